"""Projections, filters, joins, aggregates, windows, sorts and set operations over the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import table
from .base import account, line, money, query, txn

def count_rows():
    return F.count("*").alias("n")


# ---- projections and filters


@query("PRJ01_fact_projection", """
SELECT transaction_id, account_id, transaction_date, amount, abs(amount) AS amount_abs,
  CASE WHEN amount < 0 THEN 'expense' WHEN amount > 0 THEN 'income' ELSE 'zero' END AS direction,
  CAST(year(transaction_date) AS BIGINT) AS y, CAST(month(transaction_date) AS BIGINT) AS m, CAST(day(transaction_date) AS BIGINT) AS d,
  CAST(dayofweek(transaction_date) AS BIGINT) AS dow, strftime(transaction_date, '%Y-%m') AS year_month,
  year(transaction_date)::VARCHAR || '-Q' || quarter(transaction_date)::VARCHAR AS year_quarter FROM txn""")
def _(spark, sf):
    d = F.col("transaction_date")
    return txn(spark, sf).select(
        "transaction_id", "account_id", "transaction_date", "amount", F.abs("amount").alias("amount_abs"),
        F.when(F.col("amount") < 0, "expense").when(F.col("amount") > 0, "income").otherwise("zero").alias("direction"),
        F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.dayofmonth(d).cast("long").alias("d"), (F.dayofweek(d) - 1).cast("long").alias("dow"),
        F.date_format(d, "yyyy-MM").alias("year_month"), F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")).alias("year_quarter"),
    )


@query("PRJ03_common_schema", """
SELECT 'order' AS source_type, transaction_id, transaction_date, amount, category, CAST(NULL AS BIGINT) AS merchant_id FROM txn
UNION ALL SELECT 'line', transaction_id, ship_date, amount, NULL, merchant_id FROM line""")
def _(spark, sf):
    a = txn(spark, sf).select(F.lit("order").alias("source_type"), "transaction_id", "transaction_date", "amount", "category")
    b = line(spark, sf).select(F.lit("line").alias("source_type"), "transaction_id", F.col("ship_date").alias("transaction_date"), "amount", "merchant_id")
    return a.unionByName(b, allowMissingColumns=True)


@query("PRJ04_blank_to_null", "SELECT page_id, UPPER(NULLIF(TRIM(regexp_replace(url, '[^a-z]', ' ', 'g')), '')) AS u FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.upper(F.nullif(F.trim(F.regexp_replace("url", "[^a-z]", " ")), F.lit(""))).alias("u"))


@query("PRJ05_fallback_chain", "SELECT account_id, COALESCE(CASE WHEN archived THEN account_name END, currency_code || '/' || institution_id::VARCHAR, 'Account ' || account_id::VARCHAR) AS label FROM account")
def _(spark, sf):
    return account(spark, sf).select("account_id", F.coalesce(F.when(F.col("archived"), F.col("account_name")), F.concat("currency_code", F.lit("/"), F.col("institution_id").cast("string")), F.concat(F.lit("Account "), F.col("account_id").cast("string"))).alias("label"))


def search(df, accounts=None, start=None, end=None, categories=None, low=None, high=None, text=None, columns=("category",)):
    """FLT01 and FLT02: a conjunction of whatever is given; ``text`` is looked for as it stands."""
    if accounts:
        df = df.where(F.col("account_id").isin(*accounts))
    if start:
        df = df.where(F.col("transaction_date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("transaction_date") <= F.lit(end).cast("date"))
    if categories:
        df = df.where(F.col("category").isin(*categories))
    if low is not None:
        df = df.where(F.col("amount") >= low)
    if high is not None:
        df = df.where(F.col("amount") <= high)
    if text:
        hit = F.lit(False)
        for c in columns:
            hit |= F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False))
        df = df.where(hit)
    return df


@query("FLT01_optional_filters", "SELECT transaction_id, amount FROM txn WHERE transaction_date >= DATE '1996-01-01' AND transaction_date <= DATE '1997-12-31' AND category IN ('1-URGENT','2-HIGH') AND amount >= -100000 AND amount <= 0")
def _(spark, sf):
    return search(txn(spark, sf), start="1996-01-01", end="1997-12-31", categories=["1-URGENT", "2-HIGH"], low=-100000, high=0).select("transaction_id", "amount")


@query("FLT02_substring_search", "SELECT page_id, url FROM pages WHERE url ILIKE '%?page=2&%' OR url ILIKE '%example!_com%' ESCAPE '!' OR url ILIKE '%EXAMPLE.NET%'")
def _(spark, sf):
    p = table(spark, sf, "pages")
    keep = [search(p, text=t, columns=("url",)) for t in ("?page=2&", "example_com", "EXAMPLE.NET")]
    return keep[0].union(keep[1]).union(keep[2]).select("page_id", "url").distinct()


@query("FLT03_null_safe_equality", "SELECT count(*) AS n, count(*) FILTER (a.currency_code IS NULL) AS n_null FROM account a JOIN (SELECT DISTINCT currency_code FROM txn) t ON a.currency_code IS NOT DISTINCT FROM t.currency_code")
def _(spark, sf):
    a, t = account(spark, sf), txn(spark, sf).select(F.col("currency_code").alias("cc")).distinct()
    return a.join(t, a["currency_code"].eqNullSafe(t["cc"])).agg(count_rows(), F.count_if(F.col("currency_code").isNull()).alias("n_null"))


@query("FLT04_array_membership", "WITH t AS (SELECT account_id, list(DISTINCT category) AS tags FROM txn GROUP BY account_id) SELECT account_id FROM t WHERE list_contains(tags, '1-URGENT')")
def _(spark, sf):
    return txn(spark, sf).groupBy("account_id").agg(F.collect_set("category").alias("tags")).where(F.array_contains("tags", "1-URGENT")).select("account_id")


@query("FLT05_cadence_bands", "SELECT CASE WHEN d BETWEEN 6 AND 8 THEN 'weekly' WHEN d BETWEEN 13 AND 15 THEN 'biweekly' WHEN d BETWEEN 28 AND 33 THEN 'monthly' ELSE 'irregular' END AS cadence, count(*) AS n FROM (SELECT (ship_date - transaction_date) AS d FROM line JOIN txn USING (transaction_id)) GROUP BY 1")
def _(spark, sf):
    d = F.datediff("ship_date", "transaction_date")
    x = line(spark, sf).select("transaction_id", "ship_date").join(txn(spark, sf).select("transaction_id", "transaction_date"), "transaction_id")
    band = F.when(d.between(6, 8), "weekly").when(d.between(13, 15), "biweekly").when(d.between(28, 33), "monthly").otherwise("irregular")
    return x.groupBy(band.alias("cadence")).agg(count_rows())


@query("FLT06_row_comparison", "SELECT a.account_id AS a, b.account_id AS b FROM account a JOIN account b ON a.balance = b.balance AND (a.institution_id, a.account_id) < (b.institution_id, b.account_id)")
def _(spark, sf):
    a, b = account(spark, sf).alias("a"), account(spark, sf).alias("b")
    on = (F.col("a.balance") == F.col("b.balance")) & (F.struct("a.institution_id", "a.account_id") < F.struct("b.institution_id", "b.account_id"))
    return a.join(b, on).select(F.col("a.account_id").alias("a"), F.col("b.account_id").alias("b"))


def page(df, after=None, size=50, date="transaction_date", key="transaction_id"):
    """FLT07: the next page in descending order of date, then ascending id."""
    if after is not None:
        d, i = F.lit(after[0]).cast("date"), after[1]
        df = df.where((F.col(date) < d) | (F.col(date) == d) & (F.col(key) > i))
    return df.orderBy(F.col(date).desc(), F.col(key).asc()).limit(size)


@query("FLT07_keyset_page", "SELECT transaction_id, transaction_date FROM txn WHERE transaction_date < DATE '1998-03-03' OR (transaction_date = DATE '1998-03-03' AND transaction_id > 100) ORDER BY transaction_date DESC, transaction_id LIMIT 25")
def _(spark, sf):
    return page(txn(spark, sf).select("transaction_id", "transaction_date"), ("1998-03-03", 100), 25)


@query("FLT08_having", "SELECT account_id, count(*) AS n FROM txn GROUP BY account_id HAVING count(*) >= 12 AND count(DISTINCT category) > 2")
def _(spark, sf):
    return txn(spark, sf).groupBy("account_id").agg(count_rows(), F.countDistinct("category").alias("k")).where("n >= 12 and k > 2").drop("k")


@query("FLT09_qualify", "SELECT account_id, transaction_id FROM txn QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY transaction_date DESC, transaction_id) = 1")
def _(spark, sf):
    w = W.partitionBy("account_id").orderBy(F.desc("transaction_date"), "transaction_id")
    return txn(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("account_id", "transaction_id")


# ---- joins


@query("JON01_equi_inner", "SELECT n_name, count(*) AS n FROM txn t JOIN account a USING (account_id) JOIN nation ON institution_id = n_nationkey GROUP BY n_name")
def _(spark, sf):
    x = txn(spark, sf).join(account(spark, sf).select("account_id", "institution_id"), "account_id")
    return x.join(table(spark, sf, "nation"), F.col("institution_id") == F.col("n_nationkey")).groupBy("n_name").agg(count_rows())


@query("JON02_star", "SELECT l.transaction_id, l.line_number, t.transaction_date, p.p_brand, s.s_name, n.n_name, r.r_name FROM line l LEFT JOIN txn t USING (transaction_id) LEFT JOIN part p ON p.p_partkey = l.part_id LEFT JOIN supplier s ON s.s_suppkey = l.merchant_id LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def _(spark, sf):
    x = line(spark, sf).select("transaction_id", "line_number", "part_id", "merchant_id")
    x = x.join(txn(spark, sf).select("transaction_id", "transaction_date"), "transaction_id", "left")
    x = x.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("part_id"), "left").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("merchant_id"), "left")
    x = x.join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return x.select("transaction_id", "line_number", "transaction_date", "p_brand", "s_name", "n_name", "r_name")


@query("JON03_using", "SELECT transaction_id, line_number, t.amount FROM line JOIN (SELECT transaction_id, amount FROM txn) t USING (transaction_id)")
def _(spark, sf):
    return line(spark, sf).select("transaction_id", "line_number").join(txn(spark, sf).select("transaction_id", "amount"), "transaction_id")


@query("JON04_null_safe_join", "WITH s AS (SELECT currency_code, category, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM txn GROUP BY 1, 2) SELECT t.transaction_id, s.total FROM txn t JOIN s ON t.currency_code IS NOT DISTINCT FROM s.currency_code AND t.category IS NOT DISTINCT FROM s.category")
def _(spark, sf):
    t = txn(spark, sf)
    s = t.groupBy(F.col("currency_code").alias("c"), F.col("category").alias("k")).agg(money(F.sum("amount")).alias("total"))
    return t.join(s, t["currency_code"].eqNullSafe(s["c"]) & t["category"].eqNullSafe(s["k"])).select("transaction_id", "total")


def band_pairs(a, b, keys, date, days, extra=None):
    """JON05, JON06: equal keys and dates at most ``days`` apart.  Dates are cut into bands of that
    width; each left row meets its own band and both next ones, so that the join stays an equi-join
    however many rows share the keys."""
    width = days + 1
    x = a.withColumn("_band", F.explode(F.array(*[F.floor(F.datediff(F.col(date), F.lit("1970-01-01")) / width) + k for k in (-1, 0, 1)])))
    y = b.select(*[F.col(c).alias(f"r_{c}") for c in b.columns]).withColumn("_r", F.floor(F.datediff(F.col(f"r_{date}"), F.lit("1970-01-01")) / width))
    on = (F.col("_band") == F.col("_r")) & (F.abs(F.datediff(F.col(date), F.col(f"r_{date}"))) <= days)
    for k in keys:
        on &= F.col(k) == F.col(f"r_{k}")
    if extra is not None:
        on &= extra
    return x.join(y, on).drop("_band", "_r")


@query("JON05_band_self_join", "SELECT a.transaction_id AS a, b.transaction_id AS b FROM txn a JOIN txn b ON a.account_id = b.account_id AND a.status = b.status AND abs(a.transaction_date - b.transaction_date) <= 30 AND a.transaction_id < b.transaction_id AND (a.category IS NULL OR b.category IS NULL OR a.category = b.category)")
def _(spark, sf):
    t = txn(spark, sf).select("transaction_id", "account_id", "status", "transaction_date", "category")
    c, r = F.col("category"), F.col("r_category")
    x = band_pairs(t, t, ["account_id", "status"], "transaction_date", 30, (F.col("transaction_id") < F.col("r_transaction_id")) & (c.isNull() | r.isNull() | (c == r)))
    return x.select(F.col("transaction_id").alias("a"), F.col("r_transaction_id").alias("b"))


@query("JON06_inverted_band_join", "WITH c AS (SELECT *, CAST(round(amount / 1000) AS BIGINT) AS k FROM txn) SELECT a.transaction_id AS a, b.transaction_id AS b FROM c a JOIN c b ON -a.k = b.k AND a.amount < 0 AND b.amount > 0 AND a.account_id <> b.account_id AND abs(a.transaction_date - b.transaction_date) <= 3")
def _(spark, sf):
    t = txn(spark, sf).withColumn("k", F.abs(F.round(F.col("amount") / 1000, 0)).cast("long")).select("transaction_id", "account_id", "amount", "transaction_date", "k")
    x = band_pairs(t.where("amount < 0"), t.where("amount > 0"), ["k"], "transaction_date", 3, F.col("account_id") != F.col("r_account_id"))
    return x.select(F.col("transaction_id").alias("a"), F.col("r_transaction_id").alias("b"))


@query("JON07_either_endpoint", "WITH e AS (SELECT account_id AS x, account_id + 7 AS y FROM account WHERE account_id % 5 = 0) SELECT a.account_id, e.x, e.y FROM account a JOIN e ON a.account_id = e.x OR a.account_id = e.y")
def _(spark, sf):
    a = account(spark, sf).select("account_id")
    e = a.where("account_id % 5 = 0").select(F.col("account_id").alias("x"), (F.col("account_id") + 7).alias("y"))
    return a.join(e, F.col("account_id") == F.col("x")).union(a.join(e, F.col("account_id") == F.col("y"))).distinct()


@query("JON08_closure", "WITH e AS (SELECT account_id AS u, account_id + 1 AS v FROM account WHERE account_id % 4 <> 0), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(id, reach) AS (SELECT u, u FROM b UNION SELECT r.id, b.v FROM r JOIN b ON r.reach = b.u) SELECT id, min(reach) AS comp FROM r GROUP BY id")
def _(spark, sf):
    from ..operators.graph import components

    return components(account(spark, sf).where("account_id % 4 <> 0").select(F.col("account_id").alias("u"), (F.col("account_id") + 1).alias("v")))


@query("JON09_anti", "SELECT account_id FROM account a WHERE NOT EXISTS (SELECT 1 FROM txn t WHERE t.account_id = a.account_id AND t.category = '1-URGENT')")
def _(spark, sf):
    return account(spark, sf).select("account_id").join(txn(spark, sf).where("category = '1-URGENT'").select("account_id"), "account_id", "left_anti")


@query("JON10_semi", "SELECT account_id FROM account WHERE account_id IN (SELECT account_id FROM txn WHERE amount < -300000)")
def _(spark, sf):
    return account(spark, sf).select("account_id").join(txn(spark, sf).where("amount < -300000").select("account_id"), "account_id", "left_semi")


@query("JON11_membership_flag", "SELECT transaction_id, transaction_id IN (SELECT transaction_id FROM txn ORDER BY abs(amount) DESC, transaction_id LIMIT 100) AS is_top_100 FROM txn")
def _(spark, sf):
    t = txn(spark, sf).select("transaction_id", "amount")
    top = t.orderBy(F.abs("amount").desc(), "transaction_id").limit(100).select(F.col("transaction_id").alias("k"))
    return t.join(top, F.col("transaction_id") == F.col("k"), "left").select("transaction_id", F.col("k").isNotNull().alias("is_top_100"))


@query("JON12_nested_exists", "SELECT a.account_id FROM account a WHERE EXISTS (SELECT 1 FROM txn t WHERE t.account_id = a.account_id AND t.status = 'F' AND NOT EXISTS (SELECT 1 FROM txn s WHERE s.account_id = t.account_id AND s.status = 'O' AND abs(s.transaction_date - t.transaction_date) <= 5))")
def _(spark, sf):
    t = txn(spark, sf).select("account_id", "transaction_date", "status")
    s = t.where("status = 'O'").select(F.col("account_id").alias("k"), F.col("transaction_date").alias("d"))
    kept = t.where("status = 'F'").join(s, (F.col("account_id") == F.col("k")) & (F.abs(F.datediff("d", "transaction_date")) <= 5), "left_anti")
    return account(spark, sf).select("account_id").join(kept.select("account_id"), "account_id", "left_semi")


@query("JON13_as_of", "SELECT a.account_id, arg_max(t.amount, (t.transaction_date, t.transaction_id)) AS amount FROM account a JOIN txn t ON t.account_id = a.account_id AND t.transaction_date <= DATE '1998-06-30' GROUP BY a.account_id")
def _(spark, sf):
    t = txn(spark, sf).where("transaction_date <= date'1998-06-30'")
    return t.groupBy("account_id").agg(F.max_by("amount", F.struct("transaction_date", "transaction_id")).alias("amount"))


@query("JON14_as_of_exclusion", "SELECT transaction_id FROM txn p WHERE status = 'F' AND NOT EXISTS (SELECT 1 FROM txn s WHERE s.account_id = p.account_id AND s.status = 'P' AND s.transaction_date > p.transaction_date)")
def _(spark, sf):
    t = txn(spark, sf)
    last = t.where("status = 'P'").groupBy(F.col("account_id").alias("k")).agg(F.max("transaction_date").alias("d"))
    return t.where("status = 'F'").join(last, (F.col("account_id") == F.col("k")) & (F.col("d") > F.col("transaction_date")), "left_anti").select("transaction_id")


@query("JON15_interval_validity", "WITH o AS (SELECT account_id, status, min(transaction_date) AS a, max(transaction_date) AS b FROM txn WHERE status <> 'P' GROUP BY 1, 2) SELECT t.transaction_id, o.status AS owner FROM txn t JOIN o ON t.account_id = o.account_id AND t.transaction_date >= o.a AND t.transaction_date < o.b")
def _(spark, sf):
    t = txn(spark, sf)
    o = t.where("status <> 'P'").groupBy(F.col("account_id").alias("k"), F.col("status").alias("owner")).agg(F.min("transaction_date").alias("a"), F.max("transaction_date").alias("b"))
    return t.join(o, (F.col("account_id") == F.col("k")) & (F.col("transaction_date") >= F.col("a")) & (F.col("transaction_date") < F.col("b"))).select("transaction_id", "owner")


@query("JON16_scalar_relation", "SELECT transaction_id, (transaction_date - span.a) AS days FROM txn, (SELECT min(transaction_date) AS a FROM txn) span")
def _(spark, sf):
    t = txn(spark, sf)
    span = t.agg(F.min("transaction_date").alias("a"))
    return t.crossJoin(F.broadcast(span)).select("transaction_id", F.datediff("transaction_date", "a").cast("long").alias("days"))


DENSE = "m AS (SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(transaction_date)) FROM txn)::TIMESTAMP, (SELECT date_trunc('month', max(transaction_date)) FROM txn)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month), k AS (SELECT DISTINCT category, currency_code FROM txn), f AS (SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, category, currency_code, sum(amount) AS total FROM txn GROUP BY 1, 2, 3), dense AS (SELECT m.month, k.category, k.currency_code, CAST(coalesce(f.total, 0) AS DECIMAL(18,2)) AS total FROM m CROSS JOIN k LEFT JOIN f ON f.month = m.month AND f.category IS NOT DISTINCT FROM k.category AND f.currency_code IS NOT DISTINCT FROM k.currency_code)"


def densified(t):
    """JON17: every month for every pair of category and currency that occurs, zero where nothing happened."""
    span = t.agg(F.trunc(F.min("transaction_date"), "month").alias("a"), F.trunc(F.max("transaction_date"), "month").alias("b"))
    months = span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    pairs = t.select("category", "currency_code").distinct()
    facts = t.groupBy(F.trunc("transaction_date", "month").alias("fm"), F.col("category").alias("fc"), F.col("currency_code").alias("fk")).agg(F.sum("amount").alias("s"))
    on = (F.col("month") == F.col("fm")) & F.col("category").eqNullSafe(F.col("fc")) & F.col("currency_code").eqNullSafe(F.col("fk"))
    return pairs.crossJoin(F.broadcast(months)).join(facts, on, "left").select("month", "category", "currency_code", money(F.coalesce("s", F.lit(0))).alias("total"))


@query("JON17_densify", f"WITH {DENSE} SELECT * FROM dense")
def _(spark, sf):
    return densified(txn(spark, sf))


@query("JON18_lateral_unnest", "WITH s AS (SELECT t.transaction_id, list(l.line_number ORDER BY l.line_number) FILTER (l.line_number IS NOT NULL) AS splits FROM txn t LEFT JOIN (SELECT * FROM line WHERE flag = 'R') l USING (transaction_id) GROUP BY t.transaction_id) SELECT s.transaction_id, u.x AS split FROM s LEFT JOIN LATERAL (SELECT unnest(s.splits) AS x) u ON TRUE")
def _(spark, sf):
    l = line(spark, sf).where("flag = 'R'").groupBy("transaction_id").agg(F.array_sort(F.collect_list("line_number")).alias("splits"))
    return txn(spark, sf).select("transaction_id").join(l, "transaction_id", "left").select("transaction_id", F.explode_outer("splits").alias("split"))


@query("JON19_pairwise_disagreement", "SELECT a.transaction_id, a.line_number AS a, b.line_number AS b FROM line a JOIN line b ON a.transaction_id = b.transaction_id AND a.status = b.status AND b.flag > a.flag AND a.quantity <> b.quantity")
def _(spark, sf):
    a, b = line(spark, sf).alias("a"), line(spark, sf).alias("b")
    on = (F.col("a.transaction_id") == F.col("b.transaction_id")) & (F.col("a.status") == F.col("b.status")) & (F.col("b.flag") > F.col("a.flag")) & (F.col("a.quantity") != F.col("b.quantity"))
    return a.join(b, on).select("a.transaction_id", F.col("a.line_number").alias("a"), F.col("b.line_number").alias("b"))


@query("JON20_mirrored_overlap", "WITH x AS (SELECT account_id, priority, transaction_date FROM txn), c AS (SELECT DISTINCT a.account_id AS l, b.account_id AS r, a.transaction_date FROM x a JOIN x b ON a.priority = b.priority AND a.transaction_date = b.transaction_date AND a.account_id <> b.account_id) SELECT least(l, r) AS a, greatest(l, r) AS b, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) >= 4")
def _(spark, sf):
    from ..operators.graph import overlaps

    return overlaps(txn(spark, sf).select("account_id", "priority", "transaction_date")).select("a", "b", (2 * F.col("days")).alias("n"))


@query("JON21_code_preference", "WITH b AS (SELECT 'STANDARD#1-URGENT' AS code, 'x' AS target UNION ALL SELECT '1-URGENT', 'y' UNION ALL SELECT '2-HIGH', 'z'), c AS (SELECT transaction_id, target, row_number() OVER (PARTITION BY transaction_id ORDER BY (code LIKE '%#%') DESC, code) AS rn FROM txn JOIN b ON b.code IN (CASE WHEN status = 'O' THEN 'STANDARD#' || priority END, priority)) SELECT transaction_id, target FROM c WHERE rn = 1")
def _(spark, sf):
    b = spark.createDataFrame([("STANDARD#1-URGENT", "x"), ("1-URGENT", "y"), ("2-HIGH", "z")], "code string, target string")
    codes = F.array(F.struct(F.lit(0).alias("rank"), F.when(F.col("status") == "O", F.concat(F.lit("STANDARD#"), "priority")).alias("code")), F.struct(F.lit(1).alias("rank"), F.col("priority").alias("code")))
    x = txn(spark, sf).select("transaction_id", F.explode(codes).alias("c")).select("transaction_id", "c.rank", "c.code").join(F.broadcast(b), "code")
    return x.groupBy("transaction_id").agg(F.min_by("target", "rank").alias("target"))


@query("JON22_scalar_subqueries", "SELECT (SELECT count(*) FROM txn) AS n_txn, (SELECT count(*) FROM line) AS n_line, (SELECT max(transaction_date) FROM txn) AS last_date")
def _(spark, sf):
    a = txn(spark, sf).agg(F.count("*").alias("n_txn"), F.max("transaction_date").alias("last_date"))
    return a.crossJoin(line(spark, sf).agg(F.count("*").alias("n_line")))


@query("JON23_latest_date", "SELECT transaction_id FROM txn WHERE transaction_date = (SELECT max(transaction_date) FROM txn WHERE status = 'F')")
def _(spark, sf):
    t = txn(spark, sf)
    last = t.where("status = 'F'").agg(F.max("transaction_date").alias("d"))
    return t.join(F.broadcast(last), F.col("transaction_date") == F.col("d")).select("transaction_id")


# ---- aggregates


@query("AGG01_group_by", "SELECT category, currency_code, CAST(sum(amount) AS DECIMAL(18,2)) AS total, count(*) AS n, min(amount) AS low, max(amount) AS high, round(avg(CAST(amount AS DOUBLE)), 4) AS mean FROM txn GROUP BY 1, 2")
def _(spark, sf):
    return txn(spark, sf).groupBy("category", "currency_code").agg(money(F.sum("amount")).alias("total"), count_rows(), F.min("amount").alias("low"), F.max("amount").alias("high"), F.round(F.avg(F.col("amount").cast("double")), 4).alias("mean"))


@query("AGG02_conditional_sums", "SELECT account_id, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS inflow, CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DECIMAL(18,2)) AS outflow FROM txn GROUP BY 1")
def _(spark, sf):
    a = F.col("amount")
    return txn(spark, sf).groupBy("account_id").agg(money(F.sum(F.when(a > 0, a).otherwise(0))).alias("inflow"), money(F.sum(F.when(a < 0, -a).otherwise(0))).alias("outflow"))


@query("AGG03_count_distinct", "SELECT currency_code, count(DISTINCT account_id) AS accounts, count(DISTINCT date_trunc('month', transaction_date)) AS months FROM txn GROUP BY 1")
def _(spark, sf):
    return txn(spark, sf).groupBy("currency_code").agg(F.countDistinct("account_id").alias("accounts"), F.countDistinct(F.trunc("transaction_date", "month")).alias("months"))


@query("AGG04_filter_aggregates", "SELECT account_id, count(*) FILTER (WHERE category IS NULL) AS n_null, max(transaction_date) FILTER (WHERE status = 'F') AS last_f FROM txn GROUP BY 1")
def _(spark, sf):
    return txn(spark, sf).groupBy("account_id").agg(F.count_if(F.col("category").isNull()).alias("n_null"), F.max(F.when(F.col("status") == "F", F.col("transaction_date"))).alias("last_f"))


@query("AGG05_arg_min", "SELECT account_id, arg_min(category, transaction_id) AS first_category, arg_max(category, transaction_id) AS last_category FROM txn GROUP BY 1")
def _(spark, sf):
    k = F.when(F.col("category").isNotNull(), F.col("transaction_id"))
    return txn(spark, sf).groupBy("account_id").agg(F.min_by("category", k).alias("first_category"), F.max_by("category", k).alias("last_category"))


@query("AGG06_arg_min_composite", "SELECT account_id, arg_min(transaction_id, (status, -epoch_us(transaction_date::TIMESTAMP), transaction_id)) AS pick FROM txn GROUP BY 1")
def _(spark, sf):
    return txn(spark, sf).groupBy("account_id").agg(F.min_by("transaction_id", F.struct("status", -F.unix_micros(F.col("transaction_date").cast("timestamp")), "transaction_id")).alias("pick"))


@query("AGG07_median_mad", "WITH m AS (SELECT category, median(CAST(amount AS DOUBLE)) AS med FROM txn GROUP BY 1) SELECT t.category, round(any_value(m.med), 4) AS med, round(median(abs(CAST(t.amount AS DOUBLE) - m.med)), 4) AS mad FROM txn t JOIN m ON t.category IS NOT DISTINCT FROM m.category GROUP BY 1")
def _(spark, sf):
    t = txn(spark, sf).select("category", F.col("amount").cast("double").alias("x"))
    m = t.groupBy(F.col("category").alias("k")).agg(F.median("x").alias("med"))
    x = t.join(m, F.col("category").eqNullSafe(F.col("k")))
    return x.groupBy("category").agg(F.round(F.first("med"), 4).alias("med"), F.round(F.median(F.abs(F.col("x") - F.col("med"))), 4).alias("mad"))


@query("AGG08_mode", "WITH c AS (SELECT account_id, category, count(*) AS n FROM txn WHERE category IS NOT NULL GROUP BY 1, 2) SELECT account_id, arg_min(category, (-n, category)) AS top FROM c GROUP BY 1")
def _(spark, sf):
    txn(spark, sf).createOrReplaceTempView("loom_txn")
    return spark.sql("select account_id, mode() within group (order by category) as top from loom_txn where category is not null group by account_id")


@query("AGG09_stddev", "SELECT account_id, round(stddev_samp(CAST(amount AS DOUBLE)), 4) AS sd FROM txn GROUP BY 1")
def _(spark, sf):
    return txn(spark, sf).groupBy("account_id").agg(F.round(F.stddev_samp(F.col("amount").cast("double")), 4).alias("sd"))


@query("AGG10_bool_or", "SELECT account_id, bool_or(status = 'P') AS pending FROM txn GROUP BY 1")
def _(spark, sf):
    return txn(spark, sf).groupBy("account_id").agg(F.bool_or(F.col("status") == "P").alias("pending"))


@query("AGG11_any_value", "SELECT account_id, any_value(currency_code) AS currency_code FROM txn GROUP BY 1")
def _(spark, sf):
    return txn(spark, sf).groupBy("account_id").agg(F.any_value("currency_code", True).alias("currency_code"))


@query("AGG12_last_ordered", "SELECT date_trunc('month', transaction_date)::DATE AS month, last(amount ORDER BY transaction_date, transaction_id) AS last_amount FROM txn GROUP BY 1")
def _(spark, sf):
    return txn(spark, sf).groupBy(F.trunc("transaction_date", "month").alias("month")).agg(F.max_by("amount", F.struct("transaction_date", "transaction_id")).alias("last_amount"))


@query("AGG13_ordered_list", "SELECT transaction_id, array_to_string(list(line_number::VARCHAR || ':' || flag ORDER BY line_number, flag), '|') AS parts FROM line GROUP BY 1")
def _(spark, sf):
    x = line(spark, sf).groupBy("transaction_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "flag"))).alias("s"))
    return x.select("transaction_id", F.array_join(F.transform("s", lambda e: F.concat(e["line_number"].cast("string"), F.lit(":"), e["flag"])), "|").alias("parts"))


@query("AGG14_string_agg", "SELECT account_id, string_agg(transaction_id::VARCHAR, ',' ORDER BY transaction_id) AS ids FROM txn GROUP BY 1")
def _(spark, sf):
    return txn(spark, sf).groupBy("account_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("transaction_id")), lambda v: v.cast("string")), ",").alias("ids"))


@query("AGG15_distinct_list", "SELECT account_id, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses FROM txn GROUP BY 1")
def _(spark, sf):
    return txn(spark, sf).groupBy("account_id").agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))


@query("AGG16_distinct", "SELECT DISTINCT category, currency_code, status FROM txn")
def _(spark, sf):
    return txn(spark, sf).select("category", "currency_code", "status").distinct()


@query("AGG17_group_by_expression", "SELECT year(transaction_date)::BIGINT AS y, count(*) AS n FROM txn GROUP BY 1")
def _(spark, sf):
    return txn(spark, sf).groupBy(F.year("transaction_date").cast("long").alias("y")).agg(count_rows())


@query("AGG18_golden_record", "SELECT transaction_id, arg_min(flag, (CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, line_number)) AS flag, arg_min(merchant_id, (line_number, merchant_id)) AS merchant_id, min(ship_date) AS first_date, max(ship_date) AS updated, bool_or(status = 'O') AS pending FROM line GROUP BY 1")
def _(spark, sf):
    from ..operators.merge import golden_record

    rank = F.when(F.col("flag") == "A", 0).when(F.col("flag") == "N", 1).otherwise(2)
    x = line(spark, sf).withColumn("pending", F.col("status") == "O")
    return golden_record(x, ["transaction_id"], {"flag": F.struct(rank, "line_number"), "merchant_id": F.struct("line_number", "merchant_id")}, first=["ship_date:first_date"], last=["ship_date:updated"], any_of=["pending"])


@query("AGG19_share_of_total", "WITH s AS (SELECT category, sum(-amount) AS spent FROM txn WHERE amount < 0 GROUP BY 1) SELECT category, CAST(spent AS DECIMAL(18,2)) AS spent, round(CAST(spent AS DOUBLE) * 100 / CAST(sum(spent) OVER () AS DOUBLE), 1) AS pct FROM s ORDER BY spent DESC, category LIMIT 3")
def _(spark, sf):
    s = txn(spark, sf).where("amount < 0").groupBy("category").agg(F.sum(-F.col("amount")).alias("spent"))
    s = s.withColumn("pct", F.round(F.col("spent").cast("double") * 100 / F.sum("spent").over(W.partitionBy()).cast("double"), 1))
    return s.orderBy(F.desc("spent"), "category").limit(3).select("category", money("spent").alias("spent"), "pct")


@query("AGG20_budget_status", "WITH b AS (SELECT DISTINCT category, CAST(30000000 AS DECIMAL(18,2)) AS budget FROM txn WHERE category IS NOT NULL), s AS (SELECT category, sum(-amount) AS spent FROM txn WHERE amount < 0 AND year(transaction_date) = 1997 GROUP BY 1) SELECT b.category, CAST(coalesce(s.spent, 0) AS DECIMAL(18,2)) AS spent, CASE WHEN coalesce(s.spent, 0) > budget THEN 'OVER' WHEN coalesce(s.spent, 0) > budget * 0.8 THEN 'WARNING' ELSE 'OK' END AS state FROM b LEFT JOIN s USING (category)")
def _(spark, sf):
    from ..operators.reports import budget_status

    t = txn(spark, sf)
    b = t.where("category is not null").select("category").distinct().withColumn("budget", F.lit(30000000).cast("decimal(18,2)"))
    return budget_status(b, t.where("year(transaction_date) = 1997"))


@query("AGG21_coverage", "SELECT CASE WHEN category IS NULL THEN 'none' WHEN status = 'O' THEN 'rule' ELSE 'user' END AS source, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM txn), 2) AS pct FROM txn GROUP BY 1")
def _(spark, sf):
    src = F.when(F.col("category").isNull(), "none").when(F.col("status") == "O", "rule").otherwise("user")
    g = txn(spark, sf).groupBy(src.alias("source")).agg(count_rows())
    return g.withColumn("pct", F.round(F.col("n").cast("double") * 100 / F.sum("n").over(W.partitionBy()), 2))


@query("AGG22_position_rollup", "SELECT part_id, CAST(sum(quantity) AS DECIMAL(18,2)) AS quantity, CAST(sum(amount) AS DECIMAL(18,2)) AS basis, round(CAST(sum(amount) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE), 6) AS average_cost, min(ship_date) AS earliest FROM line GROUP BY 1")
def _(spark, sf):
    x = line(spark, sf).groupBy("part_id").agg(F.sum("quantity").alias("q"), F.sum("amount").alias("b"), F.min("ship_date").alias("earliest"))
    return x.select("part_id", money("q").alias("quantity"), money("b").alias("basis"), F.round(F.col("b").cast("double") / F.col("q").cast("double"), 6).alias("average_cost"), "earliest")


@query("AGG23_explode_count", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(replace(url, '?', '/'), '/')) AS w FROM pages) GROUP BY w")
def _(spark, sf):
    return table(spark, sf, "pages").select(F.explode(F.split(F.translate("url", "?", "/"), "/")).alias("w")).groupBy("w").agg(count_rows())


@query("AGG24_latest_cumulative", "SELECT user_id, event_type, event_id, value FROM events WHERE (user_id, event_type, ts) IN (SELECT user_id, event_type, max(ts) FROM events GROUP BY 1, 2)")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.join(e.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts")), ["user_id", "event_type", "ts"], "left_semi").select("user_id", "event_type", "event_id", "value")


@query("AGG25_filter_arms", "SELECT coalesce(currency_code, '(none)') AS currency_code, count(*) AS n, count(*) FILTER (archived) AS n_archived, count(*) FILTER (NOT archived) AS n_active FROM account GROUP BY 1")
def _(spark, sf):
    return account(spark, sf).groupBy(F.coalesce("currency_code", F.lit("(none)")).alias("currency_code")).agg(count_rows(), F.count_if("archived").alias("n_archived"), F.count_if(~F.col("archived")).alias("n_active"))


# ---- windows


@query("WIN01_dedup_latest", "SELECT account_id, category, transaction_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id, category ORDER BY transaction_date DESC, transaction_id DESC) AS rn FROM txn) WHERE rn = 1")
def _(spark, sf):
    return txn(spark, sf).groupBy("account_id", "category").agg(F.max_by("transaction_id", F.struct("transaction_date", "transaction_id")).alias("transaction_id"))


@query("WIN02_total_order_anchor", "SELECT transaction_id, row_number() OVER (PARTITION BY currency_code ORDER BY status, category NULLS LAST, transaction_date, amount, account_id, transaction_id)::BIGINT AS rn FROM txn")
def _(spark, sf):
    w = W.partitionBy("currency_code").orderBy("status", F.col("category").asc_nulls_last(), "transaction_date", "amount", "account_id", "transaction_id")
    return txn(spark, sf).select("transaction_id", F.row_number().over(w).cast("long").alias("rn"))


@query("WIN03_top_n_within_currency", "SELECT currency_code, transaction_id, rn FROM (SELECT currency_code, transaction_id, row_number() OVER (PARTITION BY currency_code ORDER BY abs(amount) DESC, transaction_id)::BIGINT AS rn FROM txn) WHERE rn <= 10")
def _(spark, sf):
    w = W.partitionBy("currency_code").orderBy(F.abs("amount").desc(), "transaction_id")
    return txn(spark, sf).select("currency_code", "transaction_id", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 10").orderBy("rn", F.col("currency_code").asc_nulls_last())


@query("WIN04_window_over_aggregate", "SELECT account_id, CAST(sum(amount) AS DECIMAL(18,2)) AS net, row_number() OVER (PARTITION BY any_value(currency_code) ORDER BY abs(sum(amount)) DESC, account_id)::BIGINT AS rank FROM txn GROUP BY account_id")
def _(spark, sf):
    x = txn(spark, sf).groupBy("account_id").agg(F.sum("amount").alias("s"), F.any_value("currency_code", True).alias("c"))
    return x.select("account_id", money("s").alias("net"), F.row_number().over(W.partitionBy("c").orderBy(F.abs("s").desc(), "account_id")).cast("long").alias("rank"))


@query("WIN05_order_by_window", "SELECT account_id, n, row_number() OVER (PARTITION BY currency_code ORDER BY n DESC, account_id) AS r FROM (SELECT account_id, currency_code, count(*) AS n FROM txn GROUP BY 1, 2) ORDER BY r, currency_code NULLS LAST")
def _(spark, sf):
    x = txn(spark, sf).groupBy("account_id", "currency_code").agg(count_rows())
    x = x.withColumn("r", F.row_number().over(W.partitionBy("currency_code").orderBy(F.desc("n"), "account_id")))
    return x.orderBy("r", F.col("currency_code").asc_nulls_last()).select("account_id", "n", F.col("r").cast("long").alias("r"))


MONTHLY = "v AS (SELECT currency_code, date_trunc('month', transaction_date)::DATE AS month, sum(amount) AS total FROM txn GROUP BY 1, 2)"


def _monthly(spark, sf):
    return txn(spark, sf).groupBy("currency_code", F.trunc("transaction_date", "month").alias("month")).agg(F.sum("amount").alias("total"))


@query("WIN06_lag", f"WITH {MONTHLY} SELECT currency_code, month, CAST(total - lag(total, 1) OVER w AS DECIMAL(18,2)) AS mom, CAST(total - lag(total, 12) OVER w AS DECIMAL(18,2)) AS yoy FROM v WINDOW w AS (PARTITION BY currency_code ORDER BY month)")
def _(spark, sf):
    w = W.partitionBy("currency_code").orderBy("month")
    return _monthly(spark, sf).select("currency_code", "month", money(F.col("total") - F.lag("total", 1).over(w)).alias("mom"), money(F.col("total") - F.lag("total", 12).over(w)).alias("yoy"))


@query("WIN07_interval_days", "SELECT transaction_id, (transaction_date - lag(transaction_date) OVER (PARTITION BY account_id ORDER BY transaction_date, transaction_id))::BIGINT AS days FROM txn")
def _(spark, sf):
    w = W.partitionBy("account_id").orderBy("transaction_date", "transaction_id")
    return txn(spark, sf).select("transaction_id", F.datediff("transaction_date", F.lag("transaction_date").over(w)).cast("long").alias("days"))


@query("WIN08_moving_average", f"WITH {MONTHLY} SELECT currency_code, month, round(avg(CAST(total AS DOUBLE)) OVER (PARTITION BY currency_code ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS trailing FROM v")
def _(spark, sf):
    w = W.partitionBy("currency_code").orderBy("month").rowsBetween(-2, 0)
    return _monthly(spark, sf).select("currency_code", "month", F.round(F.avg(F.col("total").cast("double")).over(w), 2).alias("trailing"))


@query("WIN09_running_sum", "SELECT transaction_id, CAST(sum(amount) OVER (PARTITION BY account_id ORDER BY category IS NULL, transaction_date, transaction_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS running FROM txn")
def _(spark, sf):
    w = W.partitionBy("account_id").orderBy(F.col("category").isNull(), "transaction_date", "transaction_id").rowsBetween(W.unboundedPreceding, 0)
    return txn(spark, sf).select("transaction_id", money(F.sum("amount").over(w)).alias("running"))


@query("WIN10_conflict", "SELECT transaction_id, line_number, min(flag) OVER w <> max(flag) OVER w AS conflict FROM line WINDOW w AS (PARTITION BY transaction_id)")
def _(spark, sf):
    w = W.partitionBy("transaction_id")
    return line(spark, sf).select("transaction_id", "line_number", (F.min("flag").over(w) != F.max("flag").over(w)).alias("conflict"))


@query("WIN11_first_and_newest", "SELECT account_id, arg_min(transaction_id, (transaction_date, transaction_id)) AS first_id, arg_max(transaction_id, (transaction_date, transaction_id)) AS newest_id FROM txn GROUP BY 1")
def _(spark, sf):
    k = F.struct("transaction_date", "transaction_id")
    return txn(spark, sf).groupBy("account_id").agg(F.min_by("transaction_id", k).alias("first_id"), F.max_by("transaction_id", k).alias("newest_id"))


@query("WIN12_current_row", "SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("WIN13_ranked_winner", "SELECT transaction_id, line_number FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, amount DESC, line_number) AS rn FROM line) WHERE rn = 1")
def _(spark, sf):
    w = W.partitionBy("transaction_id").orderBy(F.when(F.col("flag") == "R", 0).when(F.col("flag") == "A", 1).otherwise(2), F.desc("amount"), "line_number")
    return line(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("transaction_id", "line_number")


@query("WIN14_whole_partition", "SELECT transaction_id, line_number, count(*) OVER w AS n, max(amount) OVER w AS top, row_number() OVER (PARTITION BY transaction_id ORDER BY line_number)::BIGINT AS rn FROM line WINDOW w AS (PARTITION BY transaction_id)")
def _(spark, sf):
    w = W.partitionBy("transaction_id")
    return line(spark, sf).select("transaction_id", "line_number", F.count("*").over(w).alias("n"), F.max("amount").over(w).alias("top"), F.row_number().over(w.orderBy("line_number")).cast("long").alias("rn"))


# ---- sorts, limits and sets


@query("SRT01_multi_key", "SELECT transaction_id, category FROM txn ORDER BY category DESC NULLS LAST, transaction_date, transaction_id")
def _(spark, sf):
    return txn(spark, sf).orderBy(F.col("category").desc_nulls_last(), "transaction_date", "transaction_id").select("transaction_id", "category")


@query("SRT02_limit_offset", "SELECT transaction_id FROM txn ORDER BY transaction_id LIMIT 20 OFFSET 40")
def _(spark, sf):
    return txn(spark, sf).select("transaction_id").orderBy("transaction_id").offset(40).limit(20)


@query("SRT03_truncation", "WITH c AS (SELECT transaction_id FROM txn ORDER BY transaction_id LIMIT 101) SELECT (SELECT count(*) FROM c) > 100 AS truncated")
def _(spark, sf):
    return txn(spark, sf).select("transaction_id").limit(101).agg((F.count("*") > 100).alias("truncated"))


@query("SRT04_boolean_order", "SELECT transaction_id FROM txn ORDER BY (status = 'P') DESC, transaction_id LIMIT 30")
def _(spark, sf):
    return txn(spark, sf).orderBy((F.col("status") == "P").desc(), "transaction_id").limit(30).select("transaction_id")


@query("SRT05_priority_queue", "SELECT transaction_id, CAST(abs(amount) * (DATE '2001-12-31' - transaction_date) AS DECIMAL(18,2)) AS weight FROM txn WHERE category IS NULL ORDER BY weight DESC, transaction_id")
def _(spark, sf):
    x = txn(spark, sf).where("category is null").select("transaction_id", money(F.abs("amount") * F.datediff(F.lit("2001-12-31"), "transaction_date")).alias("weight"))
    return x.orderBy(F.desc("weight"), "transaction_id")


@query("SET01_union_all", "SELECT account_id, transaction_date AS d, amount FROM txn WHERE status = 'F' UNION ALL SELECT account_id, transaction_date, amount FROM txn WHERE amount < 0 UNION ALL SELECT account_id, NULL, balance FROM account")
def _(spark, sf):
    t = txn(spark, sf).select("account_id", F.col("transaction_date").alias("d"), "amount", "status")
    a = account(spark, sf).select("account_id", F.col("balance").alias("amount"))
    return t.where("status = 'F'").drop("status").unionByName(t.where("amount < 0").drop("status")).unionByName(a, allowMissingColumns=True)


@query("SET02_union_distinct", "SELECT account_id, category FROM txn UNION SELECT account_id, currency_code FROM account")
def _(spark, sf):
    return txn(spark, sf).select("account_id", "category").union(account(spark, sf).select("account_id", "currency_code")).distinct()


@query("SET04_override_union", "WITH s AS (SELECT DISTINCT priority AS code, 'seed' AS target FROM txn), o AS (SELECT DISTINCT priority AS code, 'user' AS target FROM txn WHERE priority LIKE '1%') SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.code = s.code) UNION ALL SELECT * FROM o")
def _(spark, sf):
    s = txn(spark, sf).select(F.col("priority").alias("code")).distinct()
    o = s.where(F.col("code").startswith("1"))
    return s.join(o, "code", "left_anti").withColumn("target", F.lit("seed")).unionByName(o.withColumn("target", F.lit("user")))


@query("SET05_precision_recall", "WITH p AS (SELECT transaction_id FROM txn WHERE amount < -200000), g AS (SELECT transaction_id FROM txn WHERE status = 'F') SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM g)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g)) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)) AS fn")
def _(spark, sf):
    t = txn(spark, sf)
    p, g = t.where("amount < -200000").select("transaction_id"), t.where("status = 'F'").select("transaction_id")
    return p.intersect(g).agg(F.count("*").alias("tp")).crossJoin(p.subtract(g).agg(F.count("*").alias("fp"))).crossJoin(g.subtract(p).agg(F.count("*").alias("fn")))
