"""Domain operators and reports over the ledger views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import balances, linkage, lots, reports, rules
from ..operators.graph import snapshot
from ..operators.merge import golden_record
from ..session import table
from .base import account, line, money, query, txn


def _active(spark, sf):
    """Transactions of accounts that are not archived, with a merchant."""
    a = account(spark, sf).where("not archived").select("account_id")
    m = F.nullif(F.col("transaction_id") % 37, F.lit(0))
    return txn(spark, sf).join(a, "account_id", "left_semi").withColumn("merchant_id", m)


ACTIVE = "act AS (SELECT t.*, NULLIF(t.transaction_id % 37, 0) AS merchant_id FROM txn t JOIN account a USING (account_id) WHERE NOT a.archived)"


# ---- reports


def _cash(by: str, keys: str) -> str:
    order = ", ".join(f"{k} NULLS LAST" for k in keys.split(", "))
    return f"""WITH {ACTIVE}, x AS (SELECT strftime(transaction_date, '%Y-%m') AS month, {keys}, currency_code, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS inflow,
 sum(CASE WHEN amount < 0 THEN amount ELSE 0 END) AS outflow, sum(amount) AS net, count(*) AS txn_count FROM act GROUP BY ALL)
 SELECT month, {keys}, currency_code, CAST(inflow AS DECIMAL(18,2)) AS inflow, CAST(outflow AS DECIMAL(18,2)) AS outflow, CAST(net AS DECIMAL(18,2)) AS net, txn_count,
 row_number() OVER (PARTITION BY month, currency_code ORDER BY abs(net) DESC, {order})::BIGINT AS rank FROM x"""


@query("RPT01_cashflow", _cash("account-and-category", "account_id, category"))
def _(spark, sf):
    return reports.execute("core:cashflow", _active(spark, sf))


@query("RPT01_cashflow_by_category", _cash("category", "category"))
def _(spark, sf):
    return reports.execute("core:cashflow", _active(spark, sf), by="category")


@query("RPT02_spending_trend", f"""WITH {ACTIVE}, m AS (SELECT date_trunc('month', transaction_date)::DATE AS month, category, currency_code, sum(-amount) AS spend, count(*) AS n FROM act WHERE amount < 0 GROUP BY 1, 2, 3),
cal AS (SELECT currency_code, CAST(unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month FROM m GROUP BY 1), k AS (SELECT DISTINCT category, currency_code FROM m),
d AS (SELECT cal.month, k.category, k.currency_code, CAST(coalesce(m.spend, 0) AS DECIMAL(18,2)) AS s, coalesce(m.n, 0) AS n FROM cal JOIN k ON cal.currency_code IS NOT DISTINCT FROM k.currency_code LEFT JOIN m ON m.month = cal.month AND m.category IS NOT DISTINCT FROM k.category AND m.currency_code IS NOT DISTINCT FROM k.currency_code),
c AS (SELECT *, lag(s, 1) OVER w AS p, lag(s, 12) OVER w AS y, avg(CAST(s AS DOUBLE)) OVER (PARTITION BY category, currency_code ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS t FROM d WINDOW w AS (PARTITION BY category, currency_code ORDER BY month))
SELECT strftime(month, '%Y-%m') AS year_month, category, currency_code, s AS total_spend, n AS txn_count, p AS prev_month_spend, CAST(s - p AS DECIMAL(18,2)) AS mom_delta, CASE WHEN p > 0 THEN round(CAST(s - p AS DOUBLE) / CAST(p AS DOUBLE), 6) END AS mom_pct,
 y AS prev_year_spend, CAST(s - y AS DECIMAL(18,2)) AS yoy_delta, CASE WHEN y > 0 THEN round(CAST(s - y AS DOUBLE) / CAST(y AS DOUBLE), 6) END AS yoy_pct, round(t, 6) AS trailing_3mo_avg FROM c""")
def _(spark, sf):
    return reports.execute("core:spending", _active(spark, sf))


_SUBS = "sub AS (SELECT account_id, transaction_id % 2 AS merchant_id, currency_code, transaction_date, CAST(-20 - transaction_id % 2 AS DECIMAL(18,2)) AS amount FROM act WHERE amount < 0)"
_CAD = lambda out, other: "CASE " + " ".join(f"WHEN gap BETWEEN {a} AND {b} AND sd < {s} THEN {out(n, t)}" for n, a, b, s, t in reports.CADENCES) + f" {other} END"


@query("RPT03_recurring", f"""WITH {ACTIVE}, {_SUBS}, w AS (SELECT *, round(amount, 0)::DECIMAL(18,0) AS amount_bucket, (transaction_date - lag(transaction_date) OVER (PARTITION BY account_id, merchant_id, round(amount, 0), currency_code ORDER BY transaction_date))::DOUBLE AS g FROM sub WHERE transaction_date >= (DATE '2000-06-30' - INTERVAL 18 MONTH)::DATE),
x AS (SELECT account_id, merchant_id, amount_bucket, currency_code, avg(abs(CAST(amount AS DOUBLE))) AS avg_amount, avg(g) AS gap, stddev_samp(g) AS sd, count(*) AS occurrences, min(transaction_date) AS first_seen, max(transaction_date) AS last_seen FROM w GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)
SELECT account_id, merchant_id, amount_bucket, currency_code, round(avg_amount, 2) AS avg_amount, {_CAD(lambda n, t: f"'{n}'", "ELSE 'irregular'")} AS cadence, round(gap, 4) AS interval_days_avg, occurrences, first_seen, last_seen,
 CASE WHEN DATE '2000-06-30' - last_seen <= greatest(60, gap * 2) THEN 'active' ELSE 'inactive' END AS status, round({_CAD(lambda n, t: f'avg_amount * {t}', 'WHEN gap > 0 THEN avg_amount * (365.25 / gap)')}, 2) AS annualized_cost,
 round(least(1.0, occurrences / 6.0) * greatest(0.0, 1.0 - least(1.0, coalesce(sd, 14.0) / 14.0)), 4) AS confidence FROM x""")
def _(spark, sf):
    k = F.col("transaction_id") % 2
    sub = _active(spark, sf).where("amount < 0").select("account_id", k.alias("merchant_id"), "currency_code", "transaction_date", (-20 - k).cast("decimal(18,2)").alias("amount"))
    return reports.execute("core:recurring", sub, as_of="2000-06-30")


@query("RPT04_merchants", f"""WITH {ACTIVE}, c AS (SELECT merchant_id, currency_code, category, count(*) AS n FROM act WHERE category IS NOT NULL GROUP BY ALL), md AS (SELECT merchant_id, currency_code, arg_min(category, (-n, category)) AS top_category FROM c GROUP BY 1, 2),
b AS (SELECT merchant_id, currency_code, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS sp, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS inf, count(*) AS txn_count, round(avg(CAST(amount AS DOUBLE)), 6) AS avg_amount, round(median(CAST(amount AS DOUBLE)), 6) AS median_amount, min(transaction_date) AS first_seen, max(transaction_date) AS last_seen, count(DISTINCT date_trunc('month', transaction_date)) AS active_months, count(DISTINCT account_id) AS account_count FROM act GROUP BY 1, 2)
SELECT b.merchant_id, b.currency_code, CAST(sp AS DECIMAL(18,2)) AS total_spend, CAST(inf AS DECIMAL(18,2)) AS total_inflow, txn_count, avg_amount, median_amount, first_seen, last_seen, active_months, account_count, top_category, row_number() OVER (PARTITION BY b.currency_code ORDER BY sp DESC, b.merchant_id NULLS LAST)::BIGINT AS rank
FROM b LEFT JOIN md ON b.merchant_id IS NOT DISTINCT FROM md.merchant_id AND b.currency_code IS NOT DISTINCT FROM md.currency_code""")
def _(spark, sf):
    return reports.execute("core:merchants", _active(spark, sf))


@query("RPT05_large_transactions", f"""WITH {ACTIVE}, x AS (SELECT *, abs(CAST(amount AS DOUBLE)) AS size FROM act), am AS (SELECT account_id, currency_code, median(size) AS med FROM x GROUP BY 1, 2), ad AS (SELECT am.account_id, am.currency_code, med, median(abs(size - med)) AS mad FROM x JOIN am ON x.account_id = am.account_id AND x.currency_code IS NOT DISTINCT FROM am.currency_code GROUP BY 1, 2, 3),
cm AS (SELECT category, currency_code, median(size) AS med, count(*) AS n FROM x GROUP BY 1, 2), cd AS (SELECT cm.category, cm.currency_code, med, n, median(abs(size - med)) AS mad FROM x JOIN cm ON x.category = cm.category AND x.currency_code IS NOT DISTINCT FROM cm.currency_code GROUP BY 1, 2, 3, 4)
SELECT x.transaction_id, CASE WHEN ad.mad > 0 THEN round((size - ad.med) / (1.4826 * ad.mad), 4) END AS amount_zscore_account, CASE WHEN cd.n >= 5 AND cd.mad > 0 THEN round((size - cd.med) / (1.4826 * cd.mad), 4) END AS amount_zscore_category,
 row_number() OVER (PARTITION BY x.currency_code ORDER BY abs(amount) DESC, x.transaction_id) <= 100 AS is_top
FROM x LEFT JOIN ad ON x.account_id = ad.account_id AND x.currency_code IS NOT DISTINCT FROM ad.currency_code LEFT JOIN cd ON x.category = cd.category AND x.currency_code IS NOT DISTINCT FROM cd.currency_code""")
def _(spark, sf):
    return reports.execute("core:large_transactions", _active(spark, sf))


# ---- balances: observations are purchases of users, flows are other events

_OBS = "obs AS (SELECT user_id AS account_id, CAST(ts AS DATE) AS date, CAST(value AS DECIMAL(18,2)) AS balance, CASE WHEN user_id % 7 = 0 AND event_id % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency_code, (event_id % 3)::BIGINT AS precedence FROM events WHERE event_type = 'purchase'), flow AS (SELECT user_id AS account_id, CAST(ts AS DATE) AS date, 'USD' AS currency_code, CAST(sum(CAST(CAST(value AS DECIMAL(18,2)) * 0.1 AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2)"
_DAILY = """best AS (SELECT account_id, date, max((precedence, balance, currency_code)) AS o FROM obs GROUP BY 1, 2), b2 AS (SELECT account_id, date, o[2] AS balance, o[3] AS currency_code, row_number() OVER (PARTITION BY account_id ORDER BY date) AS seg FROM best),
spine AS (SELECT account_id, CAST(unnest(generate_series(min(date)::TIMESTAMP, (SELECT max(date) FROM b2)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM b2 GROUP BY 1),
s1 AS (SELECT s.*, b.balance AS seen, b.currency_code AS sc, b.seg IS NOT NULL AS observed, (SELECT count(*) FROM b2 x WHERE x.account_id = s.account_id AND x.date < s.date) AS seg FROM spine s LEFT JOIN b2 b USING (account_id, date)),
s2 AS (SELECT s1.*, p.balance AS base, p.currency_code AS pc, f.amount AS flow FROM s1 LEFT JOIN b2 p ON p.account_id = s1.account_id AND p.seg = s1.seg LEFT JOIN flow f ON f.account_id = s1.account_id AND f.date = s1.date AND f.currency_code IS NOT DISTINCT FROM p.currency_code AND p.balance IS NOT NULL),
s3 AS (SELECT *, base + sum(coalesce(flow, 0)) OVER (PARTITION BY account_id, seg ORDER BY date ROWS UNBOUNDED PRECEDING) AS carried FROM s2),
daily AS (SELECT account_id, date, CAST(coalesce(seen, carried) AS DECIMAL(18,2)) AS balance, CASE WHEN observed THEN sc ELSE pc END AS currency_code, observed, CASE WHEN observed AND base IS NOT NULL AND pc IS NOT DISTINCT FROM sc THEN CAST(seen - carried AS DECIMAL(18,2)) END AS delta FROM s3)"""


def _observed(spark, sf):
    e = table(spark, sf, "events")
    cur = F.when((F.col("user_id") % 7 == 0) & (F.col("event_id") % 2 == 0), "EUR").otherwise("USD")
    obs = e.where("event_type = 'purchase'").select(F.col("user_id").alias("account_id"), F.to_date("ts").alias("date"), money("value").alias("balance"), cur.alias("currency_code"), (F.col("event_id") % 3).alias("precedence"))
    flow = e.where("event_type <> 'purchase'").select(F.col("user_id").alias("account_id"), F.to_date("ts").alias("date"), money(money("value") * F.lit("0.1").cast("decimal(2,1)")).alias("amount"), F.lit("USD").alias("currency_code"))
    return obs, flow


@query("DOM22_observations", f"WITH {_OBS} SELECT * FROM obs UNION ALL SELECT account_id, DATE '2024-02-01', CASE WHEN institution_id % 2 = 0 THEN -balance ELSE balance END, currency_code, 1 FROM account")
def _(spark, sf):
    a = account(spark, sf)
    signed = F.when(F.col("institution_id") % 2 == 0, -F.col("balance")).otherwise(F.col("balance"))
    b = a.select("account_id", F.lit("2024-02-01").cast("date").alias("date"), money(signed).alias("balance"), "currency_code", F.lit(1).cast("long").alias("precedence"))
    return _observed(spark, sf)[0].unionByName(b)


@query("DOM23_daily_balances", f"WITH {_OBS}, {_DAILY} SELECT * FROM daily")
def _(spark, sf):
    return balances.daily_balances(*_observed(spark, sf))


@query("DOM24_drift_status", f"WITH {_OBS}, {_DAILY} SELECT account_id, date, CASE WHEN delta IS NULL THEN 'no-data' WHEN abs(delta) < 1 THEN 'clean' WHEN abs(delta) < 10 THEN 'warning' ELSE 'drift' END AS status FROM daily WHERE observed")
def _(spark, sf):
    d = balances.daily_balances(*_observed(spark, sf)).where("observed")
    return d.select("account_id", "date", balances.drift_status(F.col("delta")).alias("status"))


_ASSERT = "asserted AS (SELECT account_id, max(date) AS assertion_date, CAST(arg_max(balance, (date, precedence, balance)) + 5 AS DECIMAL(18,2)) AS balance, 'USD' AS currency_code FROM obs GROUP BY 1)"


@query("RPT06_balance_drift", f"WITH {_OBS}, {_DAILY}, {_ASSERT} SELECT a.account_id, a.assertion_date, a.balance AS asserted, d.balance AS computed, CAST(a.balance - d.balance AS DECIMAL(18,2)) AS drift, (DATE '2024-06-30' - a.assertion_date)::BIGINT AS days, CASE WHEN d.balance IS NULL THEN 'no-data' WHEN a.currency_code IS DISTINCT FROM d.currency_code THEN 'currency-mismatch' WHEN abs(a.balance - d.balance) < 1 THEN 'clean' WHEN abs(a.balance - d.balance) < 10 THEN 'warning' ELSE 'drift' END AS status FROM asserted a LEFT JOIN daily d ON d.account_id = a.account_id AND d.date = a.assertion_date")
def _(spark, sf):
    obs, flow = _observed(spark, sf)
    a = obs.groupBy("account_id").agg(F.max("date").alias("assertion_date"), money(F.max_by("balance", F.struct("date", "precedence", "balance")) + 5).alias("balance")).withColumn("currency_code", F.lit("USD"))
    return reports.execute("core:balance_drift", a, balances.daily_balances(obs, flow), as_of="2024-06-30")


@query("RPT07_networth", f"WITH {_OBS}, {_DAILY} SELECT currency_code, date AS balance_date, CAST(sum(CASE WHEN balance > 0 THEN balance ELSE 0 END) AS DECIMAL(18,2)) AS assets, CAST(sum(CASE WHEN balance < 0 THEN balance ELSE 0 END) AS DECIMAL(18,2)) AS liabilities, CAST(sum(balance) AS DECIMAL(18,2)) AS net_worth, count(DISTINCT account_id) AS accounts FROM daily WHERE date = (SELECT max(date) FROM daily WHERE date <= DATE '2024-01-20') GROUP BY 1, 2")
def _(spark, sf):
    return reports.execute("core:networth", balances.daily_balances(*_observed(spark, sf)), as_of="2024-01-20")


@query("RPT08_networth_history", f"WITH {_OBS}, {_DAILY}, d AS (SELECT date, currency_code, sum(balance) AS net FROM daily GROUP BY 1, 2), p AS (SELECT date_trunc('week', date)::DATE AS period, currency_code, arg_max(net, date) AS net FROM d GROUP BY 1, 2) SELECT period, currency_code, CAST(net AS DECIMAL(18,2)) AS net_worth, CAST(net - lag(net) OVER (PARTITION BY currency_code ORDER BY period) AS DECIMAL(18,2)) AS change FROM p")
def _(spark, sf):
    return reports.execute("core:networth_history", balances.daily_balances(*_observed(spark, sf)), interval="week")


@query("DOM42_running_balance", "WITH x AS (SELECT o_custkey % 50 AS file, o_orderkey AS row, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders), y AS (SELECT *, sum(CASE WHEN file % 3 = 0 THEN -amount WHEN file % 3 = 1 THEN amount ELSE amount * (row % 2) END) OVER (PARTITION BY file ORDER BY row ROWS UNBOUNDED PRECEDING) AS balance FROM x), z AS (SELECT *, balance - lag(balance) OVER (PARTITION BY file ORDER BY row) AS step FROM y), s AS (SELECT file, avg(CASE WHEN abs(step - amount) <= 0.01 THEN 1.0 ELSE 0.0 END) AS m, avg(CASE WHEN abs(step + amount) <= 0.01 THEN 1.0 ELSE 0.0 END) AS i FROM z WHERE step IS NOT NULL GROUP BY 1) SELECT file, CASE WHEN m >= 0.9 THEN 'valid' WHEN i >= 0.9 THEN 'inverted' ELSE 'invalid' END AS verdict FROM s")
def _(spark, sf):
    x = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("file"), F.col("o_orderkey").alias("row"), money("o_totalprice").alias("amount"))
    k = F.col("file") % 3
    part = F.when(k == 0, -F.col("amount")).when(k == 1, F.col("amount")).otherwise(F.col("amount") * (F.col("row") % 2))
    x = x.withColumn("balance", F.sum(part).over(W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, 0)))
    return balances.running_balance_check(x).select("file", "verdict")


# ---- services


@query("SVC01_spending_summary", "SELECT strftime(transaction_date, '%Y-%m') AS month, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS income, CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DECIMAL(18,2)) AS expenses, CAST(sum(amount) AS DECIMAL(18,2)) AS net, count(*) AS n FROM txn WHERE transaction_date >= DATE '1996-01-01' AND transaction_date <= DATE '1996-12-31' GROUP BY 1")
def _(spark, sf):
    return reports.spending_summary(txn(spark, sf), "1996-01-01", "1996-12-31")


@query("SVC02_by_category", "WITH s AS (SELECT category, sum(-amount) AS s, count(*) AS n FROM txn WHERE amount < 0 GROUP BY 1) SELECT category, CAST(s AS DECIMAL(18,2)) AS spent, n, round(CAST(s AS DOUBLE) * 100 / CAST(sum(s) OVER () AS DOUBLE), 1) AS pct FROM s ORDER BY s DESC, category NULLS LAST LIMIT 4")
def _(spark, sf):
    return reports.by_category(txn(spark, sf), 4)


@query("SVC03_budgets", "WITH b AS (SELECT DISTINCT category, CAST(2500000 AS DECIMAL(18,2)) AS budget FROM txn WHERE category IS NOT NULL), s AS (SELECT category, sum(-amount) AS spent FROM txn WHERE amount < 0 AND strftime(transaction_date, '%Y-%m') = '1997-03' GROUP BY 1) SELECT b.category, CAST(coalesce(spent, 0) AS DECIMAL(18,2)) AS spent, CASE WHEN coalesce(spent, 0) > budget THEN 'OVER' WHEN coalesce(spent, 0) > budget * 0.8 THEN 'WARNING' ELSE 'OK' END AS state FROM b LEFT JOIN s USING (category)")
def _(spark, sf):
    t = txn(spark, sf)
    b = t.where("category is not null").select("category").distinct().withColumn("budget", F.lit(2500000).cast("decimal(18,2)"))
    return reports.budget_status(b, t.where(F.date_format("transaction_date", "yyyy-MM") == "1997-03"))


@query("SVC04_search", "SELECT transaction_id, transaction_date, amount FROM txn WHERE amount <= -100000 AND category = '1-URGENT' AND priority ILIKE '%urg%' ORDER BY transaction_date DESC, transaction_id LIMIT 30")
def _(spark, sf):
    from .relational import page, search

    return page(search(txn(spark, sf), categories=["1-URGENT"], high=-100000, text="URG", columns=("priority",)), size=30).select("transaction_id", "transaction_date", "amount")


@query("SVC05_current_balances", f"WITH {_OBS}, {_DAILY} SELECT account_id, arg_max(balance, date) AS balance, max(date) AS date FROM daily GROUP BY 1")
def _(spark, sf):
    return balances.daily_balances(*_observed(spark, sf)).groupBy("account_id").agg(F.max_by("balance", "date").alias("balance"), F.max("date").alias("date"))


# ---- linkage: source b shows every fifth order again, days later, under another text

_ROWS = """rws AS (SELECT 'a' || transaction_id AS id, 'ofx' AS source, 'bank' AS origin, 'f' || (transaction_id % 4) AS file, account_id, amount, transaction_date AS date, currency_code, 'POS ' || priority || ' STORE ' || (transaction_id % 97) AS description FROM txn WHERE transaction_id % 5 < 3
UNION ALL SELECT 'b' || transaction_id, 'plaid', 'bank', 'p', account_id, amount, (transaction_date + (transaction_id % 4)::INT)::DATE, CASE WHEN transaction_id % 2 = 0 THEN currency_code END, CASE transaction_id % 3 WHEN 0 THEN priority || ' store ' || (transaction_id % 97) WHEN 1 THEN 'POS ' || priority || ' STORE' ELSE 'Misc' END FROM txn WHERE transaction_id % 5 = 0)"""
_CANON = lambda c: f"trim(regexp_replace(regexp_replace(upper(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), '\\s+', ' ', 'g'))"
_PAIRS = f"cand AS (SELECT a.id AS a, b.id AS b, abs(a.date - b.date) AS days, jaro_winkler_similarity({_CANON('a.description')}, {_CANON('b.description')}) AS sim FROM rws a JOIN rws b ON a.account_id = b.account_id AND a.amount = b.amount AND abs(a.date - b.date) <= 3 AND (a.source, a.id) < (b.source, b.id) AND (a.currency_code IS NULL OR b.currency_code IS NULL OR a.currency_code = b.currency_code) WHERE a.source <> b.source OR a.file <> b.file)"


def _rows(spark, sf):
    t = txn(spark, sf)
    i = F.col("transaction_id")
    t = t.where(i % 5 < 3).withColumn("again", F.explode(F.when(i % 5 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    form = lambda once, again: F.when(F.col("again"), again).otherwise(once)
    store = F.concat(F.col("priority"), F.lit(" STORE "), (i % 97).cast("string"))
    text = F.when(i % 3 == 0, F.concat(F.col("priority"), F.lit(" store "), (i % 97).cast("string"))).when(i % 3 == 1, F.concat(F.lit("POS "), F.col("priority"), F.lit(" STORE"))).otherwise("Misc")
    return t.select(
        F.concat(form(F.lit("a"), F.lit("b")), i.cast("string")).alias("id"), form(F.lit("ofx"), F.lit("plaid")).alias("source"), F.lit("bank").alias("origin"),
        form(F.concat(F.lit("f"), (i % 4).cast("string")), F.lit("p")).alias("file"), "account_id", "amount",
        form(F.col("transaction_date"), F.date_add("transaction_date", (i % 4).cast("int"))).alias("date"),
        form(F.col("currency_code"), F.when(i % 2 == 0, F.col("currency_code"))).alias("currency_code"), form(F.concat(F.lit("POS "), store), text).alias("description"),
    )


@query("DOM01_agreement", f"WITH p(a, b) AS (VALUES ('STARBUCKS #1234', 'starbucks 1234'), ('ARCO', 'MARCOS PIZZA'), ('SHELL', 'SHELLYS CAFE'), ('POS 1234', 'POS 1234 X'), ('BLUE BOTTLE COF', 'BLUE BOTTLE COFFEE SF'), ('CARD SHELL', 'CARD SHELLYS CAFE')) SELECT a, b, a LIKE 'STAR%' OR a LIKE 'BLUE%' AS agree FROM p")
def _(spark, sf):
    p = spark.createDataFrame([("STARBUCKS #1234", "starbucks 1234"), ("ARCO", "MARCOS PIZZA"), ("SHELL", "SHELLYS CAFE"), ("POS 1234", "POS 1234 X"), ("BLUE BOTTLE COF", "BLUE BOTTLE COFFEE SF"), ("CARD SHELL", "CARD SHELLYS CAFE")], "a string, b string")
    return p.select("a", "b", linkage.agree(F.col("a"), F.col("b"), F.lit(False)).alias("agree"))


@query("DOM02_confidence", f"WITH {_ROWS}, {_PAIRS} SELECT a, b, round(0.30 * greatest(0.0, 1 - days / 3.0) + 0.70 * sim, 4) AS confidence FROM cand")
def _(spark, sf):
    c = linkage.candidates(_rows(spark, sf))
    return c.select("a", "b", F.round(linkage.dedup_confidence(F.col("days"), F.col("similarity")), 4).alias("confidence"))


@query("DOM03_candidates", f"WITH {_ROWS}, {_PAIRS} SELECT a, b, CASE WHEN left(a, 1) = left(b, 1) THEN '2b' ELSE '3' END AS tier, days::BIGINT AS days FROM cand")
def _(spark, sf):
    return linkage.candidates(_rows(spark, sf)).select("a", "b", "tier", F.col("days").cast("long").alias("days"))


@query("DOM04_classify")
def _(spark, sf):
    return linkage.classify(linkage.candidates(_rows(spark, sf))).select("a", "b", "tier", "confidence", "status")


@query("DOM05_assignment")
def _(spark, sf):
    return linkage.assign(linkage.classify(linkage.candidates(_rows(spark, sf))).where("status = 'accepted'"))


@query("DOM06_gold_groups")
def _(spark, sf):
    rows = snapshot(_rows(spark, sf))
    taken = linkage.assign(linkage.score(rows).where("status = 'accepted'"))
    return linkage.gold_groups(rows, taken)


_LEGS = "legs AS (SELECT transaction_id AS id, account_id, CAST(round(amount / 5000) * 5000 AS DECIMAL(18,2)) AS amount, transaction_date AS date, CASE transaction_id % 4 WHEN 0 THEN 'ONLINE TRANSFER TO SAV' WHEN 1 THEN 'ACH WIRE AUTOPAY' ELSE 'COFFEE' END AS description FROM txn WHERE transaction_id % 3 = 0)"
_KW = "|".join(rf"\b{p}\b" for p in sorted(linkage.TRANSFER_PHRASES, key=len, reverse=True))
_TRANSFERS = f"tp AS (SELECT a.id AS debit, b.id AS credit, abs(a.amount) AS amount, abs(a.date - b.date)::BIGINT AS days, len(regexp_extract_all(upper(a.description || ' ' || b.description), '{_KW}')) AS k FROM legs a JOIN legs b ON a.amount < 0 AND b.amount > 0 AND -a.amount = b.amount AND a.account_id <> b.account_id AND abs(a.date - b.date) <= 3), ts AS (SELECT *, round(0.6 * greatest(0.0, 1 - days / 3.0) + 0.4 * CASE WHEN k >= 3 THEN 1.0 WHEN k = 2 THEN 0.8 WHEN k = 1 THEN 0.5 ELSE 0.0 END, 4) AS score FROM tp)"


def _legs(spark, sf):
    i = F.col("transaction_id")
    d = F.when(i % 4 == 0, "ONLINE TRANSFER TO SAV").when(i % 4 == 1, "ACH WIRE AUTOPAY").otherwise("COFFEE")
    return txn(spark, sf).where(i % 3 == 0).select(i.alias("id"), "account_id", money(F.round(F.col("amount") / 5000, 0) * 5000).alias("amount"), F.col("transaction_date").alias("date"), d.alias("description"))


@query("DOM08_transfer_scores", f"WITH {_LEGS}, {_TRANSFERS} SELECT debit, credit, amount, days, score FROM ts WHERE score >= 0.55")
def _(spark, sf):
    return linkage.transfer_pairs(_legs(spark, sf)).select("debit", "credit", "amount", "days", "score")


@query("DOM07_transfer_assignment")
def _(spark, sf):
    return linkage.claim(linkage.transfer_pairs(_legs(spark, sf))).select("debit", "credit", "amount", "days", "score")


@query("DOM09_transfer_retirement")
def _(spark, sf):
    pairs = linkage.claim(linkage.transfer_pairs(_legs(spark, sf))).withColumn("decided_at", F.col("debit"))
    groups = _legs(spark, sf).select("id", (F.floor(F.col("id") / 30) * 30).cast("long").alias("anchor"))
    return linkage.retire_transfers(pairs, groups)


@query("DOM10_golden_merge", "SELECT account_id, arg_min(category, (CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, transaction_id)) AS category, arg_min(currency_code, transaction_id) AS currency_code, min(transaction_date) AS transaction_date, bool_or(status = 'P') AS pending FROM txn GROUP BY 1")
def _(spark, sf):
    rank = F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(2)
    t = txn(spark, sf).withColumn("pending", F.col("status") == "P")
    return golden_record(t, ["account_id"], {"category": F.struct(rank, "transaction_id"), "currency_code": F.col("transaction_id")}, first=["transaction_date"], any_of=["pending"])


@query("DOM11_transfer_bridge", f"WITH {_LEGS}, {_TRANSFERS} SELECT debit, credit, d.account_id AS from_account, c.account_id AS to_account, (c.date - d.date)::BIGINT AS offset_days FROM ts JOIN legs d ON d.id = debit JOIN legs c ON c.id = credit WHERE score >= 0.8")
def _(spark, sf):
    legs = _legs(spark, sf)
    p = linkage.transfer_pairs(legs, least=0.8).select("debit", "credit")
    d, c = (legs.select(F.col("id").alias(n), F.col("account_id").alias(f"{n}_account"), F.col("date").alias(f"{n}_date")) for n in ("debit", "credit"))
    return p.join(d, "debit").join(c, "credit").select("debit", "credit", F.col("debit_account").alias("from_account"), F.col("credit_account").alias("to_account"), F.datediff("credit_date", "debit_date").cast("long").alias("offset_days"))


@query("DOM12_account_golden", "SELECT a.account_id, coalesce(CASE WHEN a.archived THEN NULL ELSE a.account_name END, 'Account ' || a.account_id::VARCHAR) AS display_name, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS institution_slug, max(t.transaction_date) AS last_activity FROM account a JOIN nation ON n_nationkey = institution_id LEFT JOIN txn t USING (account_id) GROUP BY 1, 2, 3")
def _(spark, sf):
    a = account(spark, sf).join(table(spark, sf, "nation"), F.col("institution_id") == F.col("n_nationkey"))
    last = txn(spark, sf).groupBy("account_id").agg(F.max("transaction_date").alias("last_activity"))
    return a.join(last, "account_id", "left").select("account_id", F.coalesce(F.when(~F.col("archived"), F.col("account_name")), F.concat(F.lit("Account "), F.col("account_id").cast("string"))).alias("display_name"), T.alias_key(F.col("n_name")).alias("institution_slug"), "last_activity")


@query("DOM14_ledger_overlap", "WITH x AS (SELECT account_id % 40 AS l, transaction_date, amount, transaction_id FROM txn WHERE transaction_id % 2 = 0), y AS (SELECT account_id % 40 AS l, transaction_date, transaction_id FROM txn WHERE transaction_id % 2 = 1) SELECT x.l, count(DISTINCT x.transaction_id) AS covered FROM x JOIN y ON x.l = y.l AND abs(x.transaction_date - y.transaction_date) <= 3 GROUP BY 1")
def _(spark, sf):
    from .relational import band_pairs

    t = txn(spark, sf).select((F.col("account_id") % 40).alias("l"), "transaction_date", "transaction_id")
    p = band_pairs(t.where("transaction_id % 2 = 0"), t.where("transaction_id % 2 = 1"), ["l"], "transaction_date", 3)
    return p.groupBy("l").agg(F.countDistinct("transaction_id").alias("covered"))


# ---- categorisation over part names

_RULES = [("r1", "contains", "red", None, 1200.0, "warm", 1, 1), ("r2", "regex", "^(blue|navy)", None, None, "cool", 2, 1), ("r3", "contains", "e", 1500.0, None, "other", 3, 1), ("r4", "exact", "nothing", None, None, "none", 0, 1)]


@query("DOM17_rules", "WITH x AS (SELECT p_partkey AS id, lower(p_name) AS n, CAST(p_retailprice AS DECIMAL(18,2)) AS amount FROM part) SELECT id, CASE WHEN contains(n, 'red') AND amount <= 1200 THEN 'r1' WHEN regexp_matches(n, '^(blue|navy)') THEN 'r2' ELSE 'r3' END AS rule_id, CASE WHEN contains(n, 'red') AND amount <= 1200 THEN 'warm' WHEN regexp_matches(n, '^(blue|navy)') THEN 'cool' ELSE 'other' END AS category FROM x WHERE (contains(n, 'red') AND amount <= 1200) OR regexp_matches(n, '^(blue|navy)') OR (contains(n, 'e') AND amount >= 1500)")
def _(spark, sf):
    r = spark.createDataFrame([(*x[:7], None, x[7]) for x in _RULES], "rule_id string, shape string, pattern string, low double, high double, category string, priority int, only_account long, created_at int")
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("description"), money("p_retailprice").alias("amount"), F.lit(1).cast("long").alias("account_id"))
    return rules.match_rules(x, r)


@query("DOM15_merchants", "SELECT p_partkey AS id, CASE WHEN lower(trim(p_name)) IN (SELECT lower(trim(p_name)) FROM part WHERE p_partkey <= 3) THEN 'm0' WHEN contains(lower(p_name), 'green') THEN 'm1' ELSE 'm2' END AS merchant_id FROM part WHERE lower(trim(p_name)) IN (SELECT lower(trim(p_name)) FROM part WHERE p_partkey <= 3) OR contains(lower(p_name), 'green') OR regexp_matches(lower(p_name), 'bl(ue|ack)')")
def _(spark, sf):
    p = table(spark, sf, "part")
    names = p.where("p_partkey <= 3").agg(F.collect_list(F.trim("p_name")).alias("exemplars")).select(F.lit("m0").alias("merchant_id"), F.lit(None).cast("string").alias("shape"), F.lit(None).cast("string").alias("pattern"), "exemplars", F.lit(1).alias("created_at"))
    m = spark.createDataFrame([("m1", "contains", "green", [], 2), ("m2", "regex", "bl(ue|ack)", [], 3)], "merchant_id string, shape string, pattern string, exemplars array<string>, created_at int").unionByName(names)
    return rules.match_merchants(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("description")), m)


@query("DOM18_provider_bridge", "WITH b(code, category) AS (VALUES ('1-URGENT#F', 'fast-final'), ('1-URGENT', 'fast'), ('5-LOW', 'slow')), x AS (SELECT transaction_id AS id, priority || '#' || status AS detailed, priority AS prim, (transaction_id % 100) / 100.0 AS confidence FROM txn) SELECT id, coalesce(d.category, p.category) AS category FROM x LEFT JOIN b d ON d.code = x.detailed LEFT JOIN b p ON p.code = x.prim WHERE confidence >= 0.70 AND coalesce(d.category, p.category) IS NOT NULL")
def _(spark, sf):
    b = spark.createDataFrame([("1-URGENT#F", "fast-final"), ("1-URGENT", "fast"), ("5-LOW", "slow")], "code string, category string")
    x = txn(spark, sf).select(F.col("transaction_id").alias("id"), F.concat("priority", F.lit("#"), "status").alias("detailed"), F.col("priority").alias("primary"), ((F.col("transaction_id") % 100) / 100.0).alias("confidence"))
    return rules.provider_bridge(x, b)


@query("DOM19_cascade", "SELECT transaction_id AS id, CASE WHEN transaction_id % 3 = 0 THEN 'R' WHEN transaction_id % 5 = 0 THEN 'M' ELSE 'P' END AS category, CASE WHEN transaction_id % 3 = 0 THEN 'rule' WHEN transaction_id % 5 = 0 THEN 'merchant' ELSE 'provider_native' END AS categorized_by FROM txn WHERE transaction_id % 3 = 0 OR transaction_id % 5 = 0 OR transaction_id % 7 = 0")
def _(spark, sf):
    t = txn(spark, sf).select(F.col("transaction_id").alias("id"))
    step = lambda k, c: t.where(F.col("id") % k == 0).withColumn("category", F.lit(c))
    return rules.cascade(("rule", step(3, "R")), ("merchant", step(5, "M")), ("provider_native", step(7, "P")))


@query("SNK08_guarded_upsert", "SELECT transaction_id AS id, CASE WHEN transaction_id % 2 = 0 THEN 'old' ELSE 'new' END AS category, CASE WHEN transaction_id % 2 = 0 THEN 'user' ELSE 'rule' END AS categorized_by FROM txn")
def _(spark, sf):
    t = txn(spark, sf).select(F.col("transaction_id").alias("id"))
    old = t.select("id", F.lit("old").alias("category"), F.when(F.col("id") % 2 == 0, "user").otherwise("ai").alias("categorized_by"))
    return rules.guarded_upsert(old, t.select("id", F.lit("new").alias("category"), F.lit("rule").alias("categorized_by")))


@query("DOM21_blast_radius", "WITH s AS (SELECT 'r' || n AS rule_id, n FROM (VALUES (1), (40)) v(n)) SELECT rule_id, (SELECT count(*) FROM part WHERE contains(lower(p_name), CASE n WHEN 1 THEN 'red' ELSE 'zzz' END)) AS matched, n::BIGINT AS n, (SELECT count(*) FROM part WHERE contains(lower(p_name), CASE n WHEN 1 THEN 'red' ELSE 'zzz' END)) >= 20 AND (SELECT count(*) FROM part WHERE contains(lower(p_name), CASE n WHEN 1 THEN 'red' ELSE 'zzz' END)) > 10 * n AS too_broad FROM s")
def _(spark, sf):
    r = spark.createDataFrame([("r1", "contains", "red"), ("r40", "contains", "zzz")], "rule_id string, shape string, pattern string")
    n = spark.createDataFrame([("r1", 1), ("r40", 40)], "rule_id string, n long")
    return rules.blast_radius(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("description")), r, n)


# ---- investments: the account is the order's customer, the security a part number


def _ledger(spark, sf, method="fifo"):
    """Events are made before they are joined, so that little is shuffled."""
    eid = F.xxhash64("transaction_id", "line_number", "part_id", "amount")
    kind = F.when(F.col("flag") == "R", "sell").otherwise("buy")
    x = line(spark, sf).select("transaction_id", (F.col("part_id") % 5).alias("security_id"), eid.alias("event_id"), F.col("ship_date").alias("date"), kind.alias("type"), "quantity", "amount")
    return x.join(txn(spark, sf).select("transaction_id", "account_id"), "transaction_id").drop("transaction_id").withColumn("method", F.lit(method))


@query("DOM30_lots_fifo")
def _(spark, sf):
    return lots.lots_and_gains(_ledger(spark, sf))


@query("DOM30_lots_hifo")
def _(spark, sf):
    return lots.lots_and_gains(_ledger(spark, sf, "hifo"))


@query("DOM33_lots_average")
def _(spark, sf):
    return lots.lots_and_gains(_ledger(spark, sf, "average"))


@query("DOM34_realized_gains")
def _(spark, sf):
    return lots.lots_and_gains(_ledger(spark, sf)).where("kind = 'gain'")


@query("DOM30_quantities", "WITH l AS (SELECT DISTINCT account_id, part_id % 5 AS security_id, line.transaction_id, line_number, part_id, line.amount, quantity, flag FROM line JOIN txn USING (transaction_id)) SELECT account_id, security_id, CAST(sum(CASE WHEN flag <> 'R' THEN quantity ELSE 0 END) AS DECIMAL(18,2)) AS bought, CAST(sum(CASE WHEN flag = 'R' THEN quantity ELSE 0 END) AS DECIMAL(18,2)) AS sold, CAST(sum(CASE WHEN flag = 'R' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS proceeds FROM l GROUP BY 1, 2")
def _(spark, sf):
    """What the lots conserve: all that was bought, sold and received."""
    x = lots.lots_and_gains(_ledger(spark, sf))
    lot, gain = F.col("kind") == "lot", F.col("kind") == "gain"
    z = F.lit(0).cast("decimal(28,10)")
    return x.groupBy("account_id", "security_id").agg(money(F.sum(F.when(lot, F.col("quantity")).otherwise(z))).alias("bought"), money(F.sum(F.when(gain, F.col("quantity")).otherwise(z))).alias("sold"), money(F.sum(F.when(gain, F.col("proceeds")).otherwise(z))).alias("proceeds"))


@query("DOM29_election", "SELECT account_id, CASE WHEN account_id % 3 = 0 THEN 'hifo' WHEN account_id % 4 = 0 AND (currency_code <> 'BUILDING' OR currency_code IS NULL) THEN 'fifo' WHEN account_id % 4 = 0 THEN 'average' ELSE 'fifo' END AS method FROM account")
def _(spark, sf):
    i = F.col("account_id")
    kind = F.when(F.col("currency_code") == "BUILDING", "etf").otherwise("stock")
    return account(spark, sf).select("account_id", lots.elected_method(F.when(i % 3 == 0, F.lit("hifo")), F.when(i % 4 == 0, F.lit("average")), kind).alias("method"))


_PRICES = "px AS (SELECT l_partkey % 200 AS security_id, CAST(l_shipdate AS DATE) AS date, CASE l_suppkey % 3 WHEN 0 THEN 'plaid' WHEN 1 THEN 'tiingo' ELSE 'trade_implied' END AS source, CAST(l_extendedprice AS DECIMAL(18,2)) AS close, 'USD' AS currency_code FROM lineitem)"
_RESOLVED = "per AS (SELECT security_id, date, source, min(close) AS lo, max(close) AS hi FROM px GROUP BY 1, 2, 3), best AS (SELECT security_id, date, arg_min(source, CASE source WHEN 'plaid' THEN 2 WHEN 'tiingo' THEN 3 ELSE 5 END) AS source, arg_min(lo, CASE source WHEN 'plaid' THEN 2 WHEN 'tiingo' THEN 3 ELSE 5 END) AS close, 'USD' AS currency_code FROM per WHERE lo = hi GROUP BY 1, 2)"


def _prices(spark, sf):
    src = F.when(F.col("l_suppkey") % 3 == 0, "plaid").when(F.col("l_suppkey") % 3 == 1, "tiingo").otherwise("trade_implied")
    return table(spark, sf, "lineitem").select((F.col("l_partkey") % 200).alias("security_id"), F.to_date("l_shipdate").alias("date"), src.alias("source"), money("l_extendedprice").alias("close"), F.lit("USD").alias("currency_code"))


@query("DOM35_price_resolution", f"WITH {_PRICES}, {_RESOLVED} SELECT * FROM best")
def _(spark, sf):
    return lots.resolve_prices(_prices(spark, sf))


@query("DOM36_valuation", f"WITH {_PRICES}, {_RESOLVED}, h AS (SELECT p_partkey % 400 AS security_id, CAST(sum(p_size) AS DECIMAL(18,2)) AS quantity FROM part GROUP BY 1), l AS (SELECT security_id, max(date) AS price_date, arg_max(close, date) AS close FROM best WHERE date <= DATE '1999-03-31' GROUP BY 1) SELECT h.security_id, h.quantity, price_date, close, CASE WHEN close IS NULL THEN 'unpriced' WHEN h.security_id % 11 = 0 AND price_date < DATE '1999-03-30' THEN 'withheld' WHEN price_date = DATE '1999-03-31' THEN 'valued' ELSE 'carried_forward' END AS status, CASE WHEN close IS NOT NULL AND NOT (h.security_id % 11 = 0 AND price_date < DATE '1999-03-30') THEN CAST(h.quantity * close AS DECIMAL(18,2)) END AS value FROM h LEFT JOIN l USING (security_id)")
def _(spark, sf):
    h = table(spark, sf, "part").groupBy((F.col("p_partkey") % 400).alias("security_id")).agg(money(F.sum("p_size")).alias("quantity"))
    s = h.where("security_id % 11 = 0").select("security_id", F.lit("1999-03-30").cast("date").alias("date"))
    return lots.value_holdings(h, lots.resolve_prices(_prices(spark, sf)), "1999-03-31", s).select("security_id", "quantity", "price_date", "close", "status", "value")


_RATES = "rates AS (SELECT DISTINCT currency_code, transaction_date AS date, CAST(1.0 + (length(currency_code) % 7) / 10.0 AS DECIMAL(18,8)) AS rate FROM txn WHERE dayofweek(transaction_date) BETWEEN 1 AND 5 AND currency_code IS NOT NULL AND currency_code <> 'HOUSEHOLD')"
_WANTED = "wanted AS (SELECT transaction_id, currency_code, transaction_date AS date, amount FROM txn WHERE currency_code IS NOT NULL), fx AS (SELECT w.*, CASE WHEN w.currency_code = 'BUILDING' THEN 1 ELSE coalesce(a.rate, b.rate) END::DECIMAL(18,8) AS rate FROM wanted w LEFT JOIN rates a ON a.currency_code = w.currency_code AND a.date = w.date LEFT JOIN rates b ON b.currency_code = w.currency_code AND b.date = (w.date - (CASE dayofweek(w.date) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END)::INT))"


def _fx(spark, sf):
    t = txn(spark, sf).where("currency_code is not null")
    r = t.where((F.weekday("transaction_date") < 5) & (F.col("currency_code") != "HOUSEHOLD")).select("currency_code", F.col("transaction_date").alias("date")).distinct()
    r = r.select("currency_code", "date", (F.lit(1) + (F.length("currency_code") % 7) / 10.0).cast("decimal(18,8)").alias("rate"), F.lit("stored").alias("source"))
    w = t.select("transaction_id", "currency_code", F.col("transaction_date").alias("date"), "amount")
    return lots.resolve_rates(w, r, "BUILDING")


@query("DOM38_fx_resolution", f"WITH {_RATES}, {_WANTED} SELECT transaction_id, rate FROM fx")
def _(spark, sf):
    return _fx(spark, sf).select("transaction_id", "rate")


@query("DOM39_apply_rate", f"WITH {_RATES}, {_WANTED} SELECT transaction_id, CAST(round(amount * rate, 2) AS DECIMAL(18,2)) AS converted FROM fx")
def _(spark, sf):
    return _fx(spark, sf).select("transaction_id", lots.convert(F.col("amount"), F.col("rate")).alias("converted"))


@query("DOM40_convert_report", f"WITH {_RATES}, {_WANTED} SELECT transaction_id, amount, FALSE AS converted, 'missing_rates' AS degraded_reason FROM fx")
def _(spark, sf):
    return lots.convert_report(_fx(spark, sf), ["amount"]).select("transaction_id", "amount", "converted", "degraded_reason")


@query("DOM37_portfolio_total", f"WITH {_RATES}, {_WANTED} SELECT CAST(sum(CAST(round(amount * rate, 2) AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM fx WHERE currency_code = 'BUILDING'")
def _(spark, sf):
    return lots.portfolio_total(_fx(spark, sf).where("currency_code = 'BUILDING'").withColumnRenamed("amount", "value"))


@query("DOM41_fx_backfill", "SELECT currency_code, least(min(transaction_date), DATE '1995-01-15') AS earliest FROM txn WHERE currency_code <> 'BUILDING' GROUP BY 1")
def _(spark, sf):
    t = txn(spark, sf).select("currency_code", F.col("transaction_date").alias("date"))
    return lots.backfill_plan(t, account(spark, sf).select("currency_code", F.lit("1995-01-15").cast("date").alias("date")), home="BUILDING")


@query("DOM44_transaction_id", "SELECT transaction_id, line_number, part_id, merchant_id, substr(sha256(ship_date::VARCHAR || '|' || flag || '|' || status || '|' || (row_number() OVER (PARTITION BY ship_date, flag, status ORDER BY transaction_id, line_number, part_id, merchant_id, amount) - 1)::VARCHAR), 1, 16) AS id FROM line")
def _(spark, sf):
    w = W.partitionBy("ship_date", "flag", "status").orderBy("transaction_id", "line_number", "part_id", "merchant_id", "amount")
    return line(spark, sf).select("transaction_id", "line_number", "part_id", "merchant_id", T.sha16(F.col("ship_date"), F.col("flag"), F.col("status"), F.row_number().over(w) - 1).alias("id"))


@query("DOM46_split_lines", "SELECT t.transaction_id, coalesce(l.amount, t.amount) AS line_amount, l.line_number FROM txn t LEFT JOIN (SELECT * FROM line WHERE flag = 'N') l USING (transaction_id)")
def _(spark, sf):
    s = line(spark, sf).where("flag = 'N'").groupBy("transaction_id").agg(F.collect_list(F.struct("line_number", F.col("amount").alias("a"))).alias("splits"))
    x = txn(spark, sf).select("transaction_id", "amount").join(s, "transaction_id", "left").select("transaction_id", "amount", F.explode_outer("splits").alias("s"))
    return x.select("transaction_id", F.coalesce("s.a", "amount").alias("line_amount"), "s.line_number")


@query("DOM47_provenance", "SELECT DISTINCT t.transaction_id, l.merchant_id FROM txn t JOIN line l ON l.transaction_id = t.transaction_id OR l.part_id = t.transaction_id")
def _(spark, sf):
    t, l = txn(spark, sf).select("transaction_id"), line(spark, sf)
    a = l.select("transaction_id", "merchant_id").join(t, "transaction_id", "left_semi")
    b = l.select(F.col("part_id").alias("transaction_id"), "merchant_id").join(t, "transaction_id", "left_semi")
    return a.union(b).distinct()


@query("DOM49_staleness", f"WITH {_PRICES}, {_RESOLVED} SELECT security_id, (DATE '2001-12-31' - max(date))::BIGINT AS days, (DATE '2001-12-31' - max(date)) > CASE WHEN security_id % 2 = 0 THEN 60 ELSE 200 END AS stale FROM best GROUP BY 1")
def _(spark, sf):
    x = lots.resolve_prices(_prices(spark, sf)).groupBy("security_id").agg(F.datediff(F.lit("2001-12-31"), F.max("date")).cast("long").alias("days"))
    return x.withColumn("stale", F.col("days") > F.when(F.col("security_id") % 2 == 0, 60).otherwise(200))
