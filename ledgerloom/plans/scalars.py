"""Scalar functions (STR, NUM, DAT, ARR, JSN, CAS, CND) over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..session import table
from .base import account, line, money, query, txn


def _desc(spark, sf):
    """Descriptions as banks write them, made of the tables' own columns."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    head = F.element_at(F.array(*[F.lit(x) for x in ("SQ *", "TST* ", "PAYPAL *", "", "")]), (k % 5 + 1).cast("int"))
    tail = F.element_at(F.array(*[F.lit(x) for x in (" CA 94110", " Austin, TX", " #4821", " 90210", " zelle to Jo", "", " a@b.example.com 555-0199")]), (k % 7 + 1).cast("int"))
    return p.select("p_partkey", "p_name", F.concat(head, F.upper("p_name"), tail).alias("d"))


_D = "d AS (SELECT p_partkey, p_name, ['SQ *', 'TST* ', 'PAYPAL *', '', ''][(p_partkey % 5 + 1)::INT] || upper(p_name) || [' CA 94110', ' Austin, TX', ' #4821', ' 90210', ' zelle to Jo', '', ' a@b.example.com 555-0199'][(p_partkey % 7 + 1)::INT] AS d FROM part)"
_TL = T.TRAILING_LOCATION


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce({x}, '')), '{T.POS_PREFIX}', ''), '{_TL}', ''), '{T.TRAILING_NUMBER}', ''), '\\s+', ' ', 'g'))"


def _redact(x: str) -> str:
    x = _norm(x)
    for p, keep in T.REDACTIONS:
        x = f"regexp_replace({x}, '{p}', '{keep.replace('$1', chr(92) + '1')}', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("STR01_basics", "SELECT account_id, upper(account_name) AS u, lower(account_name) AS l, length(trim(account_name))::BIGINT AS n, left(account_name, 3) AS a, right(account_name, 4) AS z, substring(account_name, 3, 5) AS m, replace(account_name, '0', 'o') AS r, account_name || '-' || account_id::VARCHAR AS c FROM account")
def _(spark, sf):
    n = F.col("account_name")
    return account(spark, sf).select("account_id", F.upper(n).alias("u"), F.lower(n).alias("l"), F.length(F.trim(n)).cast("long").alias("n"), F.left(n, F.lit(3)).alias("a"), F.right(n, F.lit(4)).alias("z"), F.substring(n, 3, 5).alias("m"), F.replace(n, F.lit("0"), F.lit("o")).alias("r"), F.concat(n, F.lit("-"), F.col("account_id").cast("string")).alias("c"))


@query("STR02_last_index", "SELECT page_id, strpos(reverse(url), '/')::BIGINT AS k, reverse(split_part(reverse(url), '/', 1)) AS tail FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.instr(F.reverse("url"), "/").cast("long").alias("k"), F.substring_index("url", "/", -1).alias("tail"))


@query("STR03_contains_starts", "SELECT page_id, contains(url, '/en/') AS en, starts_with(url, 'https') AS secure FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.contains(F.col("url"), F.lit("/en/")).alias("en"), F.col("url").startswith("https").alias("secure"))


@query("STR04_regexp_replace_unicode", r"SELECT item_id, md5(regexp_replace(text, '[^\p{L}\p{N}]', ' ', 'g')) AS h FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.md5(F.regexp_replace("text", r"[^\p{L}\p{N}]", " ")).alias("h"))


@query("STR05_regexp_matches", r"SELECT page_id, regexp_matches(url, '\?page=\d+') AS paged FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.col("url").rlike(r"\?page=\d+").alias("paged"))


@query("STR06_split_slice_join", "SELECT page_id, array_to_string(list_slice(string_split(url, '/'), 1, len(string_split(url, '/')) - 1), '/') AS head FROM pages")
def _(spark, sf):
    a = F.split("url", "/")
    return table(spark, sf, "pages").select("page_id", F.array_join(F.slice(a, F.lit(1), F.size(a) - 1), "/").alias("head"))


@query("STR07_jaro_winkler", "SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(jaro_winkler_similarity(a.s_name || a.s_nationkey, b.s_name || b.s_nationkey), 6) AS s FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.concat("s_name", F.col("s_nationkey").cast("string")).alias("n"))
    x = s.alias("a").join(s.alias("b"), F.col("b.s_suppkey") == F.col("a.s_suppkey") + 1)
    return x.select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), F.round(T.jaro_winkler(F.col("a.n"), F.col("b.n")), 6).alias("s"))


@query("STR08_close_matches")
def _(spark, sf):
    s = table(spark, sf, "nation").select(F.upper("n_name").alias("n"))
    r = table(spark, sf, "region").select(F.upper("r_name").alias("r"))
    return s.crossJoin(F.broadcast(r)).select("n", "r", F.round(T.ratio("n", "r"), 6).alias("ratio")).where("ratio >= 0.6")


@query("STR09_normalize_description", f"WITH {_D} SELECT p_partkey, {_norm('d')} AS n FROM d")
def _(spark, sf):
    return _desc(spark, sf).select("p_partkey", T.normalize_description(F.col("d")).alias("n"))


@query("STR10_redact", f"WITH {_D} SELECT p_partkey, {_redact('d')} AS n FROM d")
def _(spark, sf):
    return _desc(spark, sf).select("p_partkey", T.redact(F.col("d")).alias("n"))


@query("STR11_match_text", f"WITH {_D} SELECT p_partkey, concat_ws(chr(10), NULLIF({_norm('d')}, ''), NULLIF({_norm('CASE WHEN p_partkey % 3 = 0 THEN p_name END')}, '')) AS m FROM d")
def _(spark, sf):
    return _desc(spark, sf).select("p_partkey", T.match_text(F.col("d"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name"))).alias("m"))


@query("STR12_alias_key", "SELECT account_id, regexp_replace(lower(account_name), '[^a-z0-9]', '', 'g') AS k FROM account")
def _(spark, sf):
    return account(spark, sf).select("account_id", T.alias_key(F.col("account_name")).alias("k"))


@query("STR13_label_parts", r"SELECT account_id, trim(regexp_replace(account_name || ' (x1234)', '[\s(.*x#-]*\d{4}\)?\s*$', '')) AS name, NULLIF(regexp_extract(account_name || ' (x1234)', '(\d{4})\)?\s*$', 1), '') AS last_four FROM account")
def _(spark, sf):
    return account(spark, sf).select("account_id", T.label_parts(F.concat("account_name", F.lit(" (x1234)"))).alias("p")).select("account_id", "p.*")


@query("STR14_content_key", "SELECT transaction_id, substr(sha256('order|' || account_id::VARCHAR || '|' || transaction_id::VARCHAR), 1, 16) AS k FROM txn")
def _(spark, sf):
    return txn(spark, sf).select("transaction_id", T.sha16(F.lit("order"), F.col("account_id"), F.col("transaction_id")).alias("k"))


@query("NUM01_arithmetic", "SELECT transaction_id, line_number, part_id, CAST(abs(discount - 0.05) AS DECIMAL(18,2)) AS a, CAST(round(amount, 0) AS DECIMAL(18,2)) AS r, greatest(amount, quantity) AS g, least(amount, quantity) AS l, NULLIF(line_number, 1) AS z, line_number % 3 AS m FROM line")
def _(spark, sf):
    return line(spark, sf).select("transaction_id", "line_number", "part_id", F.abs(F.col("discount") - F.lit(0.05).cast("decimal(18,2)")).cast("decimal(18,2)").alias("a"), money(F.round("amount", 0)).alias("r"), F.greatest("amount", "quantity").alias("g"), F.least("amount", "quantity").alias("l"), F.nullif(F.col("line_number"), F.lit(1)).alias("z"), (F.col("line_number") % 3).alias("m"))


@query("NUM02_half_up", "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(28,10)) * 1.005 AS DECIMAL(18,2)) AS x FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice").cast("decimal(28,10)").cast("decimal(18,6)") * F.lit("1.005").cast("decimal(4,3)")).cast("decimal(18,2)").alias("x"))




@query("NUM03_parse_amount", "SELECT transaction_id, CASE transaction_id % 5 WHEN 0 THEN -abs(amount) WHEN 1 THEN abs(amount) WHEN 2 THEN amount WHEN 3 THEN -abs(amount) END AS x FROM txn")
def _(spark, sf):
    a = F.replace(F.abs("amount").cast("string"), F.lit("."), F.lit(","))
    k = F.col("transaction_id") % 5
    s = F.when(k == 0, F.concat(F.lit("("), a, F.lit(")"))).when(k == 1, F.concat(F.lit("€ "), a)).when(k == 2, F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(","))).when(k == 3, F.concat(a, F.lit(" DR"))).otherwise("n/a")
    return txn(spark, sf).select("transaction_id", V.parse_amount(s, "european").alias("x"))


@query("NUM04_number_votes", r"SELECT count(*) FILTER (x ~ '.*\d{1,3}(\.\d{3})+,\d{2}' OR x ~ '\D*\d+,\d{2}') AS european, count(*) FILTER (regexp_matches(x, '\d{1,3}(,\d{3})+(\.\d{2})?$') OR regexp_matches(x, '^\D*\d+\.\d{2}$')) AS us, count(*) FILTER (regexp_matches(x, '\d{1,3}( \d{3})+,\d{2}$')) AS swiss_french, count(*) FILTER (regexp_matches(x, '^\D*\d{1,3}(,\d{3})+$')) AS zero_decimal FROM (SELECT CASE WHEN transaction_id % 4 = 0 THEN replace(amount::VARCHAR, '.', ',') ELSE amount::VARCHAR END AS x FROM txn)")
def _(spark, sf):
    s = F.when(F.col("transaction_id") % 4 == 0, F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(","))).otherwise(F.col("amount").cast("string"))
    return V.number_votes(txn(spark, sf).select(s.alias("x")), "x")


@query("DAT01_truncation_parts", "SELECT transaction_id, CAST(date_trunc('month', transaction_date) AS DATE) AS m, CAST(date_trunc('week', transaction_date) AS DATE) AS w, CAST(date_part('year', transaction_date) AS BIGINT) AS y, CAST(dayofweek(transaction_date) AS BIGINT) AS dow, CAST(quarter(transaction_date) AS BIGINT) AS q FROM txn")
def _(spark, sf):
    d = F.col("transaction_date")
    return txn(spark, sf).select("transaction_id", F.trunc(d, "month").alias("m"), F.trunc(d, "week").alias("w"), F.year(d).cast("long").alias("y"), (F.dayofweek(d) - 1).cast("long").alias("dow"), F.quarter(d).cast("long").alias("q"))


@query("DAT02_format", "SELECT transaction_id, strftime(transaction_date, '%Y-%m') AS ym, year(transaction_date)::VARCHAR || '-Q' || quarter(transaction_date)::VARCHAR AS q FROM txn")
def _(spark, sf):
    d = F.col("transaction_date")
    return txn(spark, sf).select("transaction_id", F.date_format(d, "yyyy-MM").alias("ym"), F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")).alias("q"))


@query("DAT03_differences", "SELECT transaction_id, (DATE '2002-01-01' - transaction_date)::BIGINT AS days, date_diff('month', transaction_date, DATE '2002-01-01')::BIGINT AS months FROM txn")
def _(spark, sf):
    d, e = F.col("transaction_date"), F.lit("2002-01-01").cast("date")
    return txn(spark, sf).select("transaction_id", F.datediff(e, d).cast("long").alias("days"), F.months_between(F.trunc(e, "month"), F.trunc(d, "month")).cast("long").alias("months"))


@query("DAT04_month_arithmetic", "SELECT transaction_id, (transaction_date - INTERVAL 18 MONTH)::DATE AS back, (transaction_date + INTERVAL 1 MONTH)::DATE AS ahead FROM txn")
def _(spark, sf):
    return txn(spark, sf).select("transaction_id", F.add_months("transaction_date", -18).alias("back"), F.add_months("transaction_date", 1).alias("ahead"))


@query("DAT05_month_series", "SELECT CAST(unnest(generate_series((SELECT min(date_trunc('month', transaction_date)) FROM txn)::TIMESTAMP, (SELECT max(date_trunc('month', transaction_date)) FROM txn)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month")
def _(spark, sf):
    span = txn(spark, sf).agg(F.trunc(F.min("transaction_date"), "month").alias("a"), F.trunc(F.max("transaction_date"), "month").alias("b"))
    return span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))


@query("DAT06_date_format_detection", "SELECT round(avg(CASE WHEN try_strptime(s, '%m/%d/%Y') IS NULL THEN 0.0 ELSE 1.0 END), 6) AS us, round(avg(CASE WHEN try_strptime(s, '%d/%m/%Y') IS NULL THEN 0.0 ELSE 1.0 END), 6) AS eu FROM (SELECT strftime(transaction_date, '%d/%m/%Y') AS s FROM txn)")
def _(spark, sf):
    v = V.date_votes(txn(spark, sf).select(F.date_format("transaction_date", "dd/MM/yyyy").alias("s")), "s", ("MM/dd/yyyy", "dd/MM/yyyy"))
    return v.select(F.round("`MM/dd/yyyy`", 6).alias("us"), F.round("`dd/MM/yyyy`", 6).alias("eu"))


@query("DAT07_epoch", "SELECT event_id, epoch_us(ts)::BIGINT AS us, epoch_us(ts)::BIGINT // 1000 AS ms FROM events")
def _(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", us.alias("us"), F.expr("cast(floor(unix_micros(cast(ts as timestamp)) / 1000) as bigint)").alias("ms"))


@query("DAT08_term", "SELECT transaction_id, line_number, part_id, CASE WHEN ship_date > (transaction_date + INTERVAL 1 YEAR)::DATE THEN 'long' ELSE 'short' END AS term FROM line JOIN txn USING (transaction_id)")
def _(spark, sf):
    x = line(spark, sf).join(txn(spark, sf).select("transaction_id", "transaction_date"), "transaction_id")
    return x.select("transaction_id", "line_number", "part_id", F.when(V.is_long_term(F.col("transaction_date"), F.col("ship_date")), "long").otherwise("short").alias("term"))


@query("DAT09_publication_day", "SELECT transaction_id, (transaction_date - (CASE dayofweek(transaction_date) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END)::INT) AS d FROM txn")
def _(spark, sf):
    return txn(spark, sf).select("transaction_id", V.last_publication_day(F.col("transaction_date")).alias("d"))


@query("ARR01_filter_contains", "SELECT account_id, len(list_filter(c, lambda x: x <> '1-URGENT'))::BIGINT AS n, list_contains(c, '1-URGENT') AS has FROM (SELECT account_id, list(DISTINCT category) FILTER (category IS NOT NULL) AS c FROM txn GROUP BY 1 HAVING count(category) > 0)")
def _(spark, sf):
    c = txn(spark, sf).where("category is not null").groupBy("account_id").agg(F.collect_set("category").alias("c"))
    return c.select("account_id", F.size(F.filter("c", lambda x: x != "1-URGENT")).cast("long").alias("n"), F.array_contains("c", "1-URGENT").alias("has"))


@query("ARR02_unnest", "SELECT account_id, unnest(list(transaction_id ORDER BY transaction_id)) AS t FROM txn GROUP BY account_id")
def _(spark, sf):
    return txn(spark, sf).groupBy("account_id").agg(F.collect_list("transaction_id").alias("l")).select("account_id", F.explode("l").alias("t"))


@query("ARR03_struct", "SELECT transaction_id, s.a AS a, s.c AS c FROM (SELECT transaction_id, {'a': account_id, 'c': currency_code} AS s FROM txn)")
def _(spark, sf):
    return txn(spark, sf).select("transaction_id", F.struct(F.col("account_id").alias("a"), F.col("currency_code").alias("c")).alias("s")).select("transaction_id", "s.a", "s.c")


@query("JSN01_extract", "SELECT event_id, props ->> '$.k' AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("JSN02_to_json", """SELECT transaction_id, sha256('{"a":' || account_id::VARCHAR || ',"s":"' || status || '"}') AS h FROM txn""")
def _(spark, sf):
    return txn(spark, sf).select("transaction_id", F.sha2(F.to_json(F.struct(F.col("account_id").alias("a"), F.col("status").alias("s"))), 256).alias("h"))


@query("CAS01_casts", "SELECT event_id, TRY_CAST(props AS INTEGER) AS bad, CAST(event_id AS VARCHAR) AS s, CAST(value AS DECIMAL(18,2)) AS v, CAST(NULL AS DATE) AS d FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("props").try_cast("int").alias("bad"), F.col("event_id").cast("string").alias("s"), F.col("value").cast("decimal(18,2)").alias("v"), F.lit(None).cast("date").alias("d"))


@query("CND01_conditionals", "SELECT transaction_id, CASE status WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'pending' END AS s, coalesce(category, currency_code, 'none') AS c, NULLIF(status, 'P') AS n FROM txn")
def _(spark, sf):
    s = F.col("status")
    return txn(spark, sf).select("transaction_id", F.when(s == "F", "final").when(s == "O", "open").otherwise("pending").alias("s"), F.coalesce("category", "currency_code", F.lit("none")).alias("c"), F.nullif(s, F.lit("P")).alias("n"))
