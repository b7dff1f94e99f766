"""Sources, sinks, streaming, quality, services and SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sinks, streaming
from ..operators import identity, quality
from ..sources import delimited, feeds
from ..session import scratch_dir, table
from . import adhoc
from .base import account, line, money, query, txn


def _scratch(spark) -> str:
    return f"{scratch_dir(spark)}/op-{uuid.uuid4().hex}"


# ---- sources


def _csv(spark, sf):
    """Nations as the lines of a bank's file: two lines before the header, a repeated header, a total."""
    n = table(spark, sf, "nation")
    body = n.select((F.col("n_nationkey") + 3 + F.floor(F.col("n_nationkey") / 20)).cast("long").alias("row"), F.concat_ws(";", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit('"')), F.col("n_regionkey").cast("string")).alias("text"))
    extra = spark.createDataFrame([(0, "Export of accounts"), (1, ""), (2, "Key;Name;Region"), (23, "Key;Name;Region"), (99, "Total;;300")], "row long, text string")
    return body.unionByName(extra).withColumn("file", F.lit("nations.csv"))


@query("SRC02_delimited", "SELECT n_nationkey::VARCHAR AS Key, n_name AS Name, n_regionkey::VARCHAR AS Region FROM nation")
def _(spark, sf):
    return delimited.parse_lines(_csv(spark, sf), ";").select("Key", "Name", "Region")


@query("SRC03_trailing_totals", "SELECT count(*) AS n FROM nation")
def _(spark, sf):
    return delimited.parse_lines(_csv(spark, sf), ";", header=2).agg(F.count("*").alias("n"))


@query("SRC05_parquet", "SELECT p_partkey, p_name FROM part WHERE p_size > 40")
def _(spark, sf):
    return table(spark, sf, "part").where("p_size > 40").select("p_partkey", "p_name")


@query("SRC07_row_guard", "SELECT CASE WHEN count(*) > 50000 THEN 'refuse' WHEN count(*) > 10000 THEN 'warn' ELSE 'ok' END AS verdict FROM orders")
def _(spark, sf):
    return spark.createDataFrame([(delimited.guard_rows(table(spark, sf, "orders")),)], "verdict string")


def _ofx_text(spark, sf):
    """Statements of all accounts, a text each."""
    t = txn(spark, sf)
    one = F.concat(F.lit("<STMTTRN>\n<TRNTYPE>DEBIT\n<DTPOSTED>"), F.date_format("transaction_date", "yyyyMMdd"), F.lit("120000\n<TRNAMT>"), F.col("amount").cast("string"), F.lit("\n<FITID>"), (F.col("transaction_id") % 200).cast("string"), F.lit("\n<NAME>"), "priority", F.lit("\n</STMTTRN>\n"))
    x = t.groupBy("account_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("transaction_id", one.alias("s")))), lambda e: e["s"]), "").alias("b"))
    return x.select(F.concat(F.lit("f"), F.col("account_id").cast("string")).alias("file"), F.concat(F.lit("OFXHEADER:100\n\n<OFX>\n<CURDEF>USD\n<ACCTID>"), F.col("account_id").cast("string"), F.lit("\n"), "b", F.lit("<LEDGERBAL>\n<BALAMT>12.50\n<DTASOF>20010801\n</OFX>")).alias("text"))


@query("SRC08_ofx", "SELECT account_id::VARCHAR AS account_id, (transaction_id % 200)::VARCHAR AS fitid, amount::VARCHAR AS amount, strftime(transaction_date, '%Y%m%d') AS date, priority AS name FROM txn")
def _(spark, sf):
    return feeds.read_ofx(_ofx_text(spark, sf)).where("kind = 'transaction'").select("account_id", "fitid", "amount", "date", "name")


@query("SRC09_id_repair", """WITH x AS (SELECT account_id::VARCHAR AS account_id, (transaction_id % 200)::VARCHAR AS fitid, amount::VARCHAR AS amount, strftime(transaction_date, '%Y%m%d') AS date, priority AS name FROM txn),
y AS (SELECT *, '["' || date || '","' || amount || '","' || name || '",""]' AS sig FROM x), c AS (SELECT account_id, fitid, count(DISTINCT sig) > 1 AS clash FROM y GROUP BY 1, 2) SELECT y.account_id, CASE WHEN clash THEN y.fitid || '#' || substr(sha256(sig), 1, 8) ELSE y.fitid END AS fitid, amount FROM y JOIN c ON c.account_id = y.account_id AND c.fitid = y.fitid""")
def _(spark, sf):
    return feeds.repair_ids(feeds.read_ofx(_ofx_text(spark, sf)).where("kind = 'transaction'")).select("account_id", "fitid", "amount")


def _statements(spark, sf):
    x = line(spark, sf).groupBy("transaction_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "part_id", "amount"))).alias("s"))
    rows = F.array_join(F.transform("s", lambda e: F.concat(F.lit("  item "), e["part_id"].cast("string"), F.lit("   "), e["amount"].cast("string"))), "\n")
    return x.select(F.col("transaction_id").cast("string").alias("file"), F.concat(F.lit("item 1 9.99\nBEGIN ITEMS\n"), rows, F.lit("\nEND ITEMS\nitem 2 8.88")).alias("text"))


_RECIPE = {"start": "^BEGIN", "end": "^END", "row": r"^\s+item (?P<part>\d+)\s+(?P<amount>[\d.]+)$", "fields": {"part": "bigint", "amount": "decimal(18,2)"}}


@query("SRC10_recipe", "SELECT transaction_id::VARCHAR AS file, part_id AS part, amount FROM line")
def _(spark, sf):
    return feeds.run_recipe(_statements(spark, sf), _RECIPE).select("file", "part", "amount")


@query("SRC11_statement_reconciliation", "SELECT transaction_id::VARCHAR AS file, CAST(100 + sum(amount) - (100 + sum(amount) + CASE WHEN transaction_id % 2 = 0 THEN 0 ELSE 1 END) AS DECIMAL(18,2)) AS difference, transaction_id % 2 = 0 AS balanced FROM line GROUP BY transaction_id")
def _(spark, sf):
    rows = feeds.run_recipe(_statements(spark, sf), _RECIPE)
    meta = line(spark, sf).groupBy("transaction_id").agg(F.sum("amount").alias("t"))
    meta = meta.select(F.col("transaction_id").cast("string").alias("file"), F.lit(100).cast("decimal(18,2)").alias("opening"), money(F.col("t") + 100 + F.when(F.col("transaction_id") % 2 == 0, 0).otherwise(1)).alias("closing"))
    return feeds.reconcile_statement(rows, meta)


def _payloads(spark, sf):
    t = txn(spark, sf).withColumn("cursor", F.floor(F.col("transaction_id") / 1000))
    r = F.struct(F.col("transaction_id").alias("id"), F.col("amount"))
    pick = lambda c: F.collect_list(F.when(c, r))
    i = F.col("transaction_id")
    x = t.groupBy("cursor").agg(pick(i % 3 != 0).alias("added"), pick(i % 3 == 0).alias("modified"), pick(i % 7 == 0).alias("removed"))
    return x.select("cursor", F.to_json(F.struct("added", "modified", "removed")).alias("body"))


@query("SRC12_sync", "SELECT transaction_id AS id, amount FROM txn WHERE transaction_id % 7 <> 0")
def _(spark, sf):
    stored = spark.createDataFrame([], "id long, amount decimal(18,2)")
    return feeds.apply_sync(stored, feeds.sync_rows(_payloads(spark, sf), "id: bigint, amount: decimal(18,2)"), "id")


@query("SRC14_seed_snapshot", """WITH n AS (SELECT '{"n_name":"' || n_name || '"}' AS data, n_nationkey AS k FROM nation) SELECT sha256(data) AS row_hash, data, k < 5 AS gone FROM n""")
def _(spark, sf):
    n = table(spark, sf, "nation")
    empty = spark.createDataFrame([], "row_hash string, data string, deleted_at timestamp")
    old = feeds.seed_snapshot(empty, n.where("n_nationkey < 12").select("n_name"), "2024-01-01")
    return feeds.seed_snapshot(old, n.where("n_nationkey >= 5").select("n_name"), "2024-02-01").select("row_hash", "data", F.col("deleted_at").isNotNull().alias("gone"))


@query("SRC15_drift", "SELECT * FROM (VALUES ('blank:category'), ('missing:memo')) v(problem)")
def _(spark, sf):
    t = txn(spark, sf).withColumn("category", F.when(F.col("transaction_id") % 3 == 0, F.col("category")))
    return spark.createDataFrame([(x,) for x in feeds.drift(t, ["amount", "memo"], ["category", "amount"])], "problem string")


@query("SRC16_typed_view", "SELECT event_id, TRY_CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def _(spark, sf):
    return feeds.typed_view(table(spark, sf, "events"), {"k": "bigint"}, ("event_id",), "props")


@query("SRC17_price_feed", "SELECT count(DISTINCT (l_partkey, CAST(l_shipdate AS DATE))) AS n FROM lineitem")
def _(spark, sf):
    x = table(spark, sf, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("d"), "l_extendedprice")
    stored = feeds.load_feed(x.where("l_partkey % 2 = 0"), ("l_partkey", "d"))
    return feeds.load_feed(x, ("l_partkey", "d"), stored).agg(F.count("*").alias("n"))


@query("SRC20_seeds", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf):
    path = _scratch(spark)
    table(spark, sf, "nation").write.csv(path, header=True)
    return feeds.read_seed(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SRC21_persona", "SELECT 50::BIGINT AS accounts, 12::BIGINT AS months, TRUE AS plausible")
def _(spark, sf):
    p = feeds.make_persona(spark, 50, 12)
    return p.agg(F.countDistinct("account_id").alias("accounts"), F.countDistinct(F.trunc("date", "month")).alias("months"), (F.min("amount") < 0).alias("plausible"))


@query("SRC22_link_resolution", "SELECT transaction_id, CASE WHEN account_id % 3 = 0 THEN account_id + 1000000 ELSE account_id END AS account_id FROM txn")
def _(spark, sf):
    links = account(spark, sf).where("account_id % 3 < 2").select(F.col("account_id").alias("source_key"), (F.col("account_id") + 1000000).alias("account_id"), F.when(F.col("account_id") % 3 == 0, "accepted").otherwise("pending").alias("status"))
    return feeds.resolved(txn(spark, sf).select("transaction_id", F.col("account_id").alias("account_key")), links).select("transaction_id", "account_id")


@query("SRC23_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(i, s)")
def _(spark, sf):
    return feeds.inline(spark, [(1, "a"), (2, "b")], "i int, s string")


# ---- sinks


def _halves(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 100)


@query("SNK01_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def _(spark, sf):
    return sinks.merged(*_halves(spark, sf), ["p_partkey"], "upsert")[0]


@query("SNK01_ignore", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 100 END AS p_size FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def _(spark, sf):
    return sinks.merged(*_halves(spark, sf), ["p_partkey"], "ignore")[0]


@query("SNK02_csv_round_trip", "SELECT account_id::VARCHAR AS account_id, balance::VARCHAR AS balance, currency_code FROM account")
def _(spark, sf):
    path = _scratch(spark)
    sinks.export_csv(account(spark, sf).select("account_id", "balance", "currency_code"), path)
    return spark.read.csv(path, header=True)


@query("SNK03_parquet_round_trip", "SELECT * FROM account")
def _(spark, sf):
    path = _scratch(spark)
    sinks.export_parquet(account(spark, sf), path)
    return spark.read.parquet(path)


@query("SNK06_checksum", "SELECT (SELECT count(*) FROM txn) AS n_rows, TRUE AS same")
def _(spark, sf):
    t = txn(spark, sf)
    a, b = sinks.checksum(t), sinks.checksum(t.repartition(7, "category")).select(F.col("checksum").alias("c2"))
    return a.crossJoin(b).select("n_rows", (F.col("checksum") == F.col("c2")).alias("same"))


def _log(spark, sf):
    t = txn(spark, sf).select("transaction_id", "category")
    a = t.select(F.lit("op1").alias("operation_id"), (F.col("transaction_id") + 1).alias("seq"), F.lit("txn").alias("entity"), F.col("transaction_id").cast("string").alias("entity_id"), F.lit(None).cast("string").alias("before"), F.lit("first").alias("after"))
    b = t.where("transaction_id % 2 = 0").select(F.lit("op2").alias("operation_id"), (F.col("transaction_id") + 10_000_000_000).alias("seq"), F.lit("txn").alias("entity"), F.col("transaction_id").cast("string").alias("entity_id"), F.lit("first").alias("before"), F.when(F.col("transaction_id") % 4 == 0, F.lit("second")).alias("after"))
    return a.unionByName(b)


@query("SNK09_audit_state", "SELECT 'txn' AS entity, transaction_id::VARCHAR AS entity_id, CASE WHEN transaction_id % 4 = 0 THEN 'second' ELSE 'first' END AS image FROM txn WHERE transaction_id % 4 <> 2")
def _(spark, sf):
    return sinks.current_state(_log(spark, sf))


@query("SNK09_undo", "SELECT 'txn' AS entity, transaction_id::VARCHAR AS entity_id, 'first' AS image FROM txn")
def _(spark, sf):
    return sinks.current_state(sinks.undo(_log(spark, sf), "op2"))


# ---- streaming


@query("STM01_drain_folder", "SELECT count(*) AS n FROM orders")
def _(spark, sf):
    src, out, cp = _scratch(spark), _scratch(spark), _scratch(spark)
    o = table(spark, sf, "orders")
    o.write.parquet(src)
    streaming.drain_folder(spark, src, o.schema.simpleString()[7:-1].replace(":", " "), cp, lambda b, n: b.write.mode("append").parquet(out))
    return spark.read.parquet(out).agg(F.count("*").alias("n"))


@query("STM02_append_once", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def _(spark, sf):
    out = _scratch(spark)
    put, e = streaming.append_once(out, ["user_id", "event_type"]), table(spark, sf, "events").select("user_id", "event_type")
    for n, part in enumerate((e.where("user_id % 2 = 0"), e, e)):
        put(part, n)
    return spark.read.parquet(out).agg(F.count("*").alias("n"))


@query("STM03_cursor_merge", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'refund'")
def _(spark, sf):
    out = _scratch(spark)
    e = table(spark, sf, "events").select("user_id", "event_id", "value", (F.col("event_type") == "refund").alias("gone"))
    put = streaming.merge_by_cursor(out, "user_id", "event_id", "gone")
    put(e.where("event_id % 2 = 0"), 0)
    put(e.where("event_id % 2 = 1"), 1)
    return spark.read.parquet(f"{out}/v1").where("not gone").select("user_id", "value")


@query("STM04_changed_since", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00'")
def _(spark, sf):
    return streaming.changed_since(table(spark, sf, "events").withColumnRenamed("ts", "updated_at"), "2024-01-25 00:00:00").select("event_id")


# ---- identity, openings


@query("PRJ02_investment_type", "WITH p(t, s, a, q) AS (VALUES ('buy', 'buy', 1, 1), ('sell', 'sell', 1, -1), ('cash', 'dividend', 1, 0), ('fee', 'margin expense', 1, 0), ('transfer', 'send', 5, -2), ('transfer', 'merger', 5, 3), ('x', 'unknown', 0, 0)) SELECT t, s, CASE s WHEN 'buy' THEN 'buy' WHEN 'sell' THEN 'sell' WHEN 'dividend' THEN 'dividend' WHEN 'margin expense' THEN 'fee' WHEN 'send' THEN 'transfer_out' WHEN 'merger' THEN 'transfer_in' END AS mapped FROM p")
def _(spark, sf):
    p = spark.createDataFrame([("buy", "buy", 1, 1), ("sell", "sell", 1, -1), ("cash", "dividend", 1, 0), ("fee", "margin expense", 1, 0), ("transfer", "send", 5, -2), ("transfer", "merger", 5, 3), ("x", "unknown", 0, 0)], "t string, s string, a int, q int")
    return p.select("t", "s", identity.investment_type(F.col("t"), F.col("s"), F.lit("sec"), F.col("a"), F.col("q")).alias("mapped"))


@query("DOM25_review_routing", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'buy' END AS mapped, event_type <> 'purchase' AS review FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("s", F.when(F.col("event_type") == "purchase", "buy").otherwise(F.col("event_type")))
    m = identity.investment_type(F.lit("buy"), F.col("s"), F.lit("x"), F.col("value"), F.col("value"))
    return e.select("event_id", m.alias("mapped"), m.isNull().alias("review"))


def _accounts(spark, sf):
    a = account(spark, sf)
    i = F.col("account_id")
    inc = a.select(F.concat(F.lit("k"), i.cast("string")).alias("key"), F.when(i % 2 == 0, F.concat(F.lit("n"), i.cast("string"))).alias("native_ref"), F.lit(None).cast("string").alias("token"), F.lit("bank").alias("slug"), F.right(F.lpad(i.cast("string"), 4, "0"), F.lit(4)).alias("last_four"), F.col("account_name").alias("name"))
    known = a.select(F.concat(F.lit("acc"), i.cast("string")).alias("account_id"), F.concat(F.lit("n"), i.cast("string")).alias("native_ref"), F.lit(None).cast("string").alias("token"), F.lit("bank").alias("slug"), F.right(F.lpad(i.cast("string"), 4, "0"), F.lit(4)).alias("last_four"), F.col("account_name").alias("name"))
    pins = a.where(i % 10 == 0).select(F.concat(F.lit("k"), i.cast("string")).alias("key"), F.concat(F.lit("acc"), i.cast("string")).alias("account_id"))
    return identity.resolve_accounts(inc, known, pins)


@query("DOM13_account_ladder", "SELECT 'k' || account_id AS key, CASE WHEN account_id % 10 = 0 THEN 'pin' WHEN account_id % 2 = 0 THEN 'native' ELSE 'minted' END AS how FROM account")
def _(spark, sf):
    return _accounts(spark, sf).select("key", "how")


@query("DOM13_account_proposals", """WITH a AS (SELECT account_id, right(lpad(account_id::VARCHAR, 4, '0'), 4) AS four FROM account)
  SELECT 'k' || account_id AS key, 'institution_last4' AS signal, (SELECT count(*) FROM a b WHERE b.four = a.four)::INTEGER AS n FROM a WHERE account_id % 2 = 1""")
def _(spark, sf):
    return _accounts(spark, sf).where("proposals is not null").select("key", "signal", F.size("proposals").alias("n"))


@query("DOM16_exact_beats_fuzzy", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'e' ELSE 'f' END AS merchant_id, p_partkey % 3 = 0 AS exact FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return identity.prefer_exact(p.where("id % 2 = 0").withColumn("merchant_id", F.lit("f")), p.where("id % 3 = 0").withColumn("merchant_id", F.lit("e")))


@query("DOM20_merchant_ladder", "SELECT n_name AS ref, CASE WHEN n_nationkey < 5 THEN 'adopt' ELSE 'bind' END AS action FROM nation")
def _(spark, sf):
    n = table(spark, sf, "nation")
    known = n.select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("merchant_id"), F.col("n_name").alias("name"))
    return identity.resolve_merchants(n.select(F.col("n_name").alias("ref"), F.lower("n_name").alias("name")), n.where("n_nationkey < 5").select(F.col("n_name").alias("ref"), F.lit("b").alias("merchant_id")), known).select("ref", "action")


def _securities(spark, sf):
    k = F.col("p_partkey")
    s = k.cast("string")
    p = table(spark, sf, "part")
    none = F.lit(None).cast("string")
    known = p.select(F.concat(F.lit("s"), s).alias("security_id"), F.concat(F.lit("c"), s).alias("cusip"), none.alias("isin"), F.concat(F.lit("t"), s).alias("ticker"), F.lit("XNYS").alias("mic"))
    twins = known.where(F.substring("cusip", 2, 20).cast("long") % 8 == 4).withColumn("security_id", F.concat(F.lit("d"), F.col("security_id")))
    ticker = F.when(k % 4 == 3, F.concat(F.lit("t"), s, F.lit(".l"))).otherwise(F.concat(F.lit("t"), s))
    inc = p.select(k.alias("ref"), F.when(k % 4 == 0, F.concat(F.lit("c"), s)).alias("cusip"), none.alias("isin"), ticker.alias("ticker"), F.when(k % 4 == 2, "XLON").otherwise("XNYS").alias("mic"))
    refs = spark.createDataFrame([], "ref long, security_id string")
    return identity.resolve_securities(inc, refs, known.unionByName(twins))


@query("DOM50_security_ladder", "SELECT p_partkey AS ref, CASE WHEN p_partkey % 8 = 0 THEN 'cusip' WHEN p_partkey % 4 = 1 THEN 'ticker' ELSE 'provisional' END AS how FROM part")
def _(spark, sf):
    return _securities(spark, sf)[0].select("ref", "how")


@query("DOM50_security_proposals", """SELECT p_partkey AS ref, 's' || p_partkey AS security_id, CASE WHEN p_partkey % 4 = 2 THEN 'exchange_contradiction' WHEN p_partkey % 4 = 3 THEN 'ticker_suffix_strip' ELSE 'identifier_tie' END AS reason
  FROM part WHERE p_partkey % 4 IN (2, 3) OR p_partkey % 8 = 4 UNION ALL SELECT p_partkey, 'ds' || p_partkey, 'identifier_tie' FROM part WHERE p_partkey % 8 = 4""")
def _(spark, sf):
    return _securities(spark, sf)[1]


_OPEN = "h AS (SELECT part_id AS account_id, 1::BIGINT AS security_id, min(ship_date) AS date, CAST(100 AS DECIMAL(18,2)) AS quantity FROM line GROUP BY 1), g AS (SELECT h.*, coalesce((SELECT sum(l.quantity) FROM line l WHERE l.part_id = h.account_id AND l.ship_date <= h.date), 0) AS explained FROM h)"


def _openings(spark, sf):
    l = line(spark, sf).select(F.col("part_id").alias("account_id"), F.lit(1).cast("long").alias("security_id"), F.col("ship_date").alias("date"), "quantity")
    snap = l.groupBy("account_id", "security_id").agg(F.min("date").alias("date")).withColumn("quantity", F.lit(100).cast("decimal(18,2)"))
    return identity.opening_gaps(snap, l)


@query("DOM26_opening_gaps", f"WITH {_OPEN} SELECT account_id, security_id, date, quantity, CAST(explained AS DECIMAL(18,2)) AS explained, CAST(quantity - explained AS DECIMAL(18,2)) AS gap FROM g")
def _(spark, sf):
    return _openings(spark, sf).withColumns({"explained": money("explained"), "gap": money("gap")})


@query("DOM27_opening_lots", f"WITH {_OPEN}, t AS (SELECT account_id, date, quantity - explained AS gap FROM g WHERE quantity - explained > 0) SELECT account_id, 1::BIGINT AS security_id, DATE '1994-01-01' AS date, CAST(least(30, gap) AS DECIMAL(18,2)) AS quantity, CAST(CAST(60 AS DOUBLE) * least(30, gap) / 30 AS DECIMAL(18,2)) AS basis FROM t UNION ALL SELECT account_id, 1, DATE '1994-06-01', CAST(least(40, gap - 30) AS DECIMAL(18,2)), CAST(CAST(80 AS DOUBLE) * least(40, gap - 30) / 40 AS DECIMAL(18,2)) FROM t WHERE gap > 30 UNION ALL SELECT account_id, 1, date, CAST(gap - 70 AS DECIMAL(18,2)), NULL FROM t WHERE gap > 70")
def _(spark, sf):
    gaps = _openings(spark, sf)
    claim = lambda d, i, q, b: gaps.select("account_id", "security_id", F.lit(d).cast("date").alias("lot_date"), F.lit(i).alias("lot_index"), F.lit(q).cast("decimal(18,2)").alias("lot_quantity"), F.lit(b).cast("decimal(18,2)").alias("lot_basis"))
    return identity.opening_lots(gaps, claim("1994-01-01", 0, 30, 60).unionByName(claim("1994-06-01", 1, 40, 80)))


@query("DOM28_ledger_union", "SELECT 'manual' AS source, transaction_id, amount FROM line WHERE flag = 'A' UNION ALL SELECT 'feed', transaction_id, amount FROM line WHERE flag = 'N' AND status = 'O' UNION ALL SELECT 'opening', transaction_id, amount FROM txn WHERE status = 'P'")
def _(spark, sf):
    l = line(spark, sf)
    cols = lambda df, s: df.select(F.lit(s).alias("source"), "transaction_id", "amount")
    return cols(l.where("flag = 'A'"), "manual").unionByName(cols(l.where("flag = 'N' and status = 'O'"), "feed")).unionByName(cols(txn(spark, sf).where("status = 'P'"), "opening"))


@query("DOM43_sign_convention", "SELECT 'negative_is_expense' AS convention, (SELECT CAST(sum(amount) AS DECIMAL(18,2)) FROM txn) AS total")
def _(spark, sf):
    t = txn(spark, sf)
    c = delimited.sign_convention(t.select(F.col("amount").cast("string").alias("a")), "a")
    return t.agg(money(F.sum(delimited.signed(c, F.col("amount")))).alias("total")).select(F.lit(c).alias("convention"), "total")


@query("DOM45_column_mapping", "SELECT * FROM (VALUES ('amount', 'Amount'), ('description', 'Payee'), ('transaction_date', 'Trans Date')) v(field, header)")
def _(spark, sf):
    return spark.createDataFrame(sorted(delimited.map_columns(["Trans Date", "Payee", "Amount", "Other"])["mapping"].items()), "field string, header string")


@query("DOM48_model_freshness", "SELECT event_type AS model, arg_max(event_id, ts) AS version, CAST(floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) / 3600000000) AS BIGINT) AS hours FROM events GROUP BY 1")
def _(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("version"), F.col("ts").alias("finished_at"))
    return identity.model_freshness(runs, "2024-02-01 00:00:00").select("model", "version", "hours")


# ---- quality


@query("AUD_fk_integrity", "SELECT transaction_id, line_number FROM line WHERE transaction_id NOT IN (SELECT transaction_id FROM txn WHERE status <> 'P')")
def _(spark, sf):
    return quality.orphans(line(spark, sf), txn(spark, sf).where("status <> 'P'"), "transaction_id").select("transaction_id", "line_number")


@query("AUD_uniqueness", "SELECT transaction_id, line_number, count(*) AS n FROM line GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return quality.duplicates(line(spark, sf), ["transaction_id", "line_number"])


@query("AUD_sign_convention", "SELECT transaction_id FROM txn WHERE (status = 'F' AND amount >= 0) OR (status = 'O' AND amount <= 0)")
def _(spark, sf):
    t = txn(spark, sf).withColumn("direction", F.when(F.col("status") == "F", "expense").when(F.col("status") == "O", "income"))
    return quality.sign_violations(t, "amount", "direction").select("transaction_id")


@query("VAL07_balanced", "SELECT account_id, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM txn GROUP BY 1 HAVING sum(amount) IS DISTINCT FROM 0")
def _(spark, sf):
    return quality.unbalanced(txn(spark, sf), "account_id").withColumn("total", money("total"))


@query("VAL01_nulls", "SELECT count(*) FILTER (category IS NULL) AS category, count(*) FILTER (currency_code IS NULL) AS currency_code FROM txn")
def _(spark, sf):
    return quality.null_counts(txn(spark, sf), ["category", "currency_code"])


@query("VAL02_populated", "SELECT s AS source, (SELECT count(*) FROM txn WHERE status = s) AS n FROM (VALUES ('F'), ('O'), ('X')) v(s)")
def _(spark, sf):
    return quality.populated(txn(spark, sf), "status", ["F", "O", "X"])


@query("VAL03_distribution", "SELECT min(amount) AS low, max(amount) AS high, round(avg(CAST(amount AS DOUBLE)), 4) AS mean FROM txn")
def _(spark, sf):
    return quality.distribution(txn(spark, sf), "amount")


@query("VAL04_distinct_within", "SELECT count(DISTINCT account_id) AS n, abs(count(DISTINCT account_id) - 1500) * 100 <= 10 * 1500 AS ok FROM txn")
def _(spark, sf):
    return quality.within(txn(spark, sf), "account_id", 1500, 10)


@query("VAL08_month_gaps", "WITH m AS (SELECT account_id, count(DISTINCT date_trunc('month', transaction_date)) AS months, min(transaction_date) AS a, max(transaction_date) AS b FROM txn GROUP BY 1) SELECT account_id, months FROM m WHERE months < date_diff('month', a, b) + 1")
def _(spark, sf):
    return quality.month_gaps(txn(spark, sf), "account_id", "transaction_date")


@query("VAL10_date_bounds", "SELECT count(*) FILTER (transaction_date IS NULL OR transaction_date < DATE '1995-06-01' OR transaction_date > DATE '2001-01-01') AS violations FROM txn")
def _(spark, sf):
    return quality.date_bounds(txn(spark, sf), "transaction_date", "1995-06-01", "2001-01-01")


@query("VAL18_f1", "WITH p AS (SELECT doc_id FROM labels WHERE quality = 0), t AS (SELECT doc_id FROM labels WHERE toxic = 1), c AS (SELECT (SELECT count(*) FROM p JOIN t USING (doc_id)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t) AS nt) SELECT tp, CASE WHEN np > 0 THEN round(tp / np, 6) ELSE 0.0 END AS precision, CASE WHEN nt > 0 THEN round(tp / nt, 6) ELSE 0.0 END AS recall, CASE WHEN np + nt > 0 THEN round(2 * tp / (np + nt), 6) ELSE 0.0 END AS f1 FROM c")
def _(spark, sf):
    l = table(spark, sf, "labels")
    return quality.f1(l.where("quality = 0"), l.where("toxic = 1"), ["doc_id"])


@query("VAL18_class_scores", "WITH x AS (SELECT category AS p, CASE WHEN status = 'F' THEN priority ELSE category END AS t FROM txn), a AS (SELECT p AS c, count(*) AS np, count(*) FILTER (p = t) AS tp FROM x WHERE p IS NOT NULL GROUP BY 1), b AS (SELECT t AS c, count(*) AS nt FROM x WHERE t IS NOT NULL GROUP BY 1) SELECT c, round(coalesce(tp / np, 0.0), 6) AS precision, round(coalesce(tp / nt, 0.0), 6) AS recall FROM a FULL JOIN b USING (c)")
def _(spark, sf):
    x = txn(spark, sf).select(F.col("category").alias("p"), F.when(F.col("status") == "F", F.col("priority")).otherwise(F.col("category")).alias("t"))
    return quality.class_scores(x, "p", "t")


@query("DOC01_dedup_balance", "SELECT (SELECT count(*) FROM line) AS raw, (SELECT count(DISTINCT transaction_id) FROM line) AS core, (SELECT count(*) - count(DISTINCT transaction_id) FROM line)::BIGINT AS merged, 0::BIGINT AS unexplained")
def _(spark, sf):
    l = line(spark, sf)
    return quality.dedup_balance(l, l.select("transaction_id").distinct(), l.select(F.col("transaction_id").alias("group"), F.col("line_number").alias("id")))


@query("DOC05_coverage", "SELECT round(count(category) * 100.0 / count(*), 2) AS pct, count(category) * 100 < 50 * count(*) AS warn FROM txn")
def _(spark, sf):
    return txn(spark, sf).agg(F.round(F.count("category") * 100.0 / F.count("*"), 2).cast("double").alias("pct"), (F.count("category") * 100 < 50 * F.count("*")).alias("warn"))


@query("DOC09_divergence", "SELECT part_id FROM (SELECT part_id, sum(quantity) AS q, sum(amount) AS b, sum(CASE WHEN flag = 'R' THEN amount + 1 ELSE amount END) AS cb FROM line GROUP BY 1) WHERE abs(CAST(b - cb AS DOUBLE)) > greatest(0.01, abs(CAST(cb AS DOUBLE)) * 0.0001)")
def _(spark, sf):
    x = line(spark, sf).groupBy("part_id").agg(F.sum("quantity").alias("quantity"), F.sum("quantity").alias("claimed_quantity"), F.sum("amount").alias("basis"), F.sum(F.when(F.col("flag") == "R", F.col("amount") + 1).otherwise(F.col("amount"))).alias("claimed_basis"))
    return quality.divergent(x).select("part_id")


@query("DOC12_conflicting_refs", "SELECT 'name' AS kind, p_name AS ref, count(DISTINCT p_partkey) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1 UNION ALL SELECT 'type', p_type, count(DISTINCT p_partkey) FROM part GROUP BY p_type HAVING count(DISTINCT p_partkey) > 1")
def _(spark, sf):
    p = table(spark, sf, "part")
    ref = lambda k, c: p.select(F.lit(k).alias("kind"), F.col(c).alias("ref"), F.col("p_partkey").alias("security_id"))
    return quality.conflicting_refs(ref("name", "p_name"), ref("type", "p_type"))


@query("DOC15_price_disagreement", "WITH x AS (SELECT part_id AS security_id, ship_date AS date, flag AS source, CAST(amount AS DOUBLE) AS c FROM line) SELECT DISTINCT a.security_id, a.date, a.source AS a, b.source AS b FROM x a JOIN x b ON a.security_id = b.security_id AND a.date = b.date AND b.source > a.source AND abs(a.c - b.c) * 100 > 2.0 * (a.c + b.c) / 2")
def _(spark, sf):
    return quality.price_disagreement(line(spark, sf).select(F.col("part_id").alias("security_id"), F.col("ship_date").alias("date"), F.col("flag").alias("source"), F.col("amount").alias("close")))


@query("DOC19_audit_coverage", "SELECT user_id FROM (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS updated, max(ts) FILTER (event_type <> 'purchase') AS audited FROM events GROUP BY 1) WHERE updated IS NOT NULL AND (audited IS NULL OR audited < updated)")
def _(spark, sf):
    e = table(spark, sf, "events")
    rows = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    return quality.unaudited(rows, e.where("event_type <> 'purchase'").select("user_id", F.col("ts").alias("at")), "user_id").select("user_id")


@query("DOC20_duplicate_names", "SELECT p_name, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    x = table(spark, sf, "part").groupBy("p_name").agg(F.array_sort(F.collect_list("p_partkey")).alias("l"))
    return x.where(F.size("l") > 1).select("p_name", F.array_join(F.transform("l", lambda v: v.cast("string")), ",").alias("ids"))


@query("DOC25_either_fk", "SELECT DISTINCT transaction_id, line_number, part_id, merchant_id, amount, quantity, discount, flag, status, ship_date FROM line WHERE part_id NOT IN (SELECT account_id FROM account WHERE account_id % 2 = 0) OR merchant_id NOT IN (SELECT account_id FROM account WHERE account_id % 2 = 0)")
def _(spark, sf):
    return quality.either_orphans(line(spark, sf), account(spark, sf).where("account_id % 2 = 0"), ("part_id", "merchant_id"), "account_id")


@query("DOC29_bad_json", "SELECT page_id FROM pages WHERE NOT json_valid(url)")
def _(spark, sf):
    return quality.bad_json(table(spark, sf, "pages"), "url").select("page_id")


# ---- services and SQL


@query("SVC07_prices", "SELECT part_id, ship_date, arg_min(amount, (flag, line_number, transaction_id)) AS close FROM line GROUP BY 1, 2")
def _(spark, sf):
    return line(spark, sf).groupBy("part_id", "ship_date").agg(F.min_by("amount", F.struct("flag", "line_number", "transaction_id")).alias("close"))


@query("SVC08_operations", "SELECT o AS operation_id, n, first_seq FROM (VALUES ('op1', (SELECT count(*) FROM txn), (SELECT min(transaction_id) + 1 FROM txn)), ('op2', (SELECT count(*) FROM txn WHERE transaction_id % 2 = 0), (SELECT min(transaction_id) + 10000000000 FROM txn WHERE transaction_id % 2 = 0))) v(o, n, first_seq)")
def _(spark, sf):
    return _log(spark, sf).groupBy("operation_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("SVC09_uncategorized", "SELECT transaction_id, amount FROM txn WHERE category IS NULL ORDER BY abs(amount) DESC, transaction_id LIMIT 40")
def _(spark, sf):
    return txn(spark, sf).where("category is null").orderBy(F.abs("amount").desc(), "transaction_id").limit(40).select("transaction_id", "amount")


@query("SVC10_status", "SELECT (SELECT count(*) FROM account) AS accounts, (SELECT count(*) FROM txn) AS transactions, (SELECT min(transaction_date) FROM txn) AS first_date, (SELECT max(transaction_date) FROM txn) AS last_date, (SELECT count(*) FROM txn WHERE category IS NULL) AS uncategorized")
def _(spark, sf):
    t = txn(spark, sf).agg(F.count("*").alias("transactions"), F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"), F.count_if(F.col("category").isNull()).alias("uncategorized"))
    return account(spark, sf).agg(F.count("*").alias("accounts")).crossJoin(t)


@query("SVC11_duplicate_files", "SELECT h, list_sort(list(doc_id))[1] AS first_id, count(*) AS n FROM (SELECT doc_id, sha256(text) AS h FROM documents) GROUP BY h HAVING count(*) > 1")
def _(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return x.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query("SQLX01_adhoc", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 3 GROUP BY r_name")
def _(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("nation")
    table(spark, sf, "region").createOrReplaceTempView("region")
    return adhoc.query(spark, "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= :low GROUP BY r_name", args={"low": 3})


@query("SQLX02_masking", "SELECT '***' AS c_name, c_nationkey, '***' AS both FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_name", "c_nationkey", F.concat(F.substring("c_name", 1, 3), F.col("c_nationkey").cast("string")).alias("both"))
    return adhoc.mask(c, {"c_nationkey": "public", "c_name": "private"}, {"public"})


@query("SQLX03_catalog", "SELECT * FROM (VALUES ('n_name'), ('n_nationkey'), ('n_regionkey')) v(column_name)")
def _(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("loom_nation")
    return adhoc.schema_catalog(spark).where("table_name = 'loom_nation'").select("column_name")


