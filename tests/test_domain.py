"""Domain operators on small cases worked out by hand or by an independent walk."""

from __future__ import annotations

import difflib
import random
from datetime import date, timedelta
from decimal import Decimal
from types import SimpleNamespace

import numpy as np
import pytest

from ledgerloom import sinks, streaming
from ledgerloom.functions import text as T
from ledgerloom.functions import values as V
from ledgerloom.operators import balances, graph, identity, linkage, lots, quality, reports
from ledgerloom.plans import adhoc
from ledgerloom.sources import delimited, feeds
from pyspark.sql import functions as F

D = Decimal
EVENT = "account_id long, security_id long, event_id long, date date, type string, quantity decimal(28,10), amount decimal(18,2), method string"


def replay(spark, events, method="fifo", picks=None):
    rows = [(1, 1, i, date(2020, 1, 1) + timedelta(days=d), t, None if q is None else D(q), None if a is None else D(a), method) for i, (d, t, q, a) in enumerate(events)]
    out = lots.lots_and_gains(spark.createDataFrame(rows, EVENT), picks).collect()
    return sorted((r for r in out if r["kind"] == "lot"), key=lambda r: r["event_id"]), sorted((r for r in out if r["kind"] == "gain"), key=lambda r: (r["event_id"], r["acquired"]))


def test_fifo_takes_the_oldest_and_keeps_every_cent(spark):
    held, gains = replay(spark, [(0, "buy", 3, 100), (5, "buy", 3, 200), (400, "sell", 4, 100)])
    assert [(g["quantity"], g["basis"], g["proceeds"], g["term"]) for g in gains] == [(D(3), D(100), D(75), "long"), (D(1), D("66.67"), D(25), "long")]
    assert [x["remaining_basis"] for x in held] == [D(0), D("133.33")]


def test_hifo_and_specific(spark):
    _, gains = replay(spark, [(0, "buy", 1, 10), (1, "buy", 1, 30), (2, "sell", 1, 50)], "hifo")
    assert gains[0]["basis"] == D(30)
    held, _ = replay(spark, [(0, "buy", 1, 10), (1, "buy", 1, 30), (2, "sell", 1, 50)])
    _, gains = replay(spark, [(0, "buy", 1, 10), (1, "buy", 1, 30), (2, "sell", 1, 50)], "specific", {2: [(held[1]["lot_id"], D(1))]})
    assert gains[0]["basis"] == D(30)


def test_average_pool_and_its_lots(spark):
    held, gains = replay(spark, [(0, "buy", 10, 100), (1, "buy", 10, 200), (2, "sell", 5, 100)], "average")
    assert gains[0]["basis"] == D(75)
    assert sum(x["remaining_basis"] for x in held) == D(225)


def test_split_return_of_capital_and_oversold(spark):
    held, gains = replay(spark, [(0, "buy", 10, 200), (1, "buy", 100, 10), (2, "return_of_capital", None, 100)])
    assert [x["remaining_basis"] for x in held] == [D("190.91"), D(0)]
    held, gains = replay(spark, [(0, "buy", 10, 100), (1, "split", 2, None), (2, "sell", 25, 250)])
    assert [(g["quantity"], g["basis"], g["incomplete"]) for g in sorted(gains, key=lambda g: g["incomplete"])] == [(D(20), D(100), False), (D(5), D(0), True)]
    assert sum(g["proceeds"] for g in gains) == D(250)


def test_transfer_out_takes_without_gain_and_same_day_buys_come_first(spark):
    held, gains = replay(spark, [(0, "sell", 1, 5), (0, "buy", 2, 8), (3, "transfer_out", 1, None)])
    assert gains[0]["basis"] == D(4) and held[0]["remaining"] == 0 and len(gains) == 1


def test_daily_balances_against_a_walk(spark):
    r = random.Random(4)
    start = date(2024, 1, 1)
    obs = [(a, start + timedelta(days=r.randrange(40)), r.randrange(3), D(r.randrange(1000)), r.choice(["USD", "USD", "EUR", None])) for a in range(5) for _ in range(6)]
    flows = [(a, start + timedelta(days=r.randrange(40)), D(r.randrange(-50, 50)), r.choice(["USD", "EUR", None])) for a in range(5) for _ in range(30)]
    got = balances.daily_balances(spark.createDataFrame(obs, "account_id long, date date, precedence int, balance decimal(18,2), currency_code string"), spark.createDataFrame(flows, "account_id long, date date, amount decimal(18,2), currency_code string"))
    got = {(x["account_id"], x["date"]): (x["balance"], x["currency_code"], x["observed"], x["delta"]) for x in got.collect()}
    end, want = max(o[1] for o in obs), {}
    for a in range(5):
        best = {}
        for _, d, p, b, c in (o for o in obs if o[0] == a):
            k = (p, b, c is not None, c or "")
            if d not in best or k > best[d][0]:
                best[d] = (k, b, c)
        day, bal, cur = min(best), None, None
        while day <= end:
            moved = None if bal is None else bal + sum(f[2] for f in flows if f[0] == a and f[1] == day and f[3] == cur)
            if day in best:
                _, b, c = best[day]
                want[a, day] = (b, c, True, None if moved is None or c != cur else b - moved)
                bal, cur = b, c
            else:
                bal = moved
                want[a, day] = (bal, cur, False, None)
            day += timedelta(days=1)
    assert got == want


def test_assignment_keeps_one_row_of_a_file_in_a_group(spark):
    pairs = spark.createDataFrame([(1, 2, 0.99, "f", "p"), (2, 3, 0.98, "p", "f"), (4, 5, 0.97, "f", "q")], "a long, b long, confidence double, file_a string, file_b string")
    assert sorted((r["a"], r["b"]) for r in linkage.assign(pairs).collect()) == [(1, 2), (4, 5)]
    seeds = spark.createDataFrame([(3, 2, "f", "p")], "a long, b long, file_a string, file_b string")
    assert sorted((r["a"], r["b"]) for r in linkage.assign(pairs, seeds).collect()) == [(4, 5)]


def test_transfers_claim_each_end_once(spark):
    pairs = spark.createDataFrame([(1, 10, D(5), 0, 1.0), (1, 11, D(5), 0, 0.9), (2, 10, D(5), 1, 0.8), (2, 11, D(5), 1, 0.7)], "debit long, credit long, amount decimal(18,2), days long, score double")
    assert sorted((r["debit"], r["credit"]) for r in linkage.claim(pairs).collect()) == [(1, 10), (2, 11)]


def test_keyword_score(spark):
    x = spark.createDataFrame([("online transfer to sav", ""), ("ach wire", "autopay"), ("coffee", "shop"), ("ACH", "WIRE")], "a string, b string")
    assert [r[0] for r in x.select(linkage.keyword_score(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 0.8]


@pytest.mark.parametrize(("a", "b", "s"), [("", "", 0.0), ("MARTHA", "MARHTA", 0.9611), ("ab", "ab", 1.0), ("abc", "xyz", 0.0), ("DIXON", "DICKSONX", 0.8133)])
def test_jaro_winkler(a, b, s):
    assert T._jaro_winkler(a, b) == pytest.approx(s, abs=1e-4)


def test_amounts(spark):
    x = spark.createDataFrame([("(1,234.50)",), ("$12.00",), ("5.00 DR",), ("-5.00 CR",), ("",), ("x",), ("-3",), (None,)], "s string")
    assert [r[0] for r in x.select(V.parse_amount(F.col("s"))).collect()] == [D("-1234.50"), D(12), D(-5), D(5), None, None, D(-3), None]
    y = spark.createDataFrame([("1.234,50",)], "s string")
    assert y.select(V.parse_amount(F.col("s"), "european")).first()[0] == D("1234.50")


def test_date_detection(spark):
    x = spark.createDataFrame([("31/12/2024",), ("01/02/2024",), (None,)], "s string")
    assert V.detect_date_format(x, "s") == "dd/MM/yyyy"
    assert V.detect_date_format(spark.createDataFrame([("nope",)], "s string"), "s") is None


def test_detection_of_files():
    assert delimited.detect("a.csv", b"a;b;c\n1;2;3\n", 20)["delimiter"] == ";"
    assert delimited.detect("a.bin", b"PAR1xxxx", 20)["kind"] == "parquet"
    assert delimited.detect("a.txt", "é|ü\n".encode("cp1252"), 5)["encoding"] == "cp1252"
    with pytest.raises(ValueError):
        delimited.detect("a.csv", b"", 10**9)
    assert delimited.map_columns(["Date", "Debit", "Credit", "Payee"])["tier"] == "high"


def test_ofx_rows():
    rows = feeds.parse_ofx("<OFX><CURDEF>USD<ACCTID>77\n<STMTTRN><TRNAMT>-5.00<FITID>a<DTPOSTED>20240102120000<NAME>x</STMTTRN><LEDGERBAL><BALAMT>9<DTASOF>20240103</OFX>")
    assert [r["kind"] for r in rows] == ["account", "transaction", "balance"] and rows[1]["date"] == "20240102"


@pytest.mark.parametrize("sql", ["DROP TABLE t", "INSERT INTO t SELECT 1", "SELECT * FROM csv.`/etc/passwd`", "SELECT 1; SELECT 2", "SELECT reflect('java.lang.System', 'exit')", "CREATE VIEW v AS SELECT 1", "SELECT * FROM read_files('x')"])
def test_sql_gate_refuses(spark, sql):
    with pytest.raises(adhoc.Refused):
        adhoc.check(spark, sql)


def test_bundle_round_trip():
    data = sinks.bundle({"a.csv": b"1", "b.csv": b"2"})
    assert sinks.verify(data) == []


def test_workbook_needs_openpyxl(spark):
    pytest.importorskip("openpyxl")
    assert sinks.workbook({"a/b": spark.range(2)})[:2] == b"PK"


def test_stream_of_windows(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = streaming.windowed_counts(s).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == e.count()


def test_stream_state(spark, sf, tmp_path):
    pytest.importorskip("google.protobuf")
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = streaming.running_state(s).writeStream.outputMode("update").format("memory").queryName("st").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from st").first()[0] == e.count()


def test_lots_of_all_accounts(spark, sf):
    from ledgerloom.plans import catalog

    want = {r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey").distinct().collect()}
    got = catalog.queries()["DOM30_lots_fifo"](spark, sf).select("account_id").distinct().collect()
    assert {r[0] for r in got} == want


READS = (
    "SELECT * FROM gate_t", "SHOW TABLES", "DESCRIBE gate_t", "VALUES (1), (2)", "FROM gate_t SELECT id",
    "WITH x AS (SELECT id FROM gate_t) SELECT count(*) FROM x WHERE id IN (SELECT id FROM gate_t) GROUP BY id HAVING count(*) > 0 ORDER BY 1 LIMIT 3",
    "SELECT (SELECT max(id) FROM gate_t) m, e FROM gate_t LATERAL VIEW explode(tags) z AS e",
)
WRITES = (
    "WITH x AS (SELECT 1 AS a) INSERT INTO gate_t SELECT * FROM x", "WITH x AS (SELECT 1 a) INSERT OVERWRITE DIRECTORY '/tmp/zz' USING parquet SELECT * FROM x",
    "SELECT * FROM `parquet`.`/etc`", "SELECT (SELECT max(value) FROM text.`/etc/passwd`)", "WITH x AS (SELECT * FROM text.`/etc/passwd`) SELECT * FROM x",
    "DESCRIBE parquet.`/etc`", "DROP TABLE gate_t", "CACHE TABLE gate_t", "SET a=b", "CREATE TABLE z AS SELECT 1", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT 1; SELECT 2",
)


def test_gate_judges_the_plan(spark):
    spark.range(3).selectExpr("id", "array(id) AS tags").createOrReplaceTempView("gate_t")
    for sql in READS:
        adhoc.check(spark, sql)
    for sql in WRITES:
        with pytest.raises(adhoc.Refused):
            adhoc.check(spark, sql)
    with pytest.raises(adhoc.Refused):
        adhoc.check(spark, "SELECT * FROM other.gate_t")
    adhoc.check(spark, "SELECT * FROM other.gate_t", schemas=("other",))


def test_lineage_follows_ids(spark, tmp_path):
    """Wide plans, renaming, common tables, unions and subqueries: what touches a secret is masked."""
    n = 140
    spark.range(1).selectExpr(*[f"'v{i}' AS c{i}" for i in range(n)]).write.parquet(f"{tmp_path}/wide")
    spark.read.parquet(f"{tmp_path}/wide").createOrReplaceTempView("wide_t")
    classes = {f"c{i}": "secret" if i % 3 == 0 else "public" for i in range(n)}
    df = spark.sql("SELECT " + ", ".join(f"concat(c{i}, '') AS d{i}" for i in range(n)) + " FROM wide_t")
    got = adhoc.mask(df, classes, {"public"}).first()
    assert [got[f"d{i}"] for i in range(n)] == ["***" if i % 3 == 0 else f"v{i}" for i in range(n)]
    for sql, want in (
        ("WITH x AS (SELECT c0 AS c1, c2 FROM wide_t) SELECT c1, c2 FROM x", ("***", "v2")),
        ("SELECT c1, c2 FROM wide_t UNION ALL SELECT c0, c4 FROM wide_t", ("***", "v2")),
        ("SELECT (SELECT max(c0) FROM wide_t) AS c1, c2 FROM wide_t", ("***", "v2")),
        ("SELECT first(c3) OVER (PARTITION BY c1 ORDER BY c2) AS c1, c2 FROM wide_t", ("***", "v2")),
        ("SELECT e AS c1, c2 FROM wide_t LATERAL VIEW explode(array(c0)) z AS e", ("***", "v2")),
    ):
        assert tuple(adhoc.mask(spark.sql(sql), classes, {"public"}).first()) == want, sql


def test_claims_in_rounds_are_those_of_the_walk(spark):
    random.seed(5)
    pairs = {(random.randrange(60), 100 + random.randrange(60)) for _ in range(700)}
    rows = [(a, b, D("5.00") if (a + b) % 2 else D("7.00"), 1, 2, random.randrange(4), random.choice([0.6, 0.8, 1.0])) for a, b in sorted(pairs)]
    df = spark.createDataFrame(rows, "debit long, credit long, amount decimal(18,2), from_account long, to_account long, days long, score double")
    want = {(r.debit, r.credit) for r in linkage.claim(df).collect()}
    assert {(r.debit, r.credit) for r in linkage.claim(df, block=0).collect()} == want
    assert linkage.claim(df.limit(0), block=0).count() == 0


ROW = "id string, source string, origin string, file string, account_id long, amount decimal(18,2), date date, currency_code string, description string"


def ledger_rows(spark, *rows):
    day = date(2024, 5, 1)
    return spark.createDataFrame([(i, s, o, f, 1, D(a), day + timedelta(days=d), "USD", t) for i, s, o, f, a, d, t in rows], ROW)


def test_pairs_of_two_origins_with_one_id(spark):
    rows = ledger_rows(spark, ("x", "ofx", "bank a", "f1", 5, 0, "STARBUCKS 12"), ("x", "ofx", "bank b", "f2", 5, 0, "STARBUCKS 12"))
    assert [(r.a, r.b, r.tier) for r in linkage.candidates(rows).collect()] == [("x", "x", "3")]


def test_matching_run_over_decisions(spark):
    rows = ledger_rows(
        spark,
        ("a1", "ofx", "bank", "f1", 5, 0, "STARBUCKS STORE"), ("b1", "plaid", "bank", "p", 5, 1, "STARBUCKS STORE"), ("c1", "csv", "bank", "c", 5, 1, "STARBUCKS STORE"),
        ("a2", "ofx", "bank", "f1", 9, 0, "SHELL OIL"), ("b2", "plaid", "bank", "p", 9, 0, "SHELL OIL"),
        ("a3", "ofx", "bank", "f1", 7, 0, "WHOLE FOODS"), ("b3", "plaid", "bank", "p", 7, 0, "QQQ"),
    )
    made, groups = linkage.match(rows)
    got = {(r.a, r.b): r.status for r in made.collect()}
    assert got.pop(("a3", "b3")) == "pending"
    assert got[("a2", "b2")] == "accepted" and len(got) == 3 and set(got.values()) == {"accepted"}
    assert {r.id: (r.anchor, r.members) for r in groups.collect()} == {"a1": ("a1", 3), "b1": ("a1", 3), "c1": ("a1", 3), "a2": ("a2", 2), "b2": ("a2", 2), "a3": ("a3", 1), "b3": ("b3", 1)}
    before = spark.createDataFrame([("b2", "a2", "rejected"), ("a1", "b1", "accepted"), ("a3", "b3", "pending")], "a string, b string, status string")
    made, groups = linkage.match(rows, before)
    assert len(got2 := {(r.a, r.b) for r in made.collect()}) == 1 and "c1" in next(iter(got2))
    assert {r.id: r.members for r in groups.collect()} == {"a1": 3, "b1": 3, "c1": 3, "a2": 1, "b2": 1, "a3": 1, "b3": 1}
    missing = linkage.unproposed(rows, before)
    assert {frozenset((r.a, r.b)) for r in missing.collect()} == {frozenset(("a1", "c1")), frozenset(("b1", "c1"))}


def test_openings_under_review(spark):
    gaps = spark.createDataFrame([(1, 1, -5), (2, 1, 5), (3, 1, 50), (4, 1, 10), (5, 1, 0)], "account_id long, security_id long, gap int")
    claims = spark.createDataFrame([(3, 1, 20), (4, 1, 10)], "account_id long, security_id long, lot_quantity int")
    assert {r.account_id: r.reason for r in identity.opening_review(gaps, claims).collect()} == {1: "oversold", 2: "no lots", 3: "not covered"}


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "[1]"), (3, "{a"), (4, None), (5, "{}")], "i int, f string")
    assert sorted(r.i for r in quality.bad_fingerprints(df, "f").collect()) == [2, 3, 4]


def test_reports_by_name():
    assert reports.resolve("Cashflow").name == "core:cashflow" == reports.resolve("core:cashflow").name
    with pytest.raises(KeyError):
        reports.resolve("nothing")


def test_open_lots(spark):
    rows = [(1, 1, i, date(2020, 1, 1) + timedelta(days=i), t, D(q), D(a), "fifo") for i, (t, q, a) in enumerate([("buy", 3, 100), ("buy", 3, 200), ("sell", 4, 100)])]
    left = lots.open_lots(spark.createDataFrame(rows, EVENT)).collect()
    assert [(r.acquired, r.remaining, r.remaining_basis) for r in left] == [(date(2020, 1, 2), D(2), D("133.33"))]


def test_merchant_ladder(spark):
    inc = spark.createDataFrame([("a", "Foo"), ("b", "foo!"), ("c", "Bar"), ("d", "Baz"), ("e", "Foo"), ("f", "Baz"), ("g", "Foo"), (None, "Foo"), ("h", None), ("i", "--")], "ref string, name string")
    bound = spark.createDataFrame([("a", "m9")], "ref string, merchant_id string")
    known = spark.createDataFrame([("m1", "FOO")], "merchant_id string, name string")
    weak = spark.createDataFrame([("c", "m2"), ("c", "m3")], "ref string, merchant_id string")
    review = spark.createDataFrame([("a",), ("e",), ("f",)], "ref string")
    no = spark.createDataFrame([("g", "m1")], "ref string, merchant_id string")
    got = {r.ref: (r.action, r.merchant_id) for r in identity.resolve_merchants(inc, bound, known, weak, review, no).collect()}
    assert got.pop("a") == ("adopt", "m9") and got.pop("b") == ("bind", "m1") and got.pop("c") == ("propose", "m2")
    assert got.pop("e") == ("propose", "m1") and got.pop("f") == ("none", None) and got.pop(None) == ("none", None)
    assert {a for a, _ in got.values()} == {"mint"} and got.keys() == {"d", "g", "h", "i"} and len(set(got.values())) == 4


def test_close_names_lose_nothing(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("ABC ") for _ in range(rng.randint(1, 14)))
    known = sorted({make() for _ in range(300)})
    wanted = sorted({make() for _ in range(60)} | {w[:3] + rng.choice("ABC") + w[4:] for w in known[::3]})
    for cutoff in (0.85, 0.92):
        got = identity.close_names(spark.createDataFrame([(w,) for w in wanted], "name string"), spark.createDataFrame([(w,) for w in known], "k_name string"), cutoff)
        assert {(r.name, r.k_name) for r in got.collect()} == {(w, n) for w in wanted for n in difflib.get_close_matches(w, known, 3, cutoff)}


def test_security_ladder(spark):
    cols = "ref string, cusip string, isin string, ticker string, mic string, name string"
    inc = spark.createDataFrame([
        ("bound", None, None, None, None, None), ("waits", "C1", None, None, None, None), ("cusip", " c1 ", None, None, None, None),
        ("split", "C1", "I9", None, None, None), ("isin", None, "I2", None, None, None), ("tie", None, None, "TT", None, None),
        ("half", "C8", None, "TT", None, None), ("abroad", None, None, "AAA", "XLON", None), ("home", None, None, "aaa", None, None),
        ("suffix", None, None, "AAA.L", None, None), ("near", None, None, None, None, "Acme Holdings Inc"), ("far", None, None, None, None, "Zzz"),
        ("no", "C5", None, None, None, "Acme Holding Inc"),
    ], cols)
    known = spark.createDataFrame([
        ("s1", "C1", "I1", None, None, None), ("s2", None, "I2", None, None, None), ("s3", "C3", None, "TT", None, None), ("s4", None, None, "TT", None, None),
        ("s5", None, None, "AAA", "XNYS", None), ("s6", "C6", None, None, None, "ACME HOLDING INC"), ("s7", None, None, None, None, "ACME HOLDING INC"),
    ], cols.replace("ref", "security_id"))
    refs = spark.createDataFrame([("bound", "s9")], "ref string, security_id string")
    pending = spark.createDataFrame([("waits",)], "ref string")
    got, offers = identity.resolve_securities(inc, refs, known, pending)
    how = {r.ref: (r.how, r.security_id) for r in got.collect()}
    assert how["bound"] == ("bound", "s9") and how["waits"] == ("pending", None) and how["cusip"] == ("cusip", "s1") and how["isin"] == ("isin", "s2") and how["home"] == ("ticker", "s5")
    assert {r for r, (h, _) in how.items() if h == "provisional"} == {"split", "tie", "half", "abroad", "suffix", "near", "far", "no"} and len(how) == 13
    want = {("tie", "s3", "identifier_tie"), ("tie", "s4", "identifier_tie"), ("half", "s4", "identifier_tie"), ("abroad", "s5", "exchange_contradiction"), ("suffix", "s5", "ticker_suffix_strip")}
    want |= {("near", "s6", "fuzzy_name"), ("near", "s7", "fuzzy_name"), ("no", "s7", "fuzzy_name")}
    assert {tuple(r) for r in offers.collect()} == want
    no = spark.createDataFrame([("tie", "s3"), ("near", "s6")], "ref string, security_id string")
    new = spark.createDataFrame([("s5",), ("s7",)], "security_id string")
    assert {tuple(r) for r in identity.resolve_securities(inc, refs, known, pending, no, new)[1].collect()} == {("tie", "s4", "identifier_tie"), ("half", "s4", "identifier_tie")}


def test_account_ladder(spark):
    cols = "key string, native_ref string, token string, slug string, last_four string, name string, number string"
    inc = spark.createDataFrame([
        ("pin", "n1", None, None, None, None, None), ("native", "n1", "t2", None, None, None, None), ("token", " ", "t2", None, None, None, None), ("number", None, None, None, None, None, "021000021:7"),
        ("twice", None, "t3", None, None, None, None), ("four", None, None, "Big-Bank", "1111", "Savings", None), ("name", None, None, "other", "9999", "my savings", None),
        ("silent", None, None, None, None, "My-Savings", None), ("retyped", None, None, "bigbank", "2222", "Checking", None), ("reissue", None, None, "bigbank", "2222", "Card", None),
        ("new", None, None, "far", "1111", "Checking", None), ("blank", "", "", "", "", "", None),
    ], cols)
    known = spark.createDataFrame([
        ("a1", "n1", None, "bigbank", "1111", "Checking", None), ("a2", None, "t2", "bigbank", "3333", "Checking", "021000021:7"), ("a3", None, "t3", "x", None, "My Savings", None),
        ("a4", None, "t3", "x", "9999", "My Savings", None), ("a5", None, None, "", "", "", None),
    ], cols.replace("key", "account_id"))
    pins = spark.createDataFrame([("pin", "a9")], "key string, account_id string")
    got = {r.key: (r.how, r.account_id, r.signal, r.proposals) for r in identity.resolve_accounts(inc, known, pins).collect()}
    assert [got[k][:2] for k in ("pin", "native", "token", "number")] == [("pin", "a9"), ("native", "a1"), ("token", "a2"), ("number", "a2")]
    assert {k for k, v in got.items() if v[0] == "minted"} == {"twice", "four", "name", "silent", "retyped", "reissue", "new", "blank"} and len(got) == 12
    offers = {k: v[2:] for k, v in got.items() if v[3]}
    assert offers == {"four": ("institution_last4", ["a1"]), "name": ("name", ["a3"]), "silent": ("name", ["a3"]), "retyped": ("name", ["a1"]), "reissue": ("institution_reissue", ["a1", "a2"]), "new": ("name", ["a1"])}
    few = {r.key: r.proposals for r in identity.resolve_accounts(inc, known, pins, 1).collect()}
    assert few["reissue"] == ["a1"] and few["four"] == ["a1"]


def test_matching_scores_pairs_once(spark, sf):
    """What the run returns reads finished tables: no plan holds the scoring, and blocks cost no call each."""
    from ledgerloom.plans.domain import _rows

    rows = _rows(spark, sf)
    made, accepted = linkage.decide(rows)
    for df in (made, accepted):
        assert "jaro_winkler" not in df._jdf.queryExecution().toString()
    pairs = spark.createDataFrame([(f"a{i:05}", f"b{i:05}", 0.99, "f", "p") for i in range(5000)] + [("a00000", "b99999", 0.98, "f", "p"), ("a00001", "b99998", 0.97, None, None)], "a string, b string, confidence double, file_a string, file_b string")
    taken = linkage.assign(pairs)
    assert "FlatMapGroupsInPandas" not in taken._jdf.queryExecution().toString()
    got = {(r.a, r.b) for r in taken.collect()}
    assert len(got) == 5001 and ("a00000", "b99999") not in got and ("a00001", "b99998") in got


def test_unproposed_duplicates_score_pairs_once(spark, sf):
    """The rows are those of a second scoring; the plan reads finished tables, no orders."""
    from ledgerloom.plans import catalog
    from ledgerloom.plans.domain import _rows

    got = catalog.queries()["DOC03_unproposed_duplicates"](spark, sf)
    assert "orders.parquet" not in got._jdf.queryExecution().toString()
    rows = _rows(spark, sf)
    made, _ = linkage.decide(rows)
    want = linkage.unproposed(rows, made.where(F.pmod(F.xxhash64("a"), F.lit(2)) == 0))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_scoring_stands_once_in_the_plan(spark, sf):
    """A filter on the scores does not have them worked out again, nor each text made canonical for each use."""
    from ledgerloom.plans.domain import _rows

    plan = linkage.classify(linkage.candidates(_rows(spark, sf)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("jaro_winkler(") == 1 and plan.count("regexp_replace(") == 4


def test_agreement_by_patterns_and_by_words(spark):
    """The patterns on canonical texts say what ``names_a_merchant`` says of their words."""
    texts = ["", "ACH", "POS 12", "ACH1", "ACH X", "X ACH", "12 34", "A", "CARD SHELL", "CARD SHELL 9", "CHECK CHECK", "CHECK ÉTÉ 1", "FEES", "AFEE", "1A CARD", "ACH 1B"]
    x = spark.createDataFrame([(t,) for t in texts], "t string")
    words = F.split("t", " ")
    head = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    got = x.select("t", linkage._names(F.col("t")), linkage.names_a_merchant(words), linkage._names(F.col("t"), " "), linkage.names_a_merchant(head)).collect()
    assert all(r[1] == r[2] and r[3] == r[4] for r in got) and len({r[1:] for r in got}) == 3


@pytest.mark.parametrize("nodes", [4, 1 << 18])
def test_components_by_tasks_and_by_rounds(spark, monkeypatch, nodes):
    monkeypatch.setattr(graph, "NODES", nodes)
    r = random.Random(nodes)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)]
    up = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in edges:
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    df = spark.createDataFrame([*edges, (None, 1)], "u long, v long").repartition(5)
    got = graph.components(df).collect()
    assert {x.id: x.comp for x in got} == up and len(got) == len(up)
    # edges that are dealt by component take no round
    stars = spark.createDataFrame([(f"x{i}", f"y{i}") for i in range(50)] + [(f"y{i}", f"z{i}") for i in range(50)], "u string, v string")
    if nodes > 4:
        got = graph.components(stars.repartition(5, F.substring("u", 2, 2)), rounds=0).collect()
        assert {(x.id, x.comp) for x in got} == {(f"{c}{i}", f"x{i}") for c in "xyz" for i in range(50)}


def test_tiers_in_one_walk(spark):
    """The lesser tier is taken first, and the next one's forest grows on it."""
    rows = [(f"a{i}", f"b{i}", t, c, fa, fb) for i in range(3) for t, c, fa, fb in [("2b", 0.96, "f", "g")]] + [("b0", "c0", "3", 0.99, "g", "f"), ("b1", "c1", "3", 0.99, "g", "h")]
    pairs = spark.createDataFrame(rows, "a string, b string, tier string, confidence double, file_a string, file_b string")
    got = {(r.a, r.b, r.tier) for r in linkage.assign(pairs, tiers=True).collect()}
    assert got == {("a0", "b0", "2b"), ("a1", "b1", "2b"), ("a2", "b2", "2b"), ("b1", "c1", "3")}


def test_pairs_across_bands(spark):
    rows = ledger_rows(spark, *[(f"{s}{d}", s, "bank", s, 5, d, "STARBUCKS 12") for s in ("ofx", "plaid") for d in range(60)])
    got = {(r.a, r.b) for r in linkage.candidates(rows).collect()}
    assert got == {(f"ofx{i}", f"plaid{j}") for i in range(60) for j in range(60) if abs(i - j) <= 3}


def booked(events, picks=None):
    """Lots and gains of one group by Book alone, event by event."""
    book = lots.Book(events[0][7], picks or {})
    for _, _, i, d, t, q, a, _ in sorted(events, key=lambda e: (e[3], lots.DAY_ORDER.get(e[4], 1), e[2])):
        e = SimpleNamespace(account_id=events[0][0], security_id=events[0][1], event_id=i, date=d, type=t, quantity=q, amount=a)
        if t in ("buy", "transfer_in", "reinvest"):
            book.add(e)
        elif t in ("sell", "transfer_out"):
            book.take(e)
        elif t == "split":
            book.split(q)
        elif t == "return_of_capital":
            book.give_back(abs(a))
    book.settle()
    return {x["id"]: (x["left"].quantize(D("1e-10")), x["basis"], x["left_basis"]) for x in book.lots} | {g["id"]: (g["lot"], g["acquired"], g["q"], g["basis"], g["proceeds"], g["gain"], g["term"], g["open"]) for g in book.gains}


@pytest.mark.parametrize("method", ["fifo", "hifo", "average"])
def test_walk_in_integers_is_that_of_the_book(spark, method):
    r, events, want = random.Random(method), [], {}
    for account in range(150):
        kinds = ["buy", "buy", "sell", "transfer_in", "transfer_out", "reinvest"] + (["split", "return_of_capital"] if account % 10 == 0 else [])
        big = 10**9 if account % 17 == 0 else 1
        group = []
        for i in range(r.randrange(1, 30)):
            t = r.choice(kinds)
            q = D(r.choice([1, 2, 3])) if t == "split" else D(r.randrange(0, 9999)) / r.choice([1, 100, 10000]) * big
            group.append((account, 7, account * 100 + i, date(2019, 1, 1) + timedelta(days=r.randrange(800) if account % 3 else r.randrange(4)), t, q, D(r.randrange(-5000, 99999)) / 100, method))
        events += group
        want |= booked(group)
    df = lots.lots_and_gains(spark.createDataFrame(events + events[:50], EVENT))
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    got = {x["id"]: (x["remaining"], x["basis"], x["remaining_basis"]) if x["kind"] == "lot" else (x["lot_id"], x["acquired"], x["quantity"], x["basis"], x["proceeds"], x["gain"], x["term"], x["incomplete"]) for x in df.collect()}
    assert got == want


@pytest.mark.parametrize("method", ["fifo", "hifo", "average", "specific"])
def test_groups_side_by_side_are_walked_like_the_book(spark, method):
    """Ties of price, days and cents, oversold and long groups, in small chunks; few groups are left to the slow walk."""
    r, events, want = random.Random(method), [], {}
    for account in range(400):
        group = []
        for i in range(r.choice([1, 2, 5, 12, 40]) if account % 50 else 700):
            t = r.choice(["buy", "buy", "sell", "sell", "transfer_in", "transfer_out", "reinvest"])
            q = D(r.choice([0, 1, 2, 3, 4, 6])) if account % 4 == 0 else D(r.randrange(1, 5000)) / 100
            a = D(r.randrange(1, 4)) / 100 if account % 4 == 0 else D(r.randrange(1, 999999)) / 100
            group.append((account, 7, account * 1000 + i, date(2019, 1, 1) + timedelta(days=r.randrange(4000)), t, q, a, method))
        events += group
        want |= booked(group)
    df = lots.lots_and_gains(spark.createDataFrame(events + events[:50], EVENT), chunk_rows=500)
    got = {x["id"]: (x["remaining"], x["basis"], x["remaining_basis"]) if x["kind"] == "lot" else (x["lot_id"], x["acquired"], x["quantity"], x["basis"], x["proceeds"], x["gain"], x["term"], x["incomplete"]) for x in df.collect()}
    assert got == want


def test_most_groups_are_walked_side_by_side():
    """Without ties a group is never left to the walk of its own."""
    n, per = 3000, 12
    r = np.random.default_rng(1)
    kind = np.where(r.random(n * per) < 0.3, lots.SELL, lots.BUY).astype(np.int8)
    day = np.tile(np.arange(per) * 30, n) + 9000
    quantity, amount = r.integers(1, 50, n * per) * 10**10, r.integers(10**5, 10**7, n * per)
    for method in ("fifo", "hifo", "average"):
        many = lots._Many(np.arange(n) * per, kind, np.arange(n * per), day, quantity, amount, np.full(n, method, object), np.zeros(n * per, bool))
        assert many.bad.mean() < 0.02


@pytest.mark.parametrize("long", [64, 3])
def test_overlaps_against_brute_force(spark, long):
    """Copies, several priorities on one day, long accounts; no plan holds the join of all rows of a day."""
    r = random.Random(long)
    have = {a: [(r.randrange(30), r.choice("pq")) for _ in range(r.randrange(1, 9))] for a in range(60)}
    have |= {100 + a: have[a] for a in range(0, 60, 3)} | {200: [(1, "p"), (1, "q")], 201: [(1, "p"), (1, "q")]}
    rows = spark.createDataFrame([(a, p, date(2020, 1, 1) + timedelta(days=d)) for a, x in have.items() for d, p in x], "account_id long, priority string, transaction_date date")
    few = [a for a, x in have.items() if len(x) <= 5]
    days = {(a, b): len({d for d, p in have[a] if (d, p) in have[b]}) for a in have for b in have if a < b}
    got = graph.overlaps(rows, spark.createDataFrame([(a,) for a in few], "account_id long"), long).collect()
    assert sorted((x.a, x.b, x.days) for x in got) == sorted((a, b, n) for (a, b), n in days.items() if n >= 2 or n == 1 and a in few)
