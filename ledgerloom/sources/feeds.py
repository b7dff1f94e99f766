"""Statements, sync payloads, sheets, seeds and made data (SRC08-SRC23)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFX_SCHEMA = "file string, kind string, account_id string, fitid string, date string, amount string, name string, memo string, type string, currency_code string"


def parse_ofx(text: str) -> list[dict]:
    """SRC08: accounts, transactions and balances of an SGML or XML statement."""
    body = text[text.find("<OFX>") :] if "<OFX>" in text else text
    out, account, currency, txn = [], None, None, None
    for m in re.finditer(r"<(/?)([A-Z0-9.]+)>([^<\r\n]*)", body):
        close, tag, value = m[1], m[2], m[3].strip() or None
        if tag == "CURDEF":
            currency = value
        elif tag == "ACCTID":
            account = value
            out.append({"kind": "account", "account_id": account, "currency_code": currency})
        elif tag == "STMTTRN":
            if close:
                out.append({"kind": "transaction", "account_id": account, "currency_code": currency, **txn})
                txn = None
            else:
                txn = {}
        elif tag == "BALAMT":
            out.append({"kind": "balance", "account_id": account, "currency_code": currency, "amount": value})
        elif tag == "DTASOF" and out and out[-1]["kind"] == "balance":
            out[-1]["date"] = (value or "")[:8]
        elif txn is not None and not close:
            key = {"FITID": "fitid", "TRNAMT": "amount", "NAME": "name", "MEMO": "memo", "TRNTYPE": "type"}.get(tag)
            if key:
                txn[key] = value
            elif tag == "DTPOSTED":
                txn["date"] = (value or "")[:8]
    return out


def read_ofx(texts: DataFrame) -> DataFrame:
    """SRC08: (file, text) of whole statements to their rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OFX_SCHEMA.split(", ")]
        for pdf in batches:
            rows = [{"file": f, **r} for f, t in zip(pdf["file"], pdf["text"], strict=True) for r in parse_ofx(t)]
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return texts.select("file", "text").mapInPandas(run, OFX_SCHEMA)


def repair_ids(rows: DataFrame, keys: tuple[str, str] = ("account_id", "fitid"), content: tuple[str, ...] = ("date", "amount", "name", "memo")) -> DataFrame:
    """SRC09: where rows of different content share an id, each gets ``#`` and 8 digits of its content's hash."""
    sig = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]))
    x = rows.withColumn("_sig", sig)
    n = x.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg((F.countDistinct("_sig") > 1).alias("_clash"))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    fixed = F.when(F.col("_clash"), F.concat(F.col(keys[1]), F.lit("#"), F.substring(F.sha2("_sig", 256), 1, 8))).otherwise(F.col(keys[1]))
    return x.join(n, on, "left").withColumn(keys[1], fixed).drop("_sig", "_clash", *[f"_{k}" for k in keys])


def run_recipe(texts: DataFrame, recipe: dict) -> DataFrame:
    """SRC10: lines between two anchors of each text, read by one regular expression with named groups.
    ``recipe``: start, end and row patterns, and a cast for each field."""
    fields = list(recipe["fields"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, end, row = (re.compile(recipe[k]) for k in ("start", "end", "row"))
        for pdf in batches:
            out = []
            for f, t in zip(pdf["file"], pdf["text"], strict=True):
                inside = False
                for i, line in enumerate((t or "").split("\n")):
                    if not inside:
                        inside = bool(start.search(line))
                    elif end.search(line):
                        inside = False
                    elif m := row.search(line):
                        out.append((f, i, *[m[k] for k in fields]))
            yield pd.DataFrame(out, columns=["file", "row", *fields])

    raw = texts.select("file", "text").mapInPandas(run, "file string, row long, " + ", ".join(f"`{k}` string" for k in fields))
    return raw.select("file", "row", *[F.col(k).try_cast(t).alias(k) for k, t in recipe["fields"].items()])


def reconcile_statement(rows: DataFrame, meta: DataFrame, slack: float = 0.01) -> DataFrame:
    """SRC11: (file, amount) against (file, opening, closing)."""
    s = rows.groupBy("file").agg(F.sum("amount").alias("total"))
    diff = (F.col("opening") + F.coalesce("total", F.lit(0)) - F.col("closing")).cast("decimal(18,2)")
    return meta.join(s, "file", "left").select("file", diff.alias("difference"), (F.abs(diff) <= slack).alias("balanced"))


def sync_rows(payloads: DataFrame, schema: str) -> dict[str, DataFrame]:
    """SRC12: (cursor, body) JSON to added, modified and removed rows; ``schema`` is that of a row."""
    x = payloads.select("cursor", F.from_json("body", f"added array<struct<{schema}>>, modified array<struct<{schema}>>, removed array<struct<{schema}>>").alias("b"))
    return {k: x.select("cursor", F.explode(f"b.{k}").alias("r")).select("cursor", "r.*") for k in ("added", "modified", "removed")}


def apply_sync(stored: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """SRC12: the newest image of each row, without those removed last."""
    cols = stored.columns
    base = stored.withColumn("cursor", F.lit(-1).cast("long")).withColumn("_gone", F.lit(False))
    for k, gone in (("added", False), ("modified", False), ("removed", True)):
        base = base.unionByName(parts[k].withColumn("cursor", F.col("cursor").cast("long")).withColumn("_gone", F.lit(gone)), allowMissingColumns=True)
    last = base.groupBy(key).agg(F.max_by(F.struct("_gone", *[c for c in cols if c != key]), F.struct("cursor", "_gone")).alias("r"))
    return last.where("not r._gone").select(key, *[f"r.{c}" for c in cols if c != key]).select(*cols)


def seed_snapshot(old: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """SRC14: rows as JSON under their hash; those that vanished are marked deleted, those that came back are not."""
    body = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    new = rows.select(F.sha2(body, 256).alias("row_hash"), body.alias("data")).dropDuplicates(["row_hash"])
    o = old.select(F.col("row_hash").alias("oh"), F.col("data").alias("od"), F.col("deleted_at").alias("ot"))
    x = new.join(o, F.col("row_hash") == F.col("oh"), "full_outer")
    gone = F.when(F.col("row_hash").isNull(), F.coalesce("ot", F.lit(at).cast("timestamp")))
    return x.select(F.coalesce("row_hash", "oh").alias("row_hash"), F.coalesce("data", "od").alias("data"), gone.alias("deleted_at"))


def drift(df: DataFrame, pinned: list[str], required: list[str]) -> list[str]:
    """SRC15: pinned headers that are missing, and required columns that are null or blank in over half the rows."""
    out = [f"missing:{c}" for c in pinned if c not in df.columns]
    have = [c for c in required if c in df.columns]
    if have:
        row = df.agg(*[F.avg((F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").cast("double")).alias(c) for c in have]).first()
        out += [f"blank:{c}" for c in have if (row[c] or 0.0) > 0.5]
    return out


def typed_view(rows: DataFrame, fields: dict[str, str], carry: tuple[str, ...] = (), data: str = "data") -> DataFrame:
    """SRC16: a column for each JSON key, named in lower case with underscores, cast where it can be."""
    name = lambda k: re.sub(r"[^a-z0-9]+", "_", k.lower()).strip("_")
    return rows.select(*carry, *[F.get_json_object(data, f"$['{k}']").try_cast(t).alias(name(k)) for k, t in fields.items()])


def infer_seed_types(rows: DataFrame, keys: list[str], data: str = "data") -> dict[str, str]:
    """Types for SRC16: bigint, decimal, date or string, by what every value can be cast to."""
    order = ("bigint", "decimal(18,2)", "date")
    v = {k: F.nullif(F.get_json_object(data, f"$['{k}']"), F.lit("")) for k in keys}
    row = rows.agg(*[(F.count(v[k].try_cast(t)) == F.count(v[k])).alias(f"{k}|{t}") for k in keys for t in order]).first()
    return {k: next((t for t in order if row[f"{k}|{t}"]), "string") for k in keys}


def load_feed(df: DataFrame, keys: tuple[str, ...], stored: DataFrame | None = None) -> DataFrame:
    """SRC17, SRC18: dated closes or rates of a feed; what is stored already under the keys stays."""
    x = df.dropDuplicates(list(keys))
    return x if stored is None else x.join(stored.select(*keys), list(keys), "left_anti").unionByName(stored)


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC20: a small CSV with a header, read with its schema."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def resolved(df: DataFrame, links: DataFrame, key: str = "account_key") -> DataFrame:
    """SRC22: the linked account where a link was accepted, the source's own key elsewhere."""
    l = links.where("status = 'accepted'").select(F.col("source_key").alias("_k"), F.col("account_id").alias("_a"))
    return df.join(l, df[key] == F.col("_k"), "left").withColumn("account_id", F.coalesce("_a", key)).drop("_k", "_a")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """SRC23: rows of the caller as a relation."""
    return spark.createDataFrame(rows, schema)


def make_persona(spark: SparkSession, accounts: int, months: int, start: str = "2024-01-01", seed: int = 7) -> DataFrame:
    """SRC21: income, rent, and log-normal spending of any number of accounts, made in parallel from a seed."""
    u = lambda *k: (F.pmod(F.xxhash64(F.lit(seed), *[F.lit(x) if isinstance(x, str) else x for x in k]), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    month = F.explode(F.expr(f"sequence(date'{start}', add_months(date'{start}', {months - 1}), interval 1 month)"))
    base = spark.range(accounts).select((F.col("id") + 1).alias("account_id"), month.alias("month"))
    income = base.select("account_id", F.col("month").alias("date"), F.lit("PAYROLL").alias("description"), F.round(3000 + 2000 * u("pay", F.col("account_id")), 2).alias("amount"))
    rent = base.select("account_id", F.date_add("month", 2).alias("date"), F.lit("RENT").alias("description"), (-F.round(900 + 600 * u("rent", F.col("account_id")), 2)).alias("amount"))
    n = base.select("account_id", "month", F.explode(F.sequence(F.lit(1), F.lit(5) + (10 * u("n", F.col("account_id"), F.col("month"))).cast("int"))).alias("k"))
    key = (F.col("account_id"), F.col("month"), F.col("k"))
    normal = F.sqrt(-2 * F.log(u("a", *key))) * F.cos(2 * 3.141592653589793 * u("b", *key))
    shop = F.element_at(F.array(*[F.lit(s) for s in ("GROCER", "CAFE", "FUEL", "BOOKS")]), (1 + F.floor(4 * u("s", *key))).cast("int"))
    spend = n.select("account_id", F.date_add("month", F.floor(28 * u("d", *key)).cast("int")).alias("date"), shop.alias("description"), (-F.round(F.exp(3 + 0.8 * normal), 2)).alias("amount"))
    return income.unionByName(rent).unionByName(spend).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


