"""Audits, doctor checks and validations (AUD, DOC, VAL): each gives the rows that violate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """AUD FKs, DOC21, DOC23-DOC28, VAL12, VAL13: child rows whose key no parent has."""
    p = parent.select(F.col(parent_key or key).alias("_k")).distinct()
    return child.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_k"), "left_anti")


def either_orphans(child: DataFrame, parent: DataFrame, keys: tuple[str, str], parent_key: str) -> DataFrame:
    """DOC25: rows one of whose two keys has no parent."""
    return orphans(child, parent, keys[0], parent_key).union(orphans(child, parent, keys[1], parent_key)).distinct()


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """AUD uniqueness, DOC20, VAL16: keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unbalanced(df: DataFrame, group: str, amount: str = "amount") -> DataFrame:
    """AUD transfers, VAL07: groups whose amounts do not sum to zero."""
    x = df.groupBy(group).agg(F.sum(amount).alias("total"))
    return x.where(~F.col("total").eqNullSafe(F.lit(0).cast(dict(x.dtypes)["total"])))


def sign_violations(df: DataFrame, amount: str, direction: str) -> DataFrame:
    """AUD signs, VAL06: expenses that are not negative, incomes that are not positive."""
    return df.where((F.col(direction) == "expense") & (F.col(amount) >= 0) | (F.col(direction) == "income") & (F.col(amount) <= 0))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """VAL01: nulls of each column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def populated(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """VAL02: rows of each source that should be there, zero where there are none."""
    e = df.sparkSession.createDataFrame([(x,) for x in expected], "source string")
    n = df.groupBy(F.col(column).alias("source")).agg(F.count("*").alias("n"))
    return e.join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """VAL03: least, greatest and mean."""
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.round(F.avg(F.col(column).cast("double")), 4).alias("mean"))


def within(df: DataFrame, column: str, expected: float, percent: float) -> DataFrame:
    """VAL04: whether the number of distinct values is within a tolerance."""
    x = df.agg(F.countDistinct(column).alias("n"))
    return x.select("n", (F.abs(F.col("n") - expected) * 100 <= percent * expected).alias("ok"))


def month_gaps(df: DataFrame, key: str, date: str) -> DataFrame:
    """VAL08: keys with a month missing between their first and last."""
    m = F.trunc(date, "month")
    x = df.groupBy(key).agg(F.countDistinct(m).alias("months"), F.min(m).alias("a"), F.max(m).alias("b"))
    return x.where(F.col("months") < F.months_between("b", "a") + 1).select(key, "months")


def date_bounds(df: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """VAL10: rows out of bounds; null counts as one."""
    d = F.col(column)
    return df.agg(F.count_if(d.isNull() | (d < F.lit(low).cast("date")) | (d > F.lit(high).cast("date"))).alias("violations"))


def schema_errors(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """VAL09, VAL14: columns that are missing or of another type."""
    have = dict(df.dtypes)
    return [f"missing:{c}" if c not in have else f"type:{c}:{have[c]}" for c, t in expected.items() if have.get(c) != t]


def row_count(df: DataFrame, expected: int | None = None, least: int | None = None, percent: float = 0.0) -> bool:
    """VAL11, VAL15: exact, at least, or within a tolerance."""
    if least is not None and expected is None:
        return df.limit(least).count() >= least
    return abs(df.count() - expected) * 100 <= percent * expected


def dedup_balance(raw: DataFrame, core: DataFrame, groups: DataFrame) -> DataFrame:
    """DOC01: rows before, after, and what the groups (group, id) explain."""
    g = groups.groupBy("group").agg((F.count("*") - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("merged"))
    x = raw.agg(F.count("*").alias("raw")).crossJoin(core.agg(F.count("*").alias("core"))).crossJoin(g)
    return x.withColumn("unexplained", F.col("raw") - F.col("core") - F.col("merged"))


def price_disagreement(prices: DataFrame, percent: float = 2.0, marked: DataFrame | None = None) -> DataFrame:
    """DOC15, JON19: sources whose closes for one day lie further apart than that share of their mean."""
    a = prices.select("security_id", "date", F.col("source").alias("a"), F.col("close").cast("double").alias("ca"))
    b = prices.select("security_id", "date", F.col("source").alias("b"), F.col("close").cast("double").alias("cb"))
    x = a.join(b, ["security_id", "date"]).where("b > a").where(F.abs(F.col("ca") - F.col("cb")) * 100 > percent * (F.col("ca") + F.col("cb")) / 2)
    if marked is not None:
        x = x.join(marked, ["security_id", "date"], "left_anti")
    return x.select("security_id", "date", "a", "b").distinct()


def conflicting_refs(*refs: DataFrame) -> DataFrame:
    """DOC12: references that lead to several securities, of (kind, ref, security_id)."""
    x = refs[0]
    for r in refs[1:]:
        x = x.union(r)
    return x.distinct().groupBy("kind", "ref").agg(F.countDistinct("security_id").alias("n")).where("n > 1")


def divergent(df: DataFrame) -> DataFrame:
    """DOC09: (quantity, claimed_quantity, basis, claimed_basis) that disagree beyond a cent or a hundredth of a percent."""
    slack = F.greatest(F.lit(0.01), F.abs(F.col("claimed_basis").cast("double")) * 0.0001)
    return df.where((F.col("quantity") != F.col("claimed_quantity")) | (F.abs((F.col("basis") - F.col("claimed_basis")).cast("double")) > slack))


def unaudited(rows: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """DOC19: rows without an audit event at or after their last change."""
    l = log.groupBy(F.col(key).alias("_k")).agg(F.max("at").alias("_at"))
    return rows.join(l, (F.col(key) == F.col("_k")) & (F.col("_at") >= F.col("updated_at")), "left_anti")


def bad_json(df: DataFrame, column: str) -> DataFrame:
    """DOC29: texts that are not JSON."""
    return df.where(F.col(column).isNotNull() & F.try_parse_json(column).isNull())


def bad_fingerprints(df: DataFrame, column: str) -> DataFrame:
    """DOC31: fingerprints that are null or no JSON object."""
    shape = F.schema_of_variant(F.try_parse_json(column))
    return df.where(~F.coalesce(F.startswith(shape, F.lit("OBJECT")), F.lit(False)))


#: Provider subtypes that the ledger has no legs for.
UNMODELLED = ("buy to cover", "sell short", "assignment", "exercise", "expire", "adjustment", "loan payment", "rebalance")


def unmodelled(df: DataFrame, subtype: str) -> DataFrame:
    """DOC08: rows of a subtype without legs, letters in either case."""
    return df.where(F.lower(subtype).isin(*UNMODELLED))


def unresolved(ledger: DataFrame, staging: DataFrame, key: str) -> DataFrame:
    """DOC11: ledger rows without ``security_id`` whose staging row has a ``source_security_key``."""
    s = staging.where("source_security_key is not null").select(F.col(key).alias("_k")).distinct()
    return ledger.where("security_id is null").join(s, F.col(key) == F.col("_k"), "left_semi")


def unreported(snapshots: DataFrame, holdings: DataFrame) -> DataFrame:
    """DOC13: (origin, file, taken_at, account_id, security_id, security_key, quantity): what the newest file of
    each origin holds and the holdings (account_id, security_id) do not; ties go to the greatest file."""
    newest = snapshots.groupBy(F.col("origin").alias("_o")).agg(F.max_by("file", F.struct("taken_at", "file")).alias("_f"))
    held = holdings.select(F.col("account_id").alias("_a"), F.col("security_id").alias("_s")).distinct()
    x = snapshots.where("quantity > 0").join(newest, F.col("origin").eqNullSafe(F.col("_o")) & (F.col("file") == F.col("_f")))
    x = x.join(held, (F.col("account_id") == F.col("_a")) & (F.col("security_id") == F.col("_s")), "left_anti")
    return x.select("account_id", F.coalesce(F.col("security_id").cast("string"), "security_key").alias("security_key")).distinct()


def format_bounds(formats: DataFrame) -> DataFrame:
    """DOC30: formats (version, times_used, created_at, last_used_at) out of their bounds."""
    return formats.where("version < 1 or times_used < 0 or last_used_at < created_at")


def count_within(df: DataFrame, expected: DataFrame, percent: float = 0.0) -> DataFrame:
    """VAL15: rows against the number in ``expected`` (n), and whether they are within the tolerance."""
    x = df.agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(expected.select(F.col("n").alias("expected"))))
    return x.withColumn("ok", F.abs(F.col("n_rows") - F.col("expected")) * 100 <= percent * F.col("expected"))


def met(kind: str, expected: DataFrame, found: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """VAL17: how many expected rows there are, and how many of them are found with an equal value."""
    f = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *([F.col(value).alias("_value")] if value else [])).distinct()
    on = F.lit(True)
    for k in keys + ([value] if value else []):
        on &= F.col(k).eqNullSafe(F.col("_value" if k == value else f"_{k}"))
    n = expected.agg(F.count("*").alias("expected"))
    return n.crossJoin(expected.join(f, on, "left_semi").agg(F.count("*").alias("met"))).select(F.lit(kind).alias("kind"), "expected", "met")


def f1(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """VAL18: precision, recall and F1 of one set of keys against another, by one full join."""
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("t", F.lit(1))
    x = p.join(t, keys, "full_outer").agg(F.sum(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("tp"), F.count("p").alias("np"), F.count("t").alias("nt"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return x.select("tp", share(F.col("tp"), F.col("np")).alias("precision"), share(F.col("tp"), F.col("nt")).alias("recall"), share(2 * F.col("tp"), F.col("np") + F.col("nt")).alias("f1"))


def class_scores(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """VAL18: precision and recall of each class; null is no class."""
    p = df.groupBy(F.col(predicted).alias("c")).agg(F.count("*").alias("np"), F.count_if(F.col(predicted) == F.col(truth)).alias("tp")).where("c is not null")
    t = df.groupBy(F.col(truth).alias("c")).agg(F.count("*").alias("nt")).where("c is not null")
    x = p.join(t, "c", "full_outer")
    return x.select("c", F.round(F.coalesce(F.col("tp") / F.col("np"), F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(F.col("tp") / F.col("nt"), F.lit(0.0)), 6).alias("recall"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
