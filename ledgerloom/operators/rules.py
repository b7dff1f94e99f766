"""Categorisation: merchants, rules and the cascade (DOM15-DOM21, SNK08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Who may overwrite whom, the strongest first.
PRIORITY = ("user", "rule", "auto_rule", "migration", "ml", "provider_native", "ai")


def _matches(shape: Column, pattern: Column, text: Column) -> Column:
    t, p = F.lower(text), F.lower(pattern)
    return F.when(shape == "exact", t == p).when(shape == "contains", F.contains(t, p)).when(shape == "regex", F.call_function("rlike", t, p)).otherwise(False)


def match_merchants(rows: DataFrame, merchants: DataFrame) -> DataFrame:
    """DOM15: (id, description) and (merchant_id, shape, pattern, exemplars, created_at): an exemplar of
    the normalised text wins, then exact, contains and regex patterns, the oldest first."""
    x = rows.withColumn("n", T.normalize_description(F.col("description")))
    e = merchants.select("merchant_id", "created_at", F.explode("exemplars").alias("e"))
    sets = x.join(e, F.lower("n") == F.lower("e")).select("id", "merchant_id", F.lit(0).alias("rank"), "created_at")
    shape = F.when(F.col("shape") == "exact", 1).when(F.col("shape") == "contains", 2).otherwise(3)
    pats = x.join(F.broadcast(merchants.where("pattern is not null").drop("exemplars")), _matches(F.col("shape"), F.col("pattern"), F.col("n"))).select("id", "merchant_id", shape.alias("rank"), "created_at")
    return sets.unionByName(pats).groupBy("id").agg(F.min_by("merchant_id", F.struct("rank", "created_at", "merchant_id")).alias("merchant_id"))


def match_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """DOM17: (id, description, amount, account_id) and (rule_id, shape, pattern, low, high, only_account,
    category, priority, created_at): the first rule by priority, then age.  Rules are user-made and
    few; their number is checked before they are broadcast."""
    few = rules.count() <= 100_000
    hit = F.coalesce(_matches(F.col("shape"), F.col("pattern"), T.normalize_description(F.col("description"))), F.lit(False))
    hit &= F.coalesce(F.col("amount") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("amount") <= F.col("high"), F.lit(True)) & F.coalesce(F.col("account_id") == F.col("only_account"), F.lit(True))
    x = rows.join(F.broadcast(rules) if few else rules, hit)
    return x.groupBy("id").agg(F.min_by(F.struct("rule_id", "category"), F.struct("priority", "created_at", "rule_id")).alias("r")).select("id", "r.*")


def provider_bridge(rows: DataFrame, bridge: DataFrame, least: float = 0.70) -> DataFrame:
    """DOM18: (id, detailed, primary, confidence) and (code, category): the detailed code first."""
    codes = F.array(F.struct(F.lit(0).alias("rank"), F.col("detailed").alias("code")), F.struct(F.lit(1).alias("rank"), F.col("primary").alias("code")))
    x = rows.where(F.coalesce(F.col("confidence"), F.lit(0.0)) >= least).select("id", F.explode(codes).alias("c")).select("id", "c.*")
    return x.join(bridge, "code").groupBy("id").agg(F.min_by("category", "rank").alias("category"))


def cascade(*steps: tuple[str, DataFrame]) -> DataFrame:
    """DOM19: the category of the first step (name, (id, category)) that has one."""
    every = None
    for k, (name, found) in enumerate(steps):
        part = found.select("id", "category", F.lit(name).alias("categorized_by"), F.lit(k).alias("rank"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(F.min_by(F.struct("category", "categorized_by"), F.struct("rank", "category")).alias("c")).select("id", "c.*")


def guarded_upsert(stored: DataFrame, new: DataFrame, source: str = "categorized_by") -> DataFrame:
    """SNK08: a new row replaces a stored one of the same id unless that one's source ranks higher."""
    rank = F.array_position(F.array(*[F.lit(s) for s in PRIORITY]), F.col(source))
    both = stored.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    cols = stored.columns
    return both.groupBy("id").agg(F.min_by(F.struct(*[c for c in cols if c != "id"]), F.struct(rank, -F.col("_seq"))).alias("r")).select("id", "r.*")


def blast_radius(rows: DataFrame, rules: DataFrame, support: DataFrame, many: int = 20, factor: int = 10) -> DataFrame:
    """DOM21: how many rows each proposed rule would match, and whether that is too broad: at least
    ``many`` and more than ``factor`` times the rows that suggested it (rule_id, n)."""
    hit = F.coalesce(_matches(F.col("shape"), F.col("pattern"), T.normalize_description(F.col("description"))), F.lit(False))
    n = rows.join(F.broadcast(rules.select("rule_id", "shape", "pattern")), hit).groupBy("rule_id").agg(F.count("*").alias("matched"))
    x = rules.select("rule_id").join(n, "rule_id", "left").join(support, "rule_id", "left").select("rule_id", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("n", F.lit(0)).alias("n"))
    return x.withColumn("too_broad", (F.col("matched") >= many) & (F.col("matched") > factor * F.col("n")))
