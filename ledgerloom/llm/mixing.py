"""Operator 4: mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key ``-ln(u) / w`` from a hash of its id, scaled by its
quality weight ``w``; sorted ascending within a source, the keys are a weighted random order.
A source's target becomes whole epochs over all its documents first; the rest is the prefix of
the key order whose sizes add up to it, the last document of that prefix in part.

Scale: the prefix sum has two levels.  Sizes are summed by (source, key bucket), the bucket in
which the budget ends is found in those sums, and only that one bucket of each source (at most
about 4 / 65,536 of it) is sorted.  No source, however hot, is ever sorted in one task.

Defined results: a null text has size 0 and is taken 0 times; null ids share one key (ties are
broken by id, then size); a null source is a source of its own, last in order; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .base import cut, word_count
from ..session import table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix has, and the most often that a source may be repeated.
SHARE, REPEATS = 1.5, 2
LEAST_WEIGHT = 0.25
BUCKETS = 65_536
SEED = "mix-1"


def quality_weight(n_chars: Column, size: Column) -> Column:
    """1 for ordinary text; half for under 20 words; half again for odd word lengths."""
    mean = n_chars / F.greatest(size, F.lit(1))
    return F.when(size < 20, 0.5).otherwise(1.0) * F.when(mean.between(3.0, 12.0), 1.0).otherwise(0.5)


def exponential_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / w, u from 52 bits of a hash of the seed and the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(4503599627370496.0)
    return -F.log(u) / weight


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): the budget goes by weight, and
    what lies above a source's cap is reshared by weight.  The level at which this ends is found
    by running sums over the sources in the order in which they reach their caps."""
    by_name, by_cap = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights)) + 1)
    x = sources.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * repeats)
    x = x.withColumn("ratio", F.col("cap") / F.col("w")).withColumn("all", F.sum("source_size").over(W.partitionBy()).cast("double"))
    x = x.withColumn("below", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("above", F.sum("w").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
    x = x.withColumn("level", (F.col("all") * share - F.col("below")) / F.col("above"))
    x = x.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(W.partitionBy())["level"])
    return x.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs and taken for every document.

    ``weight``: a column of quality weights in [0.25, 1]; by default :func:`quality_weight`."""
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("double")
    x = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), n_chars.alias("chars"), *([weight.alias("given")] if weight is not None else []))
    w = F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(1.0), F.coalesce(F.col("given"), F.lit(1.0)))) if weight is not None else quality_weight(F.col("chars"), F.col("size"))
    x = x.withColumn("key", exponential_key(F.col("doc_id"), w, seed))
    bucket = F.floor((1 - F.exp(-LEAST_WEIGHT * F.col("key"))) * BUCKETS).cast("int")
    x = cut(x.select("doc_id", "source", "size", "key", bucket.alias("bucket")))

    sums = cut(x.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", whole).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    run = W.partitionBy("source").orderBy("bucket")
    cum = sums.withColumn("after", F.sum("words").over(run)).withColumnRenamed("source", "s")
    ends = cum.join(goal.select("source", "rest"), F.col("s").eqNullSafe(F.col("source"))).where(F.col("after") > F.col("rest"))
    ends = ends.groupBy("s").agg(F.min(F.struct("bucket", (F.col("after") - F.col("words")).alias("before"))).alias("e"))
    ends = ends.select("s", F.col("e.bucket").alias("last"), F.col("e.before").alias("before"))
    goal = cut(goal.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "g"))

    y = x.join(goal, F.col("source").eqNullSafe(F.col("g"))).drop("g")
    far = y.where("last is null or bucket <> last").withColumn("more", F.when(F.col("bucket") < F.coalesce("last", F.lit(BUCKETS + 1)), F.col("size")).otherwise(F.lit(0)).cast("long"))
    order = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    near = y.where("bucket = last").withColumn("prior", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    near = near.withColumn("more", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("prior"))).cast("long")).drop("prior")
    y = far.unionByName(near)
    return y.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + F.col("more")).alias("taken"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text), 0)::DOUBLE AS chars FROM {{docs}}
), keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / ((CASE WHEN size < 20 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN chars / greatest(size, 1) BETWEEN 3.0 AND 12.0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)) AS key
  FROM sized
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         source_size::DOUBLE * 2 AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM src
), lv AS (
  SELECT *, cap / w AS ratio,
         (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), goal AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(level, ratio) FROM lv WHERE level <= ratio)) AS target FROM lv
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM goal
), run AS (
  SELECT k.doc_id, k.source, k.size, p.source_size, p.target, p.epochs, floor(p.target - p.epochs * p.source_size)::BIGINT AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
  FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source
)"""

SQL = _MIX_SQL.format(docs="documents") + """
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - prior)))::BIGINT AS taken FROM run
"""

QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLES = {"op4_mix_sources": SQL}
