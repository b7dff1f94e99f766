"""Operator 5: benchmark decontamination by spaced-seed hashing.

Fixed masks read five words of a stretch and ignore those between.  Hashes of all stretches of
the documents are joined with those of the benchmark; around each hit, document and item are
laid side by side and compared word by word.  A document is contaminated by an item if, in some
alignment, a window of ``min(16, n)`` consecutive words of the item (n words long) has at most
3 substituted words (n >= 15; 2 for n >= 11, 1 for n >= 8, none below).  Items of fewer than 8 words
are found as whole word runs, by a mask without gaps for each such length that the benchmark has.
The masks catch every such window: of all ways to place the
substitutions, each leaves some mask a clean stretch (see the tests).

Scale: the documents are read once and never shuffled; only hits move.  Seeds are broadcast only
while their number, which is counted, is at most ``BROADCAST_SEEDS``; beyond that hits come of a
shuffled join on the hash, and the texts of documents with hits are joined back by id and words.

Defined results: null or blank texts are never contaminated, and blank items contaminate nothing; words are compared with A-Z
lower-cased; rows that share a doc_id count as one document; a row without doc_id is reported
under null; an empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .base import GAP, ascii_lower, cut

#: Offsets of the words that a seed reads.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 1, 3, 7, 8))
WINDOW = 16
#: Items of fewer words are matched whole.
SPACED_WORDS = 8
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """64-bit hashes of the lower-cased words; an empty array for null and blank."""
    text = F.nullif(F.regexp_replace(ascii_lower(text), "^" + GAP + "|" + GAP + "$", ""), F.lit(""))
    return F.coalesce(F.transform(F.split(text, GAP), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def seeds(toks: Column, masks: tuple) -> Column:
    """For each mask in turn the hash at each word, null where the mask runs over the end; the
    index in the array gives mask and place: mask * size + place."""

    def of(k: int, mask: tuple[int, ...]) -> Column:
        return F.transform(toks, lambda t, i: F.when(i + mask[-1] < F.size(toks), F.xxhash64(F.lit(k), t, *[F.get(toks, i + o) for o in mask[1:]])))

    return F.concat(*[of(k, m) for k, m in enumerate(masks)])


def _places(df: DataFrame, masks: tuple, *keep: str) -> DataFrame:
    """A row for each seed: keep, toks, place, hash.  The seeds are a column before they are exploded,
    so that the explosion is compiled together with the join on the hash, and ``toks`` is copied only
    into rows that the join lets through."""
    x = df.select(*keep, "toks", seeds(F.col("toks"), masks).alias("seeds"))
    x = x.select(*keep, "toks", F.posexplode_outer("seeds").alias("i", "hash"))
    return x.where("hash is not null").withColumn("place", F.col("i") % F.size("toks")).drop("i")


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id and matched: the most words in common in any window, for each pair found."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("toks")).withColumn("n", F.size("toks")).where("n > 0")
    items = cut(items.withColumn("item", F.xxhash64("item_id", "toks")))
    # at most as many lengths as are below the bound
    short = sorted(r["n"] for r in items.where(F.col("n") < SPACED_WORDS).select("n").distinct().collect())
    masks = MASKS + tuple(tuple(range(n)) for n in short)
    marks = cut(_places(items, masks, "item").select("item", F.col("place").alias("at"), "hash").distinct())
    d = docs.select("doc_id", tokens(F.col("text")).alias("toks"))
    if marks.count() <= broadcast_seeds:
        hits = _places(d, masks, "doc_id").join(F.broadcast(marks), "hash")
        hits = hits.join(F.broadcast(items.select("item", F.col("toks").alias("b"), "n", "item_id")), "item")
        hits = _aligned(hits)
    else:
        # rows are found again by id, which may be null, and words; these also part the rows without id
        d = d.withColumn("row", F.xxhash64("toks"))
        found = _places(d, masks, "doc_id", "row").select("doc_id", "row", "hash", "place").join(marks, "hash")
        found = found.select("doc_id", "row", "item", (F.col("place") - F.col("at")).alias("at"), F.lit(0).alias("place")).distinct()
        found = found.withColumn("at", -F.col("at"))
        d = d.select(F.col("doc_id").alias("id"), F.col("row").alias("own"), "toks")
        hits = found.join(d, (F.col("row") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id"))).join(items.select("item", F.col("toks").alias("b"), "n", "item_id"), "item")
        hits = _aligned(hits)
    # written before it is used: an expression that stands in several lambdas would be worked out anew in each
    hits = cut(hits.distinct())
    same = F.transform("b", lambda t, i: F.when(F.get("part", i) == t, 1).otherwise(0))
    width = F.least("n", F.lit(WINDOW))
    sums = F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), lambda s: F.aggregate(F.slice("same", s, width), F.lit(0), lambda a, x: a + x))
    need = width - F.when(width >= 15, 3).when(width >= 11, 2).when(width >= SPACED_WORDS, 1).otherwise(0)
    out = cut(hits.select("doc_id", "item_id", "n", same.alias("same"))).withColumn("matched", F.array_max(sums)).where(F.col("matched") >= need)
    return out.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"))


def _aligned(hits: DataFrame) -> DataFrame:
    """The part of the document beside the item's n words, null beyond the document's ends."""
    shift = F.col("place") - F.col("at")
    # what lies before the document's start is made up of nulls, as is what lies behind its end
    part = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(shift + i >= 0, F.get("toks", shift + i)))
    return hits.select("doc_id", "item_id", "n", "b", part.alias("part"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def contaminated_sql(docs: str, benchmark: str) -> str:
    """The pairs, by joining all equal words and counting along each diagonal."""
    words = "SELECT {id}, unnest(w) AS tok, unnest(range(len(w))) AS pos, len(w) AS n FROM (SELECT {id}, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {t})"
    return f"""
SELECT doc_id, item_id, max(c)::BIGINT AS matched FROM (
  SELECT d.doc_id, b.item_id, b.n,
         count(*) OVER (PARTITION BY d.doc_id, b.item_id, d.pos - b.pos ORDER BY b.pos RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS c
  FROM ({words.format(id='doc_id', t=docs)}) d JOIN ({words.format(id='item_id', t=benchmark)}) b ON d.tok = b.tok
) WHERE c >= least(n, {WINDOW}) - CASE WHEN n >= 15 THEN 3 WHEN n >= 11 THEN 2 WHEN n >= {SPACED_WORDS} THEN 1 ELSE 0 END
GROUP BY doc_id, item_id"""


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES = {"op5_decontaminate": contaminated_sql("documents", "benchmark")}
