"""Operator 7: MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct word shingles (64-bit hashes).  Documents with equal sets
are one class, so only distinct sets go on.  Each class has 160 minimum hashes in 32 bands of 5
(a pair at similarity 0.8 shares no band with a chance of 3e-6).  Candidates are compared in
batches of 32 signature positions; after each batch a pair goes if the posterior chance that its
similarity reaches the threshold (uniform prior) is below ``MISS``.  What survives is verified
exactly on the full sets of both texts.

Scale: within a band's bucket no pairs are emitted at first: each member meets only the bucket's
least member.  Components are formed of the verified links; then only members outside a bucket's
largest component meet the others, block by block, and go through the same test and verification.
So the rows that a group of copies costs are linear in it, and every candidate pair between
components is tested.  All joins are on keys that
adaptive execution splits when hot; nothing grows on the driver.

Defined results: null or blank texts have empty sets, link with nothing, and are kept; rows that
share a doc_id are one node; rows with a null doc_id take part as texts but name no component;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .base import cut, only, small_batches
from .components import components

BANDS, ROWS = 32, 5
PERMS = BANDS * ROWS
STEP = 32
#: Words of a shingle and the least similarity of a link that operator 7 is given.
WORDS, PERCENT = 2, 80
MISS = 1e-6
#: Shingles in a block of members of a bucket.
BLOCK = 65_536


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a UTF-8 text; fewer than k words are one shingle."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    if n < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
    out = h[: n - k + 1].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[j : n - k + 1 + j]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def least_matches(threshold: float, miss: float, step: int = STEP, perms: int = PERMS) -> list[tuple[int, int]]:
    """(n, m) for each batch end: after n positions a pair with fewer than m matches is pruned.
    With a uniform prior, P(similarity >= t | m of n) = P(Bin(n + 1, t) <= m)."""
    out = []
    for n in range(step, perms + 1, step):
        cdf = 0.0
        for m in range(n + 1):
            cdf += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if cdf >= miss:
                break
        out.append((n, m))
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, h1, h2 (128 bits of the set), sig and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        a = (rng.integers(0, 2**32, PERMS, np.uint32) | np.uint32(1)).astype(np.uint32)
        b = rng.integers(0, 2**32, PERMS, np.uint32)
        c = rng.integers(0, 2**63, ROWS, np.uint64) | np.uint64(1)
        salt = rng.integers(0, 2**63, BANDS, np.uint64)
        for batch in batches:
            n, h1, h2, sigs, keys = [], [], [], [], []
            for data in batch.column(1).to_pylist():
                s = shingle_set(data or b"", k)
                n.append(len(s))
                if not len(s):
                    h1.append(0), h2.append(0), sigs.append(None), keys.append([])
                    continue
                h1.append(int(np.bitwise_xor.reduce(s * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)))
                h2.append(int(((s ^ (s >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64).astype(np.int64)))
                x = (s >> np.uint64(32)).astype(np.uint32)
                sig = np.full(PERMS, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(x), 2048):
                    part = np.multiply.outer(x[at : at + 2048], a)
                    part += b
                    np.minimum(sig, part.min(axis=0), out=sig)
                key = (sig.reshape(BANDS, ROWS).astype(np.uint64) * c).sum(axis=1, dtype=np.uint64) + salt
                key ^= key >> np.uint64(33)
                key *= np.uint64(0xFF51AFD7ED558CCD)
                sigs.append(sig.tobytes()), keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n", "h1", "h2", "sig", "bands"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary, bands array<long>")


def prune(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(u, v, a, b) with signatures a and b to the (u, v) that the sequential test lets pass."""
    steps = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, PERMS) for i in (2, 3))
            live, same, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
            for n, m in steps:
                same = same + (a[live, done:n] == b[live, done:n]).sum(axis=1)
                keep = same >= m
                live, same, done = live[keep], same[keep], n
            yield batch.select([0, 1]).take(pa.array(live))

    small_batches(pairs.sparkSession)
    return pairs.mapInArrow(run, "u long, v long")


def confirm(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v, a, b) with texts a and b to the (u, v) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if last is None or b != last:
                    last, other = b, shingle_set(b, k)
                s = shingle_set(a, k)
                both = len(np.intersect1d(s, other, assume_unique=True))
                if both and 100 * both >= percent * (len(s) + len(other) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    small_batches(pairs.sparkSession)
    return pairs.mapInArrow(run, "u long, v long")


def links(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """The candidate pairs (u, v) that are links."""
    a, b = sigs.select(F.col("id").alias("u"), F.col("sig").alias("a")), sigs.select(F.col("id").alias("v"), F.col("sig").alias("b"))
    left = cut(prune(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b"), percent / 100, miss))
    ids = cut(left.select(F.col("u").alias("doc_id")).union(left.select("v")).distinct())
    texts = cut(only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), ids, "doc_id"))
    a, b = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b"))
    return cut(confirm(left.join(a, "u").join(b, "v").select("u", "v", "a", "b"), k, percent).distinct())


def block_links(mixed: DataFrame, sigs: DataFrame, docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """(u, v) of different components of a bucket, one of them minor, that are links; at most one for
    each u, component and pair of blocks, as more would connect nothing else.

    A bucket's members are packed into blocks of some ``BLOCK`` shingles, and each block of minor
    members meets all blocks of its bucket.  There each pair goes through the sequential test on the
    signatures, and what passes is verified on the full sets.  So rows are blocks, not pairs."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    texts = only(texts, cut(mixed.select("id").distinct()), "id")
    steps = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x or b"", k).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    sets = cut(texts.mapInArrow(run, "id long, s binary").dropDuplicates(["id"]))
    # a member weighs its set and its signature, which is the larger part of a short text
    parts = mixed.groupBy("key").agg(F.ceil(F.sum(F.col("n") + PERMS) / BLOCK).alias("parts"))
    rows = mixed.join(parts, "key").join(sets, "id").join(sigs, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = cut(rows.select("key", "part", "minor", F.struct("id", "comp", "s", "sig").alias("m")))
    whole = rows.groupBy("key", "part").agg(F.collect_list("m").alias("all"))
    minor = rows.where("minor").groupBy("key", F.col("part").alias("own")).agg(F.collect_list("m").alias("few"))

    def pairs_of(few: list[dict], block: list[dict]) -> Iterator[tuple[int, int]]:
        ids, comps = (np.array([m[c] for m in block], np.int64) for c in ("id", "comp"))
        flat = [np.frombuffer(m["s"], np.uint64) for m in block]
        size = np.array([len(x) for x in flat])
        sig = np.frombuffer(b"".join(m["sig"] for m in block), np.uint32).reshape(-1, PERMS)
        for m in few:
            s, own = np.frombuffer(m["s"], np.uint64), np.frombuffer(m["sig"], np.uint32)
            live = np.nonzero((comps != m["comp"]) & (100 * np.minimum(size, len(s)) >= percent * np.maximum(size, len(s))))[0]
            same, done = np.zeros(len(live), np.int64), 0
            for n, least in steps:
                if not len(live):
                    break
                same = same + (sig[live, done:n] == own[done:n]).sum(axis=1)
                keep = same >= least
                live, same, done = live[keep], same[keep], n
            linked: set[int] = set()
            for j in live[np.argsort(-same, kind="stable")].tolist():
                if int(comps[j]) not in linked:
                    both = len(np.intersect1d(s, flat[j], assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(flat[j]) - both):
                        linked.add(int(comps[j]))
                        yield max(m["id"], int(ids[j])), min(m["id"], int(ids[j]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for few, block in zip(batch.column(0), batch.column(1), strict=True) for p in pairs_of(few.as_py(), block.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

    return cut(minor.join(whole, "key").select("few", "all").mapInArrow(meet, "u long, v long").distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    sk = cut(sketch(docs, k))
    small = sk.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"))
    classes = cut(small)
    reps = sk.where("n > 0").select(F.col("doc_id").alias("id"), "n", "sig", "bands").join(classes.select("id").distinct(), "id", "left_semi")
    keys = reps.select("id", "n", F.explode_outer("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("rep"), F.count("*").alias("c")).where("c > 1")
    members = cut(keys.join(buckets, "key").select("key", "id", "n", F.col("rep.id").alias("rep"), F.col("rep.n").alias("nr"), "c"))
    sigs = cut(reps.select("id", "sig").join(members.select("id").distinct(), "id", "left_semi"))

    star = members.where(f"id <> rep and 100 * least(n, nr) >= {percent} * greatest(n, nr)").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct()
    found = links(star, sigs, docs, k, percent, miss)
    comp = components(found)

    # members outside a bucket's largest component meet those of other components
    m = members.where("c > 2").join(comp, "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
    m = cut(m)
    sizes = m.groupBy("key", "comp").agg(F.count("*").alias("size"))
    major = sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    mixed = cut(m.join(major.select("key", F.col("top.comp").alias("major")), "key").select("key", "id", "n", "comp", (F.col("comp") != F.col("major")).alias("minor")))
    more = block_links(mixed, sigs, docs, k, percent, miss)
    comp = components(comp.select(F.col("id").alias("u"), F.col("comp").alias("v")).unionByName(more))

    classes = classes.join(comp, "id", "left").select("h1", "h2", "n", F.coalesce("comp", "id").alias("comp"))
    out = sk.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=WORDS, percent=PERCENT)


QUERIES = {"op7_minhash_near_dedup": op7_minhash_near_dedup}
ORACLES: dict = {}
