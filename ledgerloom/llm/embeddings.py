"""Operator 2: embedding near-duplicates on robust-pruned flat graphs.

Equal vectors of a label are one class.  Classes are dealt to cluster shards, each to its two nearest
centroids (centroids are a bounded sample), and shards that are still too large are dealt again.
In each shard every vector's nearest others are pruned to a graph whose edges lead in different
directions; the adjacency lists of a vector from all its shards are united.  A shard is joined by
the vectors of other shards that its members' united lists lead to, with their own lists, and each
member is searched for in that part of the united graph: a greedy search with a beam from the
shard's medoid, and from what it finds near the threshold the range is expanded along the edges,
over the shard's border too, until nothing new is near.  Pairs are verified by cosine in double precision.  ``audit`` measures recall against
brute force for the vectors whose id is divisible by 100.

Scale: a task holds one shard of at most ``LIMIT`` vectors and what their lists lead to.  Shards that no centroid divides (a
ball of near copies) are compared block by block, exactly.  Centroids that are broadcast are
bounded by ``CENTROIDS`` a round; whole copies are counted, never paired.

Defined results: vectors that are null, zero, of no components, or with null or non-finite
components, and vectors with a null label, link with nothing; only vectors of equal length are
compared; rows that share a vec_id and a vector are copies of one another; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .base import cut, small_batches
from .components import components

THRESHOLD = 0.98
#: Vectors a shard aims at and holds at most; centroids of one round of dealing; rounds.
SHARD, LIMIT, CENTROIDS, ROUNDS = 250, 800, 20_000, 3
OVERLAP = 2
#: Out-degree, width of pruning, beam, and how far below the threshold the range is expanded.
DEGREE, ALPHA, BEAM, SLACK = 24, 1.2, 24, 0.03


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def build_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust pruning of each vector's nearest others: one is kept if no kept one is much nearer to it."""
    n = len(x)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    width = min(n - 1, 3 * degree)
    out: list[list[int]] = [[] for _ in range(n)]
    if width <= 0:
        return [np.empty(0, np.int64)] * n
    top = np.argpartition(-near, width - 1, axis=1)[:, :width]
    for i in range(n):
        cand = top[i][np.argsort(-near[i, top[i]], kind="stable")]
        far = 1 - near[i, cand]
        live = np.ones(len(cand), bool)
        kept = out[i]
        while len(kept) < degree:
            k = int(np.argmax(live))
            if not live[k]:
                break
            kept.append(int(cand[k]))
            live &= alpha * (1 - near[cand[k], cand]) > far
            live[k] = False
    # edges lead both ways, so that what is found can be left again; a ring keeps all in reach
    both = [set(o) for o in out]
    for i, o in enumerate(out):
        for j in o:
            if len(both[j]) < 2 * degree:
                both[j].add(i)
        both[i].add((i + 1) % n)
    return [np.array(sorted(b - {i}), np.int64) for i, b in enumerate(both)]


def range_search(x: np.ndarray, graph: list[np.ndarray], start: int, q: np.ndarray, threshold: float, beam: int = BEAM, slack: float = SLACK) -> list[int]:
    """Greedy search with a beam from ``start``, then expansion from all that lies near the threshold."""
    s = float(x[start] @ q)
    seen = {start}
    best, todo = [(s, start)], [(-s, start)]
    reached: list[tuple[float, int]] = [(s, start)]
    while todo:
        d, p = heapq.heappop(todo)
        if len(best) >= beam and -d < best[0][0]:
            break
        new = [j for j in graph[p].tolist() if j not in seen]
        if not new:
            continue
        seen.update(new)
        for c, j in zip((x[new] @ q).tolist(), new, strict=True):
            reached.append((c, j))
            if len(best) < beam or c > best[0][0]:
                heapq.heappush(best, (c, j))
                heapq.heappush(todo, (-c, j))
                if len(best) > beam:
                    heapq.heappop(best)
    front = [j for c, j in reached if c >= threshold - slack]
    found = {j for c, j in reached if c >= threshold - 1e-9}
    while front:
        new = sorted({j for p in front for j in graph[p].tolist()} - seen)
        if not new:
            break
        seen.update(new)
        c = x[new] @ q
        found.update(j for j, v in zip(new, c.tolist(), strict=True) if v >= threshold - 1e-9)
        front = [j for j, v in zip(new, c.tolist(), strict=True) if v >= threshold - slack]
    return sorted(found)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _deal(rows: DataFrame, level: int) -> DataFrame:
    """(grp, cid, vec): members of groups above LIMIT go to the groups of their nearest centroids."""
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > LIMIT)
    sizes = cut(sizes)
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return rows
    parts = F.greatest(F.lit(2), F.least(F.ceil(F.col("n") / SHARD), F.floor(F.lit(float(CENTROIDS)) * F.col("n") / F.lit(float(total))))).cast("int")
    # a sample of fixed size: those of least hash, found without ordering a whole group
    share = sizes.select("grp", parts.alias("parts"), "n")
    u = F.pmod(F.xxhash64("cid", F.lit(level)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    some = rows.join(share, "grp").where(u < 3.0 * F.col("parts") / F.col("n") + 20.0 / F.col("n")).select("grp", "cid", "vec", "parts", u.alias("u"))
    some = some.groupBy("grp", "parts").agg(F.array_sort(F.collect_list(F.struct("u", "cid", "vec"))).alias("s"))
    picked = some.select("grp", F.slice("s", F.lit(1), F.col("parts")).alias("s"))
    centres = {r["grp"]: unit([c["vec"] for c in r["s"]]) for r in picked.toLocalIterator() if len(r["s"]) > 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, at, names = batch.column(0).to_pylist(), [], []
            vec = batch.column(2).to_pylist()
            for i, g in enumerate(grp):
                if g not in centres:
                    at.append(i), names.append(g)
                    continue
                near = centres[g] @ unit([vec[i]])[0]
                for k in np.argsort(-near, kind="stable")[:OVERLAP].tolist():
                    at.append(i), names.append(f"{g}/{k}")
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), kept.column(1), kept.column(2)], names=["grp", "cid", "vec"])

    small_batches(rows.sparkSession)
    return cut(rows.mapInArrow(run, "grp string, cid long, vec array<double>").dropDuplicates(["grp", "cid"]))


def _graphs(rows: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        ids = pdf["cid"].to_numpy()
        graph = build_graph(unit(pdf["vec"].tolist()))
        return pd.DataFrame({"cid": ids, "edges": [ids[g].tolist() for g in graph]})

    return rows.groupBy("grp").applyInPandas(run, "cid long, edges array<long>")


def _search(rows: DataFrame, threshold: float) -> DataFrame:
    """(grp, cid, vec, edges, own) to the pairs found for each shard's own members."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        ids, raw = pdf["cid"].to_numpy(), np.array(pdf["vec"].tolist(), np.float64)
        x = unit(pdf["vec"].tolist())
        graph = []
        for e in pdf["edges"]:
            e = np.asarray(e, np.int64)
            at = np.searchsorted(ids, e)
            graph.append(at[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == e)])
        own = np.nonzero(pdf["own"].to_numpy())[0]
        medoid = int(own[np.argmax(x[own] @ x[own].mean(axis=0))])
        us, vs = [], []
        for i in own.tolist():
            for j in range_search(x, graph, medoid, x[i], threshold):
                if j != i:
                    us.append(i), vs.append(j)
        return _verified(ids, raw, us, vs, threshold)

    return rows.groupBy("grp").applyInPandas(run, "u long, v long")


def _verified(ids: np.ndarray, raw: np.ndarray, us: list, vs: list, threshold: float) -> pd.DataFrame:
    u, v = np.array(us, np.int64), np.array(vs, np.int64)
    ok = cosine(raw[u], raw[v]) >= threshold if len(u) else np.zeros(0, bool)
    a, b = ids[u[ok]], ids[v[ok]]
    return pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b)}).drop_duplicates()


def _blocks(rows: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """All pairs of shards that stayed too large, block by block."""
    x = rows.join(sizes.select("grp", F.ceil(F.col("n") / LIMIT).cast("int").alias("k")), "grp")
    x = x.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int")).select("grp", "cid", "vec", "own", F.explode_outer(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    x = x.select("grp", "cid", "vec", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw, ids = np.array(pdf["vec"].tolist(), np.float64), pdf["cid"].to_numpy()
        left = pdf["own"].to_numpy() == pdf["lo"].iloc[0]
        a, b = np.nonzero(left)[0], np.nonzero(~left)[0] if pdf["lo"].iloc[0] != pdf["hi"].iloc[0] else np.nonzero(left)[0]
        n = unit(pdf["vec"].tolist())
        i, j = np.nonzero(n[a] @ n[b].T >= threshold - 1e-9)
        keep = ids[a[i]] != ids[b[j]]
        return _verified(ids, raw, a[i][keep].tolist(), b[j][keep].tolist(), threshold)

    return x.groupBy("grp", "lo", "hi").applyInPandas(run, "u long, v long")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vec (doubles), cid: the class of equal vectors of a label."""
    v = F.col("embedding").cast("array<double>")
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("vec")).where("label is not null and size(vec) > 0")
    bad = F.exists("vec", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    x = x.where(F.exists("vec", lambda e: e != 0) & ~F.coalesce(bad, F.lit(True)))
    return x.withColumn("cid", F.xxhash64("label", "vec"))


def pairs_found(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The classes (cid, id: least vec_id, c: members) and the pairs (u, v) of them that link."""
    x = cut(usable(vectors))
    classes = cut(x.groupBy("cid").agg(F.min("vec_id").alias("id"), F.count("*").alias("c")))
    rows = x.select(F.concat_ws(":", F.col("label").cast("string"), F.size("vec").cast("string")).alias("grp"), "cid", "vec").dropDuplicates(["cid"])
    rows = cut(rows)
    for level in range(ROUNDS):
        rows = _deal(rows, level)
    sizes = cut(rows.groupBy("grp").agg(F.count("*").alias("n")))
    fit = rows.join(sizes.where(F.col("n") <= LIMIT).select("grp"), "grp", "left_semi")
    large = sizes.where(F.col("n") > LIMIT)
    edges = cut(_graphs(fit).groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")))
    # the border: what members' lists lead to outside their shard
    inside = fit.join(edges, "cid").select("grp", "cid", "vec", "edges", F.lit(True).alias("own"))
    out = inside.select("grp", F.explode_outer("edges").alias("cid")).where("cid is not null").distinct().join(fit.select("grp", "cid"), ["grp", "cid"], "left_anti")
    border = out.join(fit.select("cid", "vec").dropDuplicates(["cid"]).join(edges, "cid"), "cid").select("grp", "cid", "vec", "edges", F.lit(False).alias("own"))
    pairs = _search(inside.unionByName(border), threshold).unionByName(_blocks(rows, large, threshold)).distinct()
    return classes, cut(pairs)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    small_batches(vectors.sparkSession)
    classes, pairs = pairs_found(vectors, threshold)
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    n = both.join(classes.select(F.col("cid").alias("v"), "c"), "v").groupBy("u").agg(F.sum("c").alias("others"))
    ids = classes.select("cid", "id")
    ends = pairs.join(ids.select(F.col("cid").alias("u"), F.col("id").alias("a")), "u").join(ids.select(F.col("cid").alias("v"), F.col("id").alias("b")), "v")
    comp = components(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "node")
    info = classes.join(n.withColumnRenamed("u", "cid"), "cid", "left").join(comp, F.col("id") == F.col("node"), "left")
    info = cut(info.select("cid", (F.coalesce("others", F.lit(0)) + F.col("c") - 1).alias("n"), F.coalesce("comp", "id").alias("comp")))
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", v.alias("vec"))
    rows = rows.select("vec_id", F.when(F.col("label").isNotNull() & F.col("vec").isNotNull(), F.xxhash64("label", "vec")).alias("key"))
    out = rows.join(info, F.col("key") == F.col("cid"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", F.col("vec_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(links found, links there are) of the classes whose least id is divisible by 100, by brute force
    against all classes of the label, in blocks."""
    classes, pairs = pairs_found(vectors, threshold)
    x = usable(vectors).dropDuplicates(["cid"]).join(classes.where("id % 100 = 0").select(F.col("cid").alias("q")), F.col("cid") == F.col("q"), "left")
    q = x.where("q is not null").select("label", F.size("vec").alias("d"), "cid", "vec")
    q = q.groupBy("label", "d", F.pmod(F.xxhash64("cid"), F.lit(16)).alias("b")).agg(F.collect_list(F.struct("cid", "vec")).alias("qs"))
    every = x.select("label", F.size("vec").alias("d"), "cid", "vec").join(q.select("label", "d", "qs"), ["label", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for cid, vec, qs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.array([e["vec"] for e in qs])
                for e, s in zip(qs, cosine(a, np.array([vec] * len(qs))).tolist(), strict=True):
                    if s >= threshold and e["cid"] != cid:
                        us.append(min(e["cid"], cid)), vs.append(max(e["cid"], cid))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    truth = cut(every.select("cid", "vec", "qs").mapInArrow(run, "u long, v long").distinct())
    return truth.join(pairs, ["u", "v"], "left_semi").count(), truth.count()


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embedding_near_dedup": op2_embedding_near_dedup}
ORACLES: dict = {}
