"""Operator 1: suffix-array dedup of repeated byte strings.

Every byte goes that a string of ``LENGTH`` bytes covers which starts anywhere else too, in the same
text or another one.  Each window of that length is known by its least 32-byte hash (its
minimizer), so equal windows have equal minimizers, and a text falls into pieces: runs of windows
with one minimizer.  A piece that occurs twice as a whole is repeated throughout.  Where a
minimizer has several different pieces, they meet in one block, whose suffixes are sorted in two
stages: those smaller than their successors directly, by their first ``LENGTH`` bytes, the rest
by scans over the buckets of their first byte, which copy the order of their successors.  The
common prefixes of neighbours, worked out in text order where they do not follow from the one
before, give the windows that occur twice.

Scale: no task holds more than a block.  A minimizer whose different pieces exceed ``HOT`` bytes
(the edges of a passage that a share of all documents hold) is not sorted in one block; its
windows are counted by 128-bit hashes instead, which spread evenly.  Whole copies meet only as
counts.  Texts move twice: those with contested pieces to be cut up, and all to be stripped.

Defined results: null and empty texts, and texts shorter than ``LENGTH`` bytes, lose nothing; rows
with the same text are different places of the same strings; rows are told apart by doc_id and
text hash, a null doc_id included; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .base import cut, small_batches

LENGTH = 400
GRAM = 32
#: Bytes of the different pieces of one minimizer that are sorted in one block.
HOT = 1 << 20
#: Bytes at which a block of several minimizers is closed.
BLOCK = 1 << 19
#: Most windows of a piece.
PIECE = 4096
CHUNK = 1 << 20


def gram_hashes(b: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes (a power of two), by doubling."""
    h = b.astype(np.uint64)
    h += np.uint64(1)
    factor, step = 0x9E3779B97F4A7C15, 1
    while step < size:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % 2**64
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from running minima in blocks of w."""
    n = len(h)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = h
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def pieces(data: bytes, length: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(minimizer, hash, start, windows, whether the minimizer occurs twice in it) of a text's pieces."""
    w = length - GRAM + 1
    b = np.frombuffer(data, np.uint8)
    for at in range(0, len(b) - length + 1, CHUNK):
        part = b[at : at + CHUNK + length - 1]
        h = gram_hashes(part)
        m = sliding_least(h, w)
        starts = np.concatenate([[0], np.nonzero(m[1:] != m[:-1])[0] + 1])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(m)], strict=True):
            least = m[s]
            for a in range(s, e, PIECE):
                n = min(PIECE, e - a)
                twice = np.count_nonzero(h[a : a + n + w - 1] == least) > 1
                yield int(least.astype(np.int64)), xxhash.xxh3_64_intdigest(data[at + a : at + a + n + length - 1]) - 2**63, at + a, n, twice


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t in the order of their first ``depth`` bytes at least (an end comes first)."""
    n = len(t)
    # S: smaller than the successor; equal neighbours take the type of the run's end
    run_end = np.append(np.nonzero(t[1:] != t[:-1])[0], n - 1)
    smaller = np.append(t[run_end[:-1] + 1] > t[run_end[:-1]], False)
    s = np.repeat(smaller, np.diff(np.append(-1, run_end)))
    data = t.tobytes()
    own = np.nonzero(s)[0]
    direct = np.array(sorted(own.tolist(), key=lambda i: data[i : i + depth]), np.int64)
    sizes = np.bincount(t, minlength=256)
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ends = heads + sizes
    order = np.empty(n, np.int64)
    # S suffixes stand at the ends of their buckets, in order
    first = t[direct]
    counts = np.bincount(first, minlength=256)
    at = 0
    for c in np.nonzero(counts)[0].tolist():
        order[ends[c] - counts[c] : ends[c]] = direct[at : at + counts[c]]
        at += counts[c]
    fill = heads.copy()
    # the last suffix is smaller than none: its successor, the end, comes before everything
    order[fill[t[n - 1]]] = n - 1
    fill[t[n - 1]] += 1

    def induce(found: np.ndarray, c: int) -> None:
        """Predecessors that are larger than their successors, to the heads of their buckets."""
        j = found[found > 0] - 1
        j = j[~s[j]]
        if not len(j):
            return
        k = t[j]
        by = np.argsort(k, kind="stable")
        j, k = j[by], k[by]
        cuts = np.append(np.nonzero(k[1:] != k[:-1])[0] + 1, len(k))
        a = 0
        for e in cuts.tolist():
            x = int(k[a])
            order[fill[x] : fill[x] + e - a] = j[a:e]
            fill[x] += e - a
            a = e

    for c in np.nonzero(sizes)[0].tolist():
        done = heads[c]
        # what a scan puts into its own bucket (runs of one byte) is scanned in turn
        while done < fill[c]:
            upto = fill[c]
            induce(order[done:upto].copy(), c)
            done = upto
        induce(order[ends[c] - counts[c] : ends[c]], c)
    return order


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the order the common prefix with the place before.  In text order a prefix
    is one shorter than its forerunner's where both neighbours moved on by one; only the others
    are compared, eight bytes at a time."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    moved = np.zeros(n, bool)
    moved[1:] = (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (t[:-1] == t[np.maximum(before[:-1], 0)])
    at = np.nonzero(~moved & (before >= 0))[0]
    pad = np.zeros(n + 16, np.uint8)
    pad[:n] = t
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | pad[k : k + n + 8].astype(np.uint64)
    got = np.zeros(n, np.int64)
    a, b = at.copy(), before[at]
    live = np.arange(len(at))
    length = np.zeros(len(at), np.int64)
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        room = n - np.maximum(x, y)
        diff = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
        same = np.full(len(live), 8, np.int64)
        odd = diff != 0
        same[odd] = (diff[odd].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        same = np.minimum(same, np.maximum(room, 0))
        length[live] += same
        live = live[(same == 8) & (room > 8)]
    got[at] = length
    head = np.maximum.accumulate(np.where(moved, -1, np.arange(n)))
    got = np.where(moved, np.maximum(0, got[np.maximum(head, 0)] - (np.arange(n) - head)), got)
    out = got[order]
    out[0] = 0
    return out


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text which windows occur twice among all windows of all texts."""
    t = np.frombuffer(b"".join(texts), np.uint8)
    if not len(t):
        return [np.zeros(0, bool) for _ in texts]
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    valid = np.arange(len(t)) + length <= np.repeat(ends, sizes)
    order = suffix_order(t, length)
    group = np.cumsum(common_prefixes(t, order) < length) - 1
    ok = valid[order]
    often = np.bincount(group[ok], minlength=int(group[-1]) + 1) > 1
    mark = np.zeros(len(t), bool)
    mark[order[ok]] = often[group[ok]]
    return [mark[e - n : max(e - n, e - length + 1)] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def runs(mark: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of true."""
    x = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return list(zip(np.nonzero(x == 1)[0].tolist(), np.nonzero(x == -1)[0].tolist(), strict=True))


RUN = pa.struct([("a", pa.int32()), ("b", pa.int32())])
FOUND = "m long, h long, runs array<struct<a:int,b:int>>"


def _found(rows: list[tuple[int, int, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in r[2]] for r in rows], pa.list_(RUN))], names=["m", "h", "runs"])


def sort_blocks(segments: DataFrame, length: int) -> DataFrame:
    """(m, h, c, text) to m, h and the runs of repeated windows of pieces that stand once (c = 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size, last = 0, None

        def close() -> pa.RecordBatch:
            marks = repeated_windows([x[3] for x in block], length)
            out = [(m, h, r) for (m, h, c, _), mark in zip(block, marks, strict=True) if c == 1 and (r := runs(mark))]
            return _found(out)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size >= BLOCK:
                    yield close()
                    block, size = [], 0
                block.append(row)
                size += len(row[3])
                last = row[0]
        if block:
            yield close()

    small_batches(segments.sparkSession)
    return segments.select("m", "h", "c", "text").repartition("m").sortWithinPartitions("m", "h").mapInArrow(run, FOUND)


def count_windows(segments: DataFrame, length: int) -> DataFrame:
    """The same for minimizers with too many pieces, by counting 128-bit hashes of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, h, c, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n = len(text) - length + 1
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[i : i + length]) for i in range(n)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m)), pa.array(np.full(n, h)), pa.array(np.arange(n, dtype=np.int32)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(np.full(n, c))], names=["m", "h", "w", "x", "y", "c"])

    small_batches(segments.sparkSession)
    w = cut(segments.select("m", "h", "c", "text").mapInArrow(run, "m long, h long, w int, x long, y long, c long"))
    often = w.groupBy("x", "y").agg(F.sum("c").alias("n")).where("n > 1").select("x", "y")
    hit = w.where("c = 1").join(often, ["x", "y"], "left_semi").groupBy("m", "h").agg(F.sort_array(F.collect_set("w")).alias("ws"))
    one = F.transform("ws", lambda v: F.struct(v.alias("a"), (v + 1).alias("b")))
    return hit.select("m", "h", one.cast("array<struct<a:int,b:int>>").alias("runs"))


def _cut_up(asked: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Texts of the pieces asked for: (doc_id, th, m, h, c, start, n) to (m, h, c, text)."""
    per = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("m", "h", "c", "start", "n")).alias("want"))
    x = docs.join(per.withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p in want:
                    s = text[p["start"] : p["start"] + p["n"] + length - 1]
                    if xxhash.xxh3_64_intdigest(s) - 2**63 == p["h"]:
                        rows.append((p["m"], p["h"], p["c"], s))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["m", "h", "c", "text"])

    small_batches(docs.sparkSession)
    # rows that share text and id would bring the same piece twice
    return x.mapInArrow(run, "m long, h long, c long, text binary").dropDuplicates(["m", "h"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, th, and spans: an array of byte ranges (a, b) to remove, for texts that have any."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("th"), F.col("text").cast("binary").alias("text"))
    long_ = d.where(F.octet_length("text") >= length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths, rows = [], [], []
            for i, th, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = list(pieces(data, length))
                rows += got
                ids += [i] * len(got)
                ths += [th] * len(got)
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int32()), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)]], names=["doc_id", "th", "m", "h", "start", "n", "twice"])

    small_batches(spark)
    p = cut(long_.mapInArrow(run, "doc_id long, th int, m long, h long, start long, n int, twice boolean"))
    often = p.groupBy("m").agg(F.count("*").alias("c"), F.max("twice").alias("twice")).where("c > 1 or twice").select("m")
    p = cut(p.join(often, "m", "left_semi"))

    classes = cut(p.groupBy("m", "h").agg(F.count("*").alias("c"), F.max("twice").alias("twice"), F.max(F.struct("doc_id", "th", "start", "n")).alias("at")))
    groups = classes.groupBy("m").agg(F.count("*").alias("different"), F.min("c").alias("least"), F.max("twice").alias("any"), F.sum(F.col("at.n") + length - 1).alias("bytes"))
    groups = groups.where("least = 1 and (different > 1 or any)").select("m", (F.col("bytes") > hot).alias("hot"))
    asked = cut(classes.join(groups, "m").select("m", "h", F.when(F.col("c") > 1, 2).otherwise(1).cast("long").alias("c"), "at.doc_id", "at.th", "at.start", "at.n", "hot"))
    cool = sort_blocks(_cut_up(asked.where("not hot"), d, length), length)
    warm = count_windows(_cut_up(asked.where("hot"), d, length), length)
    whole = classes.where("c > 1").select("m", "h", F.array(F.struct(F.lit(0).alias("a"), F.col("at.n").alias("b"))).alias("runs"))
    found = cut(whole.unionByName(cool).unionByName(warm))

    spans = p.join(found, ["m", "h"]).select("doc_id", "th", F.transform("runs", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + length - 1).alias("b"))).alias("s"))
    return spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("s")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def strip_repeats(docs: DataFrame, length: int = LENGTH, text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, where asked for, the kept bytes of each row."""
    spans = repeated_spans(docs, length, hot).withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t")
    x = docs.select("doc_id", F.hash("text").alias("th"), F.col("text").cast("binary").alias("text"))
    x = x.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, cuts = data or b"", merged(found or [])
                kept, at = [], 0
                for a, b in cuts:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept if text else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 4 + text]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + text])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return x.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if text else ""))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, and behind them the text that is left and its code points; a character of which
    only a part is left is replaced by U+FFFD there."""
    x = strip_repeats(table(spark, sf_dir, "documents"), text=True)
    left = F.make_valid_utf8(F.col("kept").cast("string"))
    return x.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", left.alias("text"), F.length(left).cast("long").alias("n_chars"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict = {}
