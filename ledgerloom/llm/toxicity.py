"""Operator 9: toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are the words of the lower-cased text (runs of letters), cut to their first five letters,
which takes inflected forms together.  All terms of the labelled examples (at most ``EXAMPLES`` of
each class, those of least hash) are indexed.  A term's weight is ``(1 + ln tf) * idf * relevance``:
document frequencies are over all documents, and the relevance factor (Lan and others, 2009) is
``log2(2 + a / max(1, c))`` for a term that a toxic and c clean examples hold, c in the labels'
proportions.

A document's nearest examples come of a block-max inverted index: similar examples stand side by
side in blocks of ``BLOCK``, each term has its largest weight in each block, and the sums of these
bound the cosine of all examples of a block.  The blocks of the highest bounds are scored first;
after that only blocks whose bound reaches the k-th best.  What is within rounding of the k-th best
is worked out anew, term by term.  Terms of a document that no example holds would scale all
its cosines alike and are left out of its norm.  Votes are weighted by squared cosine and by the
class's share of the labels, and calibrated by isotonic regression on leave-one-out votes.

Scale: two passes over the documents, neither of which shuffles a text; the index is bounded by
the sample and is broadcast.

Defined results: null and empty texts, and texts without a term of any example, score the share of
toxic ones among such examples; without usable labels every score is 0; a label of null is no
label; rows that share a doc_id are scored each by its own text; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .base import cut, small_batches

#: Most labelled examples of the classes 0 and 1.
EXAMPLES = (1_500, 1_000)
NEAREST = 15
#: Examples in a block; blocks that are scored before the bounds are asked.
BLOCK, FIRST = 128, 4
#: Terms and rounds by which similar examples are brought together, and into how many groups.
COMMON, ROUNDS, GROUPS = 256, 6, 16
#: More than the order of a sum can change a cosine by.
SLACK = 1e-9
THRESHOLD = 0.7

STEMS = re.compile(r"([^\W\d_]{1,5})[^\W\d_]*")


def terms_of(text: str | None) -> list[str]:
    """In no order; tokens that are all letters, as most are, need no pattern."""
    tokens = text.lower().split() if text else []
    return [t[:5] for t in tokens if t.isalpha()] + STEMS.findall(" ".join([t for t in tokens if not t.isalpha()]))


class Vocabulary:
    """The known terms; travels as one string, and is made into a dict once a process."""

    def __init__(self, joined: str):
        self.joined, self.known = joined, None

    def __reduce__(self):
        return Vocabulary, (self.joined,)

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known terms in a text, ascending, and how often each stands in it."""
        if self.known is None:
            self.known = {t: i for i, t in enumerate(self.joined.split())}
        got = terms_of(text)
        ids, n = np.unique(np.fromiter(map(self.known.get, got, repeat(-1)), np.int32, len(got)), return_counts=True)
        return (ids[1:], n[1:]) if len(ids) and ids[0] < 0 else (ids, n)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 and so on, size[0] of them, then those of start[1]."""
    end = size.cumsum()
    out = (start - end + size).repeat(size)
    out += np.arange(len(out))
    return out


def alike(x: np.ndarray, groups: int = GROUPS, rounds: int = ROUNDS) -> np.ndarray:
    """An order of the rows of x in which similar ones stand together: by the nearest of some
    centroids, then by how near."""
    n = len(x)
    if n <= BLOCK:
        return np.arange(n)
    x = x / np.maximum(1e-12, np.sqrt((x * x).sum(axis=1, keepdims=True)))
    centre = x[np.linspace(0, n - 1, min(groups, n)).astype(int)]
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        centre = np.stack([x[own == g].sum(axis=0) if (own == g).any() else centre[g] for g in range(len(centre))])
        centre = centre / np.maximum(1e-12, np.sqrt((centre * centre).sum(axis=1, keepdims=True)))
    near = x @ centre.T
    own = np.argmax(near, axis=1)
    return np.lexsort((np.arange(n), -near[np.arange(n), own], own))


class BlockMaxIndex:
    """Examples' vectors by example, and by term in blocks of examples.

    Example i holds the terms ids[start[i] : start[i + 1]], each so often as counts says; ``weight``
    is what a term's part in a vector is multiplied with (idf and relevance)."""

    def __init__(self, start: np.ndarray, ids: np.ndarray, counts: np.ndarray, weight: np.ndarray):
        self.size, self.factor = len(start) - 1, weight
        row = np.repeat(np.arange(self.size), np.diff(start))
        held = np.bincount(ids, minlength=len(weight))
        common = np.full(len(weight), -1)
        top = np.argsort(-held, kind="stable")[:COMMON]
        common[top] = np.arange(len(top))
        dense = np.zeros((self.size, len(top)))
        seen = common[ids] >= 0
        dense[row[seen], common[ids[seen]]] = (1 + np.log(counts[seen].astype(float))) * weight[ids[seen]]
        # place[i]: where example i stands among the blocks
        self.order = alike(dense)
        self.place = np.empty(self.size, np.int64)
        self.place[self.order] = np.arange(self.size)

        at = _runs(start[self.order], np.diff(start)[self.order]) if self.size else np.zeros(0, np.int64)
        self.ids, self.counts = ids[at].astype(np.int32), counts[at].astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.diff(start)[self.order])]).astype(np.int64)
        row = np.repeat(np.arange(self.size), np.diff(self.start))
        w = (1 + np.log(self.counts.astype(float))) * weight[self.ids]
        self.norm = np.sqrt(np.bincount(row, w * w, self.size))
        w /= self.norm[row]
        self.exact = w
        by = np.argsort(self.ids, kind="stable")
        self.who, self.part = row[by], w[by]
        term, block = self.ids[by].astype(np.int64), row[by] // BLOCK
        # postings of one term in one block
        new = np.nonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))[0]
        self.cell = np.append(new, len(term)).astype(np.int64)
        self.block = block[new]
        self.most = np.maximum.reduceat(self.part, new) if len(new) else np.zeros(0)
        self.first = np.searchsorted(term[new], np.arange(len(weight) + 1)).astype(np.int64)
        self.blocks = -(-self.size // BLOCK)
        self.query = None

    def vector(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = counts
        w = (1 + np.log(n)) * self.factor[ids] if len(ids) else np.zeros(0)
        norm = np.sqrt((w * w).sum())
        return ids, w / norm if norm else w

    def example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[self.place[i] : self.place[i] + 2]
        return self.ids[a:b], self.counts[a:b].astype(float)

    def nearest(self, counts: tuple[np.ndarray, np.ndarray], k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k best by cosine, then number; ``but`` is left out."""
        ids, w = self.vector(counts)
        a = self.first.take(ids)
        n = self.first.take(ids + 1) - a
        cells = _runs(a, n)
        q = w.repeat(n)
        block = self.block.take(cells)
        bound = np.bincount(block, q * self.most.take(cells), self.blocks)
        but = int(self.place[but]) if but >= 0 else -1
        got = np.zeros(self.blocks * BLOCK)
        todo = np.zeros(self.blocks, bool)
        todo[np.argsort(-bound, kind="stable")[:FIRST]] = True
        least = 0.0
        for last in (False, True):
            if last:
                todo = ~todo & (bound > 0) & (bound >= least - SLACK)
            use = todo.take(block).nonzero()[0]
            of = cells.take(use)
            a = self.cell.take(of)
            size = self.cell.take(of + 1) - a
            at = _runs(a, size)
            x = self.part.take(at)
            x *= q.take(use).repeat(size)
            got += np.bincount(self.who.take(at), x, len(got))
            if but >= 0:
                got[but] = 0
            seen = got[got > 0] if last else got.reshape(-1, BLOCK)[todo].ravel()
            least = np.partition(seen, -k)[-k] if len(seen) > k else 0.0
        hit = np.nonzero((got > 0) & (got >= least - SLACK))[0]
        score = self._exact(hit, ids, w)
        hit, score = self.order[hit[score > 0]], score[score > 0]
        best = np.lexsort((hit, -score))[:k]
        return hit[best], score[best]

    def _exact(self, rows: np.ndarray, ids: np.ndarray, w: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        if self.query is None:
            self.query = np.zeros(len(self.factor))
        size = self.start[rows + 1] - self.start[rows]
        at = _runs(self.start[rows], size)
        self.query[ids] = w
        x = self.query.take(self.ids.take(at))
        self.query[ids] = 0
        x *= self.exact.take(at)
        return np.add.reduceat(x, np.cumsum(size) - size)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (least x, value) of the weighted monotone fit, by pooling adjacent violators."""
    out: list[list[float]] = []
    for a in np.unique(x):
        m = x == a
        out.append([a, float((w[m] * y[m]).sum()), float(w[m].sum())])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            last = out.pop()
            out[-1][1] += last[1]
            out[-1][2] += last[2]
    return np.array([o[0] for o in out]), np.array([(o[1] + 0.05) / (o[2] + 0.1) for o in out])


class Model:
    """Index, labels with their weights, and calibration."""

    def __init__(self, index: BlockMaxIndex, ids: list[int], labels: np.ndarray, weights: np.ndarray, rest: float):
        self.index, self.ids, self.labels, self.weights, self.rest = index, ids, labels, weights, rest
        self.steps = np.zeros(1), np.zeros(1)

    def vote(self, who: np.ndarray, how: np.ndarray) -> float:
        w = how * how * self.weights[who]
        return float((w * self.labels[who]).sum() / w.sum()) if len(who) else 0.0

    def left_out(self, i: int) -> float:
        """The vote on example i by the others."""
        return self.vote(*self.index.nearest(self.index.example(i), NEAREST, i))

    def score(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[tuple[int, float, int]]]:
        """The calibrated score, and the examples that gave it."""
        who, how = self.index.nearest(counts, NEAREST) if len(counts[0]) else ((), ())
        if not len(who):
            return self.rest, []
        at = np.searchsorted(self.steps[0], self.vote(who, how) + 1e-12, side="right") - 1
        return float(min(1.0, max(0.0, self.steps[1][max(0, at)]))), [(self.ids[i], s, int(self.labels[i])) for i, s in zip(who.tolist(), how.tolist(), strict=True)]


def relevance(ids: np.ndarray, labels: np.ndarray, weights: tuple[float, float], width: int) -> np.ndarray:
    """The factor of each term, from the labels of the example that each posting is of."""
    held = [np.bincount(ids[labels == c], minlength=width) for c in (0, 1)]
    return np.log2(2 + held[1] * weights[1] / np.maximum(1.0, held[0] * weights[0]))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, examples: tuple[int, int] = EXAMPLES) -> tuple:
    """Broadcast vocabulary and model, and the steps of the calibration.  Labels are learnt from rows outside the held-out fold only."""
    y = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    y = cut(y)
    totals = {r["toxic"]: r["c"] for r in y.groupBy("toxic").agg(F.count("*").alias("c")).collect()}
    picked = None
    for c in (0, 1):
        part = y.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples[c])
        picked = part if picked is None else picked.unionByName(part)
    sample = docs.select("doc_id", "text").join(F.broadcast(cut(picked)), "doc_id")  # at most sum(examples) rows

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    sample = cut(sample.select("doc_id", "toxic", "text"))
    size = {r["toxic"]: r["c"] for r in sample.groupBy("toxic").agg(F.count("*").alias("c")).collect()}
    weights = tuple(totals.get(c, 0) / max(1, size.get(c, 0)) for c in (0, 1))
    context = docs.sparkSession.sparkContext

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(terms_of(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["term"])

    # terms are runs of letters, so that blanks keep them apart
    known = sample.select("text").mapInArrow(terms, "term string").distinct().toArrow()["term"].to_pylist()
    vocabulary, width = Vocabulary(" ".join(sorted(known))), len(known)
    del known
    shared = context.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(width, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                df[shared.value.count(text)[0]] += 1
        at = np.nonzero(df)[0]
        for a in range(0, max(1, len(at)), 65_536):
            part = at[a : a + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(df[part], pa.int64())], names=["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64())], names=["term", "n"])

    counts = np.zeros(width + 1)  # the last is the number of documents
    if width:
        got = docs.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        counts[got["term"].to_numpy()] = got["n"].to_numpy()
    idf = np.log((counts[-1] + 1) / (counts[:-1] + 0.5))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.count(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in got], pa.list_(pa.int32())), pa.array([n for _, n in got], pa.list_(pa.int32()))], names=["doc_id", "toxic", "ids", "n"])

    got = sample.select("doc_id", "toxic", "text").mapInArrow(vectors, f"doc_id {kind}, toxic int, ids array<int>, n array<int>").collect()
    rows = sorted((r["doc_id"], r["toxic"], r["ids"], r["n"]) for r in got)
    toxic, clean = (sum(weights[c] for r in rows if not r[2] and r[1] == c) for c in (1, 0))
    some = [r for r in rows if r[2]]
    start = np.cumsum([0, *(len(r[2]) for r in some)])
    flat, often = (np.concatenate([np.zeros(0, np.int32), *(np.array(r[i], np.int32) for r in some)]) for i in (2, 3))
    y = np.array([r[1] for r in some], int)
    factor = idf * relevance(flat, np.repeat(y, np.diff(start)), weights, width)
    model = Model(BlockMaxIndex(start, flat, often, factor), [r[0] for r in some], y.astype(float), np.array(weights)[y], toxic / (toxic + clean + 1))
    del got, rows
    if not some:
        return shared, context.broadcast(model), model.steps
    first = context.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([first.value.left_out(x) for x in i], pa.float64())], names=["id", "vote"])

    got = docs.sparkSession.range(0, len(some), 1, 24).mapInArrow(left_out, "id long, vote double").toArrow()
    votes = np.zeros(len(some))
    votes[got["id"].to_numpy()] = got["vote"].to_numpy()
    return shared, first, isotonic(votes, model.labels, model.weights)


def toxicity(docs: DataFrame, labels: DataFrame, evidence: bool = False) -> DataFrame:
    """All columns of docs with toxic_score, and where asked for the examples that gave it."""
    vocabulary, model, steps = train(docs, labels)
    cols = [c for c in docs.columns if c not in ("toxic_score", "toxic_evidence")]
    add = "toxic_score double" + (", toxic_evidence array<struct<doc_id:long,cosine:double,toxic:int>>" if evidence else "")
    at = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = vocabulary.value, model.value
        m.steps = steps
        for batch in batches:
            got = [m.score(words.count(x)) for x in batch.column(at).to_pylist()]
            more = [pa.array([s for s, _ in got], pa.float64())]
            if evidence:
                flat = [x for _, e in got for x in e]
                parts = [pa.array([x[j] for x in flat], k) for j, k in enumerate((pa.int64(), pa.float64(), pa.int32()))]
                ends = np.cumsum([0, *(len(e) for _, e in got)])
                more.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["doc_id", "cosine", "toxic"])))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "toxic_score", *["toxic_evidence"] * evidence])

    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*cols).dtypes)
    return docs.select(*cols).mapInArrow(run, f"{schema}, {add}")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score, and behind it its evidence: example:cosine:label of the nearest, comma-joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = toxicity(docs, table(spark, sf_dir, "labels"), evidence=True)
    one = lambda e: F.concat_ws(":", e["doc_id"].cast("string"), F.format_number(e["cosine"], 4), e["toxic"].cast("string"))
    evidence = F.array_join(F.transform("toxic_evidence", one), ",").alias("evidence")
    return x.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), evidence)


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict = {}
