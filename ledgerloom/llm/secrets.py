"""Operator 3: secret scans by grammar inference.

Three fixed patterns find the base spans.  Credentials that they label (at most ``SAMPLE`` of
each kind, those of least hash) make a prefix tree each, over character classes; statistically
compatible states are merged (Hoeffding bound, the red and blue fringe of ALERGIA) into a
probabilistic automaton.  Every other candidate, a run of ``LEAST`` or more credential characters
outside the base spans (a span that crosses a run cuts it), is scored by its log-likelihood per
character under the best automaton against that of an automaton of ordinary candidates; what scores
like the labelled ones is added with kind ``grammar``.  Whole credentials are fitted and scored.

Scale: the texts are read twice, to gather the bounded samples and to scan; nothing is shuffled
but the samples, which each task bounds before it sends them.

Defined results: null and empty texts have no spans; rows stand alone, so repeated rows and
clashing columns change nothing; with no labelled credentials nothing is added; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .base import cut, drop, small_batches

KINDS = ("assign", "access", "hex", "grammar")
#: Most credentials of a kind that an automaton is fitted to.
SAMPLE = 400
#: Characters of the shortest candidate, as of the shortest labelled credential.
LEAST = 6
ALPHA = 0.05
#: Most other candidates that the ordinary automaton is fitted to; answers that a worker keeps.
ORDINARY, CACHED = 2_000, 400_000
#: Share of the labelled credentials that may score below the threshold.
TAIL = 0.02

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind index, end, credential), sorted by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list) -> list[tuple[int, int, str]]:
    """Runs of credential characters outside the base spans; a span that a run meets cuts it."""
    if not base:
        return [(*m.span(), m[0]) for m in CANDIDATE.finditer(text)]
    out, at = [], 0
    for a, b in [*((x[0], x[2]) for x in base), (len(text), len(text))]:
        if a > at:
            out += [(*m.span(), m[0]) for m in CANDIDATE.finditer(text, at, a)]
        at = max(at, b)
    return out


#: Digits to 0, a-f to a, g-z to z, A-F to A, G-Z to Z; others stay as they are.
CLASSES = {ord(c): k for k, cs in {"0": "0123456789", "a": "abcdef", "z": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "Z": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in cs}


def classes(s: str) -> str:
    """A character class for each character."""
    return s.translate(CLASSES)


class Automaton:
    """Of a sample of class strings; ``next``: by state, symbol to (state, count); ``ends``, ``total``: counts."""

    def __init__(self, sample: list[str], alpha: float = ALPHA):
        self.next: dict[int, dict[str, list]] = {0: {}}
        self.ends: dict[int, int] = defaultdict(int)
        self.total: dict[int, int] = defaultdict(int)
        self.alpha = alpha
        for s in sorted(sample):
            at = 0
            self.total[at] += 1
            for c in s:
                to = self.next[at].setdefault(c, [len(self.next), 0])
                to[1] += 1
                at = to[0]
                self.next.setdefault(at, {})
                self.total[at] += 1
            self.ends[at] += 1
        self.most = max(1, len(sample))
        self._merge()

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        if not n or not m:
            return False
        return abs(x / n - y / m) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _open(self, n: int) -> bool:
        """Whether a state seen n times can differ from any other by the bound at all; one seen less often can't either."""
        return math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(self.most)) < 1

    def _fits(self, p: int, q: int) -> bool:
        """q is the root of a tree, so this ends; what lies below a state that can't differ can't either."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.total[p], self.total[q]
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for c in {*self.next[p], *self.next[q]}:
                a, b = self.next[p].get(c), self.next[q].get(c)
                if self._differ(a[1] if a else 0, n, b[1] if b else 0, m):
                    return False
                if a and b and self._open(b[1]):
                    todo.append((a[0], b[0]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """q, the root of a tree, into p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.total[p] += self.total[q]
            self.most = max(self.most, self.total[p])
            self.ends[p] += self.ends[q]
            for c, (to, n) in self.next.pop(q).items():
                if c in self.next[p]:
                    self.next[p][c][1] += n
                    todo.append((self.next[p][c][0], to))
                else:
                    self.next[p][c] = [to, n]

    def _merge(self) -> None:
        red = {0: None}
        while True:
            blue = [(r, c) for r in red for c, (to, _) in sorted(self.next[r].items()) if to not in red]
            if not blue:
                return
            r, c = min(blue, key=lambda x: (-self.total[self.next[x[0]][x[1]][0]], x))
            q = self.next[r][c][0]
            for p in red:
                if self._fits(p, q):
                    self.next[r][c][0] = p
                    self._fold(p, q)
                    break
            else:
                red[q] = None

    def score(self, s: str) -> float:
        """Log-likelihood per symbol and end, smoothed by one over 40 symbols."""
        at, out = 0, 0.0
        for c in s:
            to = self.next[at].get(c)
            out += math.log(((to[1] if to else 0) + 0.02) / (self.total[at] + 0.8))
            at = to[0] if to else 0
        out += math.log((self.ends[at] + 0.02) / (self.total[at] + 0.8))
        return out / (len(s) + 1)


class Grammar:
    """Automata by kind with the threshold of each, and the automaton of ordinary candidates."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        self.automata = [Automaton(list(map(classes, labelled[k]))) for k in sorted(labelled) if labelled[k]]
        self.ground = Automaton(list(map(classes, ordinary)))
        self.least = []
        for a, k in zip(self.automata, [k for k in sorted(labelled) if labelled[k]], strict=True):
            own = sorted(a.score(classes(s)) for s in labelled[k])
            self.least.append(own[int(TAIL * len(own))])
        self.known: dict[str, bool] = {}

    def accepts(self, s: str) -> bool:
        x = classes(s)
        out = self.known.get(x)
        if out is None:
            got = max((y for a, least in zip(self.automata, self.least, strict=True) if (y := a.score(x)) >= least), default=None)
            out = got is not None and got > self.ground.score(x)
            if len(self.known) >= CACHED:
                self.known.clear()
            if len(x) <= 256:
                self.known[x] = out
        return out


class Least:
    """The ``size`` different values of least hash of those offered."""

    def __init__(self, size: int):
        self.size, self.found, self.bound = size, {}, 2**64

    def offer(self, value: str) -> None:
        h = xxhash.xxh64_intdigest(value)
        if h < self.bound:
            self.found[value] = h
            if len(self.found) >= 2 * self.size:
                self.shrink()

    def shrink(self) -> None:
        best = sorted(self.found.items(), key=lambda x: (x[1], x[0]))[: self.size]
        self.found = dict(best)
        if len(best) == self.size:
            self.bound = best[-1][1] + 1


def fit(docs: DataFrame, sample: int = SAMPLE, ordinary: int = ORDINARY) -> Grammar:
    """Of at most ``sample`` credentials of each kind and ``ordinary`` other candidates, those of least
    hash of all texts; each task sends no more than that."""
    sizes = (sample, sample, sample, ordinary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [Least(n) for n in sizes]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    for _, k, _, v in base:
                        least[k].offer(v)
                    for _, _, v in candidates(text, base):
                        least[3].offer(v)
        for k, x in enumerate(least):
            x.shrink()
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(x.found), pa.int32()), pa.array([h - 2**63 for h in x.found.values()], pa.int64()), pa.array(list(x.found), pa.string())], names=["kind", "hash", "value"])

    small_batches(docs.sparkSession)
    found = cut(docs.select("text").mapInArrow(run, "kind int, hash long, value string").distinct())
    values = [[r["value"] for r in found.where(F.col("kind") == k).orderBy("hash", "value").limit(n).collect()] for k, n in enumerate(sizes)]
    drop(found)
    return Grammar(dict(zip(KINDS[:3], values[:3], strict=True)), values[3])


def find_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, found: an array of kind, start and end for all spans, the base ones and what was added."""
    grammar = fit(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                spans = [x[:3] for x in base] + [(a, 3, b) for a, b, v in candidates(text or "", base) if grammar.accepts(v)]
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "found"])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and all spans as text."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["kind"] != "grammar")
    return found.select("doc_id", *[n(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES: dict = {}
