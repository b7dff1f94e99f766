"""Operator 6: token counts by a count-only Viterbi search.

An Aho-Corasick automaton enumerates all matches of a unigram vocabulary; dynamic programming
over the characters carries only the best score and the number of pieces.  The rules are those
of the ``tokenizers`` library's Unigram model: blanks become U+2581 with one in front; a
character that is no piece itself scores the least score less 10; of equal scores the match that
starts first wins; unknown characters count as their UTF-8 bytes where the vocabulary has all 256
byte pieces, and a run of them as one piece where it has not.

The vocabulary given is a byte-pair one whose scores are merge ranks; read as a unigram
vocabulary it defines the counts here, which the tests hold against the library itself.

No piece of more than one kind of character has U+2581 behind another one (checked when the
vocabulary is read), so the best path breaks before every such blank.  Hence a text's count is
the sum over its blank-led chunks, and chunks are looked up in a bounded cache.

Defined results: null and empty texts have 0 tokens; rows stand alone, so repeated rows, ties and
further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .base import small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks kept, and the longest that is.
CACHED, CACHED_CHARS = 200_000, 48


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, by id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(m.id_to_piece(i), m.get_score(i)) for i in range(len(m))]
    if any(re.search(f"[^{BLANK}]{BLANK}", p) for p, _ in pieces):
        raise ValueError("a piece has a blank behind another character")
    return pieces


class Counter(dict):
    """Chunk to number of pieces; works out what it has not got."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.bytes = sum(bool(re.fullmatch("<0x[0-9A-F]{2}>", p)) for p, _ in pieces) == 256
        self.find = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.find.add_word(p, (len(p), s))
        if len(self.find):
            self.find.make_automaton()

    def __missing__(self, chunk: str) -> int:
        n = self.count_chunk(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = n
        return n

    def count_chunk(self, s: str) -> int:
        size = len(s)
        best, pieces, loose = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        found = self.find.iter(s) if len(self.find) else iter(())
        at, match = 1, next(found, None)
        while at <= size:
            top, n, last = None, 0, False
            # matches that end here, the longest first
            while match is not None and match[0] == at - 1:
                length, score = match[1]
                got = best[at - length] + score
                if top is None or got > top:
                    top, n, last = got, pieces[at - length] + 1, False
                match = next(found, None)
            c = s[at - 1]
            if c not in self.single:
                got = best[at - 1] + self.unknown
                if top is None or got > top:
                    more = len(c.encode("utf-8", "surrogatepass")) if self.bytes else int(not loose[at - 1])
                    top, n, last = got, pieces[at - 1] + more, True
            best[at], pieces[at], loose[at] = top, n, last
            at += 1
        return pieces[size]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if BLANK in text or "  " in text or text[0] == " " or text[-1] == " ":
            chunks = re.findall(f"{BLANK}+[^{BLANK}]*", BLANK + text.replace(" ", BLANK))
        else:
            chunks = [BLANK + w for w in text.split(" ")]
        return sum(map(self.__getitem__, chunks))


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], key: str = "doc_id") -> DataFrame:
    """key and n_tokens for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces)
        for batch in batches:
            n = [counter.count(x) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict = {}
