"""Operator 8: line dedup by an exact set-similarity join.

A line's set holds its distinct words (lower-cased, split at blanks).  Words are ordered by rarity,
from counts of all words of the corpus in a table of fixed size, and then by hash.  Two sets with Jaccard similarity of 0.8 or more share one of the larger one's first
``n - ceil(0.8 n) + 1`` and the smaller one's first ``n - ceil(8 n / 9) + 1`` words; pairs found so pass the length and positional filters, and the
whole sets are compared.  A line goes if an earlier one, by (doc_id, line number), is that
similar; lines without words stay.  Any order of the words gives the same lines; rarity only keeps
the candidates few.

Scale: equal sets are one class, known by its first line, before anything is joined.  Each set
first meets the first one of similar length with a common prefix word, which
settles the members of large groups of copies in linear time; only sets not settled so go through
the full join.  Lines are numbered in order by arithmetic on doc_id where it can be.  Rows that are shuffled hold hashes and numbers, not words; a sketch of 64 bits
among them rules out most pairs before any word is fetched.  What goes to the driver is the
table of word counts, of fixed size.

Defined results: a null text has no lines and is null again; empty texts stay empty; texts
of rows that share a doc_id are told apart by their content; rows that share doc_id and text are one
document and all come out the same; a null doc_id comes first in order; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .base import cut, drop, only

#: Size of the table of word counts.
SLOTS = 1 << 15
PERCENT = 80
#: Bits of a word's hash that are shuffled; what is found is compared on the words themselves.
KEY_BITS = 40
BAND = 1.25
#: Words from which a line's sketch has 128 bits.
WIDE = 64
#: Without effect since groups of every size are held against their first lines; the tests set them.
HOT, SAMPLED = 16, 8
#: Settled sets up to which they are broadcast to the second round's rows.
SETTLED = 1 << 20
#: Columns of the document's place in order and of its lines' numbers.
NO, ID = "document_no", "id"


def numbered(docs: DataFrame) -> tuple[DataFrame, int, bool]:
    """docs with a long ``NO`` for each different document, in the order of (doc_id, text hash), null where the text is; the
    bits that hold a line's number; and whether rows may share a document.  Where no doc_id stands for two texts this is arithmetic; else the documents are sorted."""
    x = docs.where("text is not null")
    th = F.xxhash64("text")
    per = x.groupBy("doc_id").agg(F.min(th).alias("a"), F.max(th).alias("b"), F.max(F.octet_length("text")).alias("o"), F.count("*").alias("c"))
    s = per.agg(F.max(F.col("a") != F.col("b")).alias("mixed"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("o").alias("o"), F.max("c").alias("c")).first()
    bits, again = ((s["o"] or 0) + 1).bit_length(), (s["c"] or 0) > 1
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint") and not s["mixed"]:
        lo, hi = s["lo"] or 0, s["hi"] or 0
        if (hi - lo + 2).bit_length() + bits < 63:
            place = F.coalesce(F.col("doc_id").cast("long") - F.lit(lo) + 1, F.lit(0).cast("long"))
            return docs.withColumn(NO, F.when(F.col("text").isNotNull(), place)), bits, again
    known = x.select(F.col("doc_id").alias("known_id"), th.alias("known_th")).distinct()
    known = cut(known.repartitionByRange("known_id", "known_th").sortWithinPartitions("known_id", "known_th").withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33).cast("int")
    counts = {r["p"]: r["c"] for r in known.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect()}
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(str(total))
        total += counts.get(i, 0)
    first = F.get(F.expr(f"cast(split('{','.join(before) or 0}', ',') as array<bigint>)"), part)
    known = known.select("known_id", "known_th", (first + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias(NO))
    return cut(docs.join(known, docs["doc_id"].eqNullSafe(F.col("known_id")) & (F.xxhash64(docs["text"]) == F.col("known_th")), "left").drop("known_id", "known_th")), bits, again


def _slot(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def rarity(docs: DataFrame) -> Column:
    """A literal array with the class of each slot, in the top bits of a long: the binary logarithm of how often the words of that
    slot occur in all documents, against the mean slot."""
    words = docs.select(F.split(F.lower("text"), "[ \n]").alias("w")).select(F.explode_outer("w").alias("w")).where("w <> ''")
    counts = {r["slot"]: r["c"] for r in words.groupBy(_slot(F.col("w")).alias("slot")).agg(F.count("*").alias("c")).collect()}
    mean = max(1.0, sum(counts.values()) / SLOTS)
    classes = [min(30, int(64 * counts.get(s, 0) / mean).bit_length()) for s in range(SLOTS)]
    return F.expr(f"cast(split('{','.join(str(c << 58) for c in classes)}', ',') as array<bigint>)")


def _words(line: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(line), " "), ""))


def keys_of(docs: DataFrame, bits: int, classes: Column) -> DataFrame:
    """id (the document's number, then the line's) and sorted keys of each line with words.  A word's key is its
    rarity class above 58 bits of its hash, so the rarest words come first."""
    # lines without words go here: a condition on the size of the keys would be moved below them and have them made twice
    x = docs.where("text is not null").select(NO, F.posexplode_outer(F.split(F.lower("text"), "\n")).alias("line", "words")).where(F.trim("words") != "")
    hashes = F.array_distinct(F.array_remove(F.transform(F.split("words", " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))
    # without nulls Spark sorts the longs as such
    key = lambda h: F.coalesce(F.get(classes, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")), F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(h, 6))
    return x.select(F.shiftleft(NO, bits).bitwiseOR(F.col("line").cast("long")).alias(ID), F.sort_array(F.transform(hashes, key)).alias("keys"))


def _parity(hashes: Column) -> Column:
    """64 bits: of each the parity of how many hashes fall on it.  Two sets differ in as many
    elements at least as their sketches differ in bits."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))))


def _ids(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), a the earlier one, the b of pairs whose sets are similar, as ``id``.  Sketches of 256
    bits are compared first, so that words travel only with pairs that are all but similar."""
    side = lambda s: sets.select(F.col("id").alias(s), F.size("words").alias(f"n{s}"), *[F.col(f"s{j}").alias(f"{s}{j}") for j in range(4)])
    differ = sum((F.bit_count(F.col(f"a{j}").bitwiseXOR(F.col(f"b{j}"))) for j in range(1, 4)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    total = F.col("na") + F.col("nb")
    x = cut(pairs.join(side("a"), "a").join(side("b"), "b").where((100 + percent) * differ <= (100 - percent) * total).select("a", "b"))
    y = x.join(sets.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    # the intersection stands once in the condition, as it is worked out each time that it does
    both = F.size(F.array_intersect("wa", "wb"))
    out = cut(y.where((100 + percent) * both >= percent * (F.size("wa") + F.size("wb"))).select(F.col("b").alias("id")).distinct())
    drop(x)
    return out


def _words_of(ids: DataFrame, docs: DataFrame, bits: int) -> DataFrame:
    """id and words of the lines asked for, read again from the texts.  Of the documents only
    those that a Bloom filter of their numbers lets through are shuffled."""
    line = F.col("id").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    want = cut(ids.groupBy(F.shiftright("id", bits).alias("no")).agg(F.collect_list(F.struct("id", line.alias("line"))).alias("want")))
    x = only(docs.where("text is not null").select(F.col(NO).alias("no"), F.split("text", "\n").alias("lines")), want.select("no"), "no")
    x = x.join(want, "no")
    # the lines asked for only, before the rows are multiplied
    x = x.select(F.transform("want", lambda w: F.struct(w["id"].alias("id"), F.get("lines", w["line"]).alias("text"))).alias("want"))
    x = x.select(F.explode_outer("want").alias("w"))
    got = cut(x.select("w.id", _words(F.col("w.text")).alias("words")).dropDuplicates(["id"]))
    x = got.select("id", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    part = lambda j: F.filter("h", lambda k: F.shiftrightunsigned(k, 6).bitwiseAND(F.lit(3)) == j)
    out = cut(x.select("id", "words", *[_parity(part(j)).alias(f"s{j}") for j in range(4)]))
    drop(want, got, ids)
    return out


def repeated_lines(docs: DataFrame, bits: int, percent: int = PERCENT) -> DataFrame:
    """id of each line that goes, of documents as ``numbered`` gives them."""
    mask = F.lit((1 << KEY_BITS) - 1)
    n = F.size("keys")
    most = (n - F.ceil(n * percent / 100.0 - 1e-9) + 1).cast("int")
    # a sketch of 64 bits, of 128 for long lines, whose second half is 0 for short ones
    low, high = (_parity(F.filter("keys", lambda k: F.shiftrightunsigned(k, 6).bitwiseAND(F.lit(1)) == j)) for j in (0, 1))
    sketch, more = F.when(n >= WIDE, low).otherwise(_parity(F.col("keys"))), F.when(n >= WIDE, high).otherwise(F.lit(0).cast("long"))
    pre = F.when(n >= 4, F.transform(F.slice("keys", F.lit(1), most), lambda k: k.bitwiseAND(mask)))
    x = keys_of(docs, bits, rarity(docs))
    lines = cut(x.select("id", F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2"), n.alias("n"), sketch.alias("sketch"), more.alias("more"), pre.alias("pre")))

    # equal sets are one class, known by its first line; the other lines of a class go
    first = lines.groupBy("h1", "h2").agg(F.min("id").alias("first")).select("first")
    x = lines.drop("h1", "h2").join(first, F.col("id") == F.col("first"), "left").withColumn("later", F.col("first").isNull()).drop("first")
    classes = cut(x.withColumn("pre", F.when(~F.col("later"), F.col("pre"))))
    drop(lines)
    again, classes_ = classes.where("later").select("id"), classes.where("not later and n >= 4").drop("later")

    # of two similar sets the smaller one has the first common word among so many of its first
    few = F.slice("pre", F.lit(1), (F.col("n") - F.floor((2 * percent * F.col("n") + 99 + percent) / (100 + percent)) + 1).cast("int"))

    def prefixes(t: DataFrame, words: Column) -> DataFrame:
        """key, id, np (set size, whether settled, and place, in one long) and sketch for each prefix word."""
        x = t.select("id", "n", "sketch", "more", "done", F.posexplode(words).alias("pos", "key"))
        np = F.shiftleft(F.col("n").cast("long"), 33).bitwiseOR(F.shiftleft(F.col("done").cast("long"), 32)).bitwiseOR(F.col("pos").cast("long"))
        return x.select("key", "id", np.alias("np"), "sketch", "more")

    def side(t: DataFrame, s: str) -> DataFrame:
        return t.select("key", *[F.col(c).alias(f"{c}_{s}") for c in t.columns if c != "key"])

    size = lambda s: F.shiftright(f"np_{s}", 33)
    place = lambda s: F.col(f"np_{s}").bitwiseAND(F.lit((1 << 32) - 1))
    total = size("a") + size("b")
    # similar sets pass this at the first key they share: nothing before it is common, so what is left bounds the overlap
    near = 100 * F.least(size("a"), size("b")) >= percent * F.greatest(size("a"), size("b"))
    near &= (100 + percent) * F.least(size("a") - place("a"), size("b") - place("b")) >= percent * total
    folded = lambda s: F.col(f"sketch_{s}").bitwiseXOR(F.col(f"more_{s}"))
    differ = F.when((size("a") >= WIDE) & (size("b") >= WIDE), F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b"))) + F.bit_count(F.col("more_a").bitwiseXOR(F.col("more_b")))).otherwise(F.bit_count(folded("a").bitwiseXOR(folded("b"))))
    near &= (100 + percent) * differ <= (100 - percent) * total

    # sets of similar size with a common prefix word first meet the first of them, in one sorted pass
    band = F.floor(F.log(F.shiftright("np", 33).cast("double")) / F.log(F.lit(BAND))).cast("long")
    p = prefixes(classes_.withColumn("done", F.lit(0)), few).withColumn("key", F.shiftleft("key", 8).bitwiseOR(band))
    group = Window.partitionBy("key").orderBy("id_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    star = side(p, "b").withColumn("h", F.first(F.struct(*[F.col(f"{c}_b").alias(f"{c}_a") for c in ("id", "np", "sketch", "more")])).over(group))
    star = cut(star.select("id_b", "np_b", "sketch_b", "more_b", "h.*").where(F.col("id_a") < F.col("id_b")).where(near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())
    sets = _words_of(_ids(star), docs, bits)
    settled = _similar(star, sets, percent)
    drop(sets, star)

    # sets that are not settled meet all others with a common prefix word, of which the smaller set (a) brings fewer; what is
    # settled is told by a bit and asked of the later set of a pair.
    done = settled.withColumn("done", F.lit(1))
    done = F.broadcast(done) if settled.count() <= SETTLED else done
    x = classes_.join(done, "id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    settled_ = lambda s: F.shiftright(f"np_{s}", 32).bitwiseAND(F.lit(1)) == 1
    earlier = F.col("id_a") < F.col("id_b")
    once = (size("a") < size("b")) | ((size("a") == size("b")) & earlier)
    pairs = side(prefixes(x, F.col("pre")), "b").join(side(prefixes(x, few), "a"), "key").where(once & near & ~F.when(earlier, settled_("b")).otherwise(settled_("a")))
    pairs = cut(pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())
    later = cut(again)
    drop(classes)

    # one earlier match is enough, so each set is first held against its earliest candidate alone
    first = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    sets = _words_of(_ids(pairs), docs, bits)
    early = _similar(first, sets, percent)
    rest = cut(pairs.join(early.withColumnRenamed("id", "b"), "b", "left_anti").join(first, ["a", "b"], "left_anti").select("a", "b"))
    late = _similar(rest, sets, percent)
    drop(sets, pairs, first, rest)
    out = cut(later.union(settled).union(early).union(late).distinct())
    drop(later, settled, early, late)
    return out


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All rows and columns of docs, the text without the lines that go, with n_lines and n_removed."""
    named, bits, again = numbered(docs)
    x = named.select(NO, "text")
    gone = repeated_lines(x.dropDuplicates([NO]) if again else x, bits, percent)
    gone = gone.groupBy(F.shiftright("id", bits).alias("gone_no")).agg(F.collect_list(F.col("id").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")).alias("gone_lines"))
    x = named.join(gone, F.col(NO) == F.col("gone_no"), "left")
    lines = F.split("text", "\n")
    keep = F.filter(lines, lambda _, i: ~F.array_contains("gone_lines", i))
    text = F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    cols = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return x.select(*cols, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias("n_removed"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dedup_lines(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_removed", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("kept_md5"))


def lines_sql(docs: str) -> str:
    """CTE ``kept_lines(doc_id, line, words)``: the lines that stay, by comparing all that share a word."""
    return f"""
all_lines AS (SELECT doc_id, unnest(l) AS words, unnest(range(len(l))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs})),
line_keys AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(string_split(lower(words), ' '), lambda x: x <> ''))) AS k FROM all_lines),
line_class AS (SELECT k, len(k) AS n, min(doc_id * 10000000 + line) AS first, row_number() OVER () AS c FROM line_keys WHERE len(k) > 0 GROUP BY k),
line_freq AS (SELECT tok, count(*) AS f FROM (SELECT unnest(k) AS tok FROM line_class) GROUP BY tok),
line_tok AS (SELECT c, n, first, tok, row_number() OVER (PARTITION BY c ORDER BY f, tok) AS r FROM (SELECT c, n, first, unnest(k) AS tok FROM line_class) JOIN line_freq USING (tok)),
line_pre AS (SELECT * FROM line_tok WHERE r <= n - ceil(n * 0.8 - 1e-9) + 1),
line_pair AS (SELECT DISTINCT a.c AS a, b.c AS b FROM line_pre a JOIN line_pre b ON a.tok = b.tok AND a.first < b.first AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
line_gone AS (SELECT DISTINCT p.b AS c FROM line_pair p JOIN line_class x ON x.c = p.a JOIN line_class y ON y.c = p.b
  WHERE 5 * len(list_intersect(x.k, y.k)) >= 4 * (x.n + y.n - len(list_intersect(x.k, y.k)))),
kept_lines AS (SELECT l.doc_id, l.line, l.words FROM all_lines l JOIN line_keys k USING (doc_id, line) LEFT JOIN line_class c ON c.k = k.k
  WHERE len(k.k) = 0 OR (c.first = l.doc_id * 10000000 + l.line AND c.c NOT IN (SELECT c FROM line_gone)))"""


SQL = f"""
WITH {lines_sql('documents')}
SELECT d.doc_id, coalesce(any_value(len(string_split(d.text, chr(10)))), 0)::BIGINT AS n_lines,
       (coalesce(any_value(len(string_split(d.text, chr(10)))), 0) - count(k.line))::BIGINT AS n_removed,
       md5(coalesce(string_agg(k.words, chr(10) ORDER BY k.line), '')) AS kept_md5
FROM documents d LEFT JOIN kept_lines k USING (doc_id) GROUP BY d.doc_id
"""

QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {"op8_line_dedup": SQL}
