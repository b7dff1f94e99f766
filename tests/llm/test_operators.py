"""Each operator against brute force and on odd rows: nulls, empty and very long texts, ties, repeated
rows, empty tables and further columns with clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import base, decontaminate, embeddings, extract, lines, minhash, mixing, secrets, suffix, tokencount, toxicity
from ledgerloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, blanks, a very long one and ties."""
    r = random.Random(5)
    out = [words(r, r.randint(5, 160)) for _ in range(60)]
    out += out[:6]
    for t in out[6:16]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    passage = words(r, 120)
    out += [f"{words(r, 30)}\n{passage}\n{words(r, 30)}" for _ in range(8)]
    out += [None, "", " \n\t ", "one", "one", "One two", "é ü ß " * 30, words(r, 6000)]
    return out


def odd(spark, texts):
    """The same rows with further columns that clash with names the operators use inside."""
    x = frame(spark, texts)
    return x.selectExpr("*", "1 as id", "'x' as h1", "2 as u", "3 as v", "'y' as key", "4 as n", "5 as size", "'z' as comp", "6 as gone", "7 as d", "8 as t", "9 as th")


# ---- components


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(500 + i, 501 + i) for i in range(40)] + [(3, 3), (900, 901), (901, 900)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {x["id"]: x["comp"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: root(i) for i in up}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 1


def test_suffix_order_and_prefixes():
    r = random.Random(2)
    for _ in range(150):
        t = bytes(r.choice(r.choice([b"ab", b"a", b"abcd"])) for _ in range(r.randint(1, 120)))
        t += t[: r.randint(0, len(t))]
        a = np.frombuffer(t, np.uint8)
        order = suffix.suffix_order(a, 10**6)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want
        got = suffix.common_prefixes(a, order)
        for k in range(1, len(t)):
            x, y = t[want[k - 1] :], t[want[k] :]
            n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert got[k] == n


def brute_spans(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                m[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        out.append((len(b), int(m.sum()), len(suffix.runs(m)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix.HOT, 500])
def test_suffix_dedup(spark, corpus, hot):
    texts = corpus + ["ab" * 400, "x" * 900]
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix.strip_repeats(odd(spark, texts), 400, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, 400)


def test_suffix_query_shows_what_is_left(spark, tmp_path):
    """Removal may cut a character in two; its rest shows as U+FFFD."""
    r = random.Random(13)
    shared = words(r, 120)
    one, two = shared + "é" + words(r, 40, 9000), shared + "è" + words(r, 40, 9000)
    frame(spark, [one, two, "left alone", None]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in suffix.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i]["n_bytes"] - got[i]["n_removed"] for i in range(2)] == [len(t.encode()) - len(shared) - 1 for t in (one, two)]
    assert got[0]["text"] == "\ufffd" + one.split("é", 1)[1] and got[1]["text"] == "\ufffd" + two.split("è", 1)[1]
    assert got[2]["text"] == "left alone" and got[3]["text"] == "" and got[0]["n_chars"] == len(got[0]["text"])


def test_suffix_dedup_empty(spark):
    assert suffix.strip_repeats(frame(spark, [])).count() == 0


# ---- 2


def make_vectors(seed=3, n=240, d=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    for i in range(60, 120):
        x[i] = x[i - 60] + r.normal(size=d).astype(np.float32) * 0.06
    x[120:130] = x[0]
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [float("nan")] * d, 1), (n + 3, [1.0, None], 1), (n + 4, [float(v) for v in x[0]], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [float("inf")] + [1.0] * (d - 1), 1)]
    return rows


def brute_links(rows):
    ok = [(i, np.array(v, float), y) for i, v, y in rows if v and y is not None and all(e is not None for e in v) and np.isfinite(v).all() and np.any(v)]
    links = {i: 0 for i, _, _ in rows}
    up = {i: i for i, _, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a, y), (j, b, z) in itertools.combinations(ok, 2):
        if y == z and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
            links[i] += 1
            links[j] += 1
            p, q = root(i), root(j)
            up[max(p, q)] = min(p, q)
    return {i: (links[i], root(i), root(i) == i) for i in links}


def test_embeddings(spark):
    rows = make_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cid", "2 as grp", "3 as id")
    got = {r["vec_id"]: tuple(r)[1:4] for r in embeddings.near_duplicates(df).collect()}
    want = brute_links([(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v], y) for i, v, y in rows])
    assert got == want
    found, there = embeddings.audit(df)
    assert found >= 0.9 * there
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_embeddings_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LIMIT", 40)
    monkeypatch.setattr(embeddings, "SHARD", 15)
    rows = make_vectors(9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    want = {i: n for i, (n, _, _) in brute_links(rows).items()}
    assert sum(got.values()) >= 0.9 * sum(want.values())
    assert all(got[i] <= want[i] for i in want)


def test_range_search_finds_all_on_a_line():
    x = embeddings.unit([[1.0, 0.01 * i] for i in range(200)])
    graph = embeddings.build_graph(x)
    got = embeddings.range_search(x, graph, 100, x[0], 0.9995)
    assert got == [i for i in range(200) if x[i] @ x[0] >= 0.9995 - 1e-9]


# ---- 3


def test_secrets(spark):
    r = random.Random(4)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [f'the token = "{h}" and more' for h in hexes[:40]] + [f"plain {h} here" for h in hexes[40:]]
    texts += ["password: abc", "API_KEY='ABCDEF1' x", "token=token:secretvalue1", "AKIA" + "Z9" * 9 + " AKIAshort", None, "", "ﬁ ſecret=abcdefgh é secret=abcdefgh", "a" * 24, "apikey=" + "q" * 5000]
    df = odd(spark, texts)
    got = {x["doc_id"]: x for x in secrets.digest(secrets.find_secrets(df)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        n = Counter(k for _, k, _ in spans)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == (n[0], n[1], n[2])
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))
    assert secrets.find_secrets(df.where("false")).count() == 0


def test_grammar_tells_credentials_from_words():
    r = random.Random(8)
    keys = ["sk_" + "".join(r.choice("0123456789abcdef") for _ in range(32)) for _ in range(200)]
    plain = [f"mail{r.randrange(99)}.example.com" for _ in range(50)] + [f"part-{r.randrange(9)}-of-the-list" for _ in range(50)] + [f"{r.randrange(10**9, 10**12)}" for _ in range(50)] + ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(6, 14))) for _ in range(300)]
    g = secrets.Grammar({"assign": keys[:150], "access": [], "hex": []}, plain)
    assert sum(map(g.accepts, keys[150:])) >= 45
    assert sum(map(g.accepts, plain)) <= 2
    long_ = ["".join(r.choice("ABCDEFGHIJKLMNOP0123456789") for _ in range(116)) for _ in range(90)]
    g = secrets.Grammar({"assign": long_[:60]}, plain)
    assert sum(map(g.accepts, long_[60:])) >= 27 and not any(map(g.accepts, plain))


def test_grammar_adds_spans(spark):
    """Credentials of the labelled format that no fixed pattern finds, one of them beside a base span."""
    r = random.Random(14)
    key = lambda: "sk_" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(30))
    prose = lambda: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 12))) for _ in range(40))
    loose = [key() for _ in range(20)]
    texts = [f"{prose()} token={key()} {prose()}" for _ in range(80)] + [f"{prose()} {x} {prose()}" for x in loose] + [prose() for _ in range(60)]
    got = {x["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in x["found"]] for x in secrets.find_secrets(frame(spark, texts)).collect()}
    hit = sum(("grammar", texts[80 + i].index(x), texts[80 + i].index(x) + len(x)) in got[80 + i] for i, x in enumerate(loose))
    assert hit >= 18
    assert sum(bool(got[i]) for i in range(100, 160)) <= 1
    assert secrets.candidates("aaaaaa=bbbbbbb", [(0, 0, 3, "x"), (2, 2, 9, "y")]) == []
    assert secrets.candidates("xxxxxxx-abcdefgh", [(0, 0, 8, "x")]) == [(8, 16, "abcdefgh")]


def test_states_seen_a_few_times_are_compared():
    """States that can't differ by the bound are passed over, those that can are not."""
    a = secrets.Automaton(["x"] * 40 + ["y"] * 40)
    for n in range(1, 12):
        for m in range(1, 200):
            a.most = m
            assert a._open(n) or not any(a._differ(x, n, y, m) for x in (0, n) for y in (0, m))
    assert not secrets.Grammar({"assign": []}, []).accepts("anything1234567890")


# ---- 4


@pytest.mark.parametrize("sources", [["a"], ["a", "b", None], ["hot", "hot", "hot", "é", "b", None, "zz"]])
def test_mixing(spark, corpus, sources):
    df = odd(spark, corpus)
    rows = frame(spark, corpus, sources)
    df = df.drop("source").join(rows.select("doc_id", "source"), "doc_id")
    got = mixing.mix(df).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(3)).collect()}
    assert {r["doc_id"]: r["taken"] for r in got} == again and len(got) == len(corpus)
    size = Counter()
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", corpus[r["doc_id"]] or ""))
        assert r["size"] == n and 0 <= r["taken"] <= 2 * n
        size[r["source"]] += n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, budget, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            budget -= target[s]
        open_ -= over
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 1


def test_mixing_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [None, ""])).collect()] == [0, 0]


# ---- 5


def test_masks_catch_every_window():
    for n in range(decontaminate.SPACED_WORDS, decontaminate.WINDOW + 1):
        allowed = 3 if n >= 15 else 2 if n >= 11 else 1
        for off in itertools.combinations(range(n), allowed):
            assert any(not {s + o for o in m} & set(off) for m in decontaminate.MASKS for s in range(n - m[-1]))


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_SEEDS, 0])
def test_decontaminate(spark, corpus, bound):
    r = random.Random(6)
    items = [words(r, n, 3000) for n in (8, 10, 12, 15, 16, 30, 50)] + ["too short", "w1", "One two", words(r, 7, 3000), None, ""]
    texts = list(corpus)
    texts += ["this is Too  Short\tto say", "too long", f"a {items[10]}", f"{items[10]}x", "short too"]
    for t in items[:7]:
        for off in (0, 1, 2, 3, 6):
            w = t.upper().split()
            for k in r.sample(range(len(w)), min(off, len(w))):
                w[k] = "other"
            texts.append(f"{words(r, 9)} {' '.join(w)}\n{words(r, 5)}" if off % 2 else " ".join(w))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as toks")
    got = {(x["doc_id"], x["item_id"]): x["matched"] for x in decontaminate.contaminated(odd(spark, texts), bench, bound).collect()}
    want = {}
    for (i, t), (j, b) in itertools.product(enumerate(texts), enumerate(items)):
        x, y = (t or "").lower().split(), (b or "").lower().split()
        if not y:
            continue
        w = min(16, len(y))
        need = w - (3 if w >= 15 else 2 if w >= 11 else 1 if w >= 8 else 0)
        for shift in range(-len(y) + 1, len(x)):
            same = [0 <= shift + k < len(x) and x[shift + k] == y[k] for k in range(len(y))]
            top = max(sum(same[s : s + w]) for s in range(len(y) - w + 1))
            if top >= need:
                want[i, j] = max(want.get((i, j), 0), top)
    assert got == want and len(want) > 20
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(odd(spark, texts), bench.where("false")).count() == 0


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_SEEDS, 0])
def test_decontaminate_reports_rows_without_id(spark, bound):
    passage = words(random.Random(7), 20, 3000)
    docs = spark.createDataFrame([(None, f"so {passage} on"), (None, "quite another text"), (3, passage)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["matched"]) for x in decontaminate.contaminated(docs, bench, bound).collect()}
    assert got == {(None, 1, 16), (3, 1, 16)}


# ---- 6


def test_token_counts(spark, corpus):
    from tokenizers import Tokenizer, models

    pieces = tokencount.vocabulary()
    lib = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    texts = corpus + ["  two  blanks ", "日本語 \x00 \U0001f600", "▁ ▁▁x", "<0x0A></s>", "a" * 3000, "\r\n\t"]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(odd(spark, texts), pieces).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len(lib.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0)
    assert tokencount.token_counts(frame(spark, []), pieces).count() == 0


def test_token_counts_ties_and_unknowns():
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁a", -3.0)]
    lib, mine, r = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False)), tokencount.Counter(pieces), random.Random(1)
    for _ in range(400):
        t = "".join(r.choice("aab xy") for _ in range(r.randint(1, 12)))
        assert mine.count(t) == len(lib.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids), t


# ---- 7


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, corpus, k):
    r = random.Random(11)
    texts, stem = list(corpus), words(r, 100).split()
    for n in list(range(1, 12)) * 3:  # a group around one text, some too far off to link
        w = list(stem)
        for p in r.sample(range(100), n):
            w[p] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [shingles(t, k) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(odd(spark, texts), k).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_sequential_bounds_keep_what_reaches_the_threshold():
    r = np.random.default_rng(1)
    steps = minhash.least_matches(0.8, 1e-6)
    lost = 0
    for _ in range(4000):
        same = np.cumsum(r.random(minhash.PERMS) < 0.8)
        lost += any(same[n - 1] < m for n, m in steps)
    assert lost == 0
    far = sum(all(np.cumsum(r.random(minhash.PERMS) < 0.4)[n - 1] >= m for n, m in steps) for _ in range(300))
    assert far <= 3


# ---- 8


def brute_lines(texts):
    rows = [(i, n, x, frozenset(filter(None, x.lower().split(" ")))) for i, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n"))]
    kept = {}
    for p, (i, n, x, s) in enumerate(rows):
        if not s or not any(u and len(s & u) * 5 >= 4 * len(s | u) for _, _, _, u in rows[:p]):
            kept.setdefault(i, []).append(x)
    return [None if t is None else "\n".join(kept.get(i, [])) for i, t in enumerate(texts)]


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 8)
    monkeypatch.setattr(lines, "SAMPLED", 1)
    r = random.Random(7)
    pool = [words(r, r.randint(1, 40), 150) for _ in range(40)] + [words(r, r.randint(55, 140), 3000) for _ in range(12)] + ["", "a b c d", "a b c d e", "A  b c D", "   "]
    texts = []
    for _ in range(60):
        part = []
        for _ in range(r.randint(1, 6)):
            w = r.choice(pool).split(" ")
            if len(w) > 5 and r.random() < 0.5:
                for _ in range(r.randint(1, 1 + len(w) // 6)):
                    w[r.randrange(len(w))] = f"z{r.randrange(50)}"
            part.append(" ".join(w))
        texts.append("\n".join(part))
    texts += [None, "", "\n\n", words(r, 5000)]
    df = odd(spark, texts).withColumnRenamed("size", "n_lines")
    got = {x["doc_id"]: x for x in lines.dedup_lines(df).collect()}
    want = brute_lines(texts)
    assert [got[i]["text"] for i in range(len(texts))] == want
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_of_near_copies_is_linear(spark, monkeypatch):
    """Groups of near copies are settled by their first lines, before all pairs of a group are made."""
    sizes, cut = [], lines.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(lines, "cut", counted)
    r = random.Random(17)
    texts = []
    for base in [words(r, 40, 10**6).split(" ") for _ in range(5)]:
        for i in range(60):
            w = list(base)
            w[r.randrange(len(w))] = f"z{i}"
            texts.append(" ".join(w))
    got = {x["doc_id"]: x["n_removed"] for x in lines.dedup_lines(frame(spark, texts)).collect()}
    assert got == {i: int(i % 60 > 0) for i in range(300)}
    assert 0 < max(sizes) <= 600


def test_line_dedup_repeated_rows(spark):
    """Rows that share id and text are one document."""
    text = "one two three four five\nsix seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, "alpha beta gamma"), (None, "delta beta gamma")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in lines.dedup_lines(docs).collect())
    assert got == [(0, "alpha beta gamma", 0), (0, "delta beta gamma", 0), (1, text, 0), (1, text, 0), (2, "", 2)]


def test_line_dedup_writes_no_prefix_rows(spark, monkeypatch):
    """The rows of all prefix words, many times the lines, are shuffled but never stored beside that."""
    made, cut = [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df: made.append(df.columns) or cut(df))
    r = random.Random(23)
    base = words(r, 30, 10**6).split(" ")
    texts = [" ".join([*base[:i], "z", *base[i + 1 :]]) for i in range(20)]
    got = {x["doc_id"]: x["n_removed"] for x in lines.dedup_lines(frame(spark, texts)).collect()}
    assert got == {i: int(i > 0) for i in range(20)}
    assert made and not any({"key", "sketch"} <= set(c) for c in made)


def test_line_dedup_makes_keys_once(spark, monkeypatch):
    """The sorted sets are the dearest step; a condition moved below them would have them made twice."""
    plans, cut = [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df))
    assert [r["n_removed"] for r in lines.dedup_lines(frame(spark, ["a b c d e\n\n  \na b c d", " \nf"])).orderBy("doc_id").collect()] == [1, 0]
    made = [p for c, p in plans if {"h1", "sketch"} <= set(c)]
    assert made and all(p.count("sort_array") == 1 for p in made)


def test_line_dedup_at_the_threshold(spark):
    """Sets of different sizes exactly at 0.8 and just below it, the smaller one first and last, whichever words they lack."""
    r = random.Random(29)
    texts, want = [], []
    for n in range(4, 45):
        for m, near in ((-(-4 * n // 5), True), (-(-4 * n // 5) - 1, False)):
            for first in (True, False):
                w = [f"w{len(texts)}x{r.randrange(10**6)}y{i}" for i in range(n)]
                pair = [" ".join(w), " ".join(r.sample(w, m))]
                texts += pair[::-1] if first else pair
                want += [0, int(near)]
    got = lines.dedup_lines(frame(spark, texts)).orderBy("doc_id").collect()
    assert [x["n_removed"] for x in got] == want


@pytest.mark.parametrize("ids", [[5, -3, None, 0], [2**62, -(2**62), None, 0], [7, 7, None, None]])
def test_line_dedup_order_of_documents(spark, ids):
    """The first line stays by doc_id, null first, also where ids are far apart or stand for two texts."""
    text = ["one two three four five {}", "six seven eight nine ten {}"]
    rows = [(d, "\n".join(t.format(i) if i == 3 - k else t.format("same") for k, t in enumerate(text))) for i, d in enumerate(ids)]
    docs = spark.createDataFrame([*rows, (1, None)], "doc_id long, text string")
    got = lines.dedup_lines(docs).collect()
    total = sum(r["n_lines"] for r in got if r["text"] is not None)
    assert total == 8 and [r["text"] for r in got if r["doc_id"] == 1] == [None]
    kept = [(r["doc_id"], r["text"].split("\n")) for r in got if r["text"]]
    # an edited word leaves 5 of 7 words common: such lines stay, the others once, in the first document that holds them
    assert sorted(x for _, t in kept for x in t) == sorted({x for _, t in rows for x in t.split("\n")})
    order = lambda d: (d is not None, d or 0)
    for x in {x for _, t in rows for x in t.split("\n")}:
        assert [d for d, t in kept if x in t] == [min((d for d, t in rows if x in t.split("\n")), key=order)]


# ---- 9


def test_toxicity(spark):
    r = random.Random(9)
    bad = ["vilewordo", "nastykins", "grimbulent"]
    texts, marks = [], []
    for i in range(300):
        w = words(r, r.randint(20, 60)).split()
        if i % 4 == 0:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(bad)
        texts.append(" ".join(w))
        marks.append((i, int(i % 4 == 0)))
    texts += [None, "", words(r, 8000)]
    docs = odd(spark, texts).selectExpr("*", "1 as toxic", "'q' as toxic_score")
    labels = spark.createDataFrame([(i, 1, y) for i, y in marks] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, labels, evidence=True).collect()}
    import zlib

    out = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i]["toxic_score"] >= 0.7) == (i % 4 == 0) for i in out)
    assert right >= 0.97 * len(out)
    assert all(0 <= x["toxic_score"] <= 1 for x in got.values()) and got[300]["toxic_score"] == got[301]["toxic_score"] < 0.7
    assert any(e["toxic"] == 1 for i in out if i % 4 == 0 for e in got[i]["toxic_evidence"])
    none = toxicity.toxicity(docs, labels.where("false"))
    assert {x["toxic_score"] for x in none.collect()} == {0.0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_toxicity_reads_all_terms(spark):
    """Neighbours by rare words, and by words that stand in clean examples mostly, against brute force."""
    import zlib

    r = random.Random(21)
    many = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(r.choice(many) for _ in range(r.randint(1, 40))) for _ in range(120)]
    docs = frame(spark, texts)
    marks = {i: int(i % 3 == 0) for i in range(90)}
    labels = spark.createDataFrame([(i, 1, y) for i, y in marks.items()], "doc_id long, quality int, toxic int")
    counts = [Counter(w[:5] for w in x.split()) for x in texts]
    own = [i for i in marks if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [Counter(t for i in own if marks[i] == c for t in counts[i]) for c in (0, 1)]
    df = Counter(t for c in counts for t in c)
    factor = {t: np.log((len(texts) + 1) / (df[t] + 0.5)) * np.log2(2 + held[1][t] / max(1, held[0][t])) for t in df if held[0][t] + held[1][t]}
    vector = lambda c: {t: (1 + np.log(n)) * factor[t] for t, n in c.items() if t in factor}
    for x in toxicity.toxicity(docs, labels, evidence=True).collect():
        q = vector(counts[x["doc_id"]])
        want = []
        for i in own:
            v = vector(counts[i])
            dot = sum(a * v.get(t, 0) for t, a in q.items())
            want.append(dot / np.sqrt(sum(a * a for a in q.values()) * sum(a * a for a in v.values())) if dot else 0)
        got = x["toxic_evidence"]
        best = [s for s in sorted(want, reverse=True)[: toxicity.NEAREST] if s > 0]
        assert np.allclose([e["cosine"] for e in got], best)
        assert all(np.isclose(want[own.index(e["doc_id"])], e["cosine"]) for e in got)


def packed(rows):
    start = np.cumsum([0, *map(len, rows)])
    return start, np.array([t for c in rows for t in sorted(c)], np.int32), np.array([c[t] for c in rows for t in sorted(c)], np.int32)


def counted(c):
    return np.array(sorted(c), np.int32), np.array([c[t] for t in sorted(c)])


@pytest.mark.parametrize("n", [1, 60, 900])
def test_block_max_search_is_exact(n):
    r = random.Random(3)
    rows = [Counter(min(299, int(r.expovariate(1 / 40))) for _ in range(r.randint(1, 25))) for _ in range(n)]
    factor = np.array([0.2 + r.random() * 4 for _ in range(300)])
    index = toxicity.BlockMaxIndex(*packed(rows), factor)
    dense = np.zeros((n, 300))
    for i, c in enumerate(rows):
        ids, w = index.vector(counted(c))
        dense[i, ids] = w
        assert np.array_equal(index.example(i)[0], ids)
    for t in range(60):
        c = counted(Counter(min(299, int(r.expovariate(1 / 40))) for _ in range(12)))
        ids, w = index.vector(c)
        score = dense[:, ids] @ w
        but = t % n if t % 2 else -1
        if but >= 0:
            score[but] = 0
        who, how = index.nearest(c, 15, but)
        best = np.sort(score)[::-1][:15]
        assert np.allclose(how, best[best > 0])
        assert np.allclose(score[who], how)


# ---- 10


def test_html_extraction_on_unseen_layouts():
    trees, scores = extract.model(), []
    for s in range(120):
        page = extract.make_page(77_000_000 + s)
        nodes, pieces = extract.parse(page)
        mark = [False] * len(nodes)
        for i, n in enumerate(nodes):
            mark[i] = n.mark == "1" if n.mark in ("0", "1") else bool(i) and mark[n.parent]
        a, b = (Counter(x.split()) for x in (extract.assemble(pieces, mark, False), extract.extract_batch(trees, [page])[0]))
        scores.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())))
    assert np.mean(scores) >= 0.97


def test_html_extraction_on_the_pages(spark, sf):
    import html

    for r in extract.op10_html_extraction(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(/?)(p|h1|br)[^>]*>", " ", inner))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_html_bare_text_and_open_heads():
    prose = "Long text of an article, with commas, and more than a few words in it. " * 6
    p, trees = " ".join(prose.split()), extract.model()
    pages = [
        f"<html><head><title>x</title></head><body>{prose}<br>{prose}</body></html>",
        f"<title>x</title><p>{prose}</p>",
        f"<head><title>x</title><meta name=a><p>{prose}</p>",
        f"<head><title>x</title>{prose}",
        f"<head><title>x</title></head><body><nav><a href=x>menu</a></nav>{prose}<b>{prose}</b><br>{prose}<footer>copyright</footer></body>",
        f"<head><title>x</title></head><body><h1>Some title here</h1>{prose}<br><br>{prose}<div class=footer>legal</div></body>",
    ]
    got = extract.extract_batch(trees, pages)
    assert got[:4] == [f"{p} {p}", p, p, p]
    assert p in got[4] and got[4].count(p) == 3 and "menu" not in got[4] and "copyright" not in got[4]
    assert got[5].count(p) == 2 and "legal" not in got[5]


def test_html_oddities(spark):
    prose = "Long text of an article, with commas, and more than a few words in it. " * 4
    pages = [None, "", "no tags at all", "<p>", "<<>><p", f"<article><p>{prose}&amp; &eacute;&#32;x<script>no</script><p>{prose}</article>", "<nav><a href=x>menu</a></nav>", "<div>" * 3000, f"<body><article><h1>T</h1><p>{prose}</p></article><!-- open", "<p a='>' b=\">\">" + prose]
    df = spark.createDataFrame([(i, f"u{i}", p, 1, 2) for i, p in enumerate(pages)], "page_id long, url string, html string, text int, n_chars int")
    got = {r["page_id"]: r["text"] for r in extract.main_text(df).collect()}
    p = " ".join(prose.split())
    assert got[0] == got[1] == got[3] == got[6] == "" and got[2] == "no tags at all"
    assert got[5] == f"{p} & é x {p}" and got[8] == f"T {p}"
    assert extract.main_text(df.where("false")).count() == 0


PROSE = "Long text of an article, with commas, and more than a few words in it, so that it reads as such. " * 5


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<section class="post">', "</section>"), ("<div><div>", "</div></div>"), ("", "")])
def test_html_layouts(open_, close):
    p, trees = " ".join(PROSE.split()), extract.model()
    menu = "<nav><ul><li><a href=a>First menu</a><li><a href=b>Second menu</a><li><a href=c>Third menu</a></ul></nav>"
    talk = '<section class="comments"><h3>3 comments</h3><div class="comment"><p>Nonsense, said a reader, who had much to say.</p></div><div class="comment"><p>Agreed, said the next one.</p></div></section>'
    page = f"<html><head><title>x</title></head><body>{menu}{open_}<h1>A title of some words</h1><p>{PROSE}</p><p>{PROSE}</p>{close}{talk}<footer>Copyright, all rights</footer></body></html>"
    got = extract.extract_batch(trees, [page])[0]
    assert got.count(p) == 2
    assert not any(x in got for x in ("menu", "Copyright"))
    if close:
        assert "Nonsense" not in got


def test_html_formulas_and_hidden_parts():
    p, trees = " ".join(PROSE.split()), extract.model()
    page = f"<article><h1>A title of some words</h1><p>{PROSE}<math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>tex</annotation></math> {PROSE}</p><div style='display:none'>Not to be seen by anyone.</div><p>{PROSE}</p></article>"
    got = extract.extract_batch(trees, [page])[0]
    assert got.count(p) == 3 and "E=m" in got and "tex " not in got and "Not to be seen" not in got
    bare = f"<nav><a href=x>menu one</a><a href=y>menu two</a></nav>{PROSE}{PROSE}"
    assert extract.extract_batch(trees, [bare])[0].count(p) == 2


def test_decoding_never_keeps_below_what_it_drops():
    r = random.Random(2)
    for s in range(40):
        nodes, _ = extract.parse(extract.make_page(5_000_000 + s))
        extract.features(nodes)
        kept = extract.decode(nodes, np.array([r.gauss(0, 3) for _ in nodes]))
        assert all(not kept[i] or kept[n.parent] for i, n in enumerate(nodes) if i)


# ---- null and repeated ids


def test_null_and_repeated_ids(spark):
    """Every operator takes rows without id and rows that repeat an id, with the same text or another one."""
    r = random.Random(31)
    a, b, c = (words(r, 90, 5000) for _ in range(3))
    rows = [(None, a), (None, b), (None, a), (7, a), (7, b), (7, b), (8, c), (9, None), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    out = suffix.strip_repeats(docs).collect()
    size = Counter(t for _, t in rows)
    assert sorted(x["n_removed"] for x in out) == sorted(len(t or "") if size[t] > 1 else 0 for _, t in rows)
    assert secrets.find_secrets(docs).count() == len(rows)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows) and sum(x["taken"] for x in mixed) == int(mixed[0]["target"])
    bench = spark.createDataFrame([(1, b)], "item_id long, text string")
    for bound in (decontaminate.BROADCAST_SEEDS, 0):
        assert {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, bench, bound).collect()} == {(None, 1), (7, 1)}
    assert tokencount.token_counts(docs, tokencount.vocabulary()).count() == len(rows)
    near = minhash.near_duplicates(docs, 2).collect()
    assert len(near) == len(rows) and {x["component_id"] for x in near if x["doc_id"] == 7} == {7}
    assert lines.dedup_lines(docs).count() == len(rows)
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(rows)
    vectors = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(vectors).count() == 4
    pages = spark.createDataFrame([(None, None, "<p>x</p>"), (None, None, "<p>x</p>"), (1, "u", None)], "page_id long, url string, html string")
    assert extract.main_text(pages).count() == 3


# ---- scratch


def test_scratch_tables(spark):
    x = base.cut(spark.range(5).toDF("i"))
    assert x.count() == 5 and x.scratch_path.startswith(base.scratch_dir(spark))
    base.drop(x)
