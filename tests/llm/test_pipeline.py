"""The pipeline: its shape, its stages' effects, and odd rows."""

from __future__ import annotations

import corpus_pipeline as p
from ledgerloom.llm import decontaminate, toxicity

NAMES = ["toxicity", "line dedup", "near-duplicates", "decontamination", "mixing"]


def test_stages(spark, sf):
    assert [n for n, _ in p.STAGES] == NAMES
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = p.base.cut(stage(spark, docs, sf))
        assert out.columns == list(p.COLUMNS), name
        assert 0 < out.count() <= docs.count()
        assert out.select("doc_id").distinct().count() == out.count()
        docs = out
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    mixed = p.STAGES[-1][1](spark, docs, sf)
    assert mixed.count() == docs.count()
    assert mixed.where("taken > 2 * size").count() == 0


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "same text here", None, "a", 1), (3, "same text here", None, "a", 1), (None, "no id", "en", "a", 5), (4, "x " * 5000, "en", "b", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    empty = tmp_path / "none"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert p.run(spark, str(empty)).count() == 0


def test_decontamination_moves_no_texts(spark, tmp_path, monkeypatch):
    """Ids beyond Spark's own bound of broadcasts do not make it shuffle all texts; above FOUND the rows are the same."""
    item = " ".join(f"b{i}" for i in range(20))
    rows = [(i, f"{item} of {i}" if i % 3 == 0 else f"text {i}", "en", "a", 1) for i in range(60)] + [(None, item, "en", "a", 1), (None, "no id", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = p.decontaminate_documents(spark, docs, str(tmp_path))
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        got = sorted(x["doc_id"] for x in few.collect())
        monkeypatch.setattr(p, "FOUND", 0)
        many = p.decontaminate_documents(spark, docs, str(tmp_path))
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert got == sorted(x["doc_id"] for x in many.collect()) == [i for i in range(60) if i % 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_threshold_is_that_of_the_operator():
    assert toxicity.THRESHOLD == 0.7


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on what the one before it kept, each held against a plain computation."""
    import itertools
    import random

    from test_operators import DOCS, brute_lines, shingles, words

    r = random.Random(17)
    bench = [words(r, 24, 20_000) for _ in range(4)]
    texts = [words(r, r.randint(30, 90), 20_000) for _ in range(160)]
    for i in range(0, 60, 3):  # toxic by their words
        w = texts[i].split()
        for _ in range(6):
            w[r.randrange(len(w))] = r.choice(["vilewordo", "nastykins", "grimbulent"])
        texts[i] = " ".join(w)
    for i in (70, 80, 90):  # near copies, of several lines so that none of them goes as a line
        w = texts[i].split()
        texts[i] = "\n".join(" ".join(w[a : a + 7]) for a in range(0, len(w), 7))
        w[2] = "altered"
        texts.append("\n".join(" ".join(w[a : a + 9]) for a in range(0, len(w), 9)))
    texts += [f"{words(r, 20, 20_000)} {b} {words(r, 20, 20_000)}" for b in bench]
    texts += [texts[100] + "\n" + words(r, 12, 20_000), "", None]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 60 and i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def step(name, docs):
        out = p.base.cut(dict(p.STAGES)[name](spark, docs, str(tmp_path)))
        return out, {x["doc_id"]: x["text"] for x in out.collect()} if "text" in out.columns else out.collect()

    docs, now = step("toxicity", spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert now == {i: t for i, t in enumerate(texts) if not (i < 60 and i % 3 == 0)}
    ids = sorted(now)
    kept = dict(zip(ids, brute_lines([now[i] for i in ids]), strict=True))
    want = {i: kept[i] for i in ids if kept[i] == now[i] or kept[i] and kept[i].split()}
    docs, now = step("line dedup", docs)
    assert now == want and kept[ids[-3]] != texts[ids[-3]]
    sets = {i: shingles(t, 2) for i, t in now.items()}
    up = {i: i for i in now}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sorted(now), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    want = {i: t for i, t in now.items() if root(i) == i}
    assert len(want) == len(now) - 3
    docs, now = step("near-duplicates", docs)
    assert now == want
    docs, now = step("decontamination", docs)
    assert now == {i: t for i, t in want.items() if not any(b in (t or "") for b in bench)} and len(now) == len(want) - len(bench)
    _, mixed = step("mixing", docs)
    size = {i: len((t or "").split()) for i, t in now.items()}
    assert {x["doc_id"]: x["size"] for x in mixed} == size
    for s in {x["source"] for x in mixed}:
        own = [x for x in mixed if x["source"] == s]
        assert sum(x["taken"] for x in own) == int(own[0]["target"]) and all(x["taken"] <= 2 * x["size"] for x in own)
        assert own[0]["source_size"] == sum(x["size"] for x in own)
