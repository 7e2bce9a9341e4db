"""The pipeline against a version that works on plain lists."""

import corpus_pipeline
from ledgerloom.llm import bpe, mixing, quality

from test_operators import brute_similar, brute_spans


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = docs.columns
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(stage(spark, tables[-1], sf_dir).cache())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert tables[-1].columns == names
    rows = [{r["doc_id"]: r for r in t.collect()} for t in tables]
    predicted = {r["doc_id"]: r["predicted"] for r in quality.scores(docs, labels).collect()}
    assert set(rows[1]) == {i for i, p in predicted.items() if p}
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(i in rows[1] for i in rows[0] if good.get(i) == 1)  # clean documents stay
    assert set(rows[2]) == set(brute_similar({i: r["text"] for i, r in rows[1].items()}).values())
    for i, r in rows[3].items():
        spans = brute_spans(rows[2][i]["text"])[2]
        assert (r["text"] == rows[2][i]["text"]) == (not spans) and r["n_chars"] == len(r["text"])
    drawn = {r["doc_id"] for r in mixing.plan(tables[3], rate=corpus_pipeline.MIX_RATE).where("sampled").collect()}
    assert set(rows[4]) == drawn
    for r in rows[5].values():
        assert list(r["ids"]) == bpe.load().encode(r["text"]) and r["n_tokens"] == len(r["ids"])
    out = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert out == {i: r["n_tokens"] for i, r in rows[5].items()}


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows, and columns named like anything that a stage might use: what a stage
    keeps has the values that it had."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    long = " ".join(word() for _ in range(800_000))
    assert len(long) > 4_500_000
    texts = [(1, long), (2, None), (3, ""), (4, "one two three four five six"), (4, "one two three four five six"), (5, "é \x00 日本 " * 30), (None, None), (6, long + " end"), (7, None), (8, "ONE two three four  five six")]
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "web", None if t is None else len(t), *(f"{k}{c}" for c in "abcdefghijkl")) for k, (i, t) in enumerate(texts)]
    extra = ["Score", "_score", "_spans", "SPANS", "Clean", "_source", "_topic", "_tokens", "gone_id", "own", "CELL", "key"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)).repartition(3)
    for empty in (docs.limit(0), docs):
        have = empty
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, have, sf_dir).cache()
            found = out.collect()
            if name != "bpe":
                assert out.columns == docs.columns, name
            before = {}
            for r in have.collect():
                before.setdefault(r["Score"], r)  # a column of the user's, different in each row
            for r in found:
                assert all(r[c] == before[r["Score"]][c] for c in docs.columns if c not in ("text", "n_chars")), name
                if name not in ("secrets", "bpe"):
                    assert r["text"] == before[r["Score"]]["text"]
            if name == "near_dedup" and empty is docs:
                ids = [r["doc_id"] for r in found]
                came = [r["doc_id"] for r in before.values()]
                assert not [(i, j) for i, j in ((1, 6), (4, 8), (2, 3), (2, 7)) if i in came and j in ids]
            have = out
    only = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.STAGES[1][1](spark, only, sf_dir).collect()) == [(False, 1), (False, 2), (False, 4), (False, 4), (False, 5), (True, 0)]
