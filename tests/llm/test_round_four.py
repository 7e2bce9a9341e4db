"""What the findings of round 3 ask for, each held against brute force."""

import hashlib

import pytest

from ledgerloom.llm import alignment
from ledgerloom.llm.common import tokenizer_file


@pytest.fixture(scope="module")
def sides():
    return tokenizer_file(alignment.SIDE_A), tokenizer_file(alignment.SIDE_B)


def test_alignment_grows_after_a_text_without_tokens(sides):
    """a caller may keep what a batch gave, empty texts' too, while the next batch is learnt."""
    tool = alignment.Aligner(*sides)
    kept = [list(tool.texts([b"", b"some words", b"new%d words" % k])) for k in range(3)]
    assert [[r[0] > 0 for r in rows] for rows in kept] == [[False, True, True]] * 3
    assert all(len(rows[0][5]) == 0 == len(rows[0][6]) for rows in kept)


def whole(sides, text):
    """Counts and digest of the groups of one text, encoded as a whole; places are byte offsets."""
    a_side, b_side = alignment.ByteLevel(sides[0]), alignment.Pieces(sides[1])
    ids = a_side.ids([" " + text])[0], b_side.model.encode(text)
    spans = []
    for side, found in zip((a_side, b_side), ids):
        at, out = 0, []
        for i in found:
            out.append((at, at + len(side.bytes_of[i]), i))
            at = out[-1][1]
        assert b"".join(side.bytes_of[i] for i in found) == (" " + text).encode()
        spans.append(out)
    links = sorted(x[2] << 32 | y[2] for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1])
    ends, before, groups = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]}), 0, []
    for end in ends:
        groups.append("|".join(",".join(str(i) for a, b, i in side if before <= a and b <= end) for side in spans))
        before = end
    return len(ids[0]), len(ids[1]), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


@pytest.mark.parametrize("text", ["contents" + "." * 300 + "7", "a" + "-" * 300, "x" + ",(" * 200, "É--* ı.\t\n﻿", "first\n" + "+" * 300 + "\nlast", "I'm,--456\nx  \n+"])
def test_alignment_of_parts_that_go_alone(sides, text):
    """a part that starts with a mark or after a line feed has the tokens that it has in its text."""
    n_a, n_b, n_groups, n_links, digest, pairs, times = list(alignment.Aligner(*sides).texts([text.encode()]))[0]
    links = sorted(p for p, k in zip(pairs.tolist(), times.tolist()) for _ in range(k))
    assert (n_a, n_b, n_groups, n_links, digest, links) == whole(sides, text)


def test_near_dedup_meets_under_golay_keys(spark, monkeypatch):
    """the stage's named method links near copies before any shingle is a key, and only what the exact check confirms."""
    import corpus_pipeline
    from ledgerloom.llm import similar_sets

    words = [f"w{i * 7919 % 5000}" for i in range(2000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1]), "  ".join(words), "", "!", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = docs.selectExpr("doc_id AS node", "coalesce(text, '') AS text").where("node < 4")
    assert sorted(map(tuple, similar_sets.golay_links(nodes).collect())) == [(1, 0), (3, 0)]
    asked = []
    monkeypatch.setattr(similar_sets, "links", lambda *a, f=similar_sets.links: asked.append(1) or f(*a))
    kept = corpus_pipeline.STAGES[1][1](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2, 4, 5] and asked
