"""What the findings of round 3's last report ask for."""

import random

import numpy as np
from tokenizers import Tokenizer

from ledgerloom.llm import token_store
from ledgerloom.llm.common import tokenizer_file


def plain_ids(texts):
    tok = Tokenizer.from_file(tokenizer_file(token_store.VOCABULARY))
    tok.encode_special_tokens = True
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_words_with_marks_are_put_together(monkeypatch):
    """a word that ends in marks asks the library for what is new of it only, and has the library's ids."""
    rng = random.Random(2)
    marks = token_store.MARKS.decode()
    stems = ["don't", "it's", "'", "É", "straße", "x×", "1÷", "é", "naïve", "日本", "12.5", "<|endoftext|", "–", "ſ", "İ", "a\x01", "̸", "μ", "ª", "ΰ", "a'll", "ŉ", "x²"]
    words = [s + t for s in stems for t in ["", *marks, "***", "&&&", "'s", "'", "''ll", "!?", "≮", ">", "|>", "\x01", "é***", "‍!"]]
    words += ["".join(rng.choice("aZ1é×'*|>< \t\x0b\x1c ́日ÀÿŸ") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    rng.shuffle(words)
    texts = [" ".join(words[at : at + 7]) for at in range(0, len(words), 7)] + ["", " ", " ".join(words)]
    want = plain_ids(texts)
    for most in (token_store.REMEMBERED, 50):  # the second forgets at each batch
        monkeypatch.setattr(token_store, "REMEMBERED", most)
        tool = token_store.WordEncoder(tokenizer_file(token_store.VOCABULARY))
        for at in range(0, len(texts), 100):
            flat, lengths = tool.encode([t.encode() for t in texts[at : at + 100]], 2)
            cut = np.split(flat, np.cumsum(lengths)[:-1])
            assert [x.tolist() for x in cut] == [[*w, 2] for w in want[at : at + 100]]

    tool = token_store.WordEncoder(tokenizer_file(token_store.VOCABULARY))
    asked = []
    monkeypatch.setattr(tool, "ids", lambda lines, f=tool.ids: asked.extend(w for x in lines for w in x.split() if w != token_store.MARK) or f(lines))
    tool.encode([b"word word*** word&&& other*** other", b"Word*** OTHER&&& word$$$"], 2)
    assert sorted(asked) == ["$$$", "&&&", "***", "other", "word"]


def test_shingles_meet_packed(spark, monkeypatch):
    """counts and shared keys come from packed groups (no row for each shingle), right for any sizes of groups."""
    from collections import Counter, defaultdict

    from ledgerloom.llm import similar_sets

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a b", "a b c", ""]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    sets = [similar_sets.shingle_set(t.encode(), 2) for t in texts]
    held = Counter(int(h) >> 32 for s in sets for h in s)
    monkeypatch.setattr(similar_sets, "GATHERED", 100)
    common = similar_sets.materialise(similar_sets._common(nodes, 2, 2, 7), "t")
    often = {k: n for k, n in held.items() if n > 2}
    assert often and {r["key"]: r["held"] for r in common.collect()} == often
    order = [np.array(x, np.int64) for x in zip(*sorted(often.items()))]
    want = defaultdict(list)
    for node, s in enumerate(sets):
        for pos, key in enumerate(similar_sets.prefix(s, *order).tolist(), 1):
            if key >> 32 not in often:
                want[key].append((node, len(s), pos))
    got = defaultdict(list)
    found = similar_sets._met_keys(nodes, 2, similar_sets.stored_at(common), 7)
    for r in found.collect():
        got[r["key"]].append((r["node"], r["n"], r["pos"]))
        assert r["held"] == len(want[r["key"]])
    assert got and {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if len(v) > 1}


def edited(rng, words, share):
    return [f"n{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_bitmaps_leave_no_similar_pair_out():
    """whatever the sizes, a pair that the sets confirm passes the bitmaps, and pairs that are far apart don't."""
    from ledgerloom.llm import similar_sets

    rng, passed, alike = random.Random(5), 0, 0
    for _ in range(3000):
        one = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 4, 5, 6, 9, 17, 40, 130, 500]))]
        two = edited(rng, one, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.5])) + [f"z{i}" for i in range(rng.choice([0, 0, 1, 3, 20]))]
        x, y = (similar_sets.shingle_set(" ".join(t).encode()) for t in (one, two))
        may = similar_sets.bitmaps_may_be_similar(len(x), similar_sets.bitmap(x), len(y), similar_sets.bitmap(y))
        same = similar_sets.similar(x, y)
        assert may or not same
        passed, alike = passed + may, alike + same
    assert 300 < alike <= passed < 1.25 * alike


def test_only_likely_pairs_carry_their_sets(spark, monkeypatch):
    """pairs that share keys only don't bring whole sets into the joins; the links are those of brute force."""
    from ledgerloom.llm import similar_sets

    rng = random.Random(6)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(30)]
    texts = [" ".join(t) for t in base] + [" ".join(edited(rng, t, 0.3)) for t in base] + [" ".join([*t[:-1], "end"]) for t in base[:4]]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    sets = [similar_sets.shingle_set(t.encode()) for t in texts]
    held = {}

    def counted(df, label, *a, f=similar_sets.materialise):
        out = f(df, label, *a)
        held[label] = out.count()
        return out

    monkeypatch.setattr(similar_sets, "materialise", counted)
    got = similar_sets.verified(spark.createDataFrame(pairs, "u long, v long"), nodes)
    want = [(i, j) for i, j in pairs if similar_sets.similar(sets[i], sets[j])]
    assert sorted(map(tuple, got.collect())) == want == [(60 + i, i) for i in range(4)]
    assert held["similar-sets"] == 8


def test_shuffle_files_go_with_their_query(spark):
    """the search for similar texts leaves no shuffle files behind, and the session's setting as it was."""
    import time

    from ledgerloom.llm import similar_sets

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def files():
        found = disk.getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(30))) for i in range(40)]
    docs = spark.createDataFrame([*rows, *((100 + i, t) for i, t in rows[:5])], "doc_id long, text string").repartition(3)
    before, setting = files(), spark.conf.get(name, None)
    similar_sets._similar_texts(similar_sets._with_text_id(docs, "doc_id", "text"))
    assert spark.conf.get(name, None) == setting
    ends = time.time() + 20
    while (left := files() - before) and time.time() < ends:
        time.sleep(0.5)
    assert not left
