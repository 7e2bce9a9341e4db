"""HyperMinHash, token alignment and clustering against brute force, and their edge cases."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from ledgerloom.llm import alignment, delta_lloyd, entries, hyperminhash, similar_sets
from ledgerloom.llm.common import tokenizer_file

from test_operators import LONG, TEXTS, WORD, docs, tables

# 11


def brute_sets(rows):
    """(doc_id, size of its set, smallest doc_id that its links reach) of each row, sorted."""
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset())
    single = list(dict.fromkeys(s for s in sets if s))
    place = {s: k for k, s in enumerate(single)}
    owner = list(range(len(single)))

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(single):
        both = Counter(o for g in s for o in holders[g])
        for o, n in both.items():
            if 100 * n >= 80 * (len(s) + len(single[o]) - n):
                owner[find(k)] = find(o)
        for g in s:
            holders[g].append(k)
    first = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            owner[find(place[s])] = find(first.setdefault(i, place[s]))
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[find(place[s])] = min(least.get(find(place[s]), i), i)
    return sorted((repr(i), len(s), least.get(find(place[s])) if s else i) for (i, _), s in zip(rows, sets))


def crowd_rows(seed=1):
    """A crowd of copies with words of their own, of which some are similar and some aren't, and many tiny sets."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(24)):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((1000 - k, " ".join(w)))
    return rows + [(2000 + k, " ".join(f"q{rng.randrange(20)}" for _ in range(rng.randrange(1, 7)))) for k in range(250)]


def hyper(df, **how):
    return sorted((repr(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in hyperminhash.components(df, **how).collect())


@pytest.mark.parametrize("crowd", [32, 3])
def test_hyperminhash(spark, sf_dir, crowd):
    rows = [*tables(sf_dir), *((10**6 + (i or 0) if i else None, t) for i, t in TEXTS), *((10**7 + i, t) for i, t in crowd_rows())]
    want = brute_sets(rows)
    assert hyper(docs(spark, rows), crowd=crowd) == want
    assert len({c for _, _, c in want}) < len(want) - 50


def test_hyperminhash_edges(spark):
    assert hyper(docs(spark).limit(0)) == []
    rows = [(5, "a b c d"), (5, "e f g h"), (9, "E f g h"), (4, "a b c d"), (3, "one"), (2, "ONE"), (1, None), (0, ""), (None, "e f g h"), (None, "own words here"), (9, "E f g h")]
    assert hyper(docs(spark, rows)) == brute_sets(rows)
    kept = {(r["doc_id"], r["n_shingles"]): r["kept"] for r in hyperminhash.components(docs(spark, rows)).collect()}
    assert kept[(1, 0)] and kept[(0, 0)] and kept[(None, 2)] and not kept[(3, 1)] and kept[(2, 1)]
    with pytest.raises(ValueError):
        hyperminhash.components(docs(spark).selectExpr("text AS doc_id", "text"))


def test_hyperminhash_registers(monkeypatch):
    """Registers agree as often as sets are similar, at any size; what agrees by chance is what the correction says."""
    rng = np.random.default_rng(2)
    new = lambda n: rng.integers(-(1 << 62), 1 << 62, n)
    for n in (1, 5, 40, 300, 3000):
        found = []
        for _ in range(60):
            both, a, b = new(8 * n), new(n), new(n)
            x, y = (hyperminhash.registers(np.concatenate([both, z]))[None] for z in (a, b))
            found.append(hyperminhash.estimates(x, y, np.array([9.0 * n]), np.array([9.0 * n]))[0])
        assert abs(np.mean(found) - 0.8) < 0.03
    monkeypatch.setattr(hyperminhash, "MANTISSA", 4)  # more agree by chance, so fewer draws do
    for n, m in ((50, 50), (300, 300), (3000, 1000), (20_000, 20_000)):
        alike = np.mean([(hyperminhash.registers(new(n)) == hyperminhash.registers(new(m))).mean() for _ in range(300)])
        rate = hyperminhash.chance_rate(np.array([float(n)]), np.array([float(m)]))[0]
        assert 0.8 * rate < alike < 1.25 * rate


def test_hyperminhash_bands_miss_nothing():
    rng = np.random.default_rng(3)
    for n in (4, 9, 60, 500):
        for _ in range(100):
            both, a = rng.integers(0, 1 << 62, n), rng.integers(0, 1 << 62, n // 4)
            cut = len(a) // 2
            x, y = (hyperminhash.registers(np.concatenate([both, z])) for z in (a[:cut], a[cut:]))
            keys = hyperminhash.band_keys(np.stack([x, y]))
            assert (keys[0] == keys[1]).any()


# 12

ODD = [
    None, "", " ", "  a  b \n  c <s></s> <|endoftext|> x", "▁x y", "héllo wörld ﬁ 漢字 かな\x1c\x1d x   y", "a\x00b c\r\n\td  \t e", "中文" * 500, "😀😀 👩‍👩‍👧 x" * 20, " lead trail ",
    "'s 't  's", "x" * 3000 + " " + "yz" * 2000, "don't  can't\n\n\n  indent   x", "same text", "same text", LONG, "x.y,z (a) b-c.\nd-e f:g;h ²,² 3.4,5 www.a.b...) it's-'s s.'s", "日本.語,ab.",
]


def brute_alignment(rows):
    """As the contract says it, from byte offsets."""
    a_side, b_side = alignment.ByteLevel(tokenizer_file(alignment.SIDE_A)), alignment.Pieces(tokenizer_file(alignment.SIDE_B))
    out, links = [], []
    for i, text in rows:
        row, own, full = [i, 0, 0, 0, 0, ""], [], (" " + (text or "")).encode()
        a, b = (a_side.ids([" " + text])[0], b_side.model.encode(text)) if text else ([], [])
        parts = [[side.bytes_of[x] for x in ids] for side, ids in ((a_side, a), (b_side, b))]
        if a and b"".join(parts[0]) == full == b"".join(parts[1]):
            ends = [list(itertools.accumulate(map(len, p))) for p in parts]
            starts = [[0, *e[:-1]] for e in ends]
            groups, p, q = [], 0, 0
            for e in sorted({*ends[0]} & {*ends[1]}):
                i2, j2 = ends[0].index(e, p) + 1, ends[1].index(e, q) + 1
                groups.append(",".join(map(str, a[p:i2])) + "|" + ",".join(map(str, b[q:j2])))
                p, q = i2, j2
            j = 0
            for x, s, e in zip(a, starts[0], ends[0]):
                while ends[1][j] <= s:
                    j += 1
                k = j
                while k < len(b) and starts[1][k] < e:
                    own.append((x, b[k]))
                    k += 1
            row = [i, len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()]
        out.append(row)
        links.append(own)
    count = Counter(pair for own in links for pair in set(own))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(repr((*r[:5], sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), r[5])) for r, own in zip(out, links))


@pytest.mark.parametrize("held", [alignment.HELD_PAIRS, 10])
def test_alignment(spark, sf_dir, held):
    rows = [*tables(sf_dir)[:80], *((10**6 + k, t) for k, t in enumerate(ODD)), (None, "no id"), (1, "again")]
    got = alignment.documents(docs(spark, rows), held=held).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_alignment(rows)


def test_alignment_edges(spark):
    for held in (100, -1):
        assert alignment.documents(docs(spark).limit(0), held=held).collect() == []
        assert [tuple(r)[1:] for r in alignment.documents(docs(spark, [(1, None)]), held=held).collect()] == [(0, 0, 0, 0, 0, 0, "")]
    with pytest.raises(ValueError):
        alignment.documents(docs(spark).selectExpr("text AS doc_id", "text"))


def test_cut():
    """Both ways of cutting give the same parts."""
    rng = random.Random(9)
    for _ in range(3000):
        text = " " + "".join(rng.choice("ab,.-3 \n") for _ in range(rng.randint(1, 12)))
        assert alignment.cut(text) == alignment.CUT.split(text)


def test_transducer():
    """Any two cuts of the same bytes: groups are where both cuts meet; other bytes are refused."""
    rng = random.Random(4)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    words = list(dict.fromkeys([b"a", b"b", *words]))
    tool = alignment.Transducer(words, words[::-1], most=50)
    for _ in range(300):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30)))

        def cut(table):
            ids, at = [], 0
            while at < len(data):
                i = rng.choice([i for i, w in enumerate(table) if data.startswith(w, at)])
                ids.append(i)
                at += len(table[i])
            return ids

        a, b = cut(words), cut(words[::-1])
        groups, links = tool.align(a, b)
        ends = [list(itertools.accumulate(len(t[i]) for i in ids)) for t, ids in ((words, a), (words[::-1], b))]
        assert [ends[0][i - 1] for i, _ in groups] == sorted({*ends[0]} & {*ends[1]}) and len(links) == len(a) + len(b) - len(groups)
        if data:
            assert tool.align(a + [0], b) is None and tool.align(a, b[:-1]) is None


# 13


def brute_lloyd(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            held = [v for (_, v), o in zip(kept, own) if o == j]
            if held:
                cents[j] = [sum(c) // len(held) for c in zip(*held)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return sorted(repr((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())) for i, c, d in found)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, owner string, v int").repartition(3)


def test_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(i % 7, 1, 64)).astype(np.float32).astype(float).tolist()) for i in range(150)]
    odd = [(1000, None), (1001, [1.0] * 63), (1002, [float("nan")] + [1.0] * 63), (1003, [float("inf")] + [1.0] * 63), (1004, [None] + [1.0] * 63), (1005, [])]
    same = [(2000 + i, [0.5] * 64) for i in range(60)] + [(7, rows[7][1]), (None, rows[8][1]), (None, [3.0] * 64)]
    for kind in ("float", "double"):
        got = delta_lloyd.clusters(vectors(spark, rows + odd + same, kind)).collect()
        assert sorted(repr(tuple(r)) for r in got) == brute_lloyd(rows + same)
    few = rows[:9]
    assert sorted(repr(tuple(r)) for r in delta_lloyd.clusters(vectors(spark, few)).collect()) == brute_lloyd(few)
    assert delta_lloyd.clusters(vectors(spark, odd)).collect() == []
    large = [(i, [(-1) ** i * 500_000.0 + i * 1000] * 64) for i in range(20)]
    assert sorted(repr(tuple(r)) for r in delta_lloyd.clusters(vectors(spark, large, "double"), k=3).collect()) == brute_lloyd(large, 3)
    with pytest.raises(Exception, match="beyond"):
        delta_lloyd.clusters(vectors(spark, [(1, [1e9] * 64)])).collect()


def test_reassigned_is_a_full_comparison():
    rng = np.random.default_rng(6)
    x, c = rng.integers(-20, 20, (300, 4)), rng.integers(-20, 20, (12, 4))
    owner, dist = delta_lloyd.reassigned(x, np.full(300, -1), np.zeros(300, np.int64), c, np.arange(12))
    for _ in range(20):
        changed = np.flatnonzero(rng.random(12) < 0.3)
        c = c.copy()
        c[changed] += rng.integers(-6, 6, (len(changed), 4))
        owner, dist = delta_lloyd.reassigned(x, owner, dist, c, changed)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (owner == d.argmin(1)).all() and (dist == d.min(1)).all()


def test_clusters_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(entries.oracle_sql()["op13_delta_lloyd"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in entries.queries()["op13_delta_lloyd"](spark, sf_dir).collect())


def test_aligner_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    tool = alignment.Aligner(tokenizer_file(alignment.SIDE_A), tokenizer_file(alignment.SIDE_B))
    fresh = alignment.Aligner(tokenizer_file(alignment.SIDE_A), tokenizer_file(alignment.SIDE_B))
    rng = random.Random(2)
    plain = lambda rows: [(*r[:5], r[5].tolist(), r[6].tolist()) for r in rows]
    for _ in range(30):
        texts = [" ".join(rng.choice(["the", "of", f"w{rng.randrange(900)}", "y" * 300]) for _ in range(12)).encode() for _ in range(3)]
        fresh._forget()
        assert plain(tool.texts(texts)) == plain(fresh.texts(texts)) and len(tool.known) < 80
