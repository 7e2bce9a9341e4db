"""Journal, integrity, reconcile, search, code graph, render, streaming."""

import random
import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import STATE_DIR
from ledgerloom.operators import codegraph, integrity, journal, reconcile, render, search, sessions
from ledgerloom.operators.ordered import look_back
from ledgerloom.schemas import CHANGES, IMPORTS, SYMBOLS, normalise_changes
from ledgerloom.sources import config, files
from ledgerloom.sources.git import Git
from ledgerloom.functions.crypto import derive_key
from ledgerloom.sources.code_index import CodeIndex
from ledgerloom.sources.journal_store import Journal, load_salt
from ledgerloom.sources.search_index import SearchIndex, journal_search
from ledgerloom.streaming.ingest import ingest, session_stream, skew_stream

KEY = b"k" * 32


def made(spark, *rows):
    """Changes from dicts; what isn't given is empty."""
    blank = {f.name: {"string": "", "bigint": 0, "boolean": False}[f.dataType.simpleString()] for f in CHANGES.fields}
    return spark.createDataFrame([tuple((blank | {"id": i + 1} | r).values()) for i, r in enumerate(rows)], CHANGES)


def test_old_journals(spark):
    old = spark.createDataFrame([(1, "a", None, "hook", "s", None)], "id long, file_path string, commit_hash string, source string, summary string, reason string")
    r = normalise_changes(old).first()
    assert (r["source"], r["branch"], r["recorded_at"], r["commit_hash"], r["clock_tamper_warning"]) == ("fallback", "", 0, "", False)


def test_order_and_limits(spark):
    rows = made(spark, {"summary": "older", "recorded_at": 100}, {"summary": "newer", "recorded_at": 300}, {"summary": "middle", "recorded_at": 200})
    assert [r["summary"] for r in journal.recent(rows).collect()] == ["newer", "middle", "older"]
    ties = made(spark, {"summary": "first"}, {"summary": "second"}, {"summary": "third"})
    assert [r["summary"] for r in journal.file_history(ties, "").collect()] == ["third", "second", "first"]
    assert [r["summary"] for r in journal.in_range(rows, 150, 300).collect()] == ["newer", "middle"]
    assert [journal.clamp(n, 10) for n in (0, -5, 5, 100, 501, None)] == [10, 10, 5, 100, 500, 10]
    assert journal.last_hmac(rows.limit(0)).first()["hmac"] == ""
    assert journal.status(rows.limit(0)).first()["n_changes"] == 0


def test_look_back_equals_a_loop(spark):
    rng = random.Random(3)
    data = [(i, rng.randint(0, 60) * rng.choice([0, 1, 1])) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(data, "id long, recorded_at long")
    got = {r["id"]: r["skewed"] for r in integrity.skew_flags(df, ranges=7).collect()}
    most, want = 0, {}
    for i, at in sorted(data):
        want[i] = bool(at and most and at < most - 5)
        most = max(most, at)
    assert got == want
    prev = {r["id"]: r["p"] for r in look_back(df, "id", {"p": F.col("recorded_at")}, ranges=9).collect()}
    keys = sorted(dict(data))
    assert [prev[k] for k in keys] == [None, *(dict(data)[k] for k in keys[:-1])]


def test_chain_and_mutations(spark):
    rows = made(spark, *({"file_path": f"f{i}", "summary": f"s{i}", "recorded_at": 10 * i + 1, "source": "agent"} for i in range(8)))
    signed = integrity.sign(rows, KEY).cache()
    assert integrity.findings(signed, KEY, ranges=3).count() == 0
    assert integrity.findings(signed, b"other", ranges=3).where("kind = 'content'").count() == 8
    for name in ("prev_hmac", "file_path", "branch", "source", "summary", "reason", "diff_stat", "diff_hash", "agent_id"):
        bad = signed.withColumn(name, F.when(F.col("id") == 4, F.lit("changed")).otherwise(F.col(name)))
        assert integrity.findings(bad, KEY, ranges=3).count() >= 1, name
    for name in ("commit_hash", "created_at"):
        same = signed.withColumn(name, F.lit("changed"))
        assert integrity.findings(same, KEY, ranges=3).count() == 0, name
    unsigned = signed.withColumn("hmac", F.when(F.col("id") == 3, "").otherwise(F.col("hmac")))
    assert sorted((r["id"], r["kind"]) for r in integrity.findings(unsigned, KEY).collect()) == [(3, "unsigned"), (4, "link")]
    assert integrity.findings(signed.where("id <> 1 and id <> 8"), KEY).count() == 0  # cut ends can't be seen
    with pytest.raises(ValueError):
        integrity.rotate(unsigned, KEY, b"new")
    assert integrity.findings(integrity.rotate(signed, KEY, b"new"), b"new").count() == 0
    back = made(spark, {"recorded_at": 20}, {"recorded_at": 10})
    assert [r["kind"] for r in integrity.findings(integrity.sign(back, KEY), KEY).collect()] == ["clock"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 11])
def test_merkle(spark, n):
    import hashlib

    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    level = list(leaves)
    while len(level) > 1:
        level = [hashlib.sha256(bytes.fromhex(level[i] + level[i + 1])).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    df = spark.createDataFrame([(i * 3, h, "g") for i, h in enumerate(leaves)], "id long, h string, g string")
    assert [r["root"] for r in integrity.merkle_root(df, "id", "h").collect()] == level
    assert [r["root"] for r in integrity.merkle_root(df, "id", "h", ("g",)).collect()] == level


@pytest.mark.parametrize("n", [4, 5, 16, 17, 70])
def test_merkle_over_many_blocks(spark, monkeypatch, n):
    import hashlib

    monkeypatch.setattr(integrity, "MERKLE_BLOCK", 4)
    level = leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    while len(level) > 1:
        level = [hashlib.sha256(bytes.fromhex("".join(level[i : i + 2]))).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    df = spark.createDataFrame([(i * 3, h) for i, h in enumerate(leaves)], "id long, h string").repartition(5)
    assert [r["root"] for r in integrity.merkle_root(df, "id", "h").collect()] == level


def test_claims_and_coverage(spark):
    rows = made(
        spark, {"file_path": "x", "source": "agent"}, {"file_path": "x", "source": "agent", "commit_hash": "old"}, {"file_path": "x", "source": "agent"},
        {"file_path": "x", "source": "fallback"}, {"file_path": "x", "source": "agent"}, {"file_path": "y", "source": "agent"},
    )
    claims = spark.createDataFrame([(1, "x", "c1", 3), (2, "x", "c2", 5)], "claim_seq long, file_path string, commit_hash string, as_of_id long")
    got = {r["id"]: r["effective_commit"] for r in reconcile.effective_commits(rows, claims).collect()}
    assert got == {1: "c1", 2: "old", 3: "c1", 4: "", 5: "c2", 6: ""}
    commit = spark.createDataFrame([("c", "a", 6, 3, True), ("c", "b", 1, 0, True), ("c", "bin", None, None, False), ("c", "d", 1, 1, True)], "commit_hash string, file_path string, add int, del int, measurable boolean")
    agent = spark.createDataFrame([("a", "c", "+5 -2"), ("a", "c", "+1 -1"), ("b", "c", ""), ("bin", "c", "+1 -1")], "file_path string, commit_hash string, diff_stat string")
    cov = {r["file_path"]: (r["covered"], r["verifiable"]) for r in reconcile.coverage(commit, agent).collect()}
    assert cov == {"a": (True, True), "b": (False, False), "bin": (False, False), "d": (False, False)}
    staged = spark.createDataFrame([("x",), ("z",), (f"{STATE_DIR}/n.md",), ("",)], "file_path string")
    assert [r[0] for r in reconcile.unexplained(staged, rows).collect()] == ["z"]


@pytest.mark.parametrize("hot_share", [1 / 256, 0.3, 0.9])
def test_claims_of_a_hot_file(spark, hot_share):
    """One file holds most rows; claims fall between ids, on ids, after all of them, twice on one id, and on no id."""
    rng = random.Random(int(hot_share * 1000))
    paths = [rng.choice(["hot"] * 6 + ["b", "c", "it's"]) for _ in range(400)]
    rows = made(spark, *({"id": 2 * i, "file_path": p, "source": rng.choice(["agent", "agent", "hook"]), "commit_hash": rng.choice(["", "", "own"])} for i, p in enumerate(paths)))
    marks = [(k, rng.choice(["hot", "hot", "b", "it's", "none"]), f"c{k}", rng.choice([None, rng.randrange(900), 2 * rng.randrange(400)])) for k in rng.sample(range(1000), 60)]
    marks += [(1000, "hot", "a", 100), (1001, "hot", "b", 100), (1002, "c", "last", 10_000)]
    claims = spark.createDataFrame(marks, "claim_seq long, file_path string, commit_hash string, as_of_id long")
    want = {}
    for r in rows.collect():
        first = min(((k, c) for k, p, c, at in marks if p == r["file_path"] and at is not None and at >= r["id"]), default=(0, ""))[1]
        want[r["id"]] = r["commit_hash"] or (first if r["source"] == "agent" else "")
    got = reconcile.effective_commits(rows.repartition(7), claims, hot_share, 16)
    assert got.columns == [*rows.columns, "effective_commit"]
    assert {r["id"]: r["effective_commit"] for r in got.collect()} == want and got.count() == len(paths)


def test_search_against_sqlite(spark, tmp_path):
    texts = [("fix password hashing", "use bcrypt instead of md5"), ("add connection pool", "reduce latency"), ("Fix the café menu", "password café"), ("hash of the fix", ""), ("pool pools pooling", "connection, then pool")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(summary, reason)")
    con.executemany("INSERT INTO t VALUES (?, ?)", texts)
    df = spark.createDataFrame([(i + 1, a, b, 0) for i, (a, b) in enumerate(texts)], "id long, summary string, reason string, recorded_at long")
    queries = ["bcrypt", "LATENCY", "fix password", "pool*", '"connection pool"', "pool OR bcrypt", "fix NOT password", "reason:password", "cafe", '"the fix"', "NEAR(fix hash, 5)", "NEAR(fix hash, 1)", "(pool OR fix) NOT latency", "summary:(fix OR pool)", '"connection po" *', "fix AND hash"]
    for q in queries:
        want = sorted(r[0] for r in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (q,)))
        assert sorted(r["id"] for r in search.search(df, q).collect()) == want, q
        assert sorted(r["id"] for r in search.search(search.tokenise(df), q).collect()) == want, q
    more = [("привет мир", "日本 語"), ("straße a", "Ελλάδα"), ("a b", "x"), ("a b c", ""), ("a c", ""), ("b c", ""), ("a", ""), ("Việt Nam ǖ", "ñandú Ünïcode"), ("МИР a", "й")]
    con.execute("DELETE FROM t")
    con.executemany("INSERT INTO t (rowid, summary, reason) VALUES (?, ?, ?)", [(i + 1, a, b) for i, (a, b) in enumerate(more)])
    other = spark.createDataFrame([(i + 1, a, b, 0) for i, (a, b) in enumerate(more)], "id long, summary string, reason string, recorded_at long")
    queries = ["привет", "МИР", "мир NOT a", "日本", "straße", "strasse", "STRASSE", "ελλάδα", "a NOT b c", "a NOT (b c)", "a NOT b NOT c", "a b NOT c", "a AND b NOT c", "a NOT b AND c", "a OR b NOT c", "a NOT b OR c", "a c OR b c NOT a", "vi*", "Nam", "nandu", "unicode", "ünïcode", "й", "и", "прив*", '"b c"', "summary:a NOT b"]
    for q in queries:
        want = sorted(r[0] for r in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (q,)))
        assert sorted(r["id"] for r in search.search(other, q).collect()) == want, q
    for bad in ("fix-password", '"open', "AND", "nocolumn:x"):
        with pytest.raises(search.SearchError):
            search.matches(bad)
    index = SearchIndex(spark, str(tmp_path / "ix"))
    for part in (other.where("id <= 4"), other.where("id between 5 and 6"), other.where("id > 6")):
        index.add(part, "id", part.agg(F.max("id")).first()[0])
    for q in queries:
        want = sorted(r[0] for r in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (q,)))
        assert sorted(r["key"] for r in index.keys(q).collect()) == want, q
    assert index.merge(3) == 3 and len(index.log.snapshot().of("stats")) == 1
    con.execute("DELETE FROM t")
    con.executemany("INSERT INTO t (rowid, summary, reason) VALUES (?, ?, ?)", [(i + 100, a, b) for i, (a, b) in enumerate(texts)])
    first = SearchIndex(spark, str(tmp_path / "first"))
    first.add(df.where("id < 4").withColumn("id", F.col("id") + 99), "id", 102)
    for few in (1000, 0):
        for q in ["pool*", '"connection pool"', "NEAR(fix hash, 1)", "(pool OR fix) NOT latency", "summary:(fix OR pool)", "p*"]:
            want = sorted(r[0] for r in con.execute("SELECT rowid FROM t WHERE t MATCH ? AND rowid < 103", (q,)))
            assert sorted(r["key"] for r in first.keys(q, few).collect()) == want, q
    shifted = df.withColumn("id", F.col("id") + 99)  # rows from 103 on aren't indexed yet
    for q in ("pool", "fix NOT password", "nothing"):
        want = sorted(r[0] for r in con.execute("SELECT rowid FROM t WHERE t MATCH ?", (q,)))
        assert sorted(r["id"] for r in journal_search(first, shifted, q).collect()) == want, q
    assert "PartitionFilters: [isnotnull(bucket" in first.keys("bcrypt")._jdf.queryExecution().executedPlan().toString()
    assert SearchIndex(spark, str(tmp_path / "none")).keys("x").collect() == []


def graph(spark):
    symbols = spark.createDataFrame([("User", "type", "internal/store/user.go", 1, 3, "type User struct{...}"), ("FindUser", "func", "internal/store/user.go", 5, 9, ""), ("Search", "func", "internal/api/api.go", 1, 2, "func Search()"), ("h", "func", "helper.ts", 1, 1, "")], SYMBOLS)
    imports = spark.createDataFrame([("internal/api/api.go", "m/internal/store"), ("internal/api/api.go", "fmt"), ("main.ts", "helper"), ("helper.ts", "helper")], IMPORTS)
    return symbols, imports


def test_code_graph(spark):
    symbols, imports = graph(spark)
    assert [r["name"] for r in codegraph.find_symbol(symbols, "find").collect()] == ["FindUser"]
    assert [r["name"] for r in codegraph.find_symbol(symbols, "").collect()] == ["h", "User", "Search", "FindUser"]
    assert [tuple(r) for r in codegraph.hubs(imports, 1).collect()] == [("helper", 2)]
    known = codegraph.indexed_files(symbols, imports)
    assert known.count() == 4
    assert {tuple(r) for r in codegraph.dependents(imports, known, "m").collect()} == {("internal/store/user.go", "internal/api/api.go"), ("helper.ts", "main.ts"), ("helper.ts", "helper.ts")}
    linked = {(r["file_path"], r["imported_path"]): r["provider"] for r in codegraph.linked_imports(imports, known, "m").collect()}
    assert linked == {("internal/api/api.go", "m/internal/store"): "internal/store/user.go", ("internal/api/api.go", "fmt"): None, ("main.ts", "helper"): "helper.ts", ("helper.ts", "helper"): None}
    s = codegraph.summary(symbols, imports).first()
    assert (s["file_count"], s["symbol_count"], s["import_count"], s["language_counts"]) == (3, 4, 4, {"go": 2, "typescript": 1})
    with pytest.raises(codegraph.IndexRefused):
        codegraph.guard(symbols, imports, 5)
    with pytest.raises(codegraph.IndexRefused):
        codegraph.guard(symbols, imports, 0, max_bytes=100)
    codegraph.guard(symbols, imports, 5, max_bytes=1, force=True)
    disk = spark.createDataFrame([("a.go", 10, False), ("big.go", 1 << 21, False), ("ig.go", 1, True), ("x.css", 1, False), ("n.go", 5, False)], "file_path string, length long, ignored boolean")
    indexed = spark.createDataFrame([("a.go",), ("ghost.go",)], "file_path string")
    notes = spark.createDataFrame([("a.go",), ("old.go",)], "file_path string")
    got = {tuple(r) for r in codegraph.drift(indexed, disk, notes).collect()}
    assert got == {("stale", "old.go", ""), ("ghost", "ghost.go", ""), ("uncovered", "big.go", "too large"), ("uncovered", "ig.go", "gitignored"), ("uncovered", "n.go", "")}


def test_notes(spark):
    symbols, imports = graph(spark)
    notes = {r["file_path"]: r["content"] for r in render.file_notes(symbols, imports, "m").collect()}
    assert "## Imported by\n\n- [internal/api/api.go](../api/api.go.md)" in notes["internal/store/user.go"]
    assert "- `fmt`\n" in notes["internal/api/api.go"] and "- [m/internal/store](../store/user.go.md)" in notes["internal/api/api.go"]
    assert "- [helper](helper.ts.md)" in notes["main.ts"] and "- `helper`" in notes["helper.ts"]
    roll = render.index_rollup(symbols, imports, 0, 1, module="m").first()["content"]
    assert "- last indexed: never" in roll and "  - go: 2\n" in roll and "- skipped files: 1" in roll and "- 2 import(s): [helper](index/helper.ts.md)" in roll


def test_changelog(spark):
    rows = made(spark, {"commit_hash": "111", "recorded_at": 1, "summary": "<b>"}, {"commit_hash": "222", "recorded_at": 2}, {"commit_hash": "222", "recorded_at": 3, "clock_tamper_warning": True}, {"recorded_at": 4})
    content = render.changelog(rows).first()["content"]
    assert content.count("## ") == 2 and "&lt;b&gt;" in content and "[CLOCK TAMPER WARNING]" in content
    assert render.changelog(rows.limit(0)).first()["content"].startswith("# Changes")
    line = render.changes_text(rows.where("id = 1")).first()["line"]
    assert line == "[1970-01-01T00:00:01Z]  (, 111): <b>"


def test_sessions(spark):
    used = spark.createDataFrame([("a", ["get_recent_changes"]), ("b", []), ("c", [t for t, _ in sessions.SUGGESTIONS])], "session string, tools array<string>")
    first = {r["session"]: r["tool"] for r in sessions.suggestions(spark, used).where("rank = 1").collect()}
    assert first == {"a": "get_file_history", "b": "get_recent_changes"}
    reports = {r["session"]: r["report"] for r in sessions.context(used, 1).collect()}
    assert "none yet" in reports["b"] and "every tool" in reports["c"]
    assert "Suggested" not in sessions.context(used, 0).first()["report"]


def test_elapsed():
    assert [sessions.elapsed(x) for x in (0, 4.6, 65, 3605)] == ["0s", "5s", "1m5s", "1h0m5s"]


def test_summariser_has_limits():
    import threading

    from ledgerloom.plans.summariser import BREAKER, GuardedSummariser, over_http
    from ledgerloom.sources.config import Summariser

    asked = []
    good = GuardedSummariser(lambda prompt: asked.append(prompt) or " Adds a  parser ", Summariser(max_diff_bytes=5))
    assert good("a.go", "0123456789") == "Adds a parser" and "01234" in asked[0] and "56789" not in asked[0]
    assert GuardedSummariser(lambda prompt: "run `rm`")("a", "") is None and GuardedSummariser(lambda prompt: None)("a", "") is None
    answers = iter([ValueError, "Fine now", ValueError, ValueError, ValueError])
    calls = []

    def shaky(prompt):
        calls.append(prompt)
        if (a := next(answers)) is ValueError:
            raise ValueError
        return a

    guarded = GuardedSummariser(shaky)
    assert [guarded("a", "") for _ in range(7)] == [None, "Fine now", None, None, None, None, None]
    assert len(calls) == 2 + BREAKER and guarded.open
    slow = GuardedSummariser(lambda prompt: threading.Event().wait(30) or "late", Summariser(timeout_ms=50))
    assert slow("a", "") is None and slow.failures == 1
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"response": "Drops a call."}')

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    assert over_http(Summariser(endpoint=f"http://127.0.0.1:{server.server_port}"))("a", "") == "Drops a call."
    server.shutdown()
    server.server_close()


def test_commit_job(spark, tmp_path):
    """Diff hashes and numbers, a summariser's text, the anchor, settings and the state of the index."""
    from ledgerloom.plans.toolbox import ANCHOR, ANCHOR_REF, Toolbox

    root = tmp_path / "repo"
    root.mkdir()
    sh = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b.c", "-c", "user.name=x", *a], check=True, capture_output=True)
    sh("init", "-q", "-b", "main")
    sh("config", "user.email", "a@b.c")
    sh("config", "user.name", "x")
    for name in ("a.go", "b.go", "c.go", "id_rsa.go"):
        (root / name).write_text("package m\n\nfunc One() {}\n")
    (root / "big.go").write_text("package m\n" + "// x\n" * 100)
    (root / "t.ts").write_text("export function two() {}\n")
    sh("add", "-A")
    sh("commit", "-qm", "one")
    settings = config.Config(index=config.Index(languages=["go"], max_file_size=100))
    shown = {}
    box = Toolbox(spark, str(root), Journal(spark, str(tmp_path / "j"), KEY), str(tmp_path / "ix"), lambda path, diff: shown.setdefault(path, diff) and {"b.go": "Adds Two to b"}.get(path), settings)
    box.index()
    state = box.index_status().first()
    assert (state["file_count"], state["symbol_count"], state["skipped_count"], state["unsupported_count"], state["language_counts"]) == (4, 4, 1, 1, {"go": 4})
    assert state["last_indexed_at"] > 0 and state["size_bytes"] > 0
    assert [(r["name"], r["total"]) for r in box.list_symbols("a.go").collect()] == [("One", 1)]
    for name in ("a.go", "b.go", "c.go", "id_rsa.go"):
        (root / name).write_text("package m\n\nfunc One() {}\n\nfunc Two() {}\n")
    work = box.git.diff_hash("a.go")
    box.record_change("a.go", "add Two")
    assert (root / STATE_DIR / "CHANGES.md").exists() and box.verify()["rendered"].count() == 0
    sh("add", "-A", "a.go", "b.go", "c.go", "id_rsa.go")
    sh("commit", "-qm", "two")
    top = box.after_commit()
    rows = {r["file_path"]: r for r in box.get_recent_changes().collect()}
    assert {k: (r["source"], r["diff_stat"]) for k, r in rows.items()} == {"a.go": ("agent", "+2 -0"), "b.go": ("llm", "+2 -0"), "c.go": ("fallback", "+2 -0"), "id_rsa.go": ("fallback", "+2 -0")}
    assert rows["a.go"]["diff_hash"] == work and rows["b.go"]["diff_hash"] == box.git.diff_hash("b.go", box.git.head()) and len(work) == 64
    assert rows["b.go"]["summary"] == "Adds Two to b" and "func Two" in shown["b.go"] and "func Two" not in shown["id_rsa.go"] and "a.go" not in shown
    assert box.git.run("notes", "--ref", ANCHOR_REF, "show", "HEAD").strip() == ANCHOR + top
    assert box.verify()["rendered"].count() == 0 and box.verify()["chain"].count() == 0
    assert [r["total"] for r in box.list_symbols("b.go", 1).collect()] == [2] and box.index_status().first()["skipped_count"] == 1
    assert "time since the session began" in box.get_session_context().first()["report"]


def test_journal_store_and_stream(spark, tmp_path):
    salt = load_salt(str(tmp_path / "salt"))
    assert load_salt(str(tmp_path / "salt")) == salt and len(salt) == 32
    store = Journal(spark, str(tmp_path / "j"), KEY)
    rows = [("a.go", "one", "", "agent", 100), ("b.go", "two", "", "agent", 50), ("../c", "bad", "", "agent", 1), ("d.go", "AK" + "IA" + "A" * 16, "", "agent", 1), ("e.go", "x", "", "hook", 1), ("f.go", " ", "", "agent", 1)]
    bad = store.record(spark.createDataFrame(rows, "file_path string, summary string, reason string, source string, recorded_at long").coalesce(1))
    assert sorted(r["problem"] for r in bad.collect()) == ["path", "secret", "source", "summary"]
    assert [(r["id"], r["clock_tamper_warning"]) for r in store.changes().orderBy("id").collect()] == [(1, False), (2, True)]
    src = str(tmp_path / "in")
    spark.createDataFrame([("c.go", "three", "", "agent", 200)], "file_path string, summary string, reason string, source string, recorded_at long").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    for _ in range(2):
        ingest(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert store.changes().count() == 3 and [r["kind"] for r in store.verify().collect()] == ["clock"]
    again = spark.createDataFrame([("c.go", "three", "", "agent", 200), ("..", "x", "", "agent", 1)], "file_path string, summary string, reason string, source string, recorded_at long")
    (query,) = store.snapshot().seen
    assert store.recorded((query, 0)) and store.record(again, batch=(query, 0)).count() == 1 and store.changes().count() == 3  # killed before its checkpoint
    assert store.record(again, whole=True).count() == 1 and store.changes().count() == 3
    turned = spark.createDataFrame([(k, f"s{k}.go", f"{k}", 300) for k in (3, 1, 2)], "seq long, file_path string, summary string, recorded_at long").repartition(3)
    other = Journal(spark, str(tmp_path / "ordered"), KEY)
    other.record(turned)
    assert [r["summary"] for r in other.changes().orderBy("id").collect()] == ["1", "2", "3"]
    store.claim("abc1", ["a.go"])
    assert reconcile.effective_commits(store.changes(), store.claims()).where("effective_commit = 'abc1'").count() == 1
    fresh = store.rotate(b"n" * 32, str(tmp_path / "j2"), force=True)
    assert fresh.changes().count() == 3 and [r["kind"] for r in fresh.verify().collect()] == ["clock"]
    assert fresh.compact(str(tmp_path / "j3")).changes().count() == 3
    store.changes().write.parquet(str(tmp_path / "rows"))
    q = skew_stream(spark.readStream.schema("id long, recorded_at long").parquet(str(tmp_path / "rows"))).writeStream.format("memory").queryName("skew_t").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"]: r["skewed"] for r in spark.table("skew_t").collect()} == {1: False, 2: True, 3: False}
    calls = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src).select(F.col("source").alias("session"), F.col("summary").alias("tool"))
    q = session_stream(calls).writeStream.format("memory").queryName("sess_t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sess_t").first()["tools"] == ["three"]


def test_config(tmp_path):
    assert config.load(str(tmp_path), {}).index.max_bytes == 209_715_200
    (tmp_path / STATE_DIR).mkdir()
    (tmp_path / STATE_DIR / "config.json").write_text('{"summariser": {"enabled": true}, "index": {"max_file_size": 5}}')
    c = config.load(str(tmp_path), {"LEDGERLOOM_INDEX_MAX_FILE_SIZE": "7", "LEDGERLOOM_INDEX_WIKILINKS": "yes"})
    assert c.summariser.enabled and c.index.max_file_size == 7 and c.index.wikilinks
    with pytest.raises(ValueError):
        config.load(str(tmp_path), {"LEDGERLOOM_SUMMARISER_ENDPOINT": "http://192.0.2.7:1"})
    assert config.load(str(tmp_path), {"LEDGERLOOM_SUMMARISER_ENDPOINT": "http://192.0.2.7:1", config.ALLOW_REMOTE: "1"})
    (tmp_path / STATE_DIR / "config.json").write_text("{")
    with pytest.raises(ValueError):
        config.load(str(tmp_path), {})


def test_git_without_commit_and_with_renames(tmp_path):
    root = tmp_path / "r"
    subprocess.run(["git", "init", "-q", "-b", "main", str(root)], check=True)
    git = Git(str(root))
    assert (git.head(), git.branch(), git.stats()) == ("", "main", {})
    sh = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b.c", "-c", "user.name=x", *a], check=True, capture_output=True)
    (root / "old.txt").write_text("".join(f"line {i}\n" for i in range(40)))
    sh("add", "-A")
    assert git.staged() == ["old.txt"] and "line 3" in git.diff("old.txt")
    sh("commit", "-qm", "one")
    sh("mv", "old.txt", "new.txt")
    with open(root / "new.txt", "a") as f:
        f.write("more\n")
    sh("add", "-A")
    assert git.staged() == ["new.txt", "old.txt"]
    sh("commit", "-qm", "two")
    assert git.changed_files(git.head()) == ["new.txt", "old.txt"] and git.stats(git.head()) == {"new.txt": (41, 0), "old.txt": (0, 40)}


def test_repository(spark, tmp_path):
    from ledgerloom.plans.toolbox import Toolbox

    root = tmp_path / "repo"
    (root / "lib").mkdir(parents=True)
    sh = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", "-b", "main", str(root)], check=True)
    sh("config", "user.email", "a@b.c")
    sh("config", "user.name", "x")
    (root / "go.mod").write_text("module m\n")
    (root / "lib" / "lib.go").write_text("package lib\n\nfunc Help() {}\n")
    (root / "main.go").write_text('package main\n\nimport "m/lib"\n\nfunc main() { lib.Help() }\n')
    (root / ".gitignore").write_text("skip.go\nout/\n")
    (root / "skip.go").write_text("package main\n")
    (root / "out").mkdir()
    (root / "out" / "x.go").write_text("package out\n")
    (root / "link.go").symlink_to(root / "main.go")
    sh("add", "-A")
    sh("commit", "-qm", "one")
    git = Git(str(root))
    assert git.changed_files(git.head()) == [".gitignore", "go.mod", "lib/lib.go", "link.go", "main.go"]
    assert [(p, s, i) for p, _, s, i in files.listing(str(root), git) if s] == [("main.go", True, False), ("skip.go", True, True), ("lib/lib.go", True, False)]
    box = Toolbox(spark, str(root), Journal(spark, str(tmp_path / "j"), KEY), str(tmp_path / "ix"))
    assert box.index()["symbols"] == 2
    assert [r["file_path"] for r in box.get_dependents("lib/lib.go").collect()] == ["main.go"]
    assert {(r["kind"], r["file_path"]) for r in box.index_drift().collect()} == {("uncovered", "skip.go")}
    assert "[main.go](../../index/main.go.md)" in (root / STATE_DIR / "index/lib/lib.go.md").read_text() or "[main.go](../main.go.md)" in (root / STATE_DIR / "index/lib/lib.go.md").read_text()
    (root / "main.go").write_text('package main\n\nfunc main() {}\n\nfunc two() {}\n')
    assert box.record_change("main.go", "drop lib", "not needed").count() == 0
    sh("add", "main.go", "go.mod")
    assert box.gate({})[0].count() == 0
    (root / "lib" / "lib.go").write_text("package lib\n")
    sh("add", "-A", "main.go", "lib")
    found, stop = box.gate({"LEDGERLOOM_GATE_BLOCK": "1"})
    assert [r[0] for r in found.collect()] == ["lib/lib.go"] and stop
    sh("commit", "-qm", "two")
    assert len(box.after_commit()) == 64
    got = {(r["file_path"], r["source"]) for r in box.get_recent_changes().collect()}
    assert got == {("main.go", "agent"), ("lib/lib.go", "fallback")}
    assert [r["name"] for r in box.list_symbols("main.go").collect()] == ["main", "two"]
    out = box.verify()
    assert out["chain"].count() == 0 and out["rendered"].count() == 0
    with open(root / STATE_DIR / "CHANGES.md", "a") as f:
        f.write("edited")
    assert [r["path"] for r in box.verify()["rendered"].collect()] == [f"{STATE_DIR}/CHANGES.md"]
    assert "get_recent_changes" in box.get_session_context().first()["report"]
    assert box.search_changes("lib").count() == 1 and box.get_changes_in_range(0, 1 << 40).count() == 2 and box.get_file_history("main.go").count() == 1
    assert box.get_diff("main.go").count() == 1 and box.find_symbol("ma").count() == 1 and box.status().first()["n_changes"] == 2
    top = box.get_index_summary().first()
    assert (top["imported_path"], top["file_count"], top["symbol_count"], top["skipped_count"]) == (None, 1, 2, 0) and top["last_indexed_at"] > 0 and top["size_bytes"] > 0
    two = box.find_symbol("", 1).collect()
    assert [(r["name"], r["total"]) for r in two] == [("two", 2)] and two[0]["last_indexed_at"] == top["last_indexed_at"] == box.list_symbols("main.go").first()["last_indexed_at"]
    assert box.verify()["clock_count"].first()["n_warnings"] == 0
    box.summarise = lambda path, diff: f"about {path}" if "two" in diff else None
    assert {(r["file_path"], r["told"]) for r in box.get_recent_changes(summarize=True).collect()} == {("main.go", "about main.go"), ("lib/lib.go", "")}
    assert box.get_diff("main.go", git.head(), summarize=True).first()["told"] == "about main.go"
    opened = Toolbox.open(spark, str(root), str(tmp_path / "own"), str(tmp_path / "ix"), str(tmp_path / "salt"))
    assert opened.journal.key == derive_key(load_salt(str(tmp_path / "salt")), "a@b.c") and opened.find_symbol("t").count() == 1
    with pytest.raises(ValueError):
        git.diff("main.go", "--output=x")


def test_prefix_reads_a_part(spark, tmp_path, monkeypatch):
    """A prefix of a sorted index reads the files that can have it."""
    from ledgerloom.sources import code_index

    monkeypatch.setattr(code_index, "FILE_ROWS", 1000)
    index = CodeIndex(spark, str(tmp_path / "ix"))
    symbols = spark.range(20_000).select(
        F.concat(F.sha2(F.col("id").cast("string"), 256).substr(1, 6), F.lit("Ab")).alias("name"), F.lit("func").alias("kind"), F.format_string("f%d.go", F.col("id") % 50).alias("file_path"),
        F.col("id").cast("int").alias("line_start"), F.col("id").cast("int").alias("line_end"), F.lit("").alias("signature"), F.lit(1).cast("long").alias("scan_id"),
    )
    scans = symbols.select("file_path", "scan_id", F.lit(False).alias("deleted")).distinct()
    index.add(symbols, spark.createDataFrame([], "file_path string, imported_path string, scan_id long"), scans)
    found = codegraph.find_symbol(index.symbols(), "ABC")
    want = sorted(r["name"] for r in symbols.where("lower(name) like 'abc%'").collect())
    assert sorted(r["name"] for r in found.collect()) == want and want
    stored = index._rows("symbols").where(F.col("folded").startswith("abc"))
    stored.collect()
    plan = stored._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() < 2000  # of 20,000
    # one file scanned again, one gone
    index.add(symbols.where("file_path = 'f1.go' and line_start < 100").withColumn("scan_id", F.lit(2).cast("long")), spark.createDataFrame([], "file_path string, imported_path string, scan_id long"), spark.createDataFrame([("f1.go", 2, False), ("f2.go", 2, True)], "file_path string, scan_id long, deleted boolean"))
    assert index.symbols().count() == 48 * 400 + 2


def test_scans_are_merged(spark, tmp_path):
    """Ten scans of one file leave two units at most, the index doesn't grow with them, and falls when files go."""
    index, size = CodeIndex(spark, str(tmp_path / "ix")), []
    symbols = spark.createDataFrame([(f"{'x' * 40}{i}f{k}", "func", f"f{k}.go", i, i, "s" * 50) for k in range(2) for i in range(400)], SYMBOLS)
    nothing = spark.createDataFrame([], "file_path string, imported_path string, scan_id long")
    scanned = lambda k, n, gone=False: spark.createDataFrame([(f"f{k}.go", n, gone)], "file_path string, scan_id long, deleted boolean")
    stamped = lambda n, k: symbols.where(F.col("file_path") == f"f{k}.go").withColumn("scan_id", F.lit(n).cast("long")).withColumn("line_end", F.lit(n))
    index.add(stamped(0, 0), nothing, scanned(0, 0), {"skipped_count": 3})
    for n in range(1, 10):
        index.add(stamped(n, 1), nothing, scanned(1, n))
        size.append(index.size())
        assert len(index.log.snapshot().of("symbols")) <= 2
    assert index.symbols().groupBy("file_path").agg(F.count("*").alias("n"), F.max("line_end").alias("m")).orderBy("file_path").collect() == [("f0.go", 400, 0), ("f1.go", 400, 9)]
    assert max(size) < 3 * min(size) and index.meta() == {"skipped_count": 3} and index.last_scan() == 9
    for n, k in ((10, 0), (11, 1), (12, 1)):
        index.add(stamped(n, 9), nothing, scanned(k, n, True))
    assert index.symbols().count() == 0 and index.size() < min(size)


def test_key_is_in_no_plan(spark):
    rows = made(spark, {"id": 1, "summary": "s"})
    plan = integrity.findings(rows, KEY)._jdf.queryExecution().toString()
    pads = [bytes(k ^ b for k in KEY.ljust(64, b"\0")) for b in (0x36, 0x5C)]
    assert not any(x in plan for p in (KEY, *pads) for x in (p.hex(), p.hex().upper(), p.decode("latin1"), " ".join(f"{b:02X}" for b in p)))
    assert "hmac" in plan


def test_alias_table(spark):
    """Ten thousand patterns, a plain join, the same as the resolver of single specifiers."""
    from ledgerloom.sources.aliases import resolve_alias

    rng = random.Random(6)
    piece = lambda: rng.choice(["a", "b", "ab", "@", "/", ".", "..", "x/y", "*", "é"])
    aliases = {"@/*": "src/*", "a*a": "x/*", "exact": "one/./two", "é/*/z": "p//*/../q", "*": "any/*"}
    aliases |= {"".join(piece() for _ in range(rng.randint(1, 5))): "".join(piece() for _ in range(rng.randint(1, 4))) for _ in range(300)}
    aliases |= {f"@pkg{i}/*": f"packages/{i}/src/*" for i in range(10_000)}
    specs = ["@/../x", "aa", "a", "aba", "exact", "é/1/2/z", "@pkg77/a/../b", "@pkg10000/x", "", None, "@pkg1", *("".join(piece() for _ in range(rng.randint(1, 6))) for _ in range(400))]
    aliases = {p: t for p, t in aliases.items() if p.count("*") < 2}
    table = spark.createDataFrame([(q, p, t) for q in ("one", None) for p, t in aliases.items()], "project string, pattern string, target string")
    rows = spark.createDataFrame([(i, q, s) for i, s in enumerate(specs) for q in ("one", None, "other")], "i int, project string, specifier string")
    plan = codegraph.resolve_aliases(rows, table)
    assert len(plan._jdf.queryExecution().toString()) < 100_000
    got = {(r["i"], r["project"]): r["resolved"] for r in plan.collect()}
    for i, s in enumerate(specs):
        want = None if s is None else resolve_alias(s, aliases)
        assert got[i, "one"] == got[i, None] == want, s
        assert got[i, "other"] is None
    assert got[0, "one"] == "x"


def test_index_of_a_text_with_very_many_words(spark):
    """the places of a text's words are found in time that grows with the text; a word is in the order of its places."""
    import time

    from pyspark.sql import functions as F

    from ledgerloom.sources.search_index import positions

    words = [f"w{i % 20_000}" for i in range(60_000)]
    rows = spark.createDataFrame([(1, " ".join(words), "b a b"), (2, None, ""), (None, "w1 x", None)], "k long, summary string, reason string").coalesce(1)
    begun = time.time()
    found = positions(rows, "k", ("summary", "reason"))
    have = {(r["token"], r["key"], r["column"]): r["positions"] for r in found.where(F.col("key").isNull() | (F.col("column") == "reason") | F.col("token").isin("w7", "w19999")).collect()}
    assert time.time() - begun < 30  # more than 100 s where each word is looked for in all of its text
    assert have == {("w7", 1, "summary"): [7, 20_007, 40_007], ("w19999", 1, "summary"): [19_999, 39_999, 59_999], ("a", 1, "reason"): [1], ("b", 1, "reason"): [0, 2], ("w1", None, "summary"): [0], ("x", None, "summary"): [1]}
    assert found.count() == 20_004
