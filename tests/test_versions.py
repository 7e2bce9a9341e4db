"""The journal's versions: several writers, replays, readers during a rotation, merging, anchors."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import anchors, integrity
from ledgerloom.sources.commit_log import CommitLog, Conflict
from ledgerloom.sources.journal_store import Journal
from ledgerloom.streaming.ingest import flag_skew, ingest, skew_flags_so_far

KEY, NEW_KEY = b"k" * 32, b"n" * 32
INPUT = "file_path string, summary string, recorded_at long"


def rows(spark, *names, at=100):
    return spark.createDataFrame([(f"{n}.go", n, at) for n in names], INPUT).coalesce(1)


def summaries(journal, **how):
    return [r["summary"] for r in journal.changes(**how).orderBy("id").collect()]


def test_two_streams_and_a_replay(spark, tmp_path):
    store = Journal(spark, str(tmp_path / "j"), KEY)
    for k in range(2):
        rows(spark, *(f"s{k}r{i}" for i in range(5))).write.parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema(INPUT).parquet(str(tmp_path / f"in{k}"))
        ingest(stream, store, str(tmp_path / f"cp{k}"), str(tmp_path / "bad")).awaitTermination()
    assert store.changes().count() == 10 and store.verify().count() == 0
    assert [r["id"] for r in store.changes().orderBy("id").collect()] == list(range(1, 11))
    (tmp_path / "cp1" / "commits" / "0").unlink()  # killed after the journal's commit, before its own
    for f in (tmp_path / "cp1" / "commits").glob(".*"):
        f.unlink()
    for job in (None, store.compact, lambda: store.rotate(NEW_KEY), lambda: Journal(spark, store.path, NEW_KEY).merge(2)):
        if job:
            job()
        store = Journal(spark, store.path, NEW_KEY if store._tail is None or store.snapshot().state["key"] != store_key(KEY) else KEY)
        ingest(spark.readStream.schema(INPUT).parquet(str(tmp_path / "in1")), store, str(tmp_path / "cp1")).awaitTermination()
        assert sorted(summaries(store)) == sorted(f"s{k}r{i}" for k in range(2) for i in range(5))
        for f in (tmp_path / "cp1" / "commits").iterdir():
            f.unlink()
    assert store.verify().count() == 0


def store_key(key):
    from ledgerloom.sources.journal_store import key_name

    return key_name(key)


def test_readers_keep_their_version(spark, tmp_path):
    store = Journal(spark, str(tmp_path / "j"), KEY)
    for k in range(3):
        store.record(rows(spark, f"a{k}"))
    store.claim("c1", ["a1.go"])
    before, old = store.snapshot(), store.changes()
    fresh = store.rotate(NEW_KEY)
    assert integrity.findings(old, KEY).count() == 0 and integrity.findings(fresh.changes(), NEW_KEY).count() == 0
    assert integrity.findings(store.changes(before), KEY).count() == 0 and fresh.claims().count() == 1
    with pytest.raises(ValueError, match="another key"):
        store.record(rows(spark, "late"))
    fresh.record(rows(spark, "b"))
    assert summaries(fresh) == ["a0", "a1", "a2", "b"] and fresh.verify().count() == 0
    assert fresh.vacuum() == 3 and summaries(fresh) == ["a0", "a1", "a2", "b"]
    tampered = Journal(spark, str(tmp_path / "t"), KEY)
    tampered.log.commit(tampered.snapshot(), {"changes": [tampered.log.write(fresh.changes(), "changes")]})
    with pytest.raises(ValueError, match="verify"):
        tampered.rotate(NEW_KEY)


def test_writers_at_once(spark, tmp_path, monkeypatch):
    """Another writer commits between a writer's reading and its commit: both end up in the chain, once."""
    store, other = (Journal(spark, str(tmp_path / "j"), KEY) for _ in range(2))
    real, calls = CommitLog.commit, []

    def late(self, base, *args, **kwargs):
        if not calls:
            calls.append(1)
            other.record(rows(spark, "second"))
        return real(self, base, *args, **kwargs)

    monkeypatch.setattr(CommitLog, "commit", late)
    store.record(rows(spark, "first"))
    assert summaries(store) == ["second", "first"] and store.verify().count() == 0
    calls.clear()
    store.merge(2)
    assert summaries(store) == ["second", "first", "second"] and store.verify().count() == 0
    base = store.snapshot()
    real(store.log, base)
    with pytest.raises(Conflict):
        real(store.log, base)
    assert len(os.listdir(tmp_path / "j" / "changes")) == len(store.snapshot().of("changes")) + 3  # the merged runs wait for vacuum


def test_merge_by_levels_and_full_versions(spark, tmp_path):
    store = Journal(spark, str(tmp_path / "j"), KEY)
    for k in range(18):
        store.record(rows(spark, f"r{k:02d}", at=100 + k), batch=("q", k))
        store.merge(4)
        assert store.record(rows(spark, "again"), batch=("q", k)).count() == 0
    now = store.snapshot()
    assert summaries(store) == [f"r{k:02d}" for k in range(18)] and store.verify().count() == 0
    assert sorted(r["level"] for r in now.of("changes")) == [0, 0, 2] and now.version > 16 and now.seen == {"q": 17}
    assert store.log.snapshot(now.version) == now and len(summaries(store, at=store.log.snapshot(3))) == 3
    store.vacuum()
    assert summaries(store) == [f"r{k:02d}" for k in range(18)] and min(store.log.versions()) == 16


def test_journals_from_before_versions(spark, tmp_path):
    source = Journal(spark, str(tmp_path / "a"), KEY)
    source.record(rows(spark, "x", "y"))
    source.claim("c", ["x.go"])
    source.changes().drop("created_at").write.parquet(str(tmp_path / "b" / "changes"))
    source.claims().write.parquet(str(tmp_path / "b" / "claims"))
    old = Journal(spark, str(tmp_path / "b"), KEY)
    assert summaries(old) == ["x", "y"]
    old.record(rows(spark, "z"))
    assert summaries(old) == ["x", "y", "z"] and old.claims().count() == 1 and old.verify().count() == 0
    assert old.snapshot().state["n"] == 3 and old.snapshot().state["peaks"] == anchors.peaks(old.changes().select("id", "hmac"))


def test_anchor(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(integrity, "MERKLE_BLOCK", 4)
    store = Journal(spark, str(tmp_path / "j"), KEY)
    for k in (1, 5, 9, 2):
        store.record(rows(spark, *(f"{k}x{i}" for i in range(k))))
    made = store.anchor()
    whole = store.changes().select("id", "hmac")
    assert made["n"] == 17 and made["root"] == integrity.merkle_root(whole, "id", "hmac").first()["root"] and made["peaks"] == anchors.peaks(whole)
    assert store.newest_anchor() == made == store.anchor()
    assert store.verify(made).count() == 0
    store.record(rows(spark, "later", "last", at=200))
    assert [tuple(r)[:2] for r in store.verify(made).collect()] == []
    seen = store.changes(after=made["id"] - 1)
    assert len(seen.inputFiles()) < len(store.changes().inputFiles()) and seen.agg(F.min("id")).first()[0] > 15  # earlier runs aren't read
    # a forged anchor, and one of another key
    for forged in (made | {"id": 3}, made | {"signature": "0"}, {}):
        assert not anchors.holds(forged, KEY)
    with pytest.raises(ValueError):
        store.verify(made | {"n": 4})
    (tmp_path / "j" / "_anchors" / f"{99:020d}.json").write_text(json.dumps(made | {"id": 99}))
    assert store.newest_anchor() == made
    # the newest versions are taken away, and with them the end of the journal
    for v in store.log.versions()[-2:]:
        (tmp_path / "j" / "_log" / f"{v:020d}.json").unlink()
    assert [tuple(r)[:2] for r in store.verify(made).collect()] == [(17, "cut")]
    assert store.verify().count() == 0  # the chain alone doesn't show it
    store.record(rows(spark, "new", "other"))
    assert [r["kind"] for r in store.verify(made).collect()] == ["cut"]


def test_peaks_are_the_tree(spark, monkeypatch):
    monkeypatch.setattr(integrity, "MERKLE_BLOCK", 8)
    leaves = spark.range(1, 60).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hmac"))
    for n in (1, 2, 7, 8, 9, 24, 59):
        some = leaves.where(F.col("id") <= n)
        assert anchors.root(anchors.peaks(some)) == integrity.merkle_root(some, "id", "hmac").first()["root"]
    for a, b in ((3, 5), (8, 24), (5, 59)):
        first = anchors.peaks(leaves.where(F.col("id") <= a))
        assert anchors.peaks(leaves.where((F.col("id") > a) & (F.col("id") <= b)), a, first) == anchors.peaks(leaves.where(F.col("id") <= b))


def test_skew_along_batches(spark, tmp_path):
    """Flags by ranges within a batch, the newest time carried from batch to batch, a replayed batch once."""
    import random

    rng, data, want, most = random.Random(3), [], {}, 0
    for b in range(3):
        data.append([(b * 100 + i, 0 if i % 17 == 0 else 1000 + 10 * (b * 100 + i) - rng.choice([0, 0, 4, 6, 3000])) for i in range(100)])
        spark.createDataFrame(data[-1], "id long, recorded_at long").repartition(3).write.parquet(str(tmp_path / "in" / f"b{b}"))
        for i, at in data[-1]:
            want[i] = at != 0 and most != 0 and at < most - 5
            most = max(most, at)
        stream = spark.readStream.schema("id long, recorded_at long").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in" / "b*"))
        flag_skew(stream, str(tmp_path / "table"), str(tmp_path / "cp"), ranges=8).awaitTermination()
    for f in (tmp_path / "cp" / "commits").glob("*2*"):
        f.unlink()
    flag_skew(stream, str(tmp_path / "table"), str(tmp_path / "cp"), ranges=8).awaitTermination()
    got = skew_flags_so_far(spark, str(tmp_path / "table")).collect()
    assert len(got) == 300 and {r["id"]: r["skewed"] for r in got} == want and any(want.values())
