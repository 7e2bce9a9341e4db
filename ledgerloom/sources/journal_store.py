"""A journal on disk: Parquet runs that only grow, named by numbered versions."""

from __future__ import annotations

import contextlib
import hashlib
import hmac
import json
import os
import secrets
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.secrets import first_secret
from ..functions.text import valid_path
from ..operators import anchors, integrity
from ..schemas import CHANGES, CLAIMS, SOURCES, normalise_changes, struct
from .commit_log import FANOUT, CommitLog, Conflict, Snapshot

INPUT = "file_path string, summary string, reason string, source string, diff_stat string, diff_hash string, commit_hash string, branch string, agent_id string, recorded_at long"
DEFAULT_SOURCE = "agent"


def load_salt(path: str, create: bool = True) -> bytes:
    """The secret that keys are derived from; readable by its owner alone, and never a column."""
    try:
        with open(path, "rb") as f:
            salt = f.read()
        if len(salt) < 16:
            raise ValueError("the salt is too short")
        return salt
    except FileNotFoundError:
        if not create:
            raise
    salt = secrets.token_bytes(32)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
        f.write(salt)
    return salt


def judged(rows: DataFrame) -> DataFrame:
    """Input rows with ``problem``: why a row can't be recorded, or ''."""
    have = {f.name: F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType) for f in struct(INPUT).fields}
    rows = rows.select(*(c.alias(n) for n, c in have.items()), *(["seq"] if "seq" in rows.columns else []))
    rows = rows.withColumn("source", F.when(F.coalesce("source", F.lit("")) == "", DEFAULT_SOURCE).otherwise(F.col("source")))
    texts = F.concat_ws("\n", "summary", "reason")
    problem = (
        F.when(~valid_path("file_path"), "path")
        .when(F.trim(F.coalesce("summary", F.lit(""))) == "", "summary")
        .when(~F.col("source").isin(*SOURCES), "source")
        .when(first_secret(texts) != "", "secret")
        .otherwise("")
    )
    return rows.withColumn("problem", problem)


def key_name(key: bytes) -> str:
    """What a journal's log says of its key: enough to tell another key, nothing to find it by."""
    return hmac.new(key, b"name of the key", hashlib.sha256).hexdigest()[:16]


class Journal:
    """Changes and claims, in numbered versions (see ``commit_log``). Any number of writers; each version is one of theirs."""

    def __init__(self, spark: SparkSession, path: str, key: bytes):
        self.spark, self.path, self.key = spark, path, key
        self.log = CommitLog(spark, path)

    def snapshot(self) -> Snapshot:
        """The newest version. A folder from before there were versions is taken as its first runs."""
        now = self.log.snapshot()
        if not now.version:
            old = {t: [{"path": f"{t}/{n}", "level": 0} for n in self.log.folder.names(t) if n.startswith("part-")] for t in ("changes", "claims")}
            now = Snapshot(0, {t: runs for t, runs in old.items() if runs})
        return now

    def changes(self, at: Snapshot | None = None, after: int = 0) -> DataFrame:
        """All rows of a version, or only runs that hold rows after an id."""
        runs = [r for r in (at or self.snapshot()).of("changes") if r.get("high", after + 1) > after]
        return normalise_changes(self.log.read(runs, CHANGES))

    def claims(self, at: Snapshot | None = None) -> DataFrame:
        return self.log.read((at or self.snapshot()).of("claims"), CLAIMS)

    def recorded(self, batch: tuple[str, int]) -> bool:
        """Whether a batch is in the journal, by the name of who sends it and its number."""
        return self.snapshot().seen.get(batch[0], -1) >= batch[1]

    def _tail(self, now: Snapshot) -> dict:
        """Last id, its hmac, newest time and number of rows; from the log, or by a scan of a folder that had none."""
        if "id" in now.state or not now.of("changes"):
            if now.state.get("key", key_name(self.key)) != key_name(self.key):
                raise ValueError("the journal is signed with another key")
            return {"id": 0, "hmac": "", "at": 0, "n": 0, "peaks": []} | now.state
        rows = self.changes(now)
        last = rows.agg(F.max("id").alias("id"), F.max_by("hmac", "id").alias("hmac"), F.max("recorded_at").alias("at"), F.count(F.lit(1)).alias("n")).first().asDict()
        return {k: v or ("" if k == "hmac" else 0) for k, v in last.items()} | {"peaks": anchors.peaks(rows.select("id", "hmac"))}

    def _signed(self, good: DataFrame, tail: dict) -> DataFrame:
        """The rows of a batch (``seq`` gives their order) as they follow the tail."""
        order = W.orderBy("seq")  # a batch of one writer
        good = good.withColumn("id", F.row_number().over(order) + F.lit(tail["id"]).cast("long"))
        most = F.max("recorded_at").over(W.orderBy("id").rowsBetween(W.unboundedPreceding, -1))
        most = F.greatest(F.coalesce(most, F.lit(0)), F.lit(tail["at"]))
        skewed = (F.col("recorded_at") != 0) & (most != 0) & (F.col("recorded_at") < most - integrity.SKEW_SECONDS)
        good = good.withColumn("clock_tamper_warning", skewed).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
        return integrity.sign(normalise_changes(good), self.key, tail["hmac"])

    def record(self, rows: DataFrame, now: int | None = None, whole: bool = False, batch: tuple[str, int] | None = None) -> DataFrame:
        """Append the rows that can be recorded, in one commit; the others are returned. ``whole``: if there are others, none
        is appended. ``rows`` may have ``seq`` for their order. A batch with a name and a number is appended once."""
        ordered = rows if "seq" in rows.columns else rows.withColumn("seq", F.monotonically_increasing_id())
        seq = ordered.select("seq", *(c for c in rows.columns if c != "seq"))
        marked = judged(seq)
        bad = marked.where("problem <> ''").drop("seq")
        if whole and bad.limit(1).count():
            return bad
        now = int(time.time()) if now is None else now
        good = marked.where("problem = ''").drop("problem").withColumn("recorded_at", F.coalesce("recorded_at", F.lit(now).cast("long")))
        while not (batch and self.recorded(batch)):
            base = self.snapshot()
            tail = self._tail(base)
            run = self.log.write(self._signed(good, tail), "changes")
            written = self.log.read([run], CHANGES)
            new = written.agg(F.min("id").alias("low"), F.max("id").alias("id"), F.max_by("hmac", "id").alias("hmac"), F.max("recorded_at").alias("at"), F.count(F.lit(1)).alias("n")).first()
            if not new["n"]:
                self.log.drop([run])
                if not batch:
                    break
                add, state = {}, tail
            else:
                add = {"changes": [run | {"low": new["low"], "high": new["id"]}]}
                peaks = anchors.peaks(written.select("id", "hmac"), tail["n"], tail["peaks"])
                state = {"id": new["id"], "hmac": new["hmac"], "at": max(new["at"], tail["at"]), "n": tail["n"] + new["n"], "peaks": peaks}
            try:
                self.log.commit(base, add, seen=batch, state=state | {"key": key_name(self.key)})
                break
            except Conflict:  # another writer's rows come first: ids and signatures are made anew
                if new["n"]:
                    self.log.drop([run])
        return bad

    def claim(self, commit: str, files: list[str]) -> None:
        """A commit takes up the pending agent rows of its files, by a line in the claim log."""
        while files:
            base = self.snapshot()
            last = self._tail(base)["id"]
            seq = self.claims(base).agg(F.max("claim_seq").alias("s")).first()["s"] or 0
            run = self.log.write(self.spark.createDataFrame([(seq + i + 1, f, commit, last) for i, f in enumerate(files)], CLAIMS).coalesce(1), "claims")
            try:
                self.log.commit(base, {"claims": [run]})
                break
            except Conflict:
                self.log.drop([run])

    # integrity

    def anchor(self) -> dict:
        """Sign what the journal is now, up to its last row, and keep it beside the journal; see ``anchors``."""
        tail = self._tail(self.snapshot())
        made = anchors.signed({"id": tail["id"], "hmac": tail["hmac"], "n": tail["n"], "peaks": tail["peaks"]}, self.key)
        with contextlib.suppress(Conflict):  # it is there
            self.log.folder.put(f"_anchors/{made['id']:020d}.json", json.dumps(made))
        return made

    def newest_anchor(self) -> dict | None:
        """The newest anchor whose signature holds."""
        for name in reversed([n for n in self.log.folder.names("_anchors") if n.endswith(".json")]):
            made = json.loads(self.log.folder.read(f"_anchors/{name}"))
            if anchors.holds(made, self.key):
                return made
        return None

    def verify(self, anchor: dict | None = None) -> DataFrame:
        """Findings of all rows, or, with an anchor, of those after it: runs that end before it aren't read. A journal that ends
        before its anchor, or has another row there, has lost or changed what was signed ("cut")."""
        now = self.snapshot()
        if anchor is None:
            return integrity.findings(self.changes(now), self.key)
        return anchors.findings_after(self.changes(now, anchor["id"] - 1), anchor, self.key)

    def rotate(self, new_key: bytes, to: str | None = None, force: bool = False) -> Journal:
        """The journal signed anew, as its next version (readers of older versions see the old key's rows, others the new
        one's), or in another folder; refused if the old chain has findings, unless forced."""
        target = Journal(self.spark, to or self.path, new_key)
        while True:
            base = self.snapshot()
            rows = self.changes(base)
            run = target.log.write(integrity.rotate(rows, self.key, new_key, force), "changes")
            written = target.log.read([run], CHANGES)
            last = written.agg(F.min("id").alias("low"), F.max("id").alias("id"), F.max_by("hmac", "id").alias("hmac"), F.max("recorded_at").alias("at"), F.count(F.lit(1)).alias("n")).first().asDict()
            run |= {"level": max([0, *(r["level"] for r in base.of("changes"))]), "low": last.pop("low"), "high": last["id"]}
            state = {k: v or ("" if k == "hmac" else 0) for k, v in last.items()} | {"peaks": anchors.peaks(written.select("id", "hmac")), "key": key_name(new_key)}
            try:
                return target._replaced(self, base, {"changes": [run]}, state, bool(to))
            except Conflict:
                target.log.drop([run])

    def _replaced(self, source: Journal, base: Snapshot, runs: dict[str, list[dict]], state: dict, elsewhere: bool) -> Journal:
        """Commit runs instead of a version's: here, or as the first version of another folder, with its claims."""
        if not elsewhere:
            gone = {r["path"] for t in runs for r in base.of(t)}
            self.log.commit(base, runs, gone, state=state)
            return self
        if base.of("claims"):
            runs = runs | {"claims": [self.log.write(source.claims(base).coalesce(1), "claims")]}
        self.log.commit(Snapshot(0, {}, base.seen, base.state), runs, state=state)
        return self

    def compact(self, to: str | None = None, files: int = 1) -> Journal:
        """All rows as one run sorted by id, here or in another folder. Who sent which batches stays known."""
        target = Journal(self.spark, to or self.path, self.key)
        while True:
            base = self.snapshot()
            tail = self._tail(base)
            level = max([0, *(r["level"] for r in base.of("changes"))]) + 1
            rows = self.changes(base).repartitionByRange(files, "id").sortWithinPartitions("id")
            run = target.log.write(rows, "changes", level=level, low=1, high=tail["id"])
            try:
                return target._replaced(self, base, {"changes": [run]}, tail | {"key": key_name(self.key)}, bool(to))
            except Conflict:
                target.log.drop([run])

    def merge(self, fanout: int = FANOUT) -> int:
        """Make one run of each level that has ``fanout`` of them, until none has; a row is written once a level. Appends that come
        in between stay. Returns how many runs were merged."""
        merged = 0
        while due := self.log.full_levels(base := self.snapshot(), "changes", fanout):
            rows = normalise_changes(self.log.read(due, CHANGES)).repartitionByRange(max(1, len(due) // 2), "id").sortWithinPartitions("id")
            run = self.log.write(rows, "changes", level=due[0]["level"] + 1, low=min(r.get("low", 1) for r in due), high=max(r.get("high", 1 << 62) for r in due))
            try:
                self.log.commit(base, {"changes": [run]}, {r["path"] for r in due}, state={"key": key_name(self.key)} | self._tail(base))
                merged += len(due)
            except Conflict:
                self.log.drop([run])
        return merged

    def vacuum(self, keep: int = 1) -> int:
        """See ``CommitLog.vacuum``."""
        return self.log.vacuum(keep)
