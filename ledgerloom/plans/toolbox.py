"""The tools and commands in one place: each returns a DataFrame; texts are a formatter on top."""

from __future__ import annotations

import os
import time
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.crypto import derive_key
from ..functions.secrets import scrub_diff
from ..functions.text import STATE_DIR, local_import_path
from ..operators import codegraph, integrity, journal, reconcile, render, sessions
from ..parsers.base import imports_of, parse_files, symbols_of
from ..sources import config, files
from ..sources.aliases import load_aliases
from ..sources.code_index import CodeIndex
from ..sources.git import Git, commit_files, staged_files
from ..sources.journal_store import Journal, load_salt
from ..sources.search_index import SearchIndex, journal_search
from .summariser import over_http

BLOCK = "LEDGERLOOM_GATE_BLOCK"
#: Where a commit's Merkle root is noted in git, beside the journal.
ANCHOR_REF, ANCHOR = "refs/notes/ledgerloom", "ledgerloom-root: "


class Toolbox:
    """Twelve tools over a journal and a code index of one repository. ``summarise(path, diff)`` gives a text or None, see
    ``summariser``; without one, the settings decide. Settings are the repository's own unless given."""

    def __init__(self, spark: SparkSession, root: str, store: Journal, index_path: str, summarise=None, settings: config.Config | None = None):
        self.spark, self.root, self.journal = spark, root, store
        self.code = CodeIndex(spark, index_path)
        self.settings = config.load(root) if settings is None else settings
        self.summarise = over_http(self.settings.summariser) if summarise is None and self.settings.summariser.enabled else summarise
        self.git = Git(root)
        self.words = SearchIndex(spark, f"{store.path}/_words")
        self.calls: list[tuple[str, str]] = []
        self.began = time.monotonic()

    @classmethod
    def open(cls, spark: SparkSession, root: str, journal_path: str, index_path: str, salt_path: str, **options) -> Toolbox:
        """With the journal's key made from the salt in a file (made anew where there is none) and the repository's address of its user."""
        key = derive_key(load_salt(salt_path), Git(root).email())
        return cls(spark, root, Journal(spark, journal_path, key), index_path, **options)

    # tools

    def _called(self, tool: str) -> None:
        self.calls.append(("", tool))

    def get_session_context(self) -> DataFrame:
        used = self.spark.createDataFrame([("", sorted({t for _, t in self.calls}))], "session string, tools array<string>")
        out = sessions.context(used, self.journal.changes().count(), self.index_state(), seconds=time.monotonic() - self.began)
        self._called("get_session_context")
        return out

    def record_change(self, file: str, summary: str, reason: str = "", agent_id: str = "") -> DataFrame:
        return self._record([{"file": file, "summary": summary, "reason": reason}], agent_id, "record_change")

    def record_batch(self, changes: list[dict], agent_id: str = "") -> DataFrame:
        return self._record(changes, agent_id, "record_batch")

    def _record(self, changes: list[dict], agent_id: str, tool: str) -> DataFrame:
        stats = self.git.stats()
        stat = lambda f: "+%d -%d" % s if (s := stats.get(f)) else ""
        rows = [(c["file"], c["summary"], c.get("reason", ""), "agent", stat(c["file"]), self._diff_hash(c["file"]), "", self.git.branch(), agent_id) for c in changes]
        given = self.spark.createDataFrame(rows, "file_path string, summary string, reason string, source string, diff_stat string, diff_hash string, commit_hash string, branch string, agent_id string").coalesce(1)
        bad = self.journal.record(given, whole=True)
        self.render_changes([c["file"] for c in changes])
        self._called(tool)
        return bad

    def _diff_hash(self, file: str, commit: str = "") -> str:
        return self.git.diff_hash(file, commit) if commit or self.git.head() else ""

    def get_file_history(self, file: str, limit: int | None = None) -> DataFrame:
        self._called("get_file_history")
        return journal.file_history(self.effective(), file, journal.clamp(limit, 10))

    def get_recent_changes(self, limit: int | None = None, summarize: bool = False) -> DataFrame:
        """The newest changes; ``summarize``: with what the summariser says of each one's diff, '' where it says nothing."""
        self._called("get_recent_changes")
        found = journal.recent(self.effective(), journal.clamp(limit, 20))
        if not summarize:
            return found
        shown = [(r["id"], r["file_path"], r["commit_hash"]) for r in found.select("id", "file_path", "commit_hash").collect()]  # the limit's number
        told = self._summaries([(f, c) for _, f, c in shown])
        said = self.spark.createDataFrame([(i, told.get((f, c)) or "") for i, f, c in shown], "id long, told string")
        return found.join(F.broadcast(said), "id").orderBy(F.col("recorded_at").desc(), F.col("id").desc())

    def _summaries(self, wanted: list[tuple[str, str]]) -> dict[tuple[str, str], str | None]:
        """What the summariser says of (file, commit), shown without secrets; '' as the commit is the working tree."""
        if not self.summarise or not wanted:
            return {}
        rows = []
        for f, c in dict.fromkeys(wanted):
            try:
                rows.append((f, c, self.git.diff(f, c)))
            except (RuntimeError, ValueError):  # a commit that isn't here
                continue
        if not rows:
            return {}
        shown = self.spark.createDataFrame(rows, "f string, c string, d string").select("f", "c", scrub_diff(F.col("d")).alias("d"))
        return {(r["f"], r["c"]): self.summarise(r["f"], r["d"]) for r in shown.toLocalIterator()}

    def search_changes(self, query: str, limit: int | None = None) -> DataFrame:
        self._called("search_changes")
        return journal_search(self.words, self.effective(), query, journal.clamp(limit, 20))

    def get_diff(self, file: str, commit: str = "", summarize: bool = False) -> DataFrame:
        """A file's diff; ``summarize``: with what the summariser says of it, '' where it says nothing."""
        self._called("get_diff")
        out = self.spark.createDataFrame([(file, commit, self.git.diff(file, commit))], "file_path string, commit_hash string, diff string").withColumn("scrubbed", scrub_diff(F.col("diff")))
        return out.withColumn("told", F.lit(self._summaries([(file, commit)]).get((file, commit)) or "")) if summarize else out

    def get_changes_in_range(self, since: int, until: int, file: str | None = None, limit: int | None = None) -> DataFrame:
        self._called("get_changes_in_range")
        return journal.in_range(self.effective(), since, until, file, journal.clamp(limit, 50))

    def _indexed_at(self) -> F.Column:
        """When the index was last brought up to date, as a column of answers from it."""
        return F.lit(self.code.last_scan() // 1000 if self.code.known else 0).cast("long").alias("last_indexed_at")

    def list_symbols(self, file: str, limit: int | None = None) -> DataFrame:
        """A file's symbols, with how many it has (``total``) and when the index was made."""
        self._called("list_symbols")
        found = codegraph.symbols_of_file(self.symbols(), file).drop("folded").withColumn("total", F.count(F.lit(1)).over(W.partitionBy("file_path")))  # of one file
        return found.select("*", self._indexed_at()).orderBy("line_start", "name").limit(journal.clamp(limit, 50))

    def find_symbol(self, name: str, limit: int | None = None) -> DataFrame:
        """Symbols by the beginning of their names, with how many there are (``total``) and when the index was made."""
        self._called("find_symbol")
        met = codegraph.find_symbol(self.symbols(), name).drop("folded")
        total = met.groupBy().agg(F.count(F.lit(1)).alias("total"))  # one row
        found = codegraph.find_symbol(self.symbols(), name, journal.clamp(limit, 20)).drop("folded")
        return found.join(F.broadcast(total)).select("*", self._indexed_at()).orderBy(F.length("name"), "file_path", "line_start", "name", "line_end")

    def get_dependents(self, file: str) -> DataFrame:
        self._called("get_dependents")
        key = self.spark.createDataFrame([(file,)], "f string").select(local_import_path("f", files.module_path(self.root))).first()[0]
        return codegraph.importers(self.imports(), key if key is not None else "\0").select("*", self._indexed_at())

    def get_index_summary(self, limit: int | None = None) -> DataFrame:
        """The hubs, most imported first, each beside the index's totals: files, symbols, imports, files per language, when it was
        last scanned, what was left out, its size. One row without a hub if nothing is imported; none without an index."""
        self._called("get_index_summary")
        if not self.code.known:
            return self.spark.createDataFrame([], "imported_path string, dependents long")
        hubs = codegraph.hubs(self.imports(), journal.clamp(limit, 10, 100))
        return self.index_status().join(F.broadcast(hubs), how="left").orderBy(F.col("dependents").desc(), "imported_path")  # a row beside the limit's number

    # journal jobs

    def index_words(self) -> None:
        """Take rows that came since into the word index, and merge its runs where they are due."""
        rows = self.journal.changes()
        upto, last = self.words.log.snapshot().state.get("upto", 0), rows.agg(F.max("id")).first()[0] or 0
        if last > upto:
            self.words.add(self.journal.changes(after=upto).where((F.col("id") > upto) & (F.col("id") <= last)), "id", last)
            self.words.merge()

    def effective(self) -> DataFrame:
        """The journal with claimed rows under their commits."""
        rows = self.journal.changes()
        return reconcile.effective_commits(rows, self.journal.claims()).withColumn("commit_hash", F.col("effective_commit")).drop("effective_commit")

    def after_commit(self, commit: str | None = None) -> str:
        """Claim, cover, fall back, render, index, anchor; returns the Merkle root of the commit's rows."""
        commit = commit or self.git.head()
        changed = commit_files(self.spark, self.git, [commit])
        names = [r["file_path"] for r in changed.collect()]  # of one commit
        self.journal.claim(commit, names)
        rows = self.effective()
        agent = rows.where((F.col("source") == "agent") & (F.col("commit_hash") == commit)).select("file_path", "commit_hash", "diff_stat")
        covered = reconcile.coverage(changed, agent)
        told = self._told([r["file_path"] for r in reconcile.fallback_rows(covered, 0).collect()], commit)
        text = lambda path, _: F.col("_text")
        missing = reconcile.fallback_rows(covered.join(told.select("file_path", "_text"), "file_path", "left"), int(time.time()), self.git.branch(), text)
        self.journal.record(missing.join(told.drop("_text"), "file_path", "left").orderBy("file_path").coalesce(1))
        self.index_words()
        self.render_changes(names)
        if self.settings.index.enabled:
            self.index_incremental(names)
        own = self.effective().where(F.col("commit_hash") == commit)
        root = integrity.merkle_root(own.select("id", "hmac"), "id", "hmac").first()
        if root:
            try:
                self.git.add_note(ANCHOR_REF, ANCHOR + root["root"], commit)
            except RuntimeError as e:  # the journal holds without its anchor
                warnings.warn(f"no anchor for {commit[:12]}: {e}", stacklevel=2)
        return root["root"] if root else ""

    def _told(self, names: list[str], commit: str) -> DataFrame:
        """(file_path, diff_stat, diff_hash, _text) of uncovered files of a commit; the text is a summariser's, or null. It is
        shown diffs without secrets."""
        stats = self.git.stats(commit)
        rows = [(f, "+%d -%d" % stats[f] if stats.get(f) else "", self._diff_hash(f, commit)) for f in names]
        texts: dict[str, str | None] = {}
        if self.summarise and names:
            shown = self.spark.createDataFrame([(f, self.git.diff(f, commit)) for f in names], "f string, d string").select("f", scrub_diff(F.col("d")).alias("d"))
            texts = {r["f"]: self.summarise(r["f"], r["d"]) for r in shown.toLocalIterator()}
        return self.spark.createDataFrame([(*r, texts.get(r[0])) for r in rows], "file_path string, diff_stat string, diff_hash string, _text string")

    def gate(self, env: dict | None = None) -> tuple[DataFrame, bool]:
        """Staged files without a recorded reason, and whether the commit is to be stopped."""
        found = reconcile.unexplained(staged_files(self.spark, self.git), self.effective())
        block = config.truthy((os.environ if env is None else env).get(BLOCK, ""))
        return found, block and found.limit(1).count() > 0

    def render_changes(self, only: list[str] | None = None) -> int:
        """Write the hints of all files, or of those of a batch, and the change log."""
        rows = self.effective()
        some = rows if only is None else rows.where(F.col("file_path").isin(sorted(set(only))))
        hints = render.file_hints(some).select("path", "content")
        return files.write_rendered(hints.union(render.changelog(rows)), self.root)

    def verify(self) -> dict[str, DataFrame]:
        rows = self.effective()
        expected = render.file_hints(rows).select("path", "content").union(render.changelog(rows))
        return {
            "chain": self.journal.verify(),
            "clock": rows.where("clock_tamper_warning").select("id", "file_path", "recorded_at"),
            "clock_count": rows.agg(F.count_if("clock_tamper_warning").alias("n_warnings")),
            "rendered": render.diverged(expected, files.read_rendered(self.spark, self.root)),
            "root": integrity.merkle_root(rows.select("id", "hmac"), "id", "hmac"),
        }

    def status(self) -> DataFrame:
        return journal.status(self.effective())

    # index jobs

    def symbols(self) -> DataFrame:
        return self.code.symbols()

    def imports(self) -> DataFrame:
        return self.code.imports()

    def index_state(self) -> dict | None:
        if not self.code.known:
            return None
        s = codegraph.summary(self.symbols(), self.imports()).first()
        return {"file_count": s["file_count"], "symbol_count": s["symbol_count"], "last_indexed_at": self.code.last_scan() // 1000}

    def index(self, force: bool = False, only: list[str] | None = None) -> dict:
        """Parse, guard, append as a new scan. A full scan also marks what is gone as deleted."""
        limits = self.settings.index
        found, counts = files.scan(self.spark, self.root, self.git, max_size=limits.max_file_size, only=only, languages=limits.languages)
        parsed = parse_files(found, load_aliases(self.root), limits.parse_timeout_ms / 1000).cache()
        scan_id = int(time.time() * 1000)
        good = parsed.where("status = 'ok'")
        new_symbols, new_imports = symbols_of(good), imports_of(good)
        before = self.symbols().count()
        if only is None:
            codegraph.guard(new_symbols, new_imports, before, max(0, self.index_size()), limits.max_bytes, force)
        stamp = lambda df: df.withColumn("scan_id", F.lit(scan_id).cast("long"))
        scans = good.select("file_path", F.lit(scan_id).cast("long").alias("scan_id"), F.lit(False).alias("deleted"))
        known = codegraph.indexed_files(self.symbols(), self.imports())
        if only is None:
            gone = known.join(good.select("file_path"), "file_path", "left_anti")
        else:  # files of a partial scan that are no longer there, or have lost their parser
            missing = [p for p in only if not os.path.isfile(os.path.join(self.root, p))]
            gone = known.where(F.col("file_path").isin(missing)) if missing else known.limit(0)
        scans = scans.union(gone.select("file_path", F.lit(scan_id).cast("long"), F.lit(True)))
        meta = None
        if only is None:  # a partial scan doesn't see what it skips elsewhere
            now = codegraph.summary(new_symbols, new_imports).first()
            meta = {"last_indexed_at": scan_id // 1000, "file_count": now["file_count"], "symbol_count": now["symbol_count"], "language_counts": now["language_counts"], "skipped_count": counts["skipped"], "unsupported_count": counts["unsupported"]}
        self.code.add(stamp(new_symbols), stamp(new_imports), scans, meta)
        n_files = good.count()
        parsed.unpersist()
        self.render_index(counts if only is None else None)
        return counts | {"symbols": self.symbols().count(), "files": n_files}

    def index_size(self) -> int:
        """Bytes of the index's files; -1 if there is none."""
        return self.code.size()

    def _counts(self) -> dict:
        """What the last full scan skipped and had no parser for."""
        meta = self.code.meta()
        return {"skipped": meta.get("skipped_count", 0), "unsupported": meta.get("unsupported_count", 0)}

    def index_status(self) -> DataFrame:
        """One row: files, symbols and imports now, files per language, when it was last scanned, what a full scan left out, bytes."""
        state, counts = self.index_state() or {}, self._counts()
        return codegraph.summary(self.symbols(), self.imports()).select(
            "*", F.lit(state.get("last_indexed_at", 0)).cast("long").alias("last_indexed_at"), F.lit(counts["skipped"]).alias("skipped_count"),
            F.lit(counts["unsupported"]).alias("unsupported_count"), F.lit(self.index_size()).cast("long").alias("size_bytes"),
        )

    def index_incremental(self, paths: list[str]) -> dict:
        return self.index(force=True, only=paths)

    def render_index(self, counts: dict | None = None) -> None:
        module = files.module_path(self.root)
        wiki = self.settings.index.wikilinks
        notes = render.file_notes(self.symbols(), self.imports(), module, wiki).select("path", "content")
        state = self.index_state() or {}
        counts = counts or self._counts()
        rollup = render.index_rollup(self.symbols(), self.imports(), state.get("last_indexed_at", 0), counts["skipped"], counts["unsupported"], module, wiki)
        files.write_rendered(notes.union(rollup), self.root)
        files.prune_notes(self.root, {r["path"] for r in notes.select("path").collect()})

    def index_drift(self) -> DataFrame:
        known = codegraph.indexed_files(self.symbols(), self.imports())
        disk = files.listed(self.spark, self.root, self.git).select("file_path", "length", "ignored")
        noted = files.notes(self.spark, os.path.join(self.root, STATE_DIR, "index"))
        return codegraph.drift(known, disk, noted, self.settings.index.max_file_size)
