"""Markdown views of journals and code graphs, as (path, content) rows, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STATE_DIR, blank, format_time, hint_path, language, md_escape, note_link, note_path, short_hash, shown_time
from . import codegraph
from .journal import CHANGELOG_LIMIT, HISTORY_LIMIT, newest, recent, top_per_file

CHANGELOG = f"{STATE_DIR}/CHANGES.md"
INDEX = f"{STATE_DIR}/INDEX.md"


def _part(cond: Column, *parts) -> Column:
    return F.when(cond, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))).otherwise("")


def _lines(order: list[str], line: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda s: s["_line"]), "")


def file_hints(changes: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """(file_path, path, content) for each file: its newest rows first."""
    section = F.concat(
        F.lit("## "), shown_time("recorded_at", "created_at"), F.lit("\n- source: "), F.col("source"),
        _part(blank("agent_id") != "", " · agent: `", F.col("agent_id"), "`"),
        _part(blank("branch") != "", " · branch: `", F.col("branch"), "`"),
        F.when(blank("commit_hash") != "", F.concat(F.lit(" · commit: `"), short_hash("commit_hash"), F.lit("`"))).otherwise(" · uncommitted"),
        _part(blank("diff_stat") != "", " · diff: ", F.col("diff_stat")),
        _part(F.coalesce("clock_tamper_warning", F.lit(False)), " · **CLOCK TAMPER WARNING**"),
        F.lit("\n\n"), md_escape("summary"), F.lit("\n"),
        _part(blank("reason") != "", "\n_why: ", md_escape("reason"), "_\n"), F.lit("\n"),
    )
    top = top_per_file(changes, limit).withColumn("_line", section)
    body = top.groupBy("file_path").agg(_lines(["rank"], F.col("_line")).alias("_body"))
    return body.select("file_path", hint_path("file_path").alias("path"), F.concat(F.lit("# "), F.col("file_path"), F.lit("\n\n"), F.col("_body")).alias("content"))


def empty_hint(path: str) -> str:
    return f"# {path}\n\n_no recorded changes yet_\n"


def changelog_heads(changes: DataFrame, limit: int = CHANGELOG_LIMIT) -> DataFrame:
    """The newest rows with ``head``: whether the row starts a run of its commit. Pending rows at the top have none."""
    order = W.orderBy(*newest())  # over at most ``limit`` rows
    return recent(changes, limit).withColumn("head", blank("commit_hash") != F.lag(blank("commit_hash"), 1, "").over(order)).withColumn("rank", F.row_number().over(order))


def changelog(changes: DataFrame, limit: int = CHANGELOG_LIMIT) -> DataFrame:
    """One row (path, content). Summaries are escaped here, too."""
    when = shown_time("recorded_at", "created_at")
    heading = F.when(blank("commit_hash") == "", F.concat(when, F.lit(" · uncommitted"))).otherwise(F.concat(when, F.lit(" · `"), short_hash("commit_hash"), F.lit("`")))
    line = F.concat(
        _part(F.col("head"), "## ", heading, "\n\n"), F.lit("- `"), F.col("file_path"), F.lit("` ("), F.col("source"),
        _part(blank("agent_id") != "", ", ", F.col("agent_id")), _part(F.coalesce("clock_tamper_warning", F.lit(False)), " [CLOCK TAMPER WARNING]"),
        F.lit("): "), md_escape("summary"), F.lit("\n"),
    )
    rows = changelog_heads(changes, limit).withColumn("_line", line)
    return rows.agg(F.concat(F.lit("# Changes\n\n_generated; edits are lost_\n\n"), _lines(["rank"], F.col("_line"))).alias("content")).select(F.lit(CHANGELOG).alias("path"), "content")


def file_notes(symbols: DataFrame, imports: DataFrame, module: str | None = None, wiki: bool = False) -> DataFrame:
    """(file_path, path, content) for each indexed file that may have a note: symbols, imports, importers."""
    files = codegraph.indexed_files(symbols, imports)
    link_dir = F.concat(F.lit("index/"), F.regexp_replace("file_path", r"[^/]*$", ""))
    sym = symbols.withColumn("_line", F.concat(F.lit("- `"), F.col("name"), F.lit("` ("), F.col("kind"), F.lit(") lines "), F.col("line_start"), F.lit("-"), F.col("line_end"), _part(blank("signature") != "", " — `", F.col("signature"), "`"), F.lit("\n")))
    sym = sym.groupBy("file_path").agg(_lines(["line_start", "name"], F.col("_line")).alias("_symbols"))
    out = codegraph.linked_imports(imports, files, module)
    out = out.withColumn("_line", F.concat(F.lit("- "), F.when(F.col("provider").isNotNull(), note_link(link_dir, F.col("imported_path"), F.coalesce("provider", F.lit("")), wiki)).otherwise(F.concat(F.lit("`"), F.col("imported_path"), F.lit("`"))), F.lit("\n")))
    out = out.groupBy("file_path").agg(_lines(["imported_path"], F.col("_line")).alias("_imports"))
    by = codegraph.dependents(imports, files, module).withColumn("_line", F.concat(F.lit("- "), note_link(link_dir, F.col("importer"), F.col("importer"), wiki), F.lit("\n")))
    by = by.groupBy("file_path").agg(_lines(["importer"], F.col("_line")).alias("_by"))
    section = lambda title, c: _part(F.col(c).isNotNull(), f"## {title}\n\n", F.coalesce(c, F.lit("")), "\n")
    all_parts = files.join(sym, "file_path", "left").join(out, "file_path", "left").join(by, "file_path", "left")
    content = F.concat(F.lit("# "), F.col("file_path"), F.lit("\n\n"), section("Symbols", "_symbols"), section("Imports", "_imports"), section("Imported by", "_by"))
    return all_parts.select("file_path", note_path("file_path").alias("path"), content.alias("content")).where("path is not null")


def index_rollup(symbols: DataFrame, imports: DataFrame, last_indexed_at: int = 0, skipped: int = 0, unsupported: int = 0, module: str | None = None, wiki: bool = False) -> DataFrame:
    """One row (path, content): totals, languages, hubs."""
    files = codegraph.indexed_files(symbols, imports)
    s = codegraph.summary(symbols, imports)
    hubs = codegraph.hubs(imports, 10).join(codegraph.providers(files, module), "imported_path", "left")
    line = F.concat(F.lit("- "), F.col("dependents"), F.lit(" import(s): "), F.when(F.col("provider").isNotNull(), note_link(F.lit("."), F.col("imported_path"), F.coalesce("provider", F.lit("")), wiki)).otherwise(F.concat(F.lit("`"), F.col("imported_path"), F.lit("`"))), F.lit("\n"))
    hubs = hubs.withColumn("_line", line).withColumn("_least", -F.col("dependents"))
    listed = hubs.agg(_lines(["_least", "imported_path"], F.col("_line")).alias("_hubs"))
    langs = F.array_join(F.transform(F.array_sort(F.map_entries("language_counts")), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    content = F.concat(
        F.lit("# Structural index\n\n- files indexed: "), F.col("file_count"), F.lit("\n- symbols: "), F.col("symbol_count"), F.lit("\n- imports recorded: "), F.col("import_count"),
        F.lit("\n- last indexed: "), format_time(F.lit(last_indexed_at), "never"), F.lit("\n"), _part(F.size("language_counts") > 0, "- language breakdown:\n", langs),
        F.lit(f"- skipped files: {skipped}\n" if skipped else ""), F.lit(f"- unsupported files: {unsupported}\n" if unsupported else ""),
        _part(F.col("_hubs") != "", "\n## Most imported files (hubs)\n\n", F.col("_hubs")),
    )
    return s.join(F.broadcast(listed)).select(F.lit(INDEX).alias("path"), content.alias("content"))  # one row each


def diverged(expected: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Paths whose file isn't what would be rendered; a missing file counts as empty. Both: (path, content)."""
    digest = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256)
    return expected.join(on_disk.select("path", F.col("content").alias("_have")), "path", "left").where(digest("content") != digest("_have")).select("path")


def changes_text(changes: DataFrame) -> DataFrame:
    """Rows as lines for people: (id, line)."""
    line = F.concat(
        F.lit("["), format_time("recorded_at"), F.lit("] "), F.col("file_path"), F.lit(" ("), F.col("source"),
        _part(blank("branch") != "", ", ", F.col("branch")), _part(blank("agent_id") != "", ", ", F.col("agent_id")),
        _part(F.coalesce("clock_tamper_warning", F.lit(False)), " [CLOCK TAMPER WARNING]"), F.lit(", "), short_hash("commit_hash"), F.lit("): "),
        F.col("summary"), _part(blank("reason") != "", " — why: ", F.col("reason")),
    )
    return changes.select("id", line.alias("line"))


def language_of_files(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language("file_path"))
