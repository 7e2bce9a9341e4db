"""Source files: listing with directory pruning on the driver, contents through Spark's binary source."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STATE_DIR
from ..parsers.base import MAX_FILE_BYTES, parser_for
from .git import Git

SKIPPED_DIRS = {".git", STATE_DIR}
LISTED = "file_path string, length long, supported boolean, ignored boolean"


def listing(root: str, git: Git | None = None, extra_ignore: str | None = None) -> list[tuple[str, int, bool, bool]]:
    """(path, size, has a parser, ignored) of all regular files, in order; links and special files are skipped, ignored
    folders aren't entered."""
    found: list[tuple[str, int]] = []
    for folder, dirs, names in os.walk(root):
        rel = os.path.relpath(folder, root)
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED_DIRS)
        if git:
            gone = git.ignored([os.path.normpath(os.path.join(rel, d)) + "/" for d in dirs], extra_ignore)
            dirs[:] = [d for d in dirs if os.path.normpath(os.path.join(rel, d)) + "/" not in gone]
        for name in sorted(names):
            info = os.lstat(os.path.join(folder, name))
            if stat.S_ISREG(info.st_mode):
                found.append((os.path.normpath(os.path.join(rel, name)).replace(os.sep, "/"), info.st_size))
    gone = git.ignored([p for p, _ in found], extra_ignore) if git else set()
    return [(p, n, parser_for(p) is not None, p in gone) for p, n in found]


def listed(spark: SparkSession, root: str, git: Git | None = None, extra_ignore: str | None = None) -> DataFrame:
    return spark.createDataFrame(listing(root, git, extra_ignore), LISTED)


def contents(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(file_path, length, content) of listed files."""
    if not paths:
        return spark.createDataFrame([], "file_path string, length long, content binary")
    base = "file:" + os.path.realpath(root).rstrip("/") + "/"
    read = spark.read.format("binaryFile").load(["file://" + os.path.join(os.path.realpath(root), p) for p in paths])
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + base.replace(".", r"\."), "")
    return read.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("file_path"), "length", "content")


def scan(spark: SparkSession, root: str, git: Git | None = None, extra_ignore: str | None = None, max_size: int = MAX_FILE_BYTES, only: list[str] | None = None, languages: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Files to be parsed, and how many were skipped or have no parser. Size and kind are judged before a byte is read.
    ``only``: an incremental scan of these paths (links are followed there); ``languages``: those to parse, or all."""
    rows = listing(root, git, extra_ignore)
    if only is not None:
        wanted = set(only)
        rows = [r for r in rows if r[0] in wanted] + [
            (p, os.stat(os.path.join(root, p)).st_size, parser_for(p) is not None, False)
            for p in sorted(wanted) if os.path.islink(os.path.join(root, p)) and os.path.isfile(os.path.join(root, p))
        ]
    if languages is not None:
        rows = [(p, n, supported and parser_for(p)[0] in languages, ignored) for p, n, supported, ignored in rows]
    good = [p for p, n, supported, ignored in rows if supported and not ignored and n <= max_size]
    counts = {"unsupported": sum(not r[2] and not r[3] for r in rows), "skipped": sum(r[2] and not r[3] and r[1] > max_size for r in rows)}
    return contents(spark, root, good), counts


def module_path(root: str) -> str | None:
    """The module line of go.mod."""
    try:
        with open(os.path.join(root, "go.mod"), encoding="utf-8") as f:
            return next((x.split()[1].strip('"') for x in f if x.startswith("module ") and len(x.split()) > 1), None)
    except OSError:
        return None


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path) of the notes below a folder."""
    found = [os.path.relpath(os.path.join(d, n), folder)[:-3].replace(os.sep, "/") for d, _, names in os.walk(folder) for n in names if n.endswith(".md")]
    return spark.createDataFrame([(p,) for p in sorted(found)], "file_path string")


def write_rendered(rendered: DataFrame, root: str) -> int:
    """Write (path, content) rows below a folder of this machine, row by row as they arrive; returns how many."""
    n = 0
    for row in rendered.select("path", "content").toLocalIterator():
        target = os.path.join(root, row["path"])
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8") as f:
            f.write(row["content"])
        n += 1
    return n


def read_rendered(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all markdown in the state folder."""
    base = os.path.join(root, STATE_DIR)
    found = [(os.path.relpath(os.path.join(d, n), root).replace(os.sep, "/"), open(os.path.join(d, n), encoding="utf-8").read()) for d, _, names in os.walk(base) for n in names if n.endswith(".md")]
    return spark.createDataFrame(found, "path string, content string")


def prune_notes(root: str, keep: set[str]) -> list[str]:
    """Delete index notes that aren't in ``keep`` (paths below the root), then folders that are left empty, deepest first."""
    base = os.path.join(root, STATE_DIR, "index")
    gone = []
    for d, _, names in os.walk(base, topdown=False):
        for n in names:
            rel = os.path.relpath(os.path.join(d, n), root).replace(os.sep, "/")
            if n.endswith(".md") and rel not in keep:
                os.remove(os.path.join(d, n))
                gone.append(rel)
        if d != base and not os.listdir(d):
            os.rmdir(d)
    return sorted(gone)
