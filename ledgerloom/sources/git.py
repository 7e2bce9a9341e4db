"""Git as a source: what commits changed, diffs, ignore rules. Runs on the driver; results are small tables."""

from __future__ import annotations

import hashlib
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

from ..schemas import COMMIT_FILES

_COMMITISH = re.compile(r"^[0-9a-fA-F]{4,64}$")


class Git:
    def __init__(self, root: str):
        self.root = root

    def run(self, *args: str, stdin: str | None = None, ok: tuple[int, ...] = (0,)) -> str:
        done = subprocess.run(["git", "-C", self.root, *args], input=stdin, capture_output=True, text=True, errors="replace")
        if done.returncode not in ok:
            raise RuntimeError(f"git {args[0]}: {done.stderr.strip()[:200]}")
        return done.stdout

    def top(self) -> str:
        return self.run("rev-parse", "--show-toplevel").strip()

    def head(self) -> str:
        """The current commit; '' in a repository without one."""
        return self.run("rev-parse", "--verify", "--quiet", "HEAD", ok=(0, 1)).strip()

    def branch(self) -> str:
        """The branch's name, also before its first commit; HEAD if none is checked out."""
        return self.run("symbolic-ref", "--short", "--quiet", "HEAD", ok=(0, 1)).strip() or "HEAD"

    def email(self) -> str:
        return self.run("config", "user.email", ok=(0, 1)).strip()

    def staged(self) -> list[str]:
        return [p for p in self.run("diff", "--cached", "--name-only", "--no-renames", "-z").split("\0") if p]

    def _commit(self, commit: str) -> str:
        if not _COMMITISH.match(commit):
            raise ValueError(f"not a commit: {commit!r}")
        return commit

    def is_root(self, commit: str) -> bool:
        return len(self.run("rev-list", "--parents", "-n", "1", self._commit(commit)).split()) < 2

    def changed_files(self, commit: str) -> list[str]:
        """Against the first parent; all files of a root commit."""
        args = ("show", "--name-only", "--format=", "-z", commit) if self.is_root(commit) else ("diff", "--name-only", "--no-renames", "-z", f"{commit}^", commit)
        return [p for p in self.run(*args).split("\0") if p.strip()]

    def diff(self, path: str, commit: str = "") -> str:
        """A file's unified diff in a commit, or of the working tree."""
        if not commit:
            return self.run("diff", *(["HEAD"] if self.head() else ["--cached"]), "--", path)
        args = ("show", "--format=", commit) if self.is_root(commit) else ("diff", f"{commit}^", commit)
        return self.run(*args, "--", path)

    def diff_hash(self, path: str, commit: str = "") -> str:
        """SHA-256 of a file's diff without blanks around it; '' where git can't tell."""
        try:
            diff = self.diff(path, commit)
        except RuntimeError:
            return ""
        return hashlib.sha256(diff.strip().encode()).hexdigest()

    def stats(self, commit: str = "") -> dict[str, tuple[int, int] | None]:
        """file -> (added, deleted); None for binary files. A root commit has no numbers."""
        if not commit and not self.head():
            return {}
        if commit and self.is_root(commit):
            return {p: None for p in self.changed_files(commit)}
        out: dict[str, tuple[int, int] | None] = {}
        for line in self.run("diff", "--numstat", "--no-renames", "-z", *((f"{commit}^", commit) if self._commit(commit) else ()) if commit else ("HEAD",)).split("\0"):
            parts = line.split("\t")
            if len(parts) == 3 and parts[2]:
                out[parts[2]] = None if "-" in parts[:2] else (int(parts[0]), int(parts[1]))
        return out

    def ignored(self, paths: list[str], extra_file: str | None = None) -> set[str]:
        """Which paths the ignore rules leave out, in one call; an extra file can only add to them."""
        if not paths:
            return set()
        stdin = "\0".join(paths)
        found = set(self.run("check-ignore", "--no-index", "--stdin", "-z", stdin=stdin, ok=(0, 1)).split("\0"))
        if extra_file:
            found |= set(self.run("-c", f"core.excludesFile={extra_file}", "check-ignore", "--no-index", "--stdin", "-z", stdin=stdin, ok=(0, 1)).split("\0"))
        return found - {""}

    def add_note(self, ref: str, text: str, commit: str = "HEAD") -> None:
        self.run("notes", "--ref", ref, "add", "--force", "-m", text, commit if commit == "HEAD" else self._commit(commit))


def commit_files(spark: SparkSession, git: Git, commits: list[str]) -> DataFrame:
    """What commits changed: (commit_hash, file_path, add, del, measurable)."""
    rows = []
    for c in commits:
        stats = git.stats(c)
        for p in git.changed_files(c):
            s = stats.get(p)
            rows.append((c, p, s[0] if s else None, s[1] if s else None, s is not None))
    return spark.createDataFrame(rows, COMMIT_FILES)


def staged_files(spark: SparkSession, git: Git) -> DataFrame:
    return spark.createDataFrame([(p,) for p in git.staged()], "file_path string")


def diffs(spark: SparkSession, git: Git, commit: str) -> DataFrame:
    return spark.createDataFrame([(p, commit, git.diff(p, commit)) for p in git.changed_files(commit)], "file_path string, commit_hash string, diff string")
