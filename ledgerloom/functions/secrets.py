"""Credential shapes: detection in texts and redaction of diffs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import glob_regex

#: Shapes that are never recorded.
SECRET_PATTERNS = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.",
)
#: Files whose content is never shown.
SECRET_FILES = (".env*", "*.pem", "*.key", "id_rsa*", "id_ed25519*", "id_ecdsa*", "id_dsa*", "*.p12", "*.pfx", "*.der", "*.pkcs*", "*secret*", "*credential*", "*private*")
REDACTED = "[REDACTED SECRET LINE]"
#: How lines start that only say what changed.
HEADERS = ("@@ ", "--- ", "+++ ", "diff ", "index ", "new file ", "deleted file ", "similarity ", "rename ", "Binary ")
#: What a summary by a model must not hold.
FORBIDDEN = ("\n", "\r", "\t", "`", "$", "|", ";", "&", "<", ">", "\\", "{", "}")
SUMMARY_BYTES = 240


def first_secret(text: Column, patterns: tuple[str, ...] = SECRET_PATTERNS) -> Column:
    """The first pattern that a text meets, or ''."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(p)) for p in patterns), F.lit(""))


def is_secret_file(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    globs = "|".join(map(glob_regex, SECRET_FILES))
    return base.rlike(globs) | path.rlike(globs)


def redact_lines(text: Column, patterns: tuple[str, ...] = SECRET_PATTERNS) -> Column:
    """Each line that meets a pattern becomes the marker."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(line.rlike("|".join(patterns)), REDACTED).otherwise(line)), "\n")


def scrub_diff(diff: Column, patterns: tuple[str, ...] = SECRET_PATTERNS) -> Column:
    """A unified diff without secrets: a fold over its lines carries whether the current file is a secret one."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def target(line: Column) -> Column:
        """The file that a header names; null for other lines and for headers that name none."""
        t = trimmed(line)
        words = F.split(t, r"\s+")
        git = F.when(F.size(words) >= 4, F.regexp_replace(F.get(words, F.lit(3)), "^b/", "")).otherwise("")
        side = F.regexp_replace(F.regexp_replace(F.get(words, F.lit(1)), "^a/", ""), "^b/", "")
        return F.when(t.startswith("diff --git "), git).when(t.rlike(r"^(?:---|\+\+\+) \S") & (side != "/dev/null"), side)

    plain = lambda line: F.reduce(F.array(*(F.startswith(line, F.lit(h)) for h in HEADERS)), F.lit(False), lambda a, x: a | x)

    def step(a: Column, line: Column) -> Column:
        named = target(line)
        shown = F.when(named.isNotNull() | plain(line), line).when(a["secret"] | line.rlike("|".join(patterns)), REDACTED).otherwise(line)
        return F.struct(F.when(named.isNotNull(), is_secret_file(F.coalesce(named, F.lit("")))).otherwise(a["secret"]).alias("secret"), F.concat(a["out"], F.array(shown)).alias("out"))

    start = F.struct(F.lit(False).alias("secret"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.split(diff, "\n", -1), start, step, lambda a: F.array_join(a["out"], "\n"))


def safe_summary(text: str | None) -> str | None:
    """One safe line of at most 240 bytes, cut at a blank; None for what must not be used."""
    text = text.strip() if isinstance(text, str) else ""
    if not text or any(f in text for f in FORBIDDEN):
        return None
    line = " ".join("".join(c for c in text if c.isprintable() or c == " ").split())
    data = line.encode()
    if len(data) > SUMMARY_BYTES:
        cut = data[:SUMMARY_BYTES]
        blank = cut.rfind(b" ")
        line = (cut[:blank] if blank > 0 else cut).decode(errors="ignore")
    return line if len(line.encode()) >= 4 else None


@F.pandas_udf(StringType())
def sanitise_summary(texts: pd.Series) -> pd.Series:
    """``safe_summary`` of a column."""
    return texts.map(safe_summary)
