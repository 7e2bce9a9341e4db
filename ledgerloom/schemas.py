"""Table schemas of the engine and the normaliser that older journals go through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "map<string,int>": T.MapType(T.StringType(), T.IntegerType())}


def struct(text: str) -> T.StructType:
    """A schema from 'name type, ...', also where there is no session yet."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(", "))])


CHANGES = struct(
    "id long, file_path string, commit_hash string, branch string, source string, summary string, reason string, diff_stat string, "
    "diff_hash string, agent_id string, recorded_at long, hmac string, prev_hmac string, clock_tamper_warning boolean, created_at string"
)
SYMBOLS = struct("name string, kind string, file_path string, line_start int, line_end int, signature string")
IMPORTS = struct("file_path string, imported_path string")
INDEX_META = struct("last_indexed_at long, file_count int, symbol_count int, language_counts map<string,int>, skipped_count int, unsupported_count int")
CLAIMS = struct("claim_seq long, file_path string, commit_hash string, as_of_id long")
COMMIT_FILES = struct("commit_hash string, file_path string, add int, del int, measurable boolean")

#: Who can have written a row.
SOURCES = ("agent", "llm", "fallback")
OLD_SOURCES = {"hook": "fallback"}


def normalise_changes(df: DataFrame) -> DataFrame:
    """Any journal, old ones too, in the current schema: missing columns get defaults, null texts become empty, retired sources are renamed."""
    out = []
    for f in CHANGES.fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        value = value.cast(f.dataType)
        if isinstance(f.dataType, T.StringType) and f.name != "created_at":
            value = F.coalesce(value, F.lit(""))
        elif f.name == "recorded_at":
            value = F.coalesce(value, F.lit(0).cast("long"))
        elif f.name == "clock_tamper_warning":
            value = F.coalesce(value, F.lit(False))
        if f.name == "source":
            for old, new in OLD_SOURCES.items():
                value = F.when(value == old, new).otherwise(value)
        out.append(value.alias(f.name))
    return df.select(*out)


def is_pending(commit="commit_hash"):
    """A row that no commit has taken up: no hash, or an empty one."""
    return F.coalesce(F.col(commit), F.lit("")) == ""
