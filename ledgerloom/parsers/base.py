"""Parser registry, and how parsers run on executors."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable
from dataclasses import astuple, dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..schemas import struct

PARSE_SECONDS = 5.0
MAX_FILE_BYTES = 1 << 20


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str  # func, method, type, const or var
    line_start: int
    line_end: int
    signature: str


#: What a parser is: (path, text, aliases) -> symbols and import keys, in order of appearance.
Parser = Callable[[str, str, dict], tuple[list[Symbol], list[str]]]
_REGISTRY: dict[str, tuple[str, Parser]] = {}
_NAMES: set[str] = set()


def register(name: str, extensions: tuple[str, ...], parser: Parser) -> None:
    """Make a parser known; a name or an extension can be taken once."""
    if name in _NAMES or any(e in _REGISTRY for e in extensions):
        raise ValueError(f"parser {name} or one of {extensions} is registered already")
    _NAMES.add(name)
    _REGISTRY.update({e: (name, parser) for e in extensions})


def parser_for(path: str) -> tuple[str, Parser] | None:
    base = (path or "").rpartition("/")[2]
    return _REGISTRY.get(base.rpartition(".")[2].lower()) if "." in base else None


class _TooSlow(Exception):
    pass


def parse_guarded(path: str, text: str, aliases: dict, seconds: float = PARSE_SECONDS):
    """(status, symbols, imports); a parser that fails or takes too long yields nothing but its status."""
    found = parser_for(path)
    if found is None:
        return "unsupported", [], []
    timed = threading.current_thread() is threading.main_thread()

    def stop(*_):
        raise _TooSlow

    if timed:
        before = signal.signal(signal.SIGALRM, stop)
        signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        symbols, imports = found[1](path, text, aliases)
        return "ok", symbols, imports
    except _TooSlow:
        return "timeout", [], []
    except Exception as e:  # a bad file must not end the job
        return f"error: {type(e).__name__}", [], []
    finally:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)


SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("signature", pa.string())])
PARSED = (
    "file_path string, status string, language string, symbols array<struct<name:string,kind:string,line_start:int,line_end:int,signature:string>>, imports array<string>"
)


def parse_files(files: DataFrame, aliases: dict | None = None, seconds: float = PARSE_SECONDS) -> DataFrame:
    """A row per file of (file_path, content): status, language, symbols, imports. Aliases: see ``sources.aliases``.

    Parsing costs far more than reading, and a small table is one task however many sources it stands for: files are dealt evenly,
    to as many tasks as Spark shuffles to."""
    aliases = aliases or {}
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches):
        for batch in batches:
            path, content = (batch.column(c).to_pylist() for c in ("file_path", "content"))
            texts = (c.decode(errors="replace") if isinstance(c, bytes) else c or "" for c in content)
            status, symbols, imports = zip(*(parse_guarded(p, t, aliases, seconds) for p, t in zip(path, texts))) if path else ((), (), ())
            language = [found[0] if (found := parser_for(p)) else None for p in path]
            flat = [x for one in symbols for x in one]
            fields = [pa.array([getattr(x, f.name) for x in flat], f.type) for f in SYMBOL]
            ends = pa.array(list(accumulate(map(len, symbols), initial=0)), pa.int32())
            listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, fields=list(SYMBOL)))
            columns = [batch.column("file_path"), pa.array(status, pa.string()), pa.array(language, pa.string()), listed, pa.array(imports, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["file_path", "status", "language", "symbols", "imports"])

    return files.select("file_path", "content").repartition(tasks).mapInArrow(run, PARSED)


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", F.inline("symbols")).select("name", "kind", "file_path", "line_start", "line_end", "signature")


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", F.explode("imports").alias("imported_path"))


class ParseSymbols:
    """The parsers as a table function over a table of (file_path, content), with or without partitions:
    ``SELECT * FROM parse_symbols(TABLE(files) PARTITION BY file_path)``. A row per symbol; a file without any has one row with its
    status alone."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("parse_symbols takes a table")
        missing = {"file_path", "content"} - {f.name for f in table.dataType.fields}
        if missing:
            raise ValueError(f"parse_symbols needs the columns {sorted(missing)}")
        return AnalyzeResult(struct("file_path string, status string, name string, kind string, line_start int, line_end int, signature string"))

    def eval(self, row: Row):
        content = row["content"]
        text = content.decode(errors="replace") if isinstance(content, (bytes, bytearray)) else content or ""
        status, symbols, _ = parse_guarded(row["file_path"] or "", text, {})
        for s in symbols:
            yield (row["file_path"], status, *astuple(s))
        if not symbols:
            yield (row["file_path"], status, None, None, None, None, None)


class ParseText:
    """The same for one file, as a lateral function: ``FROM files f, LATERAL parse_text(f.file_path, f.content)``. A row per symbol."""

    def eval(self, file_path: str, content: str):
        for s in parse_guarded(file_path or "", content or "", {})[1]:
            yield astuple(s)


def register_functions(spark: SparkSession) -> None:
    """Make ``parse_symbols`` and ``parse_text`` known to the session's SQL."""
    spark.udtf.register("parse_symbols", F.udtf(ParseSymbols))
    spark.udtf.register("parse_text", F.udtf(ParseText, returnType="name string, kind string, line_start int, line_end int, signature string"))
