"""The code index on disk: symbols and imports of files, one unit of runs per scan, in numbered versions.

A scan commits its symbols, its imports and which files it saw or found gone, all at once. A file's rows are those of its latest
scan. Units are merged so that two are left: the first, and one of all scans since; where these have grown to a
quarter of the first, in rows or in files, one of all. Merging leaves out what later scans have replaced, and marks of deleted files once
nothing older is left that they hide.

Symbols are stored sorted by their folded names, in small row groups, so a prefix is a range of the table and the statistics of the
files leave out the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import codegraph
from ..schemas import IMPORTS, INDEX_META, SYMBOLS, struct
from .commit_log import CommitLog, Conflict

SCANNED = struct("scan_id long").fields
STORED = {
    "symbols": StructType([*SYMBOLS.fields, *struct("folded string").fields, *SCANNED]),
    "imports": StructType([*IMPORTS.fields, *SCANNED]),
    "scans": struct("file_path string, scan_id long, deleted boolean"),
}
#: Rows of a file of symbols, about; a file is what a prefix can leave out.
FILE_ROWS = 50_000
SHARE = 4


class CodeIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)

    @property
    def known(self) -> bool:
        return bool(self.log.versions())

    def _rows(self, name: str) -> DataFrame:
        return self.log.read(self.log.snapshot().of(name), STORED[name])

    def symbols(self) -> DataFrame:
        """The current symbols, with ``folded`` names."""
        return codegraph.current_rows(self._rows("symbols"), self._rows("scans")).drop("scan_id")

    def imports(self) -> DataFrame:
        return codegraph.current_rows(self._rows("imports"), self._rows("scans")).drop("scan_id")

    def last_scan(self) -> int:
        return self._rows("scans").agg(F.max("scan_id")).first()[0] or 0

    def meta(self) -> dict:
        """What the last full scan said; see ``INDEX_META``."""
        return self.log.snapshot().state.get("meta", {})

    def meta_row(self) -> DataFrame:
        meta = self.meta()
        return self.spark.createDataFrame([tuple(meta[f.name] for f in INDEX_META.fields)] if meta else [], INDEX_META)

    def size(self) -> int:
        """Bytes of the runs of the newest version; -1 if there is none."""
        if not self.known:
            return -1
        return sum(self.log.folder.size(r["path"]) for runs in self.log.snapshot().runs.values() for r in runs)

    def _unit(self, symbols: DataFrame, imports: DataFrame, scans: DataFrame) -> dict[str, list[dict]]:
        n, m, k = symbols.count(), imports.count(), scans.count()
        dealt = symbols.repartitionByRange(max(1, -(-n // FILE_ROWS)), "folded", "file_path").sortWithinPartitions("folded")
        parts = {"symbols": dealt, "imports": imports.coalesce(max(1, -(-m // FILE_ROWS))), "scans": scans.coalesce(1)}
        return {t: [self.log.write(df.select(*STORED[t].names), t, rows=n + m, files=k)] for t, df in parts.items()}

    def add(self, symbols: DataFrame, imports: DataFrame, scans: DataFrame, meta: dict | None = None) -> None:
        """Commit a scan; symbols and imports with their scan_id. Then merge what is due."""
        unit = self._unit(symbols.withColumn("folded", codegraph.folded("name")), imports, scans)
        while True:
            try:
                self.log.commit(self.log.snapshot(), unit, state={"meta": meta} if meta else {})
                break
            except Conflict:
                continue  # scans don't depend on each other
        self.compact()

    def compact(self) -> int:
        """Merge units until two are left at most; how many were merged."""
        base = self.log.snapshot()
        units = list(zip(*(base.of(t) for t in STORED)))
        if len(units) <= 2:
            return 0
        grown = any(SHARE * sum(u[0][what] for u in units[1:]) >= units[0][0][what] for what in ("rows", "files"))
        due = units if grown else units[1:]
        symbols, imports, scans = (self.log.read([u[i] for u in due], STORED[t]) for i, t in enumerate(STORED))
        latest = scans.groupBy("file_path").agg(F.max_by(F.struct("scan_id", "deleted"), "scan_id").alias("s")).select("file_path", "s.*")
        if due is units:
            latest = latest.where(~F.col("deleted"))
        unit = self._unit(codegraph.current_rows(symbols, scans), codegraph.current_rows(imports, scans), latest)
        try:
            self.log.commit(base, unit, {r["path"] for u in due for r in u})
        except Conflict:  # the next scan merges
            self.log.drop([r for rs in unit.values() for r in rs])
            return 0
        self.log.vacuum(keep=2)
        return len(due)
