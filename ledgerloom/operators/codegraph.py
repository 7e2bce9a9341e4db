"""Queries over symbols and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import language, local_import_path, normal_path

MAX_INDEX_BYTES = 200 << 20


def symbols_of_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("file_path") == path).orderBy("line_start", "name")


def folded(name) -> F.Column:
    """A name with its ASCII letters in lower case."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def find_symbol(symbols: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """Symbols whose name starts with a text, ASCII letters in either case; shortest first. An empty text meets all. A table
    sorted by ``folded`` is read only where the prefix can be."""
    low = prefix.translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})
    name = F.col("folded") if "folded" in symbols.columns else folded("name")
    found = symbols.where(F.startswith(name, F.lit(low))).orderBy(F.length("name"), "file_path", "line_start", "name", "line_end")
    return found if limit is None else found.limit(limit)


def importers(imports: DataFrame, key: str) -> DataFrame:
    return imports.where(F.col("imported_path") == key).select("file_path").orderBy("file_path")


def imports_of_file(imports: DataFrame, path: str) -> DataFrame:
    return imports.where(F.col("file_path") == path).select("imported_path").orderBy("imported_path")


def indexed_files(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    return symbols.select("file_path").union(imports.select("file_path")).distinct()


def hubs(imports: DataFrame, limit: int = 10) -> DataFrame:
    """The most imported keys, by import rows."""
    return imports.groupBy("imported_path").agg(F.count(F.lit(1)).alias("dependents")).orderBy(F.col("dependents").desc(), "imported_path").limit(limit)


def providers(files: DataFrame, module: str | None = None) -> DataFrame:
    """(imported_path, provider): the first file, by path, that a key means."""
    return files.withColumn("imported_path", local_import_path("file_path", module)).where("imported_path is not null").groupBy("imported_path").agg(F.min("file_path").alias("provider"))


def linked_imports(imports: DataFrame, files: DataFrame, module: str | None = None) -> DataFrame:
    """Imports with the file that provides them; null for outside packages and for a file's own key."""
    found = imports.join(providers(files, module), "imported_path", "left")
    return found.withColumn("provider", F.when(F.col("provider") != F.col("file_path"), F.col("provider")))


def dependents(imports: DataFrame, files: DataFrame, module: str | None = None) -> DataFrame:
    """(file_path, importer): who imports a file through its key."""
    keyed = files.select("file_path", local_import_path("file_path", module).alias("imported_path")).where("imported_path is not null")
    return keyed.join(imports.withColumnRenamed("file_path", "importer"), "imported_path").select("file_path", "importer")


def summary(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """One row: files with symbols (exactly), symbols, imports, files per language."""
    files = symbols.select("file_path").distinct()
    langs = files.groupBy(language("file_path").alias("l")).count().where("l is not null").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("l", F.col("count").cast("int"))))).alias("language_counts"))
    return (
        symbols.agg(F.countDistinct("file_path").alias("file_count"), F.count(F.lit(1)).alias("symbol_count"))
        .join(F.broadcast(imports.agg(F.count(F.lit(1)).alias("import_count"))))  # one row
        .join(F.broadcast(langs))  # one row
    )


def drift(indexed: DataFrame, on_disk: DataFrame, notes: DataFrame, max_size: int = 1 << 20) -> DataFrame:
    """(kind, file_path, reason): notes of files that aren't indexed (stale), indexed files that are gone (ghost), files
    that could be indexed and aren't (uncovered). on_disk: file_path, length, ignored."""
    stale = notes.join(indexed, "file_path", "left_anti").select(F.lit("stale").alias("kind"), "file_path", F.lit("").alias("reason"))
    ghost = indexed.join(on_disk, "file_path", "left_anti").select(F.lit("ghost").alias("kind"), "file_path", F.lit("").alias("reason"))
    why = F.when(F.col("ignored"), "gitignored").when(F.col("length") > max_size, "too large").otherwise("")
    uncovered = on_disk.where(language("file_path").isNotNull()).join(indexed, "file_path", "left_anti").select(F.lit("uncovered").alias("kind"), "file_path", why.alias("reason"))
    return stale.union(ghost).union(uncovered)


def estimated_bytes(symbols: DataFrame, imports: DataFrame) -> int:
    """What an index of these rows takes, about: the bytes of its texts and a share per row."""
    texts = sum((F.octet_length(c) for c in ("name", "kind", "file_path", "signature")), F.lit(64))
    a = symbols.agg(F.sum(texts)).first()[0] or 0
    b = imports.agg(F.sum(F.octet_length("file_path") + F.octet_length("imported_path") + 32)).first()[0] or 0
    return int(a + b)


class IndexRefused(ValueError):
    """A new index would be too large, or smaller than the one it replaces."""


def guard(symbols: DataFrame, imports: DataFrame, previous_symbols: int, existing_bytes: int = 0, max_bytes: int = MAX_INDEX_BYTES, force: bool = False) -> None:
    if force:
        return
    if (now := symbols.count()) < previous_symbols:
        raise IndexRefused(f"{now} symbols would replace {previous_symbols}")
    if (size := existing_bytes + estimated_bytes(symbols, imports)) > max_bytes:
        raise IndexRefused(f"an index of {size} bytes is over the limit of {max_bytes}")


def current_rows(rows: DataFrame, scans: DataFrame) -> DataFrame:
    """Of rows with scan_id those of each file's latest scan; scans: (file_path, scan_id, deleted), one per file and scan.
    This is how an index on immutable files is updated and deleted from."""
    latest = scans.groupBy("file_path").agg(F.max_by(F.struct("scan_id", "deleted"), "scan_id").alias("s")).where(~F.col("s")["deleted"]).select("file_path", F.col("s")["scan_id"].alias("scan_id"))
    return rows.join(latest, ["file_path", "scan_id"], "left_semi")


def resolve_aliases(specs: DataFrame, aliases: DataFrame, column: str = "specifier", project: str = "project") -> DataFrame:
    """Specifiers with ``resolved`` by their project's path aliases (project, pattern, target), any number of them: an exact
    pattern first, else the wildcard with the longest prefix, then the smallest pattern; its target is cleaned as a path. Null without one.

    A pattern is met by an equi-join on the part before its star: each different specifier gives its beginnings of the
    lengths that patterns have. The lengths are the only thing that comes to the driver, no more than the longest pattern has characters."""
    named = [F.coalesce(project, F.lit("")).alias("_p"), F.col("pattern").alias("_pattern"), F.col("target").alias("_target")]
    star, end = F.instr("pattern", "*"), F.length("pattern")
    wild = aliases.where(star > 0).select(*named, F.substring("pattern", F.lit(1), star - 1).alias("_head"), F.substring("pattern", star + 1, end).alias("_tail"), F.lit(False).alias("_exact"))
    table = aliases.select(*named, F.col("pattern").alias("_head"), F.lit("").alias("_tail"), F.lit(True).alias("_exact")).union(wild).distinct()
    lengths = sorted(r[0] for r in table.select(F.length("_head")).distinct().collect())
    each = specs.select(F.coalesce(project, F.lit("")).alias("_p"), F.col(column).alias("_s")).where("_s is not null").distinct()
    size = F.length("_s")
    heads = each.withColumn("_n", F.explode(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= size))).withColumn("_head", F.substring("_s", F.lit(1), F.col("_n")))
    fits = F.when(F.col("_exact"), F.col("_s") == F.col("_pattern")).otherwise((size >= F.length("_head") + F.length("_tail")) & F.endswith("_s", F.col("_tail")))
    best = F.min_by(F.struct("_exact", "_target", "_head", "_tail"), F.struct((~F.col("_exact")).alias("e"), (-F.length("_head")).alias("n"), "_pattern")).alias("_b")
    found = heads.join(table, ["_p", "_head"]).where(fits).groupBy("_p", "_s").agg(best).select("_p", "_s", "_b.*")
    middle = F.substring("_s", F.length("_head") + 1, F.length("_s") - F.length("_head") - F.length("_tail"))
    at = F.instr("_target", "*")
    filled = F.when(at == 0, F.col("_target")).otherwise(F.concat(F.substring("_target", F.lit(1), at - 1), middle, F.substring("_target", at + 1, F.length("_target"))))
    found = found.select("_p", "_s", F.when(F.col("_exact"), F.col("_target")).otherwise(normal_path(filled)).alias("resolved"))
    own = specs.drop("resolved")
    return own.join(found, (F.coalesce(own[project], F.lit("")) == found["_p"]) & (own[column] == found["_s"]), "left").select(*own.columns, "resolved")


def resolve_specifiers(specs: DataFrame, aliases: dict[str, str], column: str = "specifier") -> DataFrame:
    """``resolve_aliases`` for the aliases of one project."""
    table = specs.sparkSession.createDataFrame([("", p, t) for p, t in aliases.items()], "project string, pattern string, target string")
    return resolve_aliases(specs.withColumn("_project", F.lit("")), table.withColumnRenamed("project", "_project"), column, "_project").drop("_project")
