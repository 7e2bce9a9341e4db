"""Scalar functions over columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE_DIR = ".ledgerloom"
#: What markdown and HTML give a meaning to, and its harmless spelling. The ampersand comes first and the
#: backslash before those that add one, so that one replacement after the other equals a single pass.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\\", "\\\\"), ("`", "\\`"), ("*", "\\*"), ("_", "\\_"), ("[", "\\["), ("]", "\\]"), ("(", "\\("), (")", "\\)"))
#: Extensions of the TypeScript family.
CODE_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "svelte", "astro")
LANGUAGES = {"go": "go", "svelte": "svelte", "astro": "astro"} | {e: "typescript" for e in CODE_EXTENSIONS[:8]}
TIME_SHAPES = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def md_escape(c: Column | str) -> Column:
    out = _col(c)
    for raw, safe in ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def like_escape(c: Column | str) -> Column:
    r"""Backslash, % and _ lose their meaning in LIKE."""
    return F.regexp_replace(_col(c), r"([\\%_])", r"\\$1")


def short_hash(c: Column | str, pending: str = "uncommitted") -> Column:
    return F.when(blank(c) == "", pending).otherwise(F.substring(_col(c), 1, 8))


def parse_timestamp(c: Column | str) -> Column:
    """Unix seconds from seconds, RFC 3339, a date, or a date and time without zone (UTC, whatever the session's zone);
    null for anything else."""
    c = _col(c)
    zoned = F.when(~c.contains("T"), F.concat(c, F.lit("T00:00:00Z"))).when(c.rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint")).when(c.rlike(TIME_SHAPES), F.unix_seconds(F.try_to_timestamp(zoned)))


def format_time(c: Column | str, zero: str = "unknown") -> Column:
    """RFC 3339 in UTC, whatever the session's zone; 0 has no time."""
    day, rest = F.floor(_col(c) / 86400).cast("int"), F.pmod(_col(c), F.lit(86400))
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(day, F.lit(0), F.lit(0), rest.cast("decimal(18,6)"))
    return F.when(_col(c) == 0, zero).otherwise(F.concat(F.replace(at.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z")))


def shown_time(recorded_at: Column | str, created_at: Column | str) -> Column:
    """The recorded time, or the display text of rows from before it was kept."""
    return F.when(_col(recorded_at) == 0, blank(created_at)).otherwise(format_time(recorded_at))


def diff_stat(c: Column | str) -> Column:
    """struct<add, del> of '+N -M' (signs may be missing); null for anything else."""
    fields = F.split(F.trim(F.regexp_replace(blank(c), r"\s+", " ")), " ")
    number = lambda i, sign: F.regexp_replace(F.get(fields, F.lit(i - 1)), sign, "").try_cast("int")
    both = F.struct(number(1, r"^\+").alias("add"), number(2, "^-").alias("del"))
    return F.when(F.size(fields) == 2, F.when(both["add"].isNotNull() & both["del"].isNotNull(), both))


def extension(c: Column | str) -> Column:
    """Lower-case extension without its dot; '' without one."""
    return F.lower(F.regexp_extract(_col(c), r"\.([^./]*)$", 1))


def language(path: Column | str) -> Column:
    """Name of the parser that a path goes to; null for none."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(names, extension(path))


def file_key(path: Column | str) -> Column:
    """The import key of a file of the TypeScript family: no code extension, no trailing /index."""
    return F.regexp_replace(F.regexp_replace(_col(path), r"(?i)\.(?:" + "|".join(CODE_EXTENSIONS) + ")$", ""), "/index$", "")


def directory(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(path), r"[^/]*$", ""), "/$", "")


def local_import_path(path: Column | str, module: str | None = None) -> Column:
    """The key that importers of a file use: its package's path for Go, its file key for the TypeScript family; else null."""
    ext = extension(path)
    go = F.when(directory(path) == "", F.lit(module)).otherwise(F.concat(F.lit(module), F.lit("/"), directory(path))) if module else F.lit(None).cast("string")
    return F.when(ext == "go", go).when(ext.isin(*CODE_EXTENSIONS), file_key(path))


def valid_path(path: Column | str) -> Column:
    """Not empty, not absolute, and never above its root on the way."""
    parts = F.filter(F.split(_col(path), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    step = lambda a, p: F.struct((a["depth"] + F.when(p == "..", -1).otherwise(1)).alias("depth"), F.least(a["least"], a["depth"] + F.when(p == "..", -1).otherwise(1)).alias("least"))
    return (blank(path) != "") & ~F.startswith(blank(path), F.lit("/")) & (F.aggregate(parts, start, step, lambda a: a["least"]) >= 0)


def normal_path(path: Column | str) -> Column:
    """A path without empty and "." parts, and with each ".." taken back by the part before it; "." for nothing."""
    path = _col(path)
    lead = F.when(path.rlike("^//([^/]|$)"), "//").when(F.startswith(path, F.lit("/")), "/").otherwise("")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))

    def step(done: Column, p: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(".."))
        back = F.when(last != "..", F.slice(done, F.lit(1), F.size(done) - 1)).when(lead == "", F.concat(done, F.array(p))).otherwise(done)
        return F.when(p == "..", back).otherwise(F.concat(done, F.array(p)))

    out = F.concat(lead, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(out == "", ".").otherwise(out)


def in_state_dir(path: Column | str) -> Column:
    return (blank(path) == "") | F.startswith(blank(path), F.lit(STATE_DIR + "/"))


def commitish(c: Column | str) -> Column:
    return blank(c).rlike(r"^(?:[0-9a-fA-F]{4,64})?$")


def note_path(path: Column | str) -> Column:
    """Where a file's index note lives; null where it would collide with the index itself."""
    p = _col(path)
    clash = (p == "index") | F.startswith(p, F.lit("index/"))
    return F.when(valid_path(p) & ~clash, F.concat(F.lit(STATE_DIR + "/index/"), p, F.lit(".md")))


def hint_path(path: Column | str) -> Column:
    return F.concat(F.lit(STATE_DIR + "/"), _col(path), F.lit(".md"))


def note_link(from_dir: Column, label: Column, target: Column, wiki: bool = False) -> Column:
    """A link from a note's folder to a file's note, relative in markdown or absolute in wiki style."""
    def encoded(c: Column, signs: str) -> Column:
        for ch in signs:
            c = F.replace(c, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
        return c

    if wiki:
        return F.concat(F.lit("[["), encoded(target, "[]|"), F.lit(".md|"), label, F.lit("]]"))
    here, there = F.filter(F.split(from_dir, "/"), lambda x: ~x.isin("", ".")), F.split(F.concat(F.lit("index/"), target), "/")
    # folders that both share from the root on
    same = F.aggregate(
        F.zip_with(here, F.slice(there, F.lit(1), F.greatest(F.size(there) - 1, F.lit(0))), lambda a, b: F.coalesce(a == b, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, e: F.struct((a["n"] + (a["on"] & e).cast("int")).alias("n"), (a["on"] & e).alias("on")),
        lambda a: a["n"],
    )
    up = F.array_repeat(F.lit(".."), F.size(here) - same)
    path = F.array_join(F.concat(up, F.slice(there, same + 1, F.size(there))), "/")
    return F.concat(F.lit("["), label, F.lit("]("), encoded(path, " []()"), F.lit(".md)"))


def encode_counts(c: Column | str) -> Column:
    """'go:5,typescript:2' from a map, keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(_col(c))), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")


def decode_counts(c: Column | str) -> Column:
    return F.when(blank(c) == "", F.create_map().cast("map<string,int>")).otherwise(F.transform_values(F.str_to_map(_col(c), F.lit(","), F.lit(":")), lambda k, v: v.cast("int")))


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression; a star doesn't cross a slash."""
    special = {"*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(special.get(ch, "\\" + ch if not ch.isalnum() else ch) for ch in glob) + "$"


def truncate_bytes(c: Column | str, most: int) -> Column:
    """The longest prefix of whole characters within so many bytes."""
    # no more characters than bytes
    chars = F.regexp_extract_all(F.substring(_col(c), 1, max(1, most)), F.lit("(?s)."), F.lit(0))
    kept = F.aggregate(
        chars, F.struct(F.lit("").alias("out"), F.lit(True).alias("on")),
        lambda a, x: F.struct(F.when(a["on"] & (F.octet_length(a["out"]) + F.octet_length(x) <= most), F.concat(a["out"], x)).otherwise(a["out"]).alias("out"), (a["on"] & (F.octet_length(a["out"]) + F.octet_length(x) <= most)).alias("on")),
        lambda a: a["out"],
    )
    return F.when((F.lit(most) <= 0) | (F.octet_length(_col(c)) <= most), _col(c)).otherwise(kept)
