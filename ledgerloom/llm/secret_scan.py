"""Secret scans: three base patterns, and sliding-window Shannon entropy over candidate strings. DataFrame functions only.

Base kinds are leftmost non-overlapping matches per kind, of which too short ones are dropped. Where matches lie is
found without row-at-a-time code: ``split`` gives the gaps between matches, ``regexp_extract_all`` the matches, and a
prefix sum over their lengths (in blocks, so it stays linear) the positions, in code points.

The method adds spans. A candidate is a run of 20 or more characters of the base64 alphabets; its class is hex, alnum
or base64. An ordered fold slides a window of 20 characters over it. Its state holds the window's count of each
character, five bits each in six longs, and the sum of c*log2(c) over them: the leaving and the entering character
change one count and one term each, nothing is counted again. Terms are whole micro-bits, so any engine gets the same
sums. Windows whose entropy reaches their threshold make a span from the first such window's start to the last one's
end.

The allow list acts on windows, not on candidates: UUIDs and the placeholders of documentation are blanked out before
windows are judged, so what stands beside them still counts; a window without letters (dates, numbers) never counts; one
without digits and plus signs (words, paths, names) has to reach the threshold ``WORDLIKE``, which random letters of both
cases do and words don't.

Defined cases: a null or empty text has no spans; a text of any length is scanned whole; repeated rows keep a row each;
an empty table gives an empty table; other columns, whatever their names, are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: The base patterns. Letters are spelt in both cases, as engines differ in what case folding means.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # of AKIA[A-Z0-9]+ those of 18 or more: a run ends where it ends, so none of the rest can match later
HEX = r"[0-9a-f]{16,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Least entropy of a window in bits, per class, and for windows without digits and plus signs.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.75}
WORDLIKE = 4.0
#: What is blanked out before windows are judged, and by what: UUIDs, documentation placeholders.
ALLOWED = (
    ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "-" * 36),
    ("EXAMPLE|example", "-" * 7),
    ("XXXXX|xxxxx", "-" * 5),
)
MASK = "[SECRET]"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
UNIT = 1_000_000
BLOCK = 256
PIECE = 1024
BITS, PER_LONG = 5, 12  # of a count, and counts in a long
SPAN = "struct<start:int,ord:int,end:int>"


def terms(window: int = WINDOW) -> list[int]:
    """c*log2(c) in micro-bits for each count c that a window can hold."""
    return [0] + [round(UNIT * c * math.log2(c)) for c in range(1, window + 1)]


def limits(thresholds: dict[str, float] = THRESHOLDS, window: int = WINDOW) -> dict[str, int]:
    """The largest sum of terms at which a window reaches its class's threshold."""
    return {k: math.floor(UNIT * window * (math.log2(window) - t)) for k, t in {**thresholds, "wordlike": WORDLIKE}.items()}


def _before(xs: Column, op) -> Column:
    """For each element what ``op`` makes of those before it, from 0 on; blocks of 256 keep the array appends from being quadratic."""

    def fold(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(xs, start, lambda a, x: F.struct(op(a["all"], x).alias("all"), F.concat(a["before"], F.array(a["all"])).alias("before")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))))
    joined = F.transform(F.array(F.struct(blocks.alias("b"))), lambda s: F.struct(s["b"].alias("b"), fold(F.transform(s["b"], lambda x: x["all"]))["before"].alias("base")))
    return F.flatten(F.flatten(F.transform(joined, lambda s: F.transform(s["b"], lambda x, i: F.transform(x["before"], lambda v: op(F.element_at(s["base"], i + 1), v))))))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _blocks(text: Column, size: int) -> Column:
    """The text in pieces of so many characters; a character of a long string is reached only by walking, one of a piece at once."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, hit>> of the leftmost non-overlapping matches; an empty array without any."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    shape = F.struct(hits.alias("hits"), F.transform(gaps, F.length).alias("gaps"))
    parts = F.transform(F.array(shape), lambda s: F.struct(s["hits"].alias("hits"), s["gaps"].alias("gaps"), F.zip_with(s["hits"], F.slice(s["gaps"], F.lit(1), F.size(s["hits"])), lambda h, g: g + F.length(h)).alias("steps")))
    placed = F.transform(parts, lambda s: F.zip_with(_before(s["steps"], _sum), F.zip_with(s["hits"], F.slice(s["gaps"], F.lit(1), F.size(s["hits"])), lambda h, g: F.struct(h.alias("hit"), g.alias("gap"))), lambda b, x: F.struct((b + x["gap"]).alias("start"), x["hit"].alias("hit"))))
    return F.when(text.rlike(pattern), F.flatten(placed)).otherwise(F.array().cast("array<struct<start:int,hit:string>>"))


def _base(text: Column) -> Column:
    def spans(pattern: str, order: int, keep=None) -> Column:
        found = _found(text, pattern)
        if keep is not None:
            found = F.filter(found, keep)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), (m["start"] + F.length(m["hit"])).alias("end")))

    return F.concat(
        spans(ASSIGN, 0, lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= ASSIGN_LEAST),
        spans(ACCESS, 1),
        spans(HEX, 2),
    )


def _blanked(hit: Column) -> Column:
    for pattern, blank in ALLOWED:
        hit = F.regexp_replace(hit, pattern, blank)
    return hit


def _windows(hit: Column, limit: Column, wordlike: int, window: int) -> Column:
    """struct<first, last>: from the first window that reaches its threshold to the end of the last; first is -1 without one."""
    term = F.array(*map(F.lit, terms(window)))
    at = lambda c: F.element_at(term, c + 1)
    one = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), place % PER_LONG * BITS)
    counted = lambda counts, place: F.call_function("shiftright", F.element_at(counts, F.floor(place / PER_LONG).cast("int") + 1), place % PER_LONG * BITS).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")
    more = lambda counts, place, sign: F.transform(counts, lambda x, i: F.when(i == F.floor(place / PER_LONG), x + sign * one(place)).otherwise(x))
    places = F.transform(F.split(hit, ""), lambda c: (F.position(c, F.lit(ALPHABET)) - 1).cast("int"))
    is_letter, is_mark = lambda k: (k < 52).cast("int"), lambda k: ((k >= 52) & (k <= 62)).cast("int")  # noqa: E731  digits and plus
    longs = -(-len(ALPHABET) // PER_LONG)
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), *(F.lit(0).alias(n) for n in ("s", "letters", "marks")), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )

    def moved(a: Column, place: Column, sign: int) -> Column:
        """The state with one character more or less; first and last stay."""
        c = counted(a["counts"], place)
        return F.struct(
            more(a["counts"], place, sign).alias("counts"), (a["s"] + at(c + sign) - at(c)).cast("int").alias("s"),
            (a["letters"] + sign * is_letter(place)).alias("letters"), (a["marks"] + sign * is_mark(place)).alias("marks"), a["first"].alias("first"), a["last"].alias("last"),
        )

    def judged(a: Column, i: Column) -> Column:
        high = (i >= window) & (a["letters"] > 0) & (a["s"] <= F.when(a["marks"] > 0, limit).otherwise(F.lit(wordlike)))
        first = F.when(high & (a["first"] < 0), i - window).otherwise(a["first"])
        return F.struct(*(a[n].alias(n) for n in ("counts", "s", "letters", "marks")), first.cast("int").alias("first"), F.when(high, i).otherwise(a["last"]).cast("int").alias("last"))

    # one-element transforms name a value, so it's computed once a step
    name = lambda value, fn: F.element_at(F.transform(F.array(value), fn), 1)

    def fold(at: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            gone = F.when(i > window, name(F.element_at(at, i - window), lambda k: moved(a, k, -1))).otherwise(a)
            return name(name(gone, lambda left: name(F.element_at(at, i), lambda k: moved(left, k, 1))), lambda now: judged(now, i))

        return F.aggregate(F.sequence(F.lit(1), F.size(at)), start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return name(places, fold)


def _swept(hit: Column, limit: Column, wordlike: int, window: int) -> Column:
    """``_windows`` of a string of any length: blocks that overlap by a window less one character, each swept by itself."""
    seen = F.transform(
        F.array(_blocks(hit, BLOCK)),
        lambda b: F.filter(
            F.transform(b, lambda x, i: _moved(_windows(F.when(i > 0, F.concat(F.right(F.element_at(b, F.greatest(i, F.lit(1))), F.lit(window - 1)), x)).otherwise(x), limit, wordlike, window), F.when(i > 0, i * BLOCK - (window - 1)).otherwise(F.lit(0)))),
            lambda w: w["first"] >= 0,
        ),
    )
    ends = lambda w: F.struct(F.element_at(w, 1)["first"].alias("first"), F.element_at(w, -1)["last"].alias("last"))
    none = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.element_at(F.transform(seen, lambda w: F.when(F.size(w) > 0, ends(w)).otherwise(none)), 1)


def _moved(w: Column, by: Column) -> Column:
    """A pair of ends, moved along unless there is none."""
    return F.element_at(F.transform(F.array(w), lambda v: F.struct(*(F.when(v[n] >= 0, v[n] + by).otherwise(v[n]).alias(n) for n in ("first", "last")))), 1)


def _entropy(text: Column, thresholds: dict[str, float], window: int) -> Column:
    limit = limits(thresholds, window)
    order = lambda h: F.when(h.rlike("^[0-9A-Fa-f]+$"), 3).when(h.rlike("^[A-Za-z0-9]+$"), 4).otherwise(5)
    most = lambda o: F.when(o == 3, limit["hex"]).when(o == 4, limit["alnum"]).otherwise(limit["base64"])
    classed = F.transform(_found(text, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), _blanked(m["hit"]).alias("hit"), order(m["hit"]).alias("ord")))
    swept = F.transform(classed, lambda m: F.struct(m["start"].alias("start"), m["ord"].alias("ord"), _swept(m["hit"], most(m["ord"]), limit["wordlike"], window).alias("w")))
    return F.transform(F.filter(swept, lambda m: m["w"]["first"] >= 0), lambda m: F.struct((m["start"] + m["w"]["first"]).alias("start"), m["ord"].alias("ord"), (m["start"] + m["w"]["last"]).alias("end")))


def _spans(text: Column, thresholds: dict[str, float] = THRESHOLDS, window: int = WINDOW) -> tuple[Column, Column]:
    """Sorted base spans and all further spans: array<struct<start, ord, end>>, ord being the place in ``KINDS``."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(_base(text).cast(f"array<{SPAN}>")), _entropy(text, thresholds, window).cast(f"array<{SPAN}>")


def with_spans(df: DataFrame, text_col: str = "text", thresholds: dict[str, float] = THRESHOLDS, window: int = WINDOW) -> DataFrame:
    """The input with ``base_spans`` and ``spans``; columns of these names, in whatever case, are replaced."""
    base, more = _spans(F.col(text_col), thresholds, window)
    if text_col.lower() in ("base_spans", "spans"):
        raise ValueError(f"the text column can't be {text_col}")
    out = df.drop("base_spans", "spans").withColumn("base_spans", base).withColumn("spans", more)
    return out.withColumn("spans", F.array_sort(F.concat("base_spans", "spans")))


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of spans of each base kind, the base spans' digest and all spans as a string."""
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["ord"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written("base_spans").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """The input with each span of its text replaced by ``mask`` (overlapping spans by one); other columns stay."""
    base, more = _spans(F.col(text_col))
    own, out = free_name(df.columns, "spans"), free_name(df.columns, "clean")
    found = df.withColumn(own, F.array_sort(F.concat(base, more)))
    text = F.col(text_col)
    most = lambda a, b: F.greatest(a, b)
    # a span that starts before an earlier one's end makes that one longer; the others come after a piece that stays
    shape = F.struct(_blocks(text, PIECE).alias("b"), F.zip_with(own, _before(F.transform(own, lambda x: x["end"]), most), lambda x, at: F.struct(at.alias("low"), x["start"].alias("high"))).alias("gaps"))

    def piece(b: Column, low: Column, high: Column) -> Column:
        """Characters [low, high)."""
        i, j = F.floor(low / PIECE).cast("int") + 1, F.floor((high - 1) / PIECE).cast("int") + 1
        inside = F.substring(F.element_at(b, i), low % PIECE + 1, high - low)
        across = F.concat(F.substring(F.element_at(b, i), low % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(b, i + 1, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.element_at(b, j), F.lit(1), (high - 1) % PIECE + 1))
        return F.when(low >= high, F.lit("")).when(i == j, inside).otherwise(across)

    end, length = F.array_max(F.transform(own, lambda x: x["end"])), F.length(text)
    kept = F.transform(F.array(shape), lambda s: F.concat(F.transform(F.filter(s["gaps"], lambda g: g["high"] >= g["low"]), lambda g: piece(s["b"], g["low"], g["high"])), F.array(piece(s["b"], end, length))))
    folded = F.array_join(F.element_at(kept, 1), mask)
    clean = F.when(F.size(own) > 0, folded).otherwise(text)
    return found.withColumn(out, clean).select(*(F.col(out).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns))


def _sql_spans(text: str, pattern: str, order: str, keep: str = "true", low: str = "s", high: str = "s + length(h)") -> str:
    """Spans of one pattern in DuckDB: gaps and matches, then sums over what lies before."""
    q = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, {low} AS start, {order} AS ord, {high} AS "end" FROM (
        SELECT doc_id, h, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::INT + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)::INT AS s
        FROM (SELECT doc_id, hits, gaps, unnest(hits) AS h, unnest(range(1, len(hits) + 1)) AS i
              FROM (SELECT doc_id, regexp_extract_all({text}, '{q}') AS hits, regexp_split_to_array({text}, '{q}') AS gaps FROM @docs WHERE regexp_matches({text}, '{q}')))
      ) WHERE {keep}"""


def oracle_sql(docs: str = "documents") -> str:
    """DuckDB SQL for the rows of ``scan``; doc_id has to be unique."""
    limit = limits()
    assign = ASSIGN.replace("'", "''")
    term = "[" + ", ".join(map(str, terms())) + "]"
    base = " UNION ALL ".join(
        _sql_spans("text", p, o, k)
        for p, o, k in ((ASSIGN, "0", f"length(regexp_extract(h, '{assign}', 2)) >= {ASSIGN_LEAST}"), (ACCESS, "1", "true"), (HEX, "2", "true"))
    ).replace("@docs", docs)
    cut = f"substr(h, k::INT + 1, {WINDOW})"
    sweep = f"""list_filter(range(0, length(h) - {WINDOW} + 1), lambda k: regexp_matches({cut}, '[A-Za-z]') AND
        list_sum(list_transform(list_distinct(regexp_extract_all({cut}, '.')), lambda c: {term}[length({cut}) - length(replace({cut}, c, '')) + 1]))
          <= CASE WHEN NOT regexp_matches({cut}, '[0-9+]') THEN {limit["wordlike"]} WHEN o = 3 THEN {limit["hex"]} WHEN o = 4 THEN {limit["alnum"]} ELSE {limit["base64"]} END)"""
    blanked = "ord"
    for pattern, blank in ALLOWED:
        blanked = f"regexp_replace({blanked}, '{pattern}', '{blank}', 'g')"
    candidates = _sql_spans("text", CANDIDATE, "h").replace("@docs", docs)
    return f"""
    WITH base AS ({base}),
    cand AS (SELECT doc_id, start, {blanked} AS h, CASE WHEN regexp_matches(ord, '^[0-9A-Fa-f]+$') THEN 3 WHEN regexp_matches(ord, '^[A-Za-z0-9]+$') THEN 4 ELSE 5 END AS o FROM ({candidates})),
    swept AS (SELECT doc_id, start, o, {sweep} AS w FROM cand),
    more AS (SELECT doc_id, (start + w[1])::INT AS start, o AS ord, (start + w[-1] + {WINDOW})::INT AS "end" FROM swept WHERE len(w) > 0),
    named AS (SELECT doc_id, start, ord, {list(KINDS)}[ord + 1] || ':' || start || ':' || "end" AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM more)),
    summed AS (
      SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS a, count(*) FILTER (WHERE ord = 1) AS k, count(*) FILTER (WHERE ord = 2) AS x,
        string_agg(s, ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS b, string_agg(s, ',' ORDER BY start, ord) AS t
      FROM named GROUP BY doc_id)
    SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(x, 0)::BIGINT AS n_hex,
      sha256(coalesce(b, '')) AS base_sha256, coalesce(t, '') AS spans
    FROM {docs} d LEFT JOIN summed USING (doc_id)"""
