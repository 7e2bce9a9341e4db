"""Mixing sources to target weights: iterative proportional fitting. DataFrame functions only.

Documents fall into cells (source, language, topic). A cell's tokens are raked to three target marginals in turn; the
factor of a cell then is its raked over its own token weight. Documents are sampled without replacement with probability
proportional to their cell's factor, at most 1, scaled so that ``rate`` of all tokens are expected (cells at 1 pass
their excess on to the others).

Targets are arguments, per marginal: a number tempers the marginal's own shares (each to that power), a dict gives
weights (values without one keep their share). ``ROUNDS`` rounds are made at least, and so many more until every marginal
is within ``TOLERANCE`` of its target; where targets contradict each other (a source that only has one topic, say) the
rounds end once they no longer come nearer, with a warning that says by how much; ``marginals`` says what was reached.

The cells are an aggregate whose size follows the number of sources, languages and topics, not the rows: the window sums
of the fitting run over one partition of cells, without a shuffle between rounds, at about 200 bytes a cell. Sampling
compares a digest of the id with the probability, so a document's fate depends on nothing but its id and its cell.

Defined cases: null source, language or topic is the value 'unknown'; a null text has no tokens; a text of any length is
counted whole; documents without tokens have the probability of their cell; repeated rows share their fate; an empty
table gives an empty table; columns besides those named, whatever their names, are kept by ``sample`` and ignored by
``plan``.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, free_name, materialise

#: Topics by the first rule that a text meets, else ``OTHER_TOPIC``.
TOPICS = (("table", r" \| "), ("licence", "[Ll]icen[cs]e|[Cc]opyright"), ("contact", "@"), ("markup", r"\*\*\*|###|%%%|&&&"), ("capitals", "!!"))
OTHER_TOPIC = "prose"
#: Targets: a source's and a language's share is tempered (its share to this power), topics have fixed weights.
SOURCE_POWER = 0.7
LANG_POWER = 0.7
TOPIC_WEIGHTS = {"prose": 0.9, "table": 0.02, "licence": 0.03, "contact": 0.03, "markup": 0.01, "capitals": 0.01}
TARGETS = {"source": SOURCE_POWER, "lang": LANG_POWER, "topic": TOPIC_WEIGHTS}
ROUNDS = 12
CAP_ROUNDS = 6
#: How far a marginal's share, and the expected share of all tokens, may be off; and rounds that are made at most.
TOLERANCE = 1e-6
MOST_ROUNDS = 1200
RATE = 0.5
SEED = "mix-1"
WORDS = r"[\x20\x09-\x0D]+"
KEYS = ("source", "lang", "topic")
DIGITS = 9


def topic_of(text: Column) -> Column:
    rule = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(TOPICS):
        rule = F.when(text.rlike(pattern), name).otherwise(rule)
    return F.coalesce(rule, F.lit(OTHER_TOPIC))


def tokens_of(text: Column) -> Column:
    """Words between ASCII white space."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), WORDS, " ")
    trimmed = F.trim(joined)
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def described(text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> list[Column]:
    """source, lang, topic and tokens of a row."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return [known(source_col).alias("source"), known(lang_col).alias("lang"), topic_of(F.col(text_col)).alias("topic"), tokens_of(F.col(text_col)).alias("tokens")]


def _targets(c: DataFrame, targets: dict, over) -> DataFrame:
    """Cells with the target share of each of their marginal values; only values that are there count."""
    whole = W.orderBy(*KEYS).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    for k in KEYS:
        goal, own = targets[k], F.sum("share").over(over(k))
        if isinstance(goal, dict):
            target = F.coalesce(*(F.when(F.col(k) == n, float(w)) for n, w in goal.items()), own)
        else:
            target = F.pow(own, F.lit(float(goal)))
        c = c.withColumn(f"t_{k}", target)
    for k in KEYS:
        first = F.row_number().over(W.partitionBy(k).orderBy(*(x for x in KEYS if x != k)))
        c = c.withColumn("_one", F.when(first == 1, F.col(f"t_{k}")).otherwise(0.0))
        c = c.withColumn(f"t_{k}", F.col(f"t_{k}") / F.sum("_one").over(whole))
    return c.drop("_one")


def marginals(found: DataFrame) -> DataFrame:
    """(marginal, value, target, reached) of fitted cells: what each marginal was to have and what it has."""
    parts = [found.groupBy(F.lit(k).alias("marginal"), F.col(k).alias("value")).agg(F.max(f"t_{k}").alias("target"), F.sum("w").alias("reached")) for k in KEYS]
    return parts[0].union(parts[1]).union(parts[2])


def fitted(rows: DataFrame, targets: dict | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Cells of rows (source, lang, topic, tokens) with share, targets t_*, and w, their raked share."""
    targets = TARGETS | (targets or {})
    scratch = Scratch(rows.sparkSession)
    c = rows.groupBy(*KEYS).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
    c = scratch.save(c, "cells").coalesce(1)
    over = lambda k: W.partitionBy(k).orderBy(*(x for x in KEYS if x != k)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole = W.orderBy(*KEYS).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = _targets(c.withColumn("share", F.col("tokens") / F.sum("tokens").over(whole)), targets, over).withColumn("w", F.col("share"))
    made, before = 0, None
    while True:
        for _ in range(rounds):
            for k in KEYS:
                c = c.withColumn("w", F.col("w") * F.col(f"t_{k}") / F.sum("w").over(over(k)))
        c = scratch.save(c, "cells").coalesce(1)
        made += rounds
        off = marginals(c).agg(F.max(F.abs(F.col("target") - F.col("reached")))).first()[0] or 0.0
        if off <= TOLERANCE or made >= MOST_ROUNDS or before is not None and off > 0.999 * before:
            if off > TOLERANCE:
                warnings.warn(f"the targets aren't met: a share is off by {off:.6f} after {made} rounds", stacklevel=2)
            return scratch.finish(c, "cells")
        before = off


def cells(rows: DataFrame, rate: float = RATE, targets: dict | None = None, rounds: int = ROUNDS, cap_rounds: int = CAP_ROUNDS) -> DataFrame:
    """One row per cell: source, lang, topic, its tokens, raked weight and probability. The expected share of all tokens is
    ``rate``, or what there is to give if every cell is at 1."""
    c, scratch = fitted(rows, targets, rounds).coalesce(1), Scratch(rows.sparkSession)
    whole = W.orderBy(*KEYS).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = c.withColumn("factor", F.col("w") / F.col("share")).withColumn("p", F.lit(0.0))
    before = None
    while True:
        for _ in range(cap_rounds):
            full = F.col("p") >= 1.0
            left = F.lit(rate) - F.sum(F.when(full, F.col("share")).otherwise(0.0)).over(whole)
            room = F.sum(F.when(full, 0.0).otherwise(F.col("w"))).over(whole)
            c = c.withColumn("_scale", F.when(room > 0, left / room).otherwise(0.0))
            c = c.withColumn("p", F.when(full, 1.0).otherwise(F.least(F.lit(1.0), F.col("factor") * F.col("_scale"))))
        c = scratch.save(c, "cells").coalesce(1)
        given = c.agg(F.sum(F.col("p") * F.col("share"))).first()[0] or 0.0
        if abs(given - rate) <= TOLERANCE or given == before:  # each round fills a cell more, or none is left
            break
        before = given
    return scratch.finish(c.select(*KEYS, "tokens", F.round("w", DIGITS).alias("weight"), F.round("p", DIGITS).alias("probability")), "cells")


def draw(id_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the digest of an id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def _placed(rows: DataFrame, found: DataFrame, own: str, cell: str) -> DataFrame:
    """Rows whose column ``own`` names a cell, with that cell as the column ``cell``; Spark broadcasts the cells if their size
    allows, else splits hot cells."""
    right = found.select(F.struct(*KEYS, "weight", "probability").alias(cell))
    same = [F.col(own)[k] == F.col(cell)[k] for k in KEYS]
    return rows.join(right, same[0] & same[1] & same[2], "left")


def _chance(cell: str) -> Column:
    return F.coalesce(F.col(cell)["probability"], F.lit(0.0))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", rate: float = RATE, targets: dict | None = None) -> DataFrame:
    """A row per document: cell, tokens, the cell's raked weight, probability, and whether the document is drawn."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.struct(*described(text_col, source_col, lang_col)).alias("own"))
    rows = materialise(rows, "mix-rows")
    out = _placed(rows, cells(rows.select("own.*"), rate, targets), "own", "cell")
    return out.select(
        "doc_id", "own.source", "own.lang", "own.topic", F.col("own.tokens").alias("n_tokens"),
        F.coalesce(F.col("cell.weight"), F.lit(0.0)).alias("cell_weight"), _chance("cell").alias("probability"), (draw("doc_id") < _chance("cell")).alias("sampled"),
    )


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", rate: float = RATE, targets: dict | None = None) -> DataFrame:
    """The documents drawn, columns as they are."""
    own, cell = free_name(docs.columns, "own"), free_name(docs.columns, "cell")
    rows = docs.withColumn(own, F.struct(*described(text_col, source_col, lang_col)))
    out = _placed(rows, cells(docs.select(*described(text_col, source_col, lang_col)), rate, targets), own, cell)
    return out.where(draw(id_col) < _chance(cell)).drop(own, cell)


def oracle_sql(docs: str = "documents", rate: float = RATE) -> str:
    """DuckDB SQL for the rows of ``plan``."""
    rule = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS) + f" ELSE '{OTHER_TOPIC}' END"
    ctes = [
        f"""rows AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, {rule} AS topic,
          len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {docs})""",
        "c0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "c1 AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM c0)",
        f"""s AS (SELECT source, t / sum(t) OVER () AS t_source FROM (SELECT source, pow(sum(share), {SOURCE_POWER}) AS t FROM c1 GROUP BY 1))""",
        f"""l AS (SELECT lang, t / sum(t) OVER () AS t_lang FROM (SELECT lang, pow(sum(share), {LANG_POWER}) AS t FROM c1 GROUP BY 1))""",
        "t AS (SELECT topic, t / sum(t) OVER () AS t_topic FROM (SELECT topic, CASE topic "
        + " ".join(f"WHEN '{n}' THEN {w}::DOUBLE" for n, w in TOPIC_WEIGHTS.items())
        + " ELSE sum(share) END AS t FROM c1 GROUP BY 1))",
        "w0 AS (SELECT *, share AS w FROM c1 JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic))",
    ]
    at = "w0"
    for i in range(ROUNDS * 3):
        k = KEYS[i % 3]
        ctes.append(f"w{i + 1} AS (SELECT * REPLACE (w * t_{k} / sum(w) OVER (PARTITION BY {k}) AS w) FROM {at})")
        at = f"w{i + 1}"
    ctes.append(f"p0 AS (SELECT *, w / share AS factor, 0.0::DOUBLE AS p FROM {at})")
    for i in range(CAP_ROUNDS):
        ctes.append(f"""p{i + 1} AS (SELECT * EXCLUDE (f, room, leftover) REPLACE (CASE WHEN f THEN 1.0 ELSE least(1.0, factor * CASE WHEN room > 0 THEN leftover / room ELSE 0 END) END AS p)
          FROM (SELECT *, p >= 1 AS f, sum(CASE WHEN p >= 1 THEN 0 ELSE w END) OVER () AS room, {rate} - sum(CASE WHEN p >= 1 THEN share ELSE 0 END) OVER () AS leftover FROM p{i}))""")
    return f"""WITH {", ".join(ctes)},
    c AS (SELECT source, lang, topic, round(w, {DIGITS}) AS cell_weight, round(p, {DIGITS}) AS probability FROM p{CAP_ROUNDS})
    SELECT doc_id, source, lang, topic, n_tokens, coalesce(cell_weight, 0) AS cell_weight, coalesce(probability, 0) AS probability,
      (('0x' || substr(md5('{SEED}:' || doc_id), 1, 8))::BIGINT / {float(1 << 32)}) < coalesce(probability, 0) AS sampled
    FROM rows LEFT JOIN c USING (source, lang, topic)"""
