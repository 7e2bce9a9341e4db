"""Journal rows and commits: claims, coverage, gate, fallback rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.secrets import first_secret
from ..functions.text import diff_stat, in_state_dir
from ..schemas import is_pending

SUMMARIES = {"uncovered": "Changed by a commit; nobody recorded why.", "unverifiable": "Changed by a commit; whether the recorded rows explain all of it can't be told."}


def effective_commits(changes: DataFrame, claims: DataFrame, hot_share: float = 1 / 256, ranges: int = 64) -> DataFrame:
    """The journal with the commits that claims gave to pending agent rows.

    The journal stays append-only; a claim (claim_seq, file_path, commit_hash, as_of_id) takes all rows of a file up to
    an id. A row belongs to its first claim: an as-of join. Claims and rows of a file are merged into one sequence by id
    and the next claim is carried back, so the cost is one sort, not a product. A file that may hold more than
    ``hot_share`` of all rows (there are at most 1 / hot_share of them) is dealt over ``ranges`` ranges of ids; into each
    go, ahead of its rows, the least of the claims in the ranges above it. Claims without an id take rows without one."""
    kinds = {f.name: f.dataType for f in changes.schema.fields}
    # a bounded sketch that misses no frequent file
    hot = [f for f in changes.stat.freqItems(["file_path"], hot_share).first()[0] or [] if f is not None]
    shares = [i / ranges for i in range(1, ranges)]
    of_hot = changes.where(F.col("file_path").isin(hot)).agg(F.percentile_approx("id", shares, 10_000).alias("q")) if hot else None
    cuts = sorted(set(of_hot.first()["q"] or [])) if hot else []
    part = F.when(F.col("file_path").isin(hot), F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("id")))).otherwise(0) if cuts else F.lit(0)

    given = {"file_path": F.col("file_path"), "id": F.col("as_of_id").cast(kinds["id"])}
    rows = changes.select("*", F.lit(0).alias("_k"), F.lit(None).cast("long").alias("_seq"), F.lit(None).cast("string").alias("_claim")).withColumn("_part", part)
    blank = [given.get(n, F.lit(None).cast(t)).alias(n) for n, t in kinds.items()]
    marks = claims.select(*blank, F.lit(1).alias("_k"), F.col("claim_seq").cast("long").alias("_seq"), F.col("commit_hash").alias("_claim")).withColumn("_part", part)
    both = rows.union(marks)
    if cuts:
        # claims by range first: what is spread is at most a row per hot file and pair of ranges
        ends = marks.where("_part > 0").groupBy("file_path", "_part").agg(F.min(F.struct("_seq", "_claim")).alias("_least"))
        below = ends.select("file_path", F.explode(F.sequence(F.lit(0), F.col("_part") - 1)).alias("_part"), "_least").groupBy("file_path", "_part").agg(F.min("_least").alias("_least"))
        empty = [F.col(n) if n == "file_path" else F.lit(None).cast(t).alias(n) for n, t in kinds.items()]
        both = both.union(below.select(*empty, F.lit(2).alias("_k"), F.col("_least._seq"), F.col("_least._claim"), "_part"))
    # of the claims at or after a row the one with the least number; the rows keep their columns, so nothing is joined back
    order = [(F.col("_k") == 2).desc(), F.col("id").desc(), F.col("_k").desc()]
    later = W.partitionBy("file_path", "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    least = F.min(F.when(F.col("_k") > 0, F.struct("_seq", "_claim"))).over(later)
    found = both.withColumn("_claim", least["_claim"]).where("_k = 0")
    own = F.when(~is_pending(), F.col("commit_hash")).when(F.col("source") == "agent", F.coalesce("_claim", F.lit(""))).otherwise("")
    return found.withColumn("effective_commit", own).drop("_k", "_seq", "_claim", "_part")


def coverage(commit_files: DataFrame, agent: DataFrame) -> DataFrame:
    """Per (file_path, commit_hash) of a commit: do agent rows account for its diff? commit_files: add, del, measurable;
    agent: file_path, commit_hash, diff_stat. A diff without numbers, or a row without, can't be verified."""
    sums = agent.withColumn("_s", diff_stat("diff_stat")).groupBy("file_path", "commit_hash").agg(
        F.sum(F.col("_s")["add"]).alias("_add"), F.sum(F.col("_s")["del"]).alias("_del"), F.bool_and(F.col("_s").isNotNull()).alias("_ok"), F.count(F.lit(1)).alias("n_rows")
    )
    known = F.col("measurable") & F.coalesce("_ok", F.lit(False))
    equal = (F.col("_add") == F.col("add")) & (F.col("_del") == F.col("del"))
    return commit_files.join(sums, ["file_path", "commit_hash"], "left").select(
        "file_path", "commit_hash", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (known & F.coalesce(equal, F.lit(False))).alias("covered"), known.alias("verifiable")
    )


def fallback_rows(covered: DataFrame, recorded_at: int, branch: str = "", summarise=None) -> DataFrame:
    """Rows for files of a commit that no agent row covers. ``summarise``: an optional column function of the file and
    commit that gives a text or null; where it gives one, the row's source is llm."""
    plain = F.when(F.col("verifiable"), SUMMARIES["uncovered"]).otherwise(SUMMARIES["unverifiable"])
    text = summarise(F.col("file_path"), F.col("commit_hash")) if summarise else F.lit(None).cast("string")
    text = F.when(first_secret(F.coalesce(text, F.lit(""))) == "", text)
    return covered.where(~F.col("covered") & ~in_state_dir("file_path")).select(
        "file_path", "commit_hash", F.lit(branch).alias("branch"), F.when(text.isNotNull(), "llm").otherwise("fallback").alias("source"),
        F.coalesce(text, plain).alias("summary"), F.lit(recorded_at).cast("long").alias("recorded_at"),
    )


def unexplained(staged: DataFrame, changes: DataFrame) -> DataFrame:
    """Staged files without a pending agent row: what the gate warns of or stops."""
    pending = changes.where((F.col("source") == "agent") & is_pending()).select("file_path")
    return staged.where(~in_state_dir("file_path")).join(pending, "file_path", "left_anti").select("file_path").distinct()
