"""Look-back over one global order, without gathering it in one task.

A window without partitions sorts everything in a single task. Here rows are dealt by ranges of the order, each range
looks back within itself, and what crosses from range to range is one row per range: a small table that is scanned
once and broadcast (its size is the number of ranges, a parameter).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def look_back(df: DataFrame, order: str, lags: dict[str, Column], running_max: dict[str, Column] | None = None, ranges: int = 64) -> DataFrame:
    """The input with, for each name, the expression's value on the row before (``lags``) or its maximum over all rows
    before (``running_max``); null on the first row. ``order`` has to be unique and not null."""
    running_max = running_max or {}
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(df.agg(F.percentile_approx(order, shares, 10_000).alias("q")).first()["q"] or []))
    # the number of a row's range: how many cuts lie below it
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    cut = df.withColumn("_part", part).withColumns({f"_v_{n}": e for n, e in {**lags, **running_max}.items()})
    inside = W.partitionBy("_part").orderBy(order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    out = cut.withColumns({n: F.lag(f"_v_{n}").over(inside) for n in lags} | {n: F.max(f"_v_{n}").over(before) for n in running_max})
    out = out.withColumn("_first", F.row_number().over(inside) == 1)
    ends = cut.groupBy("_part").agg(
        *(F.max_by(F.struct(F.col(f"_v_{n}").alias("v")), order).alias(f"_e_{n}") for n in lags), *(F.max(f"_v_{n}").alias(f"_e_{n}") for n in running_max)
    )  # a row per range
    ahead = W.orderBy("_part")
    carried = ends.select(
        "_part", *(F.lag(f"_e_{n}").over(ahead)["v"].alias(f"_c_{n}") for n in lags),
        *(F.max(f"_e_{n}").over(ahead.rowsBetween(W.unboundedPreceding, -1)).alias(f"_c_{n}") for n in running_max),
    )
    out = out.join(F.broadcast(carried), "_part", "left")
    found = {n: F.when(F.col("_first"), F.col(f"_c_{n}")).otherwise(F.col(n)) for n in lags}
    found |= {n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in running_max}
    return out.withColumns(found).select(*df.columns, *lags, *running_max)
