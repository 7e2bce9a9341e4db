"""Centroid clustering by Lloyd's rounds that only look at what moved.

Vectors become whole numbers, so every distance, sum and mean is exact and the result doesn't depend on how rows are dealt.
Two tables persist between rounds, both in the shared folder: the assignments (each vector with its owner and the squared
distance to it) and the global sums (a row per cluster and component, and one for the count). A round

* compares a vector only with the centroids that changed in the round before, against the distance that is kept; it is
  compared with all centroids only if its own owner moved (the kept distance is then stale);
* sends, for vectors that change their owner, their components with a minus to the old sum and with a plus to the new
  one. Each task adds these transfers up, so k * (dim + 1) numbers leave it at most, whatever its rows are;
* adds the transfers to the sums; a mean is the floor of sum / count, an empty cluster keeps its centroid.

A round whose centroids all stayed changes nothing and isn't run. No vector is shuffled; a round reads and writes the table
of vectors once. The driver sees the centroids and the sums (k * (dim + 1) numbers).

Defined cases: vectors that are null, have another length, or hold a null or a number that isn't finite are left out;
repeated rows are vectors of their own; ties go to the smaller number; fewer vectors than ``k`` make as many clusters;
equal starting vectors leave the later ones empty; a null id counts as the empty text when starts are chosen; ids that aren't
integers and components beyond +-2^19 (a squared distance would leave 64 bits) are refused with an error; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_files, integer_id, materialise

K = 40
DIM = 64
ROUNDS = 5
SEED = 2
SCALE = 256
LIMIT = 1 << 27
EXACT = 1 << 21  # below it float64 products are exact
STATE = "vec_id long, v array<int>, owner int, dist long, was int"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """(vec_id, v) of the vectors that count, as whole numbers."""
    x = F.col(vector_col)
    fits = x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform(x, lambda c: F.lit(float(SCALE)) * c.cast("double"))
    low = F.exists(scaled, lambda c: F.abs(c) >= LIMIT)
    v = F.when(low, F.raise_error(F.lit(f"a component is beyond {LIMIT // SCALE}")).cast("array<int>")).otherwise(F.transform(scaled, lambda c: F.floor(c).cast("int")))
    return vectors.where(fits).select(integer_id(vectors, id_col).alias("vec_id"), v.alias("v"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose digest of the id is smallest, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.orderBy(digest, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors, a row per vector of x."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
    else:
        a, b = x.astype(np.int64), c.astype(np.int64)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def reassigned(x: np.ndarray, owner: np.ndarray, dist: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances, comparing only where something changed; an owner of -1 is none."""
    owner, dist = owner.copy(), dist.copy()
    if not len(changed):
        return owner, dist
    stale = (owner < 0) | np.isin(owner, changed)
    if stale.any():
        d = squared_distances(x[stale], centroids)
        owner[stale] = d.argmin(1)
        dist[stale] = d.min(1)
    still = np.flatnonzero(~stale)
    if len(still):
        d = squared_distances(x[still], centroids[changed])
        near, other = d.min(1), changed[d.argmin(1)]
        take = (near < dist[still]) | (near == dist[still]) & (other < owner[still])
        owner[still[take]], dist[still[take]] = other[take], near[take]
    return owner, dist


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _assign(state: DataFrame, centroids: np.ndarray, changed: np.ndarray, dim: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            before = batch.column("owner").to_numpy()
            owner, dist = reassigned(_matrix(batch.column("v"), dim), before, batch.column("dist").to_numpy(), centroids, changed)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(owner.astype(np.int32)), pa.array(dist), pa.array(before)], ["vec_id", "v", "owner", "dist", "was"])

    return state.mapInArrow(run, STATE)


def _transfers(state: DataFrame, k: int, dim: int) -> DataFrame:
    """(cluster, i, s): what each cluster's sums gain or lose by vectors that changed their owner; i = dim is the count."""

    def run(batches):
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            x = np.hstack([_matrix(batch.column("v"), dim), np.ones((batch.num_rows, 1), np.int64)])
            np.add.at(total, batch.column("owner").to_numpy(), x)
            was = batch.column("was").to_numpy()
            np.subtract.at(total, was[was >= 0], x[was >= 0])
        cluster, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[cluster, i])], ["cluster", "i", "s"])

    return state.where("owner <> was").select("v", "owner", "was").mapInArrow(run, "cluster int, i int, s long")


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """Per vector: cluster, squared distance, the distance summed over its cluster and over all, a digest of its centroid."""
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, id_col, vector_col, dim)
    state = materialise(kept.select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("dist"), F.lit(-1).alias("was")), "lloyd-state")
    centroids = first_centroids(state, k, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], RESULT)
    changed = np.arange(k)
    sums = spark.createDataFrame([], "cluster int, i int, s long")
    for step in range(rounds + 1):
        if not len(changed):
            break
        after = materialise(_assign(state, centroids, changed, dim), "lloyd-state")
        drop_files(state)
        state = after
        if step == rounds:
            break
        before, sums = sums, materialise(sums.union(_transfers(state, k, dim)).groupBy("cluster", "i").agg(F.sum("s").alias("s")), "lloyd-sums")
        drop_files(before)
        table = np.zeros((k, dim + 1), np.int64)
        for r in sums.collect():  # k * (dim + 1) rows at most
            table[r["cluster"], r["i"]] = r["s"]
        held = table[:, dim] > 0
        means = centroids.copy()
        means[held] = table[held, :dim] // table[held, dim:]
        changed = np.flatnonzero((means != centroids).any(1))
        centroids = means
    drop_files(sums)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    inertia = state.groupBy("owner").agg(F.sum("dist").alias("s")).collect()  # a row per cluster
    of = {r["owner"]: r["s"] for r in inertia}
    total = sum(of.values())
    listed = spark.createDataFrame([(i, of.get(i, 0), total, d) for i, d in digests], "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(listed), "owner").select("vec_id", F.col("owner").alias("cluster"), F.col("dist").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> str:
    """Plain Lloyd rounds in SQL: every vector against every centroid each time."""
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS c, v
            FROM kept QUALIFY c < {k})""",
        "parts AS (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, min({{'d': list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c.c}}) AS m
            FROM kept k CROSS JOIN c{r} c GROUP BY rid)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (
                SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
                    SELECT m.c AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN parts USING (rid) GROUP BY ALL) GROUP BY c) n USING (c))"""
            )
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, m.c AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} c ON c.c = m.c"""
