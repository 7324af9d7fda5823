"""Centroid clustering by Lloyd rounds with Exponion search.

A vector keeps its cluster, an upper bound of the distance to that centroid and a
lower bound of the distance to the second nearest. Where the upper bound is
strictly below the lower one, or below half the way from the centroid to its
nearest neighbour, nothing is computed. Else the upper bound u is made exact, and
where that does not settle it, only centroids within 2 u + s of the current one
are scanned, s being the way to its nearest neighbour: the nearest and the second
nearest of the vector lie in that ball. Lists of the other centroids in order of
their distance tell by a binary search how many that are; the radius is
inclusive, so ties are scanned, and the smaller number wins.

Centroids, k times components, are what the driver holds and tasks get.

Defined cases: vectors that are null, hold null or non-finite components or have
another number of components than asked for are left out; components beyond
+-2^25 are held to that; rows of one id, or none, start in order of the vector,
null ids after all others; with fewer rows than k there are fewer centroids;
repeated rows are rows like others; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.llm.lloyd import CHUNK, below, distances, down, drift, gaps, integers, lists, matrix, means, own, sound, sums, two_nearest, up

SCALE, K, ROUNDS, WIDTH, SEED = 1024.0, 8, 10, 64, 3


class Ball:
    """Centroids with the others of each in order of distance."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres
        between = gaps(centres)
        self.near = between.min(1, initial=np.inf)
        np.fill_diagonal(between, 0)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.way = np.take_along_axis(between, self.order, 1)

    def search(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
        """Assign vectors to their nearest centroids, in place; which were searched, and how many distances that took."""
        gate = np.maximum(lower, self.near[code] / 2)
        i = np.flatnonzero(~below(upper, gate))
        upper[i] = np.sqrt(own(x[i], self.centres[code[i]]))
        i = i[~below(upper[i], gate[i])]
        radius = (2 * upper[i] + self.near[code[i]]) * (1 + 1e-9) + 1e-9
        group, scanned = code[i].copy(), 0
        for a in np.unique(group):
            inside = np.flatnonzero(group == a)
            many = np.searchsorted(self.way[a], radius[inside], "right")
            for n in np.unique(many):
                some = i[inside[many == n]]
                ball = np.sort(self.order[a, :n])  # by number, so that ties go to the smaller
                for at in range(0, len(some), CHUNK):
                    rows = some[at : at + CHUNK]
                    nearest, upper[rows], lower[rows] = two_nearest(distances(x[rows], self.centres[ball]))
                    code[rows] = ball[nearest]
                scanned += len(some) * int(n)
        return i, scanned


@dataclass
class Centroids:
    """(k, components), and of each round the distances computed in balls, as a share of all vectors times k."""

    centres: np.ndarray
    scanned: list[float] = field(default_factory=list)

    def sha256(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.centres.tolist()]


def _assign(state: DataFrame, centres: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The state after a pass: clusters of the nearest centroids, bounds for these centroids."""
    fresh = moved is None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(centres)
        for batch in batches:
            n = batch.num_rows
            x = matrix(batch.column(1), np.int64)
            if fresh:
                code, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
            else:
                code, upper, lower = matrix(batch.column(2), np.int64)[:, 0], *(batch.column(c).to_numpy().astype(float) for c in (3, 4))
                upper, lower = drift(code, upper, lower, moved)
            _, scanned = ball.search(x, code, upper, lower)
            searched = np.zeros(n, np.int32)
            searched[:1] = scanned
            columns = [*batch.columns[:2], lists(code[:, None], pa.int32()), pa.array(up(upper)), pa.array(down(lower)), pa.array(searched)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "code", "upper", "lower", "searched"])

    return state.mapInArrow(rows, "vec_id long, v array<int>, code array<int>, upper float, lower float, searched int")


def fit(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED, scale: float = SCALE) -> tuple[DataFrame, Centroids]:
    """(vec_id, v, cluster) of every sound vector of `width` components, written, and the centroids."""
    kept = embeddings.where(sound(F.col("embedding")) & (F.size("embedding") == width)).select(F.col("vec_id").cast("long"), integers(F.col("embedding"), scale).alias("v"))
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(lot.asc_nulls_last(), "v").limit(k).select("v").toArrow().column(0).to_pylist()
    found = Centroids(np.array(first, np.int64).reshape(len(first), width))
    state, moved, total = kept, None, 0
    for n in range(rounds + 1):
        state = scratch.keep(_assign(state, found.centres, moved), "clustered")
        if not first:
            break
        if n < rounds:
            summed, count, scanned = sums(state, 1, len(first), width)
            after = means(summed[0], count[0], found.centres)
            moved, total = np.sqrt(((after - found.centres) ** 2).sum(1)), int(count.sum())
            found.centres = after
        else:
            scanned = state.agg(F.sum("searched")).first()[0]
        found.scanned.append(scanned / max(1, total * len(first)))
    return state.select("vec_id", "v", F.element_at("code", 1).alias("cluster")), found


def report(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED, scale: float = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector."""
    state, found = fit(embeddings, k, rounds, width, seed, scale)
    centres = found.centres

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = own(matrix(batch.column(1), np.int64), centres[batch.column(2).to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(distance)], ["vec_id", "cluster", "distance"])

    scored = scratch.keep(state.mapInArrow(rows, "vec_id long, cluster int, distance long"), "scored")
    by = {r["cluster"]: r["inertia"] for r in scored.groupBy("cluster").agg(F.sum("distance").alias("inertia")).toArrow().to_pylist()}  # k rows
    named = [(c, by[c], sum(by.values()), sha) for c, sha in enumerate(found.sha256()) if c in by]
    table = embeddings.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return scored.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> str:
    """DuckDB's form of report over the table embeddings."""
    steps = [
        f"""WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), vec_id) - 1 AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT n, unnest(range({width})) AS pos, unnest(v) AS x FROM k),
c0 AS MATERIALIZED (SELECT n AS centre, pos, x AS c FROM x WHERE n < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS (SELECT n, centre, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{r} USING (pos) GROUP BY n, centre),
a{r} AS MATERIALIZED (SELECT n, min({{'d': d, 'centre': centre}}) AS a FROM d{r} GROUP BY n)"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT a.centre AS centre, pos, sum(x) AS total, count(*) AS many FROM x JOIN a{r} USING (n) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT centre, pos, coalesce((total - ((total % many) + many) % many) // many, c)::BIGINT AS c FROM c{r} LEFT JOIN s{r} USING (centre, pos))"""
            )
    return (
        ",\n".join(steps)
        + f""",
h AS (SELECT centre, sha256(string_agg(c::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY centre)
SELECT vec_id, a.centre::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.centre))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM k JOIN a{rounds} USING (n) JOIN h ON h.centre = a.centre
"""
    )
