"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector is cut into segments; from the segments' lengths, means and deviations
follows a lower bound of two vectors' distance, and so an upper bound of their
inner product: sum of len * (mean * mean' + dev * dev'). Bounds are taken on few,
then on more segments; exact scores are computed for survivors only.

Queries go in blocks of bounded size against all rows, one written table a
block, so a lost executor costs parts of one block; a task works through a block
in batches. Defined cases: vectors that are null or hold a null or non-finite
component take no part, as query or candidate; shorter vectors count as padded
with zeros to the longest; every row is a query and a candidate of its own, also
where rows share a vec_id or repeat, and only the query's own row is no candidate
of it; a null vec_id is no multiple of anything, so no query, but a candidate
that comes after all others of its score; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapgraph import scratch

#: Queries in a block, about; queries and candidates compared at once; segments of the levels, coarse to fine.
BLOCK, BATCH, CHUNK, LEVELS = 32_768, 4096, 2048, (4, 16)
#: The share of open pairs above which a product of whole matrices is cheaper than one for each pair.
DENSE = 1 / 16
#: Stands for a null vec_id, behind all others.
NONE = 2**63 - 1


def _statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Scaled segment means and deviations; the product of two vectors' rows bounds their inner product."""
    edges = np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int)
    out = np.empty((len(vectors), 2 * (len(edges) - 1)))
    for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        part = vectors[:, a:b]
        out[:, 2 * s] = part.mean(1) * np.sqrt(b - a)
        out[:, 2 * s + 1] = part.std(1) * np.sqrt(b - a)
    return out


class Search:
    """The k best candidates of each query among all that have been shown; rows equal to the query are left out."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [_statistics(vectors, n) for n in LEVELS]
        self.norms = np.sqrt((vectors**2).sum(1))
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.least = np.full(len(ids), -np.inf)

    def _scores(self, q: np.ndarray, c: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        out = np.empty(len(q), np.int64)
        for i in range(0, len(q), 1 << 16):
            a, b = self.vectors[q[i : i + (1 << 16)]], candidates[c[i : i + (1 << 16)]]
            exact = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53
            out[i : i + (1 << 16)] = (a * b).sum(1) if exact else (a.astype(np.int64) * b.astype(np.int64)).sum(1)
        return out

    def _take(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = (np.concatenate(x) for x in zip(self.best, (q, score, ids), strict=True))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.best = (q[keep], score[keep], ids[keep])
        last = rank == self.k - 1
        self.least[q[last]] = score[last]

    def show(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids):
            return
        slack = 1e-9 * self.norms.max(initial=0) * np.sqrt((vectors**2).sum(1).max()) + 1e-6
        open_ = np.ones((len(self.ids), len(ids)), bool)
        q, c = np.nonzero(self.ids[:, None] == ids[None, :])
        open_[q, c] = (self.vectors[q] != vectors[c]).any(1)
        for level, n in zip(self.levels, LEVELS, strict=True):
            self._narrow(open_, level, _statistics(vectors, n), slack)
            if np.isinf(self.least).any():  # no thresholds yet: begin with the candidates of the largest bounds
                upper = np.where(open_, level @ _statistics(vectors, n).T, -np.inf)
                most = min(len(ids), 4 * self.k)
                c = np.argpartition(-upper, most - 1, axis=1)[:, :most]
                q, c = np.repeat(np.arange(len(self.ids)), most), c.reshape(-1)
                seen = open_[q, c]
                q, c = q[seen], c[seen]
                self._take(q, self._scores(q, c, vectors), ids[c])
                open_[q, c] = False
                self._narrow(open_, level, _statistics(vectors, n), slack)
        exact = np.abs(self.vectors).max(initial=0) * np.abs(vectors).max(initial=0) * vectors.shape[1] < 2**53
        if exact and open_.mean() > DENSE:
            scores = self.vectors @ vectors.T
            open_ &= scores >= self.least[:, None]
            q, c = np.nonzero(open_)
            self._take(q, scores[q, c].astype(np.int64), ids[c])
        else:
            q, c = np.nonzero(open_)
            self._take(q, self._scores(q, c, vectors), ids[c])

    def _narrow(self, open_: np.ndarray, level: np.ndarray, bound: np.ndarray, slack: float) -> None:
        """Close the pairs whose upper bound lies below the query's k-th best score so far."""
        least = self.least - slack
        if open_.mean() > DENSE:
            open_ &= level @ bound.T >= least[:, None]
            return
        q, c = np.nonzero(open_)
        for i in range(0, len(q), 1 << 16):
            a, b = q[i : i + (1 << 16)], c[i : i + (1 << 16)]
            open_[a, b] = (level[a] * bound[b]).sum(1) >= least[a]


def _matrix(values: list, width: int) -> np.ndarray:
    if all(len(v) == width for v in values):
        return np.asarray(values, float).reshape(len(values), width)
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for rows with vec_id % every = 0, the k largest inner products of floor(scale * x)."""
    spark = embeddings.sparkSession
    wide = F.transform("embedding", lambda x: x.cast("double"))
    broken = F.exists(F.col("_v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = embeddings.where("embedding IS NOT NULL").select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NONE)).alias("vec_id"), wide.alias("_v"))
    vectors = vectors.where(~F.coalesce(broken, F.lit(True))).select("vec_id", F.transform("_v", lambda x: F.floor(x * scale).cast("double")).alias("_v"))
    shortest, longest = vectors.agg(F.min(F.size("_v")), F.max(F.size("_v"))).first()
    if shortest != longest:
        vectors = vectors.select("vec_id", F.concat("_v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("_v"))).alias("_v"))
    path = f"{scratch.folder(spark)}/topk-{uuid.uuid4().hex}"
    asked = vectors.where((F.col("vec_id") != NONE) & (F.col("vec_id") % every == 0)).groupBy("vec_id", "_v").agg(F.count("*").alias("copies"))
    asked = scratch.keep(asked, "asked")
    blocks = -(-asked.count() // BLOCK)
    block = F.pmod(F.xxhash64("vec_id", "_v"), F.lit(blocks or 1)).cast("int").alias("block")
    asked.select("*", block).write.partitionBy("block").parquet(f"{path}/asked")
    schema, paths = "query_id long, rank int, vec_id long, score long", []
    for n in range(blocks):
        own = spark.read.parquet(f"{path}/asked").where(F.col("block") == n).select("vec_id", "_v", "copies").toArrow()  # of bounded size
        if not own.num_rows:
            continue
        ids, values = own.column(0).to_numpy(), own.column(1).to_pylist()
        width = max(1, *map(len, values))
        sent = spark.sparkContext.broadcast((ids, _matrix(values, width)))

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query, matrix = sent.value
            searches: list[Search] = []
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    found = part.column(1).to_pylist()
                    wide = max(matrix.shape[1], *map(len, found))
                    if not searches or wide > searches[0].vectors.shape[1]:
                        was, padded = searches, np.pad(matrix, ((0, 0), (0, wide - matrix.shape[1])))
                        searches = [Search(query[i : i + BATCH], padded[i : i + BATCH], k) for i in range(0, len(query), BATCH)]
                        for old, new in zip(was, searches, strict=False):
                            new.best, new.least = old.best, old.least
                    shown, wide = part.column(0).to_numpy(), searches[0].vectors.shape[1]
                    for search in searches:
                        search.show(shown, _matrix(found, wide))
            for i, search in enumerate(searches):
                q, score, vec = search.best
                yield pa.RecordBatch.from_arrays([pa.array(q + i * BATCH), pa.array(vec), pa.array(score)], ["query", "vec_id", "score"])

        # what equals the query: all of its copies but itself are candidates
        copies = own.column(2).to_numpy()
        norm = lambda v: sum(x * x for x in map(int, v))  # noqa: E731  of repeated rows only
        again = [(q, int(ids[q]), norm(values[q])) for q in np.flatnonzero(copies > 1).tolist() for _ in range(min(k, int(copies[q]) - 1))]
        numbers = spark.createDataFrame([(q, int(ids[q]), int(copies[q])) for q in range(len(ids))], "query long, query_id long, copies long")
        found = vectors.mapInArrow(rows, "query long, vec_id long, score long").union(spark.createDataFrame(again, "query long, vec_id long, score long"))
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(numbers), "query")
        best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))  # equal rows have equal answers, one each
        best.select("query_id", "rank", F.nullif("vec_id", F.lit(NONE)).alias("vec_id"), "score").write.parquet(f"{path}/{n}")
        sent.unpersist()
        paths.append(f"{path}/{n}")
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


#: DuckDB's form of top_k over the table embeddings.
SQL = """
WITH c AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM c q JOIN c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
