"""Vector code compression: product codes from Lloyd rounds with Hamerly's bounds.

Vectors are cut into equal consecutive parts, each with a codebook of its own. A
vector keeps, for each part, its code, an upper bound of the distance to its
entry and one lower bound of the distance to the second-nearest entry. After the
entries have moved, the bounds move with them; a part is searched again, by an
exact scan of the whole codebook, only where the upper bound is not strictly
below the lower bound or half the way to the entry's nearest neighbour, also
after the upper bound has been made exact. So ties always reach the scan, which
takes the lower index.

Codebooks, entries times components, are what the driver holds and tasks get.

Defined cases: vectors that are null or hold null or non-finite components are
left out; shorter vectors count as padded with zeros up to the longest, and to a
multiple of the parts; components beyond +-2^25 are held to that; the first
entries come from the rows in order of vec_id, then of the vector, null ids
last; with fewer rows than entries the codebooks are smaller; null and repeated
ids are rows like others; an empty table gives an empty result; extra columns
are ignored.
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
from snapgraph.llm import lsh
from snapgraph.llm.lloyd import CHUNK, below, distances, down, drift, gaps, integers, lists, matrix, means, own, sound, sums, two_nearest, up

SCALE, PARTS, ENTRIES, ROUNDS = 1024.0, 4, 256, 4


def search(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Assign one part's vectors to their nearest entries, in place; returns which vectors had to scan the codebook."""
    gate = np.maximum(lower, gaps(book).min(1, initial=np.inf)[code] / 2)
    i = np.flatnonzero(~below(upper, gate))
    upper[i] = np.sqrt(own(x[i], book[code[i]]))
    i = i[~below(upper[i], gate[i])]
    for at in range(0, len(i), CHUNK):
        some = i[at : at + CHUNK]
        code[some], upper[some], lower[some] = two_nearest(distances(x[some], book))
    return i


@dataclass
class Codebooks:
    """(parts, entries, components a part), and the share of searches each round made, of all parts of all vectors."""

    entries: np.ndarray
    searched: list[float] = field(default_factory=list)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _assign(state: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The state after a pass: codes of the nearest entries, bounds for these codebooks."""
    parts, _, width = books.shape
    fresh = moved is None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = matrix(batch.column(2), np.int64)
            if fresh:
                code, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf), np.zeros((n, parts))
            else:
                code, upper, lower = matrix(batch.column(3), np.int64), matrix(batch.column(4), float), matrix(batch.column(5), float)
            searched = np.zeros(n, np.int32)
            for p in range(parts):
                c, u, v = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                if not fresh:
                    u, v = drift(c, u, v, moved[p])
                searched[search(x[:, p * width : (p + 1) * width], books[p], c, u, v)] += 1
                code[:, p], upper[:, p], lower[:, p] = c, u, v
            columns = [*batch.columns[:3], lists(code, pa.int32()), lists(up(upper), pa.float32()), lists(down(lower), pa.float32()), pa.array(searched)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "code", "upper", "lower", "searched"])

    kind = state.schema["label"].dataType.simpleString()
    return state.mapInArrow(rows, f"vec_id long, label {kind}, v array<int>, code array<int>, upper array<float>, lower array<float>, searched int")


def fit(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, v, code) of every sound vector, written, and the codebooks that the codes refer to."""
    kept = embeddings.where(sound(F.col("embedding"))).select(F.col("vec_id").cast("long"), "label", integers(F.col("embedding"), scale).alias("v"))
    sizes = kept.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    width = -(-(sizes[1] or 0) // parts)
    if sizes[2] != width * parts:
        kept = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("v"))))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column(0).to_pylist()
    books = Codebooks(np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2))
    state, moved = kept, None
    for n in range(rounds + 1):
        state = scratch.keep(_assign(state, books.entries, moved), "coded")
        if not first:
            break
        if n < rounds:
            total, count, searched = sums(state, parts, len(first), width)
            after = means(total, count, books.entries)
            moved = np.sqrt(((after - books.entries) ** 2).sum(2))
            books.entries = after
        else:
            searched = state.agg(F.sum("searched")).first()[0]
        books.searched.append(searched / (parts * sizes[0]))
    return state.select("vec_id", "label", "v", "code"), books


def decode(code: np.ndarray, books: Codebooks) -> np.ndarray:
    """The vectors that rows of codes stand for, in scaled whole numbers."""
    return np.concatenate([books.entries[p][code[:, p]] for p in range(len(books.entries))], axis=1)


def report(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared), label_error (summed over equal labels), codebooks_sha256."""
    coded, books = fit(embeddings, parts, entries, rounds, scale)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = matrix(batch.column(3), np.int64)
            error = own(matrix(batch.column(2), np.int64), decode(code, books))
            names = ["".join(f"{c:02x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = coded.schema["label"].dataType.simpleString()
    scored = coded.mapInArrow(rows, f"vec_id long, label {kind}, code string, error long")
    scored = scratch.keep(scored.select("vec_id", F.struct("label").alias("label"), "code", "error"), "scored")  # null labels are equal within a struct
    by = scratch.keep(scored.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("size")), "by_label")
    out = lsh.sized_join(scored, by, "label", "size")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB's form of report over the table embeddings, for vectors of one length that the parts divide."""
    steps = [
        f"""WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT n, len(v) // {parts} AS w, unnest(v) AS x, unnest(range(len(v))) AS i FROM k),
x AS MATERIALIZED (SELECT n, i // w AS part, i % w AS pos, x FROM u),
c0 AS MATERIALIZED (SELECT part, n AS entry, pos, x AS c FROM x WHERE n < {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS (SELECT n, part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{r} USING (part, pos) GROUP BY n, part, entry),
a{r} AS MATERIALIZED (SELECT n, part, min({{'d': d, 'entry': entry}}) AS a FROM d{r} GROUP BY n, part)"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT part, a.entry AS entry, pos, sum(x) AS total, count(*) AS many FROM x JOIN a{r} USING (n, part) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((total - ((total % many) + many) % many) // many, c)::BIGINT AS c FROM c{r} LEFT JOIN s{r} USING (part, entry, pos))"""
            )
    return (
        ",\n".join(steps)
        + f""",
e AS (SELECT n, string_agg(printf('%02x', a.entry), '' ORDER BY part) AS code, sum(a.d)::BIGINT AS error FROM a{rounds} GROUP BY n),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN e USING (n), h
"""
    )
