"""Lloyd rounds over vectors of whole numbers: what vector codes and clustering share.

Distances, sums and means are exact, so results depend on no order of rows or
tasks. Bounds are doubles, kept as floats rounded outwards; a bound decides only
where it is strictly apart, by more than rounding can account for.

A round is one pass that assigns all vectors, written as a table in the shared
folder, and one that sums them by centre inside the tasks; of those sums only a
table of fixed size, centres times components, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held to this range, so that squared distances of up to 4,096 components fit into longs.
LIMIT = 1 << 25
#: Vectors compared with all centres at once.
CHUNK = 2048


def sound(vector: Column) -> Column:
    """Whether a vector is not null and holds neither null nor non-finite components."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~broken, F.lit(False))


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as ints within LIMIT."""
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """An Arrow column of lists of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=True).reshape(len(column), -1 if len(column) and len(flat) else 0)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1), kind))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c, both of whole numbers."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * top * top * max(1, x.shape[1]) < 2**53:
        x, c = x.astype(float), c.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, one in enumerate(c.astype(np.int64)):
        out[:, j] = ((x.astype(np.int64) - one) ** 2).sum(1)
    return out


def own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to their partners."""
    return ((x.astype(np.int64) - c.astype(np.int64)) ** 2).sum(1)


def below(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Where an upper bound is strictly below a lower one, whatever rounding did."""
    return upper * (1 + 1e-9) + 1e-9 < lower


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def two_nearest(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first nearest column of each row, its distance and that of the second nearest, infinite if there is none."""
    first = squared.argmin(1)
    least = squared[np.arange(len(squared)), first]
    if squared.shape[1] < 2:
        return first, np.sqrt(least), np.full(len(squared), np.inf)
    return first, np.sqrt(least), np.sqrt(np.partition(squared, 1, axis=1)[:, 1])


def gaps(centres: np.ndarray) -> np.ndarray:
    """Distances between centres; a centre's own is infinite."""
    out = np.sqrt(distances(centres, centres).astype(float))
    np.fill_diagonal(out, np.inf)
    return out


def drift(code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after centres have moved: the own one's way on top, the farthest way of any other off."""
    far = int(moved.argmax())
    rest = np.delete(moved, far).max(initial=0.0)
    return upper + moved[code], lower - np.where(code == far, rest, moved[far])


def sums(state: DataFrame, parts: int, k: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Component sums (parts, k, width) and counts (parts, k) by code, and how many full searches the round made."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width + 1), np.int64)
        searched = 0
        for batch in batches:
            x, code = matrix(batch.column(0), np.int64), matrix(batch.column(1), np.int64)
            searched += int(batch.column(2).to_numpy().sum())
            for p in range(parts):
                total[p, :, width] += np.bincount(code[:, p], minlength=k)
                for i in range(width):
                    total[p, :, i] += np.bincount(code[:, p], x[:, p * width + i], k).astype(np.int64)
        at = np.flatnonzero(total)
        cells = np.append(at, -1)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.append(total.reshape(-1)[at], searched))], ["cell", "n"])

    found = state.select("v", "code", "searched").mapInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = found.column(0).to_numpy(), found.column(1).to_numpy()
    out = np.zeros(parts * k * (width + 1), np.int64)
    out[cell[cell >= 0]] = n[cell >= 0]
    out = out.reshape(parts, k, width + 1)
    return out[:, :, :width], out[:, :, width], int(n[cell < 0].sum())


def means(total: np.ndarray, count: np.ndarray, before: np.ndarray) -> np.ndarray:
    """floor(sum / count); centres without vectors stay."""
    return np.where(count[..., None] > 0, total // np.maximum(count, 1)[..., None], before)
