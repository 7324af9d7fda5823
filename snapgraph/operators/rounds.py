"""What loops of joins share: relations that only grow, and joins that keep a hot key out of one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch

#: A key that stands in this share of a table's rows, or more, is never joined by shuffle.
HOT = 10_000


class Growing:
    """Rows of all rounds so far, in few written tables: a table is merged with the one before once that is not twice as large.

    So of n rows none is written more than log2(n) times, and there are no more
    than log2(n) tables however many rounds there are.
    """

    def __init__(self, first: DataFrame, name: str) -> None:
        self.name = name
        self.tables: list[tuple[DataFrame, int]] = []
        self.add(first, first.count())

    def add(self, rows: DataFrame, n: int) -> None:
        self.tables.append((rows, n))
        while len(self.tables) > 1 and self.tables[-2][1] < 2 * self.tables[-1][1]:
            (a, m), (b, n) = self.tables[-2:]
            self.tables[-2:] = [(a.union(b), m + n)]
            if len(self.tables) > 1 and self.tables[-2][1] < 2 * (m + n):
                continue  # merged again at once
            self.tables[-1] = (scratch.keep(self.tables[-1][0], self.name, fewer=True), m + n)

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, (t for t, _ in self.tables))


def sized_join(rows: DataFrame, table: DataFrame, on: str, size: str) -> DataFrame:
    """Inner join with a written table that tells how many rows each key has.

    Keys of 1 / HOT of all these rows or more, HOT of them at most, are sent to
    every task, so no task gets a hot key's rows; the others are shuffled.
    """
    total, most = table.agg(F.sum(size), F.max(size)).first()
    if not total or most <= 1 or most * HOT < total:
        return rows.join(table, on)
    hot = F.col(size) * HOT >= total
    heavy = table.where(hot & (F.col(size) > 1))
    heavy = F.broadcast(heavy)
    rest = table.where(~hot | (F.col(size) <= 1))
    return rows.join(heavy, on).union(rows.join(heavy, on, "left_anti").join(rest, on))
