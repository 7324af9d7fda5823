"""Line differences of text pairs, by the standard library's matcher."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("lines_added", "lines_removed", "lines_changed")])
OPCODES = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("i1", "i2", "j1", "j2")]]))


def opcodes(a: str | None, b: str | None, keep_ends: bool = True) -> list[tuple[str, int, int, int, int]]:
    """Ratcliff-Obershelp opcodes of two texts' lines; with their terminators, a final newline is a difference."""
    x, y = (a or "").splitlines(keep_ends), (b or "").splitlines(keep_ends)
    return difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()


def stats(a: str | None, b: str | None) -> tuple[int, int, int]:
    added = removed = 0
    for tag, i1, i2, j1, j2 in opcodes(a, b):
        if tag != "equal":
            removed, added = removed + i2 - i1, added + j2 - j1
    return added, removed, added + removed


@F.pandas_udf(STATS)
def diff_stats(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Added, removed and changed lines of each pair."""
    return pd.DataFrame([stats(x, y) for x, y in zip(a, b, strict=True)], columns=["lines_added", "lines_removed", "lines_changed"])


@F.pandas_udf(OPCODES)
def diff_opcodes(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The opcodes of each pair without line terminators, for side-by-side display."""
    names = ("tag", "i1", "i2", "j1", "j2")
    for a, b in pairs:
        yield pd.Series([[dict(zip(names, o, strict=True)) for o in opcodes(x, y, False)] for x, y in zip(a, b, strict=True)])
