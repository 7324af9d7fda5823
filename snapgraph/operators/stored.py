"""Relations stored by key, for looking up few of very many rows.

Rows are written in ranges of their key and in its order, in small row groups
with Bloom filters, so that statistics and filters tell for nearly every row
group whether it can hold a key. Few keys are pushed down to the scan as a list,
more are joined, and then files outside their range are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph import scratch

#: Bytes of a row group, and keys that are pushed down as a list.
GROUP, LISTED = 1 << 20, 1000


def store(df: DataFrame, key: str) -> DataFrame:
    """df written in order of key."""
    ordered = df.repartitionByRange(key).sortWithinPartitions(key)
    return scratch.keep(ordered, "stored", options={f"parquet.bloom.filter.enabled#{key}": "true", "parquet.block.size": str(GROUP), "parquet.page.size": str(64 << 10)})


def look_up(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The stored rows of each wanted row (key, ...), with its columns."""
    asked = scratch.keep(wanted, "asked")
    keys = [r[0] for r in asked.select(key).distinct().limit(LISTED + 1).collect()]
    low_high = asked.agg(F.min(key), F.max(key)).first()
    if low_high[0] is None:
        rows = stored.where("false")
    elif len(keys) <= LISTED:
        rows = stored.where(F.col(key).isin([k for k in keys if k is not None]))
    else:
        rows = stored.where(F.col(key).between(*low_high))
    return asked.join(rows, key)
