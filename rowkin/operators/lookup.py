"""Looking up one row per key when some keys may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot from this many rows on, or from 1/4096 of all rows when that is more. So there are
# never more than 4096 hot keys, and broadcasting them is bounded whatever the data.
HOT_ROWS = 200_000
MAX_HOT_KEYS = 4096


def hot_threshold(total_rows: int, hot_rows: int = HOT_ROWS) -> int:
    return max(hot_rows, total_rows // MAX_HOT_KEYS)


def lookup(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Join ``rows`` with the one row per ``key`` of ``table``.

    ``hot`` holds the frequent keys (see ``hot_threshold``), or is None when there are none. Their
    few table rows are broadcast, so the many rows stay where they are; all others are shuffled.
    """
    if hot is None:
        return rows.join(table, key, how)
    hot = F.broadcast(hot.select(key))
    frequent = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, how)
    others = rows.join(hot, key, "left_anti").join(table, key, how)
    return frequent.unionByName(others)


def hot_keys(counts: DataFrame, key: str, count: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The hot keys of ``counts`` (one row per key, a written table), or None."""
    total = counts.agg(F.sum(count).alias("rows"), F.max(count).alias("largest")).first()
    threshold = hot_threshold(total["rows"] or 0, hot_rows)
    if (total["largest"] or 0) <= threshold:
        return None
    return counts.where(F.col(count) > threshold).select(key)
