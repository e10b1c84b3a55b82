"""Content digest of a table that does not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(columns: list[str]) -> Column:
    """All values as text; a missing value differs from an empty one."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])


def table_digest(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows, sum and xor of 60-bit row hashes. Aggregated map-side, never sorted."""
    hashed = table.select(F.conv(F.substring(F.md5(row_text(columns or table.columns)), 1, 15), 16, 10).cast("bigint").alias("h"))
    return hashed.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).cast("string").alias("hash_xor"),
    )


def combined_digest(tables: list[DataFrame]) -> str:
    """One MD5 for several tables."""
    parts = [table_digest(t).select(F.concat_ws(":", "rows", "hash_sum", "hash_xor").alias("part"), F.lit(i).alias("i"))
             for i, t in enumerate(tables)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "|")
    return both.agg(F.md5(in_order).alias("digest")).first()["digest"]
