"""Insert-or-update by key, as a new version of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None,
           order: str | None = None) -> DataFrame:
    """Rows of ``old`` with those of ``new`` put over them by key.

    ``update`` names the columns an existing row takes over (all by default); the others keep their
    first value. ``order`` decides between several new rows of one key. Aggregation combines
    before the shuffle, so many versions of one key are no problem.
    """
    others = [c for c in old.columns if c not in keys]
    update = list(others if update is None else update)
    kept = [c for c in others if c not in update]
    rank = F.col(order) if order else F.lit(0)
    tagged = old.select("*", F.lit(0).alias("_new")).unionByName(new.select(*old.columns, F.lit(1).alias("_new")))
    version = F.struct(F.col("_new"), rank)
    parts = []
    if update:
        parts.append(F.max_by(F.struct(*update), version).alias("_update"))
    if kept:
        parts.append(F.min_by(F.struct(*kept), version).alias("_kept"))
    merged = tagged.groupBy(*keys).agg(*parts)
    return merged.select(*[
        F.col(c) if c in keys else F.col(f"{'_update' if c in update else '_kept'}.{c}") for c in old.columns
    ])


def overlay(base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``base`` with the values of ``changes`` where it has a row for the key (update by join)."""
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(renamed, key, "left")
    return joined.select(*[
        F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns
    ])
