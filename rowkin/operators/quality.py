"""Checks before publication. A check is one row: (check, passed, observed)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class GateFailed(RuntimeError):
    """At least one check failed; nothing was published."""


def _violations(name: str, df: DataFrame, count: Column) -> DataFrame:
    observed = df.agg(F.coalesce(count, F.lit(0)).cast("bigint").alias("observed"))
    return observed.select(F.lit(name).alias("check"), (F.col("observed") == 0).alias("passed"), "observed")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_checks(df: DataFrame, failing: Mapping[str, Column]) -> DataFrame:
    """Count the rows where each predicate holds: all of them in one pass."""
    names = list(failing)
    counted = df.agg(*[F.count_if(F.coalesce(failing[n], F.lit(False))).alias(f"c{i}") for i, n in enumerate(names)])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("observed"))
                               for i, n in enumerate(names)]))
    return counted.select(rows.alias("r")).select("r.check", (F.col("r.observed") == 0).alias("passed"), "r.observed")


def unique_check(name: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key. Counted per key map-side, so a hot key does no harm."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    per_key = df.where(present).groupBy(*keys).agg(F.count("*").alias("n"))
    return _violations(name, per_key, F.sum(F.col("n") - 1))


def reference_check(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key is not in ``parent``; keys are counted before they are joined."""
    keys = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    orphans = keys.join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return _violations(name, orphans, F.sum("n"))


@dataclass(frozen=True)
class Contract:
    """What a table promises: columns, required columns, keys, allowed values, ranges, references."""

    columns: Sequence[str] = ()
    types: Mapping[str, str] = field(default_factory=dict)
    required: Sequence[str] = ()
    keys: Sequence[Sequence[str]] = ()
    allowed: Mapping[str, Sequence[str]] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    references: Mapping[str, tuple[DataFrame, str]] = field(default_factory=dict)


def _predicates(name: str, contract: Contract) -> dict[str, Column]:
    """What makes a row fail, by check."""
    failing: dict[str, Column] = {}
    for c in contract.required:
        failing[f"{name}.{c} not null"] = F.col(c).isNull()
    for c, values in contract.allowed.items():
        failing[f"{name}.{c} allowed"] = ~F.col(c).isin(list(values))
    for c, (low, high) in contract.ranges.items():
        failing[f"{name}.{c} range"] = ~F.col(c).between(low, high)
    return failing


def contract_checks(name: str, df: DataFrame, contract: Contract) -> DataFrame:
    failing = _predicates(name, contract)
    if contract.columns:
        kinds = dict(df.dtypes)
        odd = set(df.columns) ^ set(contract.columns) | {c for c, kind in contract.types.items() if kinds.get(c) != kind}
        schema = df.sparkSession.range(1, numPartitions=1).select(
            F.lit(f"{name} columns").alias("check"), F.lit(not odd).alias("passed"), F.lit(len(odd)).cast("bigint").alias("observed"))
    parts = [row_checks(df, failing)] if failing else []
    parts += [schema] if contract.columns else []
    parts += [unique_check(f"{name}({','.join(keys)}) unique", df, keys) for keys in contract.keys]
    parts += [reference_check(f"{name}.{c} reference", df, c, parent, key)
              for c, (parent, key) in contract.references.items()]
    return _union(parts)


OFFENDERS_KEPT = 100  # rows shown per check, at most 999; all of them are counted


def _shown(name: str | Column, rows: DataFrame) -> DataFrame:
    """(check, row): offending rows as JSON, missing values kept."""
    check = F.lit(name) if isinstance(name, str) else name
    return rows.select(check.alias("check"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("row"))


def failing_rows(df: DataFrame, failing: Mapping[str, Column], show: Sequence[str] | None = None) -> DataFrame:
    """A row for each check that a row of ``df`` fails, all checks in one pass; ``show`` names the columns that tell rows apart."""
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in failing.items()]), lambda n: n.isNotNull())
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in show or df.columns]), {"ignoreNullFields": "false"})
    return df.select(hits.alias("hits"), whole.alias("row")).where(F.size("hits") > 0).select(F.explode("hits").alias("check"), "row")


def repeated_rows(name: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, as one row each with their number of rows."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    repeated = df.where(present).groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
    return _shown(name, repeated)


def orphan_rows(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """The keys of ``child`` that ``parent`` lacks, as one row each with their number of rows."""
    counted = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    return _shown(name, counted.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti"))


def keep_first(rows: DataFrame, limit: int = OFFENDERS_KEPT) -> DataFrame:
    """(check, offenders, row): the first ``limit`` rows of a check by their text, and how many there are.

    Below 1,000 the planner lets every task keep its own first rows before the shuffle, so a check
    that all rows fail does not bring them into one task. Equal rows stay separate rows.
    """
    if not 0 < limit < 1_000:
        raise ValueError(f"limit {limit} is not between 1 and 999")
    counts = rows.groupBy("check").agg(F.count("*").alias("offenders"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("check").orderBy("row"))).where(F.col("n") <= limit)
    return first.join(F.broadcast(counts), "check").select("check", "offenders", "row")


def contract_offenders(name: str, df: DataFrame, contract: Contract, limit: int = OFFENDERS_KEPT,
                       show: Sequence[str] | None = None) -> DataFrame:
    """The rows and keys behind the failed checks of ``contract_checks``, under the same names."""
    failing = _predicates(name, contract)
    parts = [failing_rows(df, failing, show)] if failing else []
    parts += [repeated_rows(f"{name}({','.join(keys)}) unique", df, keys) for keys in contract.keys]
    parts += [orphan_rows(f"{name}.{c} reference", df, c, parent, key) for c, (parent, key) in contract.references.items()]
    return keep_first(_union(parts), limit)


def gold_offenders(master: DataFrame, xref: DataFrame, entities: DataFrame, limit: int = OFFENDERS_KEPT) -> DataFrame:
    """The rows and keys behind the failed checks of ``gold_checks``; an empty master has none."""
    entity_keys, mapped = entities.select("entity_key"), xref.select("entity_key")
    mapping = "every entity mapped"
    return keep_first(_union([
        failing_rows(master.select("master_id", "given_name", "family_name"),
                     {f"{c} not null": F.col(c).isNull() for c in ("master_id", "given_name", "family_name")}),
        repeated_rows("master_id unique", master, ["master_id"]),
        repeated_rows("email unique when resolved", master.where(~F.col("has_pending_review")), ["email"]),
        repeated_rows("entity_key unique", xref, ["entity_key"]),
        _shown(mapping, entity_keys.join(mapped, "entity_key", "left_anti").withColumn("missing_in", F.lit("xref"))),
        _shown(mapping, mapped.join(entity_keys, "entity_key", "left_anti").withColumn("missing_in", F.lit("entities"))),
    ]), limit)


def gold_checks(master: DataFrame, xref: DataFrame, entities: DataFrame) -> DataFrame:
    """The gate in front of the gold tables."""
    nulls = row_checks(master, {f"{c} not null": F.col(c).isNull() for c in ("master_id", "given_name", "family_name")})
    empty = master.agg(F.count("*").alias("observed")).select(
        F.lit("master not empty").alias("check"), (F.col("observed") > 0).alias("passed"), "observed")
    resolved = master.where(~F.col("has_pending_review"))
    entity_keys = entities.select("entity_key")
    unmapped = entity_keys.join(xref.select("entity_key"), "entity_key", "left_anti")
    unknown = xref.select("entity_key").join(entity_keys, "entity_key", "left_anti")
    return _union([
        nulls,
        unique_check("master_id unique", master, ["master_id"]),
        empty,
        unique_check("email unique when resolved", resolved, ["email"]),
        unique_check("entity_key unique", xref, ["entity_key"]),
        _violations("every entity mapped", unmapped.unionByName(unknown), F.count("*")),
    ])


def require(checks: DataFrame, record: Callable[[], str] | None = None) -> None:
    """Raise ``GateFailed`` with the failed checks; ``checks`` has a handful of rows.

    ``record`` writes the offending rows and says where; it is called only when a check failed.
    """
    failed = checks.where(~F.col("passed")).select("check", "observed").collect()
    if failed:
        where = f"; rows in {record()}" if record else ""
        raise GateFailed("; ".join(f"{r['check']}: {r['observed']}" for r in failed) + where)
