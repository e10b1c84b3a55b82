"""Candidate pairs: records that share an e-mail, a phone, or family sound + city.

A block with too many records says too little to compare them all. It grows into a tree of keys: its
records are split by the sound of the given name, parts that are still too large by the ending of the
phone number, then by birth year. Records without the next key are a part of their own. Parts of at
most half the limit are packed together, in the order of their keys, up to the limit, so that records
are not kept apart for being rare. The leaves of a tree hold each record of the block exactly once; a
leaf within the limit forms all its pairs. All other pairs of the block, inside leaves that stay too
large and across leaves, are counted and reported for the block they come from.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.functions.keys import family_key
from rowkin.functions.text import norm_text
from rowkin.operators.lookup import HOT_ROWS, hot_keys, lookup
from rowkin.session import stage, task_count

# A key shared by more records than this says too little to compare them all.
MAX_BLOCK_SIZE = 50
PHONE_ENDING = 4
LEVELS = (0, 1, 2, 3)  # of a block's tree, 0 being the block itself


def block_rows(entities: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    """One row per record and block key; records without a key give none. One scan, no union."""
    block_keys = F.array(
        F.concat(F.lit("e:"), F.col("email")),
        F.concat(F.lit("p:"), F.col("phone_e164")),
        F.concat(F.lit("s:"), F.col("family_soundex"), F.lit("|"), F.col("city")),
    )
    return entities.select("entity_key", *carry, F.explode(F.array_compact(block_keys)).alias("block"))


def block_sizes(rows: DataFrame) -> DataFrame:
    """Counted per partition before the shuffle, so one key with most of the rows does no harm."""
    return rows.groupBy("block").agg(F.count("*").alias("records"))


def tree_keys() -> tuple[tuple[str, Column], ...]:
    """The keys that split a block, level by level; a record without a key has the empty one."""
    return (
        ("g", F.coalesce(family_key(norm_text("given_name")), F.lit(""))),
        ("t", F.coalesce(F.right("phone_e164", F.lit(PHONE_ENDING)), F.lit(""))),
        ("y", F.coalesce(F.year("birth_date").cast("string"), F.lit(""))),
    )


def packed_parts(parts: DataFrame, letter: str, max_block: int) -> DataFrame:
    """(node, part, records) with the node that each part becomes, ``child``, and that one's records.

    A part over half the limit stands alone. Smaller ones are packed in the order of their keys by
    their running total in steps of half the limit, so a pack never exceeds the limit. A node has at
    most as many parts as its key has values: some thousand sounds, ten thousand endings, the years.
    """
    half = max(1, max_block // 2)
    small = F.when(F.col("records") <= half, F.col("records")).otherwise(0)
    before = F.sum(small).over(Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pack = F.floor(F.coalesce(before, F.lit(0)) / half).cast("string")
    child = F.when(F.col("records") > half, F.concat("node", F.lit(f"|{letter}:"), "part")).otherwise(F.concat("node", F.lit(f"|{letter}~"), pack))
    named = parts.withColumn("child", child)
    sizes = named.groupBy("child").agg(F.sum("records").alias("child_records"))
    return named.select("origin", "node", "part", "child").join(sizes, "child")


def refined_blocks(entities: DataFrame, max_block: int = MAX_BLOCK_SIZE, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """((entity_key, block, level) of leaves with 2 to ``max_block`` records, (block, records, pairs) of blocks that miss pairs).

    Works on keys alone. Each level counts its parts and looks the counts up; frequent ones are
    looked up by a broadcast of bounded size, so a key that a third of all rows share stays spread.
    """
    keys = tree_keys()
    columns = [f"_{letter}" for letter, _ in keys]
    rows = block_rows(entities.withColumns({f"_{letter}": key for letter, key in keys}), columns).withColumn("origin", F.col("block"))
    sizes = stage(block_sizes(rows), "block-sizes")
    rows = lookup(rows, sizes, "block", hot_keys(sizes, "block", "records", hot_rows))
    leaf = lambda level: rows.where(F.col("records").between(2, max_block)).select("entity_key", "block", F.lit(level).alias("level"))
    fitting = leaf(0)
    large = sizes.where(F.col("records") > max_block)
    all_pairs = F.expr("records * (records - 1) DIV 2")
    formed: DataFrame | None = None
    for level, (letter, _) in enumerate(keys if not large.isEmpty() else (), 1):
        finer = stage(rows.where(F.col("records") > max_block).select(
            "entity_key", *columns, "origin", F.col("block").alias("node"), F.col(f"_{letter}").alias("part")).withColumn(
            "at", F.concat("node", F.lit("|"), "part")), "tree-rows")
        parts = finer.groupBy("at").agg(F.min("origin").alias("origin"), F.min("node").alias("node"), F.min("part").alias("part"), F.count("*").alias("records"))
        tree = stage(packed_parts(stage(parts, "tree-parts"), letter, max_block), "tree-nodes")
        found = tree.select(F.concat("node", F.lit("|"), "part").alias("at"), F.col("child").alias("block"), F.col("child_records").alias("records"))
        counted = stage(finer.groupBy("at").agg(F.count("*").alias("rows")), "tree-counts")
        rows = lookup(finer.select("entity_key", *columns, "origin", "at"), found, "at", hot_keys(counted, "at", "rows", hot_rows))
        rows = stage(rows, "tree")
        fitting = fitting.unionByName(leaf(level))
        leaves = tree.select("origin", "child", F.col("child_records").alias("records")).distinct().where(F.col("records") <= max_block)
        own = leaves.groupBy("origin").agg(F.sum(all_pairs).alias("formed"))
        formed = own if formed is None else formed.unionByName(own)
        if rows.where(F.col("records") > max_block).isEmpty():
            break
    if formed is None:
        return fitting, large.select("block", "records", all_pairs.alias("pairs"))
    done = formed.groupBy(F.col("origin").alias("block")).agg(F.sum("formed").alias("formed"))
    missed = large.join(done, "block", "left").select("block", "records", (all_pairs - F.coalesce("formed", F.lit(0))).alias("pairs"))
    return fitting, missed.where(F.col("pairs") > 0)


def paired_rows(entities: DataFrame, carry: Iterable[str] = (), max_block: int = MAX_BLOCK_SIZE, levels: Iterable[int] = LEVELS,
                fitting: DataFrame | None = None) -> DataFrame:
    """Both records of every pair inside a usable block, as ``left_…`` and ``right_…`` columns.

    A pair of records that share several blocks appears in the first of them only: each row of a
    block knows its record's earlier blocks. Blocks of a sound come first; they hold most of the
    pairs, and their rows carry nothing for that. Both sides of the join read the same shuffle.
    ``fitting`` is what ``refined_blocks`` returned first, if that is known already.
    """
    carry = list(carry)
    usable = (refined_blocks(entities, max_block)[0] if fitting is None else fitting).where(F.col("level").isin(list(levels)) & F.col("entity_key").isNotNull())
    held = usable.groupBy("entity_key").agg(F.sort_array(F.collect_set("block"), asc=False).alias("blocks"))
    records = held.join(entities.select("entity_key", *carry), "entity_key") if carry else held
    placed = records.select("entity_key", *carry, "blocks", F.posexplode("blocks").alias("place", "block"))
    # The shuffle a large join needs anyway. With a number of tasks given it stays at that: merged by
    # their bytes, which say little of the pairs to come, a few more tasks than cores would take twice the time.
    rows = placed.withColumn("before", F.slice("blocks", F.lit(1), F.col("place"))).drop("blocks", "place").repartition(task_count(entities), "block")

    def side(name: str) -> DataFrame:
        named = [F.col(c).alias(f"{name}_{c}") for c in carry]
        return rows.select(F.col("block").alias(f"{name}_block"), F.col("before").alias(f"{name}_before"), F.col("entity_key").alias(f"{name}_key"), *named)

    same_block: Column = F.col("left_block") == F.col("right_block")
    first_met = ~F.arrays_overlap("left_before", "right_before")
    pairs = side("left").join(side("right"), same_block & (F.col("left_key") < F.col("right_key")) & first_met)
    return pairs.drop("left_block", "right_block", "left_before", "right_before")


def candidate_pairs(entities: DataFrame, max_block: int = MAX_BLOCK_SIZE, levels: Iterable[int] = LEVELS) -> DataFrame:
    return paired_rows(entities, max_block=max_block, levels=levels).distinct()


def oversized_blocks(entities: DataFrame, max_block: int = MAX_BLOCK_SIZE) -> DataFrame:
    """(block, records, pairs): blocks over the limit, and how many of their pairs no leaf of their tree formed."""
    return refined_blocks(entities, max_block)[1]
