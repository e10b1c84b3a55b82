"""Sharding by a permutation-filled lookup table.

Every shard ranks the slots of a prime-sized table by its own permutation (an offset and a skip
hashed from its name). The shards take turns; in its turn a shard claims the first slot of its
ranking that is still free. So the shards' shares differ by one slot at most, and when the list of
shards changes, few slots change hands. A row is placed by hashing its key to a slot.

The table has one entry per slot, a size that depends on the number of shards alone, so it is
broadcast; placing a row is one hash and one look-up and moves no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.session import stage

SLOTS_PER_SHARD = 100  # keeps the shares of the shards within one per cent


def prime_from(n: int) -> int:
    """The smallest prime that is at least ``n``."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def hashed(text: Column, modulus: int) -> Column:
    """The first 60 bits of the text's md5, modulo."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % modulus


def slot_table(spark: SparkSession, shards: Sequence[str], slots: int | None = None) -> DataFrame:
    """(slot, shard): who owns each slot. ``slots`` must be prime; names must be distinct."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    size = slots or prime_from(SLOTS_PER_SHARD * len(shards))
    if prime_from(size) != size or size <= len(shards):
        raise ValueError("the number of slots must be a prime above the number of shards")
    count = len(shards)
    seeds = spark.range(1, numPartitions=1).select(F.array(*[F.struct(
        F.lit(name).alias("name"), hashed(F.lit(f"{name}#offset"), size).alias("offset"),
        (hashed(F.lit(f"{name}#skip"), size - 1) + 1).alias("skip")) for name in shards]).alias("seeds"))
    rankings = F.transform("seeds", lambda s: F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda j: ((s["offset"] + j * s["skip"]) % size).cast("int")))
    # Written before the fold reads it, else it would be made anew in every turn.
    ranked = stage(seeds.select(rankings.alias("rankings")), "rankings")
    claims = F.expr(f"""
        aggregate(sequence(0, {size - 1}), array_repeat(-1, {size}), (owners, turn) ->
          transform(array(filter(rankings[turn % {count}], p -> owners[p] = -1)[0]),
            slot -> concat(slice(owners, 1, slot), array(turn % {count}), slice(owners, slot + 2, {size})))[0])""")
    owners = ranked.select(F.posexplode(claims).alias("slot", "owner"))
    return stage(owners.select("slot", F.element_at(F.array(*[F.lit(s) for s in shards]), F.col("owner") + 1).alias("shard")), "slots")


def place(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` with the ``slot`` and ``shard`` of each row; columns of these names are replaced.

    A null key is placed like empty text, equal keys always land on one shard, an empty table of
    rows stays empty. All other columns pass unchanged.
    """
    size = table.count()
    slot = hashed(F.coalesce(F.col(key).cast("string"), F.lit("")), size).cast("int")
    return rows.drop("shard").withColumn("slot", slot).join(F.broadcast(table), "slot")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard. A shard's rows are dealt over several tasks, so a hot key does no harm."""
    salt = F.pmod(F.xxhash64(*[c for c in placed.columns if c != "shard"]), F.lit(files_per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
