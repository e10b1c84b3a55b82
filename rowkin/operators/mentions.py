"""Linking records by the e-mails and telephone numbers that stand in their texts.

A key that few records mention says much, one that many mention says little: a key weighs the binary
logarithm of all records over those that mention it. Two records are linked by the sum of the weights
of the keys they share. Keys of more than ``hub`` records (role addresses, hot lines) are hubs: they
link nobody and are listed with the pairs that they would have formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.operators.blocking import MAX_BLOCK_SIZE
from rowkin.operators.components import clusters
from rowkin.session import stage

# How an e-mail and an international telephone number look in a text.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
PHONE = r"[+][0-9][0-9 ().-]{7,}[0-9]"
LEAST_WEIGHT = 4.0  # of a link: one key that a sixteenth of all records mention, or several


def _keys(text: Column) -> Column:
    mails = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda m: F.concat(F.lit("e:"), F.lower(m)))
    phones = F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda p: F.concat(F.lit("p:"), F.regexp_replace(p, "[^0-9]", "")))
    return F.array_distinct(F.concat(mails, phones))


def mentions(records: DataFrame) -> DataFrame:
    """(entity_key, key): distinct keys of each record of (entity_key, text). Null texts and ids mention nothing."""
    known = records.where("entity_key IS NOT NULL AND text IS NOT NULL")
    return known.select("entity_key", F.explode(_keys(F.col("text"))).alias("key")).distinct()


def weighted_keys(found: DataFrame, total: int, hub: int = MAX_BLOCK_SIZE) -> DataFrame:
    """(key, records, weight, hub) of every key that is mentioned; ``total`` is the number of records."""
    counted = found.groupBy("key").agg(F.count("*").alias("records"))
    return counted.select("key", "records", F.log2(F.lit(float(total)) / F.col("records")).alias("weight"), (F.col("records") > hub).alias("hub"))


def hubs(keys: DataFrame) -> DataFrame:
    """(key, records, pairs): keys that link nobody, and the pairs they would have formed."""
    return keys.where("hub").select("key", "records", F.expr("records * (records - 1) DIV 2").alias("pairs"))


def links(found: DataFrame, keys: DataFrame, least: float = LEAST_WEIGHT) -> DataFrame:
    """(left_key, right_key, shared, weight) of records whose shared keys weigh enough.

    No key forms more pairs than its hub limit allows, so a task never meets a large group. Hubs and
    keys of one record are left out before the join.
    """
    usable = keys.where("NOT hub AND records > 1").select("key", "weight")
    rows = found.join(usable, "key")
    left = rows.select("key", "weight", F.col("entity_key").alias("left_key"))
    right = rows.select("key", F.col("entity_key").alias("right_key"))
    pairs = left.join(right, "key").where("left_key < right_key")
    summed = pairs.groupBy("left_key", "right_key").agg(F.count("*").alias("shared"), F.sum("weight").alias("weight"))
    return summed.where(F.round("weight", 6) >= least)


def linked(records: DataFrame, hub: int = MAX_BLOCK_SIZE, least: float = LEAST_WEIGHT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((entity_key, root_key) of every record that mentions a key, its mentions, the weighted keys)."""
    found = stage(mentions(records), "mentions")
    keys = stage(weighted_keys(found, records.count(), hub), "mention-keys")
    rooted = clusters(found.select("entity_key").distinct(), stage(links(found, keys, least), "mention-links"))
    return rooted, found, keys


def survivors(rooted: DataFrame, found: DataFrame) -> DataFrame:
    """(root_key, records, email, phone): per cluster of several records the key that most of them mention, ties by the key."""
    counted = found.join(rooted, "entity_key").groupBy("root_key", "key").agg(F.count("*").alias("n"))
    best = lambda kind: F.min_by(F.substring("key", 3, 320), F.when(F.col("key").startswith(kind), F.struct(-F.col("n"), F.col("key"))))
    keys = counted.groupBy("root_key").agg(best("e:").alias("email"), best("p:").alias("phone"))
    size = rooted.groupBy("root_key").agg(F.count("*").alias("records")).where("records > 1")
    return size.join(keys, "root_key")
