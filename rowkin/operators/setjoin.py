"""Similarity join of token sets inside blocks, without comparing all pairs of a block.

Equal sets of a block count once. A set's tokens are ordered by how rare they are in its block.

Sets of at most ``SHORT`` tokens meet by the sizes of both and by two tokens: sets of sizes n and m that
must share o tokens share two of the first n - o + 2 and m - o + 2 (one of the first n - o + 1 and
m - o + 1 where o is 1). Two tokens at once are rare where single ones are not: a block has many sets
with the same family name and few with the same two names. Sizes that no two different sets can have
make no key. A pair is looked at only for the first tokens that it shares.

Pairs with a longer set must share one of the first tokens of either, as many as ``prefix_length`` says.
Candidates go if their sizes differ too much, or if even a match of all tokens after the shared one
would not do. What is left is verified on whole sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.session import stage


SHORT = 8  # tokens; longer sets would have too many pairs of tokens


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(block, tokens): the distinct sorted token sets per block of (block, tokens array<string>); empty and null ones are left out."""
    tokens = F.array_sort(F.array_distinct(F.array_compact("tokens")))
    return rows.where("block IS NOT NULL").select("block", tokens.alias("tokens")).where(F.size("tokens") > 0).distinct()


def prefix_length(n: Column, percent: int) -> Column:
    """n - ceil(n * percent / 100) + 1 in whole numbers."""
    return (n - F.expr(f"(size(tokens) * {percent} + 99) DIV 100") + 1).cast("int")


def _keys(prefix: Column, tokens: int) -> Column:
    """The tokens of a prefix as arrays of one, or its pairs of tokens, in the order of the prefix."""
    if tokens == 1:
        return F.transform(prefix, lambda t: F.array(t))
    pairs = F.transform(prefix, lambda t, i: F.transform(F.slice(prefix, i + 2, F.size(prefix)), lambda u: F.array(t, u)))
    return F.flatten(pairs)


def _short_keys(cut: DataFrame, percent: int, side: str) -> DataFrame:
    """The keys of every short set as the smaller or the larger one of a pair, for each size that the other can have."""
    own, other = F.col("n"), F.col("other")
    least, most = F.expr(f"(n * {percent} + 99) DIV 100").cast("int"), F.expr(f"least(n * 100 DIV {percent}, {SHORT})").cast("int")
    others = F.sequence(own, most) if side == "small" else F.sequence(least, own)
    shared = F.expr(f"((n + other) * {percent} + {99 + percent}) DIV {100 + percent}").cast("int")  # what both must share
    rows = cut.where(own <= SHORT).select("block", "set", "n", "tokens", F.explode(others).alias("other")).withColumn("shared", shared)
    rows = rows.where(F.col("shared") <= F.least(own, other) - (own == other).cast("int"))  # different sets of one size differ in a token
    start = lambda length: F.slice("tokens", F.lit(1), own - F.col("shared") + length)
    keys = F.when(F.col("shared") == 1, _keys(start(1), 1)).otherwise(_keys(start(2), 2))
    sizes = (own, other) if side == "small" else (other, own)
    return rows.select("block", sizes[0].alias("small_n"), sizes[1].alias("large_n"), F.explode(keys).alias("key"),
                       F.col("set").alias(f"{side}_set"), F.col("tokens").alias(f"{side}_tokens"))


def short_candidates(cut: DataFrame, percent: int) -> DataFrame:
    """Pairs of short sets that share a key."""
    met = _short_keys(cut, percent, "small").join(_short_keys(cut, percent, "large"), ["block", "small_n", "large_n", "key"])
    return met.where((F.col("small_n") < F.col("large_n")) | (F.col("small_set") < F.col("large_set")))


def short_pairs(cut: DataFrame, percent: int) -> DataFrame:
    """(block, left_tokens, left_n, right_tokens, right_n, shared): similar pairs of sets of at most ``SHORT`` tokens."""
    both = F.array_intersect("small_tokens", "large_tokens")
    met = short_candidates(cut, percent).withColumn("both", both).where(F.slice("both", F.lit(1), F.size("key")) == F.col("key"))
    found = met.withColumn("shared", F.size("both")).where((100 + percent) * F.col("shared") >= percent * (F.col("small_n") + F.col("large_n")))
    return found.select("block", F.col("small_tokens").alias("left_tokens"), F.col("small_n").alias("left_n"),
                        F.col("large_tokens").alias("right_tokens"), F.col("large_n").alias("right_n"), "shared")


def long_pairs(cut: DataFrame, percent: int) -> DataFrame:
    """The same of pairs with a set of more than ``SHORT`` tokens."""
    reach = cut.where(100 * F.col("n") >= percent * (SHORT + 1))  # sets that can be similar to a long one
    seeds = reach.select("block", "set", "n", "tokens", "prefix", F.posexplode("prefix").alias("at", "token"))

    def side(name: str) -> DataFrame:
        return seeds.select("block", "token", *[F.col(c).alias(f"{name}_{c}") for c in ("set", "n", "tokens", "prefix", "at")])

    small, large = F.least("left_n", "right_n"), F.greatest("left_n", "right_n")
    # The most that can be shared, the tokens before the shared one having no match.
    most = F.least(F.col("left_n") - F.col("left_at"), F.col("right_n") - F.col("right_at"))
    enough = lambda shared: (100 + percent) * shared >= percent * (F.col("left_n") + F.col("right_n"))
    met = side("left").where(F.col("left_n") > SHORT).join(side("right"), ["block", "token"]).where(
        ((F.col("right_n") <= SHORT) | (F.col("left_set") < F.col("right_set"))) & (100 * small >= percent * large) & enough(most)
        & (F.get(F.array_intersect("left_prefix", "right_prefix"), F.lit(0)) == F.col("token")))
    found = met.withColumn("shared", F.size(F.array_intersect("left_tokens", "right_tokens"))).where(enough(F.col("shared")))
    return found.select("block", "left_tokens", "left_n", "right_tokens", "right_n", "shared")


def similar_sets(rows: DataFrame, percent: int) -> DataFrame:
    """(block, left_tokens, right_tokens, shared, total): pairs of distinct sets with 100 * shared >= percent * total.

    ``total`` is the size of the union, left_tokens < right_tokens. Rows with the same set are one set
    here; whoever needs row pairs joins its rows to their sets.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    sets = stage(distinct_sets(rows).withColumn("set", F.xxhash64("block", "tokens")), "sets")
    each = sets.select("block", "set", F.explode("tokens").alias("token"))
    rare = each.groupBy("block", "token").agg(F.count("*").alias("sets"))
    ordered = each.join(rare, ["block", "token"]).groupBy("block", "set").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("o"))
    tokens = F.transform("o", lambda o: o["token"]).alias("tokens")
    cut = stage(ordered.select("block", "set", tokens).withColumn("n", F.size("tokens")).withColumn(
        "prefix", F.slice("tokens", F.lit(1), prefix_length(F.col("n"), percent))), "prefixes")
    verified = short_pairs(cut, percent).unionByName(long_pairs(cut, percent))
    left, right = F.array_sort("left_tokens"), F.array_sort("right_tokens")
    swap = left > right
    return verified.select("block", F.when(swap, right).otherwise(left).alias("left_tokens"), F.when(swap, left).otherwise(right).alias("right_tokens"),
                           F.col("shared").cast("long").alias("shared"), (F.col("left_n") + F.col("right_n") - F.col("shared")).cast("long").alias("total"))
