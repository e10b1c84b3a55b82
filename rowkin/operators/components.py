"""Connected components of MATCH edges: the transitive closure of pairwise decisions.

Randomised contraction (Bögeholz, Brand, Todor 2020) on DataFrames. In each round every vertex
picks, among itself and its neighbours, the one with the smallest pseudo-random rank; edges move
to the picked vertices, loops and duplicates go, and finished components drop out. The expected
number of edges falls by a constant factor per round, for paths and stars as well, so all rounds
together cost about as much as the first. No task ever holds a neighbourhood: picking is a
grouped minimum with map-side combining, and frequent vertices are looked up by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.functions.keys import cluster_id
from rowkin.operators.lookup import HOT_ROWS, hot_keys, lookup
from rowkin.session import stage

MAX_ROUNDS = 200


def _rank(vertex: Column, round_no: int) -> Column:
    """For a fixed round, xxHash64 is a one-to-one mapping of 8-byte values: no two ranks tie."""
    return F.xxhash64(F.lit(round_no), vertex)


def _picks(edges: DataFrame, round_no: int) -> DataFrame:
    """(v, pick, degree): the smallest-ranked vertex among each vertex and its neighbours."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")),
                             F.struct(F.col("b").alias("v"), F.col("a").alias("w"))))
    directed = edges.select(ends.alias("e")).select("e.v", "e.w")
    rank_w, rank_v = _rank(F.col("w"), round_no), _rank(F.col("v"), round_no)
    best = directed.groupBy("v").agg(
        F.min_by("w", rank_w).alias("w"), F.min(rank_w).alias("rank"), F.count("*").alias("degree")
    )
    return best.select("v", F.when(F.col("rank") < rank_v, F.col("w")).otherwise(F.col("v")).alias("pick"), "degree")


def _contract(edges: DataFrame, picks: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Edges between the picked vertices, each once."""
    for end in ("a", "b"):
        renamed = picks.select(F.col("v").alias(end), F.col("pick").alias(f"{end}_pick"))
        hot_end = None if hot is None else hot.select(F.col("v").alias(end))
        edges = lookup(edges, renamed, end, hot_end)
    moved = edges.select(F.least("a_pick", "b_pick").alias("a"), F.greatest("a_pick", "b_pick").alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def _numbered(match_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices with a number each, and the edges between the numbers. The numbers are written
    before anything reads them, so a lost executor cannot change them."""
    ends = match_edges.select(F.explode(F.array("left_key", "right_key")).alias("entity_key"))
    vertices = stage(ends.distinct().withColumn("v", F.monotonically_increasing_id()), "vertices")
    edges = match_edges.select("left_key", "right_key").where(F.col("left_key") != F.col("right_key"))
    for end, key in (("a", "left_key"), ("b", "right_key")):
        edges = edges.join(vertices.select(F.col("entity_key").alias(key), F.col("v").alias(end)), key)
    canonical = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return vertices, canonical


def component_roots(match_edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(entity_key, root_key) of every vertex of an edge; the root is the smallest member key."""
    vertices, edges = _numbered(match_edges)
    edges = stage(edges, "edges")
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    while not edges.isEmpty():
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError(f"components not closed after {MAX_ROUNDS} rounds")
        picks = stage(_picks(edges, len(rounds)), "picks")
        hot = hot_keys(picks, "v", "degree", hot_rows)
        edges = stage(_contract(edges, picks, hot), "edges")
        rounds.append((picks, hot))

    # Follow the picks from the last round back to the first; each table is a fraction of the one before.
    roots: DataFrame | None = None
    for picks, hot in reversed(rounds):
        step = picks.select("v", "pick")
        if roots is not None:
            later = roots.select(F.col("v").alias("pick"), F.col("root").alias("later"))
            hot_picks = None if hot is None else _frequent_picks(picks, hot_rows)
            followed = lookup(step, later, "pick", hot_picks, "left")
            step = followed.select("v", F.coalesce("later", "pick").alias("pick"))
        roots = step.withColumnRenamed("pick", "root")
    if roots is None:
        return vertices.select("entity_key", F.col("entity_key").alias("root_key"))

    members = stage(vertices.join(roots, "v", "left").select(
        "entity_key", F.coalesce("root", "v").alias("root")), "members")
    named = stage(members.groupBy("root").agg(
        F.min("entity_key").alias("root_key"), F.count("*").alias("members")), "roots")
    hot = hot_keys(named, "root", "members", hot_rows)
    return lookup(members, named.select("root", "root_key"), "root", hot).select("entity_key", "root_key")


def _frequent_picks(picks: DataFrame, hot_rows: int) -> DataFrame | None:
    counts = stage(picks.groupBy("pick").agg(F.count("*").alias("rows")), "pick-counts")
    return hot_keys(counts, "pick", "rows", hot_rows)


def clusters(entity_keys: DataFrame, match_edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(entity_key, root_key) of every entity; one without a match is its own root."""
    roots = component_roots(match_edges, hot_rows)
    joined = entity_keys.select("entity_key").join(roots, "entity_key", "left")
    return joined.select("entity_key", F.coalesce("root_key", "entity_key").alias("root_key"))


def cross_reference(clustered: DataFrame) -> DataFrame:
    """(entity_key, master_id)."""
    return clustered.select("entity_key", cluster_id(F.col("root_key")).alias("master_id"))
