"""Clusters over time: new matches join published clusters without closing all edges again.

A published cluster is one vertex, named by its smallest member. New edges between members become
edges between clusters, so only what new edges touch takes part in the closure. Master ids follow
the smallest member; an id that vanishes in a merge gets one redirect to the id its members have
now. Clusters only grow here: matches that are withdrawn need a full run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.functions.keys import cluster_id
from rowkin.operators.components import component_roots
from rowkin.operators.golden import golden_records
from rowkin.operators.lookup import HOT_ROWS, hot_keys, lookup
from rowkin.session import stage


@dataclass(frozen=True)
class ClusterUpdate:
    xref: DataFrame  # (entity_key, master_id) of all entities
    redirects: DataFrame  # (master_id, now) of each id that vanished
    touched: DataFrame  # (master_id) of clusters with other members than before


def update_clusters(published: DataFrame, entities: DataFrame, new_edges: DataFrame, hot_rows: int = HOT_ROWS) -> ClusterUpdate:
    """``published`` (entity_key, master_id) after the edges (left_key, right_key) came in.

    ``entities`` has all entities, old and new; a new one without an edge is a cluster of its own.
    Edges with a null end or within a cluster change nothing, repeated ones count once. What is
    published of entities that are gone stays.
    """
    masters = stage(published.groupBy("master_id").agg(F.min("entity_key").alias("root_key"), F.count("*").alias("members")), "masters")
    hot = hot_keys(masters, "master_id", "members", hot_rows)

    edges = new_edges.select("left_key", "right_key").where("left_key <> right_key").distinct()
    ends = edges.select(F.explode(F.array("left_key", "right_key")).alias("entity_key")).distinct()
    placed = lookup(ends.join(published.select("entity_key", "master_id"), "entity_key", "left"),
                    masters.select("master_id", "root_key"), "master_id", hot, "left")
    vertices = stage(placed.select("entity_key", F.coalesce("root_key", "entity_key").alias("vertex")), "vertices")
    for end in ("left_key", "right_key"):
        named = vertices.select(F.col("entity_key").alias(end), "vertex")
        edges = edges.join(named, end).drop(end).withColumnRenamed("vertex", end)
    closed = stage(component_roots(edges.where("left_key <> right_key").distinct(), hot_rows), "closed")

    moved = closed.where("entity_key <> root_key").select(
        cluster_id(F.col("entity_key")).alias("master_id"), cluster_id(F.col("root_key")).alias("now"))
    redirects = stage(moved.join(masters, "master_id", "left_semi"), "redirects")
    old = lookup(published.select("entity_key", "master_id"), redirects, "master_id", hot, "left").select(
        "entity_key", F.coalesce("now", "master_id").alias("master_id"))
    arrived = entities.select("entity_key").join(published, "entity_key", "left_anti").join(closed, "entity_key", "left")
    new = stage(arrived.select("entity_key", cluster_id(F.coalesce("root_key", "entity_key")).alias("master_id")), "arrived")
    touched = redirects.select(F.col("now").alias("master_id")).unionByName(new.select("master_id")).distinct()
    return ClusterUpdate(stage(old.unionByName(new), "xref"), redirects, stage(touched, "touched"))


def extended_redirects(known: DataFrame, later: DataFrame) -> DataFrame:
    """Redirects (master_id, now) of all updates so far: those known end where the later ones lead."""
    step = later.select(F.col("master_id").alias("now"), F.col("now").alias("later"))
    followed = known.join(step, "now", "left").select("master_id", F.coalesce("later", "now").alias("now"))
    return followed.unionByName(later.select("master_id", "now"))


def refreshed_masters(master: DataFrame, entities: DataFrame, update: ClusterUpdate, review: DataFrame) -> DataFrame:
    """Golden records after the update; only those of touched clusters are built anew.

    Values and review flags of other clusters stay as ``master`` has them. To refresh a cluster whose
    records or reviews changed, add it to ``touched``.
    """
    gone = update.touched.unionByName(update.redirects.select("master_id"))
    kept = master.join(gone, "master_id", "left_anti")
    members = update.xref.join(update.touched, "master_id", "left_semi").select("entity_key", "master_id")
    return kept.unionByName(golden_records(entities, members, review).select(*master.columns))
