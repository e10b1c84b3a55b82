"""Near-duplicate groups by min-hash with tensored banding.

A document's set of five-word shingles is sketched by two small collections of half keys. A table
key is a pair of one half key of each collection, so 32 + 32 half keys (256 min-hashes) stand for
1,024 tables, for which plain banding would compute 8,192 min-hashes. Two sets of similarity 0.75
share no key with a probability of 1e-5, dissimilar ones rarely share one. Links are confirmed on
the full sets.

How it stays linear in the documents:

* Equal sets count as one vertex from the start, so a group of exact copies is one row.
* A half key that only one set has cannot be part of a shared table key. Those are dropped before
  pairs of half keys are formed; most sets end here.
* In a table cell all sets are compared with the cell's first set alone. That joins almost all of a
  group of near copies. What is left are sets that meet in a cell and are in different components
  still. Those are paired by their half keys of the first collection, each pair once, at its first
  common half key.
* Full sets are fetched only for pairs whose sizes allow a link and whose longer signatures do not
  rule it out (512 min-hashes; a pair of similarity 0.75 is ruled out with a probability of 4e-6).
* Frequent keys are counted before the shuffle; the joins on them can be split by the engine,
  for no aggregate stands on top of their shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm import shingles as sh
from rowkin.llm.tables import small_batches
from rowkin.operators.lookup import hot_keys
from rowkin.session import stage

SIMILARITY = (75, 100)  # intersection to union, as a fraction
HALVES = 32
PER_HALF = 4
LEAST_AGREEING = 349  # of 512 four-bit min-hashes; a similarity of 0.75 gives 392 with a deviation of 9.6
MAX_ROUNDS = 100
PAIRS_PER_SALT = 1_000  # pairs that one copy of a frequent set serves


def _sketched(halves: int, per_half: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher, hashes = sh.Sketcher(halves, per_half), sh.WordHashes()
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch["text"]:
                found = sh.shingle_set(text, hashes)
                sizes.append(len(found))
                digests.append(sh.set_digest(found) if len(found) else None)
                keys.append(sketcher.half_keys(found) if len(found) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes, "digest": digests, "halves": keys})

    return work


def _full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes, signer = sh.WordHashes(), sh.Signer()
    for batch in batches:
        found = [s for s in (sh.shingle_set(text, hashes) for text in batch["text"]) if len(s)]
        if found:
            yield pd.DataFrame({"digest": [sh.set_digest(s) for s in found], "shingles": [s.tobytes() for s in found],
                                "planes": [signer.planes(s) for s in found]})


def _confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, whole = SIMILARITY
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        for i, (a, b) in enumerate(zip(batch["a_shingles"], batch["b_shingles"], strict=True)):
            left, right = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = sh.overlap(left, right)
            keep[i] = whole * both >= part * (len(left) + len(right) - both)
        yield batch.loc[keep, ["a", "b"]]


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the links (a, b); the root is the smallest vertex of its component.

    Every vertex hangs itself below its smallest neighbour, chains of hooks are shortened by doubling,
    and the links move up to the hooks' ends. Stars end after one round, chains shrink eightfold in each.
    """
    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    labels = None
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        hooks = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("up"))
        for _ in range(3):
            above = hooks.select(F.col("v").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(above, "up", "left").select("v", F.coalesce("top", "up").alias("up"))
        hooks = stage(hooks, "hooks")
        for end in ("a", "b"):
            moved = hooks.select(F.col("v").alias(end), "up")
            edges = edges.join(moved, end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
        if labels is None:
            labels = hooks.withColumnRenamed("up", "root")
        else:
            later = hooks.select(F.col("v").alias("root"), "up")
            followed = labels.join(later, "root", "left").select("v", F.coalesce("up", "root").alias("root"))
            # Roots of earlier rounds hook on in later ones only.
            labels = followed.unionByName(hooks.select("v", F.col("up").alias("root")).join(followed.select("v"), "v", "left_anti"))
        labels = stage(labels, "labels")
    else:
        raise RuntimeError(f"components not closed after {MAX_ROUNDS} rounds")
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = labels.select(F.col("root").alias("v"), "root").distinct()
    return labels.unionByName(roots)


def beside(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) with ``column`` of both ends' sets as a_<column> and b_<column>; ``sets`` has one row per v.

    A set that many pairs name as b is handed out in salted copies, so no task gets all of its pairs.
    The sets to copy are known by a broadcast of ``MAX_HOT_KEYS`` rows at most; no other has more
    than its share of 1/4096 of the pairs.
    """
    key = ["b"]
    right = sets.select(F.col("v").alias("b"), F.col(column).alias(f"b_{column}"))
    counts = stage(pairs.groupBy("b").agg(F.count("*").alias("pairs")), "pair-counts")
    hot = hot_keys(counts, "b", "pairs", PAIRS_PER_SALT)
    if hot is not None:
        copies = F.broadcast(counts.join(hot, "b").select("b", F.floor(F.col("pairs") / PAIRS_PER_SALT).cast("int").alias("copies")))
        more = F.coalesce("copies", F.lit(0))
        pairs = pairs.join(copies, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), more + 1).cast("int"))
        right = right.join(copies, "b", "left").select("b", f"b_{column}", F.explode(F.sequence(F.lit(0), more)).alias("salt"))
        key = ["b", "salt"]
    left = sets.select(F.col("v").alias("a"), F.col(column).alias(f"a_{column}"))
    return pairs.join(right, key).join(left, "a").select("a", "b", f"a_{column}", f"b_{column}")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of vertices whose full sets are similar enough; ``sets`` is (v, shingles)."""
    return beside(pairs, sets, "shingles").mapInPandas(_confirmed, "a long, b long")


def similar_sizes(left: str, right: str) -> F.Column:
    """Whether two sets of these sizes can reach the similarity at all."""
    part, whole = SIMILARITY
    return F.least(left, right) * whole >= F.greatest(left, right) * part


def alike_signatures() -> F.Column:
    """Whether the signatures a_planes and b_planes leave room for the similarity."""
    def differing(word: int) -> F.Column:
        planes = [F.col("a_planes")[4 * word + i].bitwiseXOR(F.col("b_planes")[4 * word + i]) for i in range(4)]
        return F.bit_count(planes[0].bitwiseOR(planes[1]).bitwiseOR(planes[2]).bitwiseOR(planes[3]))

    odd = sum((differing(w) for w in range(1, sh.Signer.LANES // 64)), differing(0))
    return odd <= sh.Signer.LANES - LEAST_AGREEING


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out."""
    return beside(pairs, sets, "planes").where(alike_signatures()).select("a", "b")


def unlike_roots(rest: DataFrame, halves: int) -> DataFrame:
    """Pairs (a, b) of ``rest`` (v, n, root, halves, planes) that may be similar and have different roots."""
    first = rest.withColumn("first", F.slice("halves", 1, halves)).drop("halves")
    rows = first.select("v", "n", "root", "planes", "first", F.posexplode("first").alias("at", "half"))
    shared = rows.groupBy("half").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("half")
    rows = stage(rows.join(shared, "half"), "open-halves")
    left, right = (rows.select("half", "at", *[F.col(c).alias(f"{side}_{c}") for c in ("v", "n", "root", "planes", "first")])
                   for side in ("a", "b"))

    at = F.array_position(F.zip_with("a_first", "b_first", lambda x, y: x == y), True) - 1
    alike = (F.col("a_v") > F.col("b_v")) & (F.col("a_root") != F.col("b_root")) & similar_sizes("a_n", "b_n")
    pairs = left.join(right.drop("at"), "half").where(alike & alike_signatures() & (at == F.col("at")))
    return pairs.select(F.col("a_v").alias("a"), F.col("b_v").alias("b"))


def near_duplicates(docs: DataFrame, halves: int = HALVES, per_half: int = PER_HALF) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``, of which doc_id and text are read.

    Without words or text the set is empty and the row is linked with nothing. Rows that repeat a
    doc_id stay separate; component_id is the smallest doc_id of the rows linked with a row, itself
    included, and null if these have no doc_id. kept is true where doc_id equals component_id.
    """
    with small_batches(docs.sparkSession):  # rows hold texts, sketches or two full sets
        return _grouped(docs, halves, per_half)


def _grouped(docs: DataFrame, halves: int, per_half: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text, since pandas would make null ids floats
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(texts.mapInPandas(_sketched(halves, per_half), "doc_id string, n_shingles long, digest binary, halves array<long>").withColumn("doc_id", F.col("doc_id").cast(id_type)), "sketches")

    grouped = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"))
    vertices = stage(grouped.withColumn("v", F.monotonically_increasing_id()), "vertices")

    half_keys = vertices.select("v", F.explode("halves").alias("half"))
    shared = half_keys.groupBy("half").agg(F.count("*").alias("sets")).where("sets > 1").select("half")
    living = half_keys.join(shared, "half").groupBy("v").agg(F.collect_list("half").alias("living"))
    first = F.filter("living", lambda h: h.bitwiseAND(F.lit(1)) == 0)
    second = F.filter("living", lambda h: h.bitwiseAND(F.lit(1)) == 1)
    keyed = living.select("v", F.explode(first).alias("x"), second.alias("ys")).select("v", "x", F.explode("ys").alias("y"))
    cells = keyed.select("v", F.xxhash64("x", "y").alias("cell"))
    heads = cells.groupBy("cell").agg(F.min("v").alias("head"), F.max("v").alias("last")).where("head < last").select("cell", "head")
    cells = stage(cells.join(heads, "cell").join(vertices.select("v", "n"), "v").select("cell", "v", "head", "n"), "cells")

    starred = cells.where("v <> head").select(F.col("v").alias("a"), F.col("head").alias("b")).distinct()
    sizes = vertices.select(F.col("v").alias("b"), F.col("n").alias("b_n"))
    sizes_a = vertices.select(F.col("v").alias("a"), F.col("n").alias("a_n"))
    starred = stage(starred.join(sizes, "b").join(sizes_a, "a").where(similar_sizes("a_n", "b_n")).select("a", "b"), "starred")

    met = cells.select("v").distinct()
    wanted = vertices.join(met, "v").select("digest", "v", "first_id")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id_text")
    named = texts.select(as_text("doc_id"), "text").join(wanted.select(as_text("first_id")).distinct(), "id_text", "left_semi")
    sets = named.select("text").mapInPandas(_full_sets, "digest binary, shingles binary, planes array<long>").join(wanted.select("digest", "v"), "digest")
    sets = stage(sets.select("v", "shingles", "planes").dropDuplicates(["v"]), "sets")

    links = stage(confirm(stage(plausible(starred, sets), "plausible"), sets), "star-links")
    roots = components(links)
    rooted = cells.join(roots, "v", "left").select("cell", "v", "n", F.coalesce("root", "v").alias("root"))
    open_cells = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
    rest = rooted.join(open_cells, "cell").select("v", "n", "root").distinct()
    pairs = unlike_roots(rest.join(vertices.select("v", "halves"), "v").join(sets.select("v", "planes"), "v"), halves)
    pairs = pairs.join(starred, ["a", "b"], "left_anti")
    more = confirm(stage(pairs, "pairs"), sets)
    roots = components(links.unionByName(more))  # written, so no Python runs after this

    placed = vertices.select("digest", "v", "first_id").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    names = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = placed.join(names, "root").select("digest", "component_id")
    joined = rows.select("doc_id", "n_shingles", "digest").join(known, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with all their columns: of each group the row with the smallest doc_id, and all rows without words.

    Groups are formed over rows, so rows that repeat a doc_id or have none are told apart.
    """
    row = max(docs.columns, key=len) + "_row"  # longer than any column's name, so it clashes with none
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    grouped = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, "doc_id").join(grouped, row)
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)
