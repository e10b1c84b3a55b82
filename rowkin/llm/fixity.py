"""Merkle fixity audit of WARC replicas.

Records are hashed; records whose start offset lies in the same 64 KiB range of their archive form
a leaf, which hashes their offsets, lengths, numbers and digests, and sixteen neighbouring nodes form the node above. Two replicas are compared by the roots
of each archive first; below a root that differs only the branches that differ are followed, down
to the leaves, and only there records are compared one by one.

A node is keyed by archive, level and number, so an archive of any size is spread over many tasks;
a group never holds more than sixteen nodes or the records that start within one range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowkin.session import stage

RANGE_BYTES = 65_536
FANOUT = 16
MIN_LEVELS = 3  # roots of archives up to 256 MiB don't depend on the other archives' sizes
PAGES_PER_ARCHIVE = 1_000


def warc_record(url: str, payload: str) -> F.Column:
    """A response record as text: header, blank line, payload, two line ends. Nulls are empty."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def page_records(pages: DataFrame) -> DataFrame:
    """(archive, offset, length, record_id, digest): pages laid out in archives of a thousand ids.

    Only sizes and digests are moved. Pages without an id go to archive ``none``; repeated ids stay
    separate records in the order of their digests. Offsets are sums in two steps, over parts of
    an id by the first digits of the digest and inside a part, and equal records are counted
    before: neither a repeated id nor an equal page brings its rows into one task.
    """
    record = warc_record("url", "html")
    hashed = pages.select(
        F.coalesce(F.floor(F.col("page_id") / PAGES_PER_ARCHIVE).cast("string"), F.lit("none")).alias("archive"),
        F.col("page_id").alias("record_id"), F.octet_length(record).cast("bigint").alias("length"),
        F.sha2(record, 256).alias("digest"))
    counted = hashed.groupBy("archive", "record_id", "length", "digest").agg(F.count("*").alias("copies"))
    counted = stage(counted.withColumn("part", F.substring("digest", 1, 2)), "records")
    keys = ["archive", "record_id", "part"]
    earlier = Window.partitionBy("archive").orderBy("record_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy(*keys).agg(F.sum(F.col("length") * F.col("copies")).alias("size"))
    starts = parts.select(*keys, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    before = Window.partitionBy(*keys).orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    inside = counted.withColumn("inside", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)))
    same = (inside["archive"] == starts["archive"]) & (inside["part"] == starts["part"]) & inside["record_id"].eqNullSafe(starts["record_id"])
    placed = inside.join(starts.alias("s"), same).select(*[inside[c] for c in ("archive", "record_id", "length", "digest", "copies", "inside")], "s.start")
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(
        "archive", "record_id", "length", "digest",
        (F.col("start") + F.col("inside") + F.col("copy") * F.col("length")).cast("bigint").alias("offset"))


def content() -> F.Column:
    """What a record is, wherever it lies."""
    return F.concat_ws(":", F.coalesce(F.col("record_id").cast("string"), F.lit("")), "length", "digest")


def leaves(records: DataFrame) -> DataFrame:
    """(archive, level 0, node, hash) of one replica; a node is the number of an offset range.

    Place, length, number and digest of each record that starts in the range are hashed, in the
    order of the offsets.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", content().alias("content"))))
    lines = F.transform(ordered, lambda r: F.concat(r["offset"].cast("string"), F.lit(":"), r["content"]))
    return records.groupBy("archive", F.floor(F.col("offset") / RANGE_BYTES).alias("node")).agg(
        F.sha2(F.concat_ws("\n", lines), 256).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above. The number of a child is hashed too, so a missing range shows."""
    ordered = F.array_sort(F.collect_list(F.struct("node", "hash")))
    named = F.transform(ordered, lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["hash"]))
    return nodes.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("up")).agg(
        F.sha2(F.concat_ws("", named), 256).alias("hash")).withColumnRenamed("up", "node")


def height(*replicas: DataFrame) -> int:
    """Levels above the leaves so that every archive has one root, the same for all replicas."""
    last = max((r.agg(F.max("offset").alias("m")).first()["m"] or 0) for r in replicas) // RANGE_BYTES
    levels = MIN_LEVELS
    while last >= FANOUT**levels:
        levels += 1
    return levels


def tree(records: DataFrame, levels: int) -> DataFrame:
    """(archive, level, node, hash) of one replica, written once: it is read level by level."""
    nodes = [leaves(records)]
    for _ in range(levels):
        nodes.append(parents(nodes[-1]))
    tagged = [n.select("archive", F.lit(i).alias("level"), F.col("node").cast("bigint").alias("node"), "hash")
              for i, n in enumerate(nodes)]
    return stage(reduce(DataFrame.unionByName, tagged), "merkle")


def differing(left: DataFrame, right: DataFrame, level: int, within: DataFrame | None) -> DataFrame:
    """Nodes of a level that differ or exist in one replica only, below the nodes ``within``."""
    sides = []
    for name, side in (("left", left), ("right", right)):
        nodes = side.where(F.col("level") == level).select("archive", "node", F.col("hash").alias(f"{name}_hash"))
        if within is not None:
            above = within.select("archive", F.col("node").alias("up"))
            nodes = nodes.withColumn("up", F.floor(F.col("node") / FANOUT)).join(
                above, ["archive", "up"], "left_semi").drop("up")
        sides.append(nodes)
    both = sides[0].join(sides[1], ["archive", "node"], "full")
    return both.where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))


def _seen(own: DataFrame, other: DataFrame, **marks: str) -> DataFrame:
    """``own`` with marks that say whether a record of the other replica's archive has the same value in a column."""
    for mark, column in marks.items():
        theirs = other.select("archive", column).distinct().withColumn(mark, F.lit(True))
        own = own.join(theirs, ["archive", column], "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
    return own


def locate(lone: DataFrame) -> DataFrame:
    """(archive, verdict, offset, record_id, length) of records that one replica has and the other lacks.

    A record whose content the other replica has elsewhere in the archive is ``moved``. Among the
    rest, one whose place or number is taken by another content is ``altered``, else it is
    ``missing``. What only the right replica has is ``extra``, unless it is the other side of one of these.
    """
    left, right = lone.where("side = 'left'"), lone.where("side = 'right'")
    left, right = _seen(left, right, same_content="content"), _seen(right, left, same_content="content")
    moved = left.where("same_content").withColumn("verdict", F.lit("moved"))
    left, right = left.where("not same_content"), right.where("not same_content")
    marks = {"same_place": "offset", "same_id": "record_id"}
    taken = F.col("same_place") | F.col("same_id")
    lost = _seen(left, right, **marks).withColumn("verdict", F.when(taken, "altered").otherwise("missing"))
    extra = _seen(right, left, **marks).where(~taken).withColumn("verdict", F.lit("extra"))
    found = ("archive", "verdict", "offset", "record_id", "length")
    return moved.select(*found).unionByName(lost.select(*found)).unionByName(extra.select(*found))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per archive that agrees, and one per record that does not.

    Columns: archive, left_root, right_root, verdict (intact, altered, moved, missing, extra; see
    ``locate``), offset, record_id, length. Equal rows of a replica count as one. A null archive is
    ``none``, a null offset or length 0, a null digest empty. Two empty replicas give no row; an
    archive that only one replica has gives its records. Further columns are ignored.
    """
    columns = ["archive", "offset", "length", "record_id", "digest"]
    whole = [F.coalesce("archive", F.lit("none")).alias("archive"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("offset", "length")],
             "record_id", F.coalesce("digest", F.lit("")).alias("digest")]
    left, right = stage(left.select(*whole).distinct(), "left"), stage(right.select(*whole).distinct(), "right")
    levels = height(left, right)
    trees = tree(left, levels), tree(right, levels)

    roots = [t.where(F.col("level") == levels).select("archive", F.col("hash").alias(f"{name}_root"))
             for name, t in zip(("left", "right"), trees, strict=True)]
    roots = roots[0].join(roots[1], "archive", "full")
    odd = None
    for level in range(levels, -1, -1):
        odd = differing(*trees, level, odd)

    suspects = stage(odd.select("archive", "node"), "suspects")
    sides = [side.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES)).join(suspects, ["archive", "node"], "left_semi")
             .select(*columns, content().alias("content"), F.lit(name).alias("side"))
             for name, side in (("left", left), ("right", right))]
    lone = sides[0].unionByName(sides[1]).groupBy(*columns, "content").agg(
        F.count("*").alias("replicas"), F.min("side").alias("side")).where("replicas = 1")
    located = locate(stage(lone, "lone"))
    damaged = roots.where(~F.col("left_root").eqNullSafe(F.col("right_root"))).join(located, "archive")
    intact = roots.where(F.col("left_root") == F.col("right_root")).withColumns({
        "verdict": F.lit("intact"), "offset": F.lit(None).cast("bigint"),
        "record_id": F.lit(None).cast(left.schema["record_id"].dataType), "length": F.lit(None).cast("bigint")})
    return damaged.unionByName(intact).select("archive", "left_root", "right_root", "verdict", "offset", "record_id", "length")
