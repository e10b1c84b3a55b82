"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine. On a cluster, bring your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rowkin")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("spark.driver.memory", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session on one machine may fall back to a folder of its own: executors on other
    machines could not read it, and it would be lost together with its machine.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="rowkin-")
    spark.conf.set(CHECKPOINT_DIR, own)
    return own


def task_count(df: DataFrame) -> int:
    """As many tasks as a shuffle has, and no fewer than there are cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly over as many tasks as a shuffle has.

    A small file, or a file of one row group, is read by one task, which would also do all the work
    that follows on its rows. Rows are dealt in turn, so no value of a key brings them together.
    """
    return df.repartition(task_count(df))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and go on from the written table.

    This cuts the lineage, survives the loss of executors, makes a result that is read several
    times cost one computation, and gives the planner real table sizes.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

