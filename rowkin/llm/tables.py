"""Given tables and the few helpers that the operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: words are maximal runs of anything but space and the ASCII controls 9 to 13.
# bytes.split() without an argument splits at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_slices(batches: Iterator[pa.RecordBatch], chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of the batches with about ``chars`` bytes of text each, and their texts; a longer text is a part of its own."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) // chars
        cuts = np.r_[0, np.flatnonzero(size[1:] != size[:-1]) + 1, len(size)] if len(size) else np.zeros(1, int)
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(start, stop - start)
            yield part, part.column("text").to_pylist()


def keep_texts(docs: DataFrame, judge: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text the judge accepts; it gets some texts at a time."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            yield part.filter(pa.array(judge(texts), pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


BATCH_SIZE = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Python workers get few rows at a time; for steps that run inside the block and have wide rows."""
    before = spark.conf.get(BATCH_SIZE)
    spark.conf.set(BATCH_SIZE, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SIZE, before)
