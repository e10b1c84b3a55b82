"""Units: runs of documents whose distinct items are exchanged once instead of once per occurrence.

A pass over the documents cuts each partition into units of some megabytes of text. A unit sends
its distinct items (words, or pairs of words), dealt into blocks by hash. A block meets the items of
all units and answers each unit. Then units and answers meet again by unit number. Documents are
small beside a unit and items are hashed, so no hot source, document or word makes a task heavy.

The documents are read once for the items and once for the unit's text, so both passes must cut
alike. That holds for plans without a shuffle: the same scan gives the same rows in the same order,
also after an executor was lost. Anything else is written first.
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.session import stage

UNIT_CHARS = 10_000_000


def repeatable(docs: DataFrame) -> DataFrame:
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return stage(docs, "documents") if "Exchange" in plan else docs


def numbered(docs: DataFrame, fold: Column) -> DataFrame:
    """(part, fold, doc_id as text, text): what both passes read."""
    return docs.select(F.spark_partition_id().alias("part"), fold.cast("int").alias("fold"), F.col("doc_id").cast("string").alias("doc_id"), "text")


def cut(batches: Iterator[pd.DataFrame], chars: int) -> Iterator[tuple[int, int, int, list, list]]:
    """(part, fold, number, ids, texts) of each unit. A fold's units don't depend on other folds' rows."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for part, fold, doc_id, text in zip(batch["part"], batch["fold"], batch["doc_id"], batch["text"], strict=True):
            unit = held.setdefault((part, fold), [0, 0, [], []])
            unit[2].append(doc_id)
            unit[3].append(text or "")
            unit[1] += len(text or "") + 1
            if unit[1] >= chars:
                yield part, fold, unit[0], unit[2], unit[3]
                held[part, fold] = [unit[0] + 1, 0, [], []]
    for (part, fold), unit in held.items():
        if unit[2]:
            yield part, fold, unit[0], unit[2], unit[3]


def items(rows: DataFrame, send: Callable[[list[str]], Iterator[dict]], schema: str, chars: int = UNIT_CHARS) -> DataFrame:
    """Rows of ``send(texts)`` of each unit, with its number (part, fold, unit)."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, fold, unit, _, texts in cut(batches, chars):
            out = list(send(texts))
            if out:
                yield pd.DataFrame(out).assign(part=part, fold=fold, unit=unit)
        give_back()

    return rows.mapInPandas(work, f"part int, fold int, unit int, {schema}")


def packs(rows: DataFrame, chars: int = UNIT_CHARS) -> DataFrame:
    """(part, fold, unit, payload): ids and texts of each unit, compressed."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for part, fold, unit, ids, texts in cut(batches, chars):
            yield pd.DataFrame([{"part": part, "fold": fold, "unit": unit, "payload": press.compress(pickle.dumps((ids, texts)))}])
        give_back()

    return rows.mapInPandas(work, "part int, fold int, unit int, payload binary")


def give_back() -> None:
    """Return freed memory to the system. Python workers outlive their tasks, and what they hold counts for the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def unpack(payload: bytes) -> tuple[list, list[str]]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned numbers byte by byte: all first bytes, all second bytes and so on. Compresses well when sorted."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


def blocks_for(docs: DataFrame) -> int:
    """As many blocks as the session has shuffle partitions, the setting that follows the data's size."""
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
