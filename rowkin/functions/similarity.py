"""Agreement codes and token-set similarity of two texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD_BITS = 64


def agreement(a: Column, b: Column) -> Column:
    """1 = both present and equal, 0 = one is missing, -1 = both present and different."""
    return F.when(a.isNull() | b.isNull(), 0).when(a == b, 1).otherwise(-1)


def _lcs_batch(a: list[str], b: list[str]) -> np.ndarray:
    """LCS length of many short text pairs at once; one 64-bit word per pair.

    Bit-parallel LCS (Hyyrö 2004): each step consumes one character of every ``b``.
    """
    rows = np.arange(len(a))
    texts_a, texts_b = np.array(a, dtype=np.str_), np.array(b, dtype=np.str_)
    len_a, len_b = np.char.str_len(texts_a), np.char.str_len(texts_b)
    codes_a, codes_b = (t.view(np.uint32).reshape(len(rows), -1) for t in (texts_a, texts_b))
    # A number for each character of the ``a`` side; those that only ``b`` has share the number after the last.
    seen = np.zeros(max(int(codes_a.max()), int(codes_b.max())) + 1, dtype=bool)
    seen[codes_a.ravel()] = True
    symbols = np.where(seen, np.cumsum(seen) - 1, np.count_nonzero(seen))
    symbol_a, symbol_b = symbols[codes_a], symbols[codes_b]

    where = np.zeros((len(rows), np.count_nonzero(seen) + 1), dtype=np.uint64)
    for i in range(codes_a.shape[1]):
        live = np.flatnonzero(i < len_a)
        where[live, symbol_a[live, i]] |= np.uint64(1 << i)

    unmatched = np.full(len(a), np.uint64(2**64 - 1))
    for j in range(codes_b.shape[1]):
        hits = np.where(j < len_b, where[rows, symbol_b[:, j]], np.uint64(0))
        common = unmatched & hits
        unmatched = (unmatched + common) | (unmatched - common)
    used = np.array([(1 << n) - 1 for n in range(_WORD_BITS + 1)], dtype=np.uint64)[len_a]
    return np.bitwise_count(~unmatched & used).astype(np.int32)


def _lcs_long(a: str, b: str) -> int:
    """The same recurrence on one pair, in a whole number as long as ``a``."""
    where: dict[str, int] = {}
    for i, char in enumerate(a):
        where[char] = where.get(char, 0) | (1 << i)
    used = (1 << len(a)) - 1
    unmatched = used
    for char in b:
        common = unmatched & where.get(char, 0)
        unmatched = ((unmatched + common) | (unmatched - common)) & used
    return len(a) - unmatched.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence; 0 when a side is empty or NULL."""
    out = np.zeros(len(a), dtype=np.int32)
    size_a = a.str.len().fillna(0).to_numpy(dtype=np.int64)
    size_b = b.str.len().fillna(0).to_numpy(dtype=np.int64)
    both = (size_a > 0) & (size_b > 0)
    short = np.flatnonzero(both & (size_a <= _WORD_BITS) & (size_b <= _WORD_BITS))
    if len(short):
        out[short] = _lcs_batch(a.iloc[short].tolist(), b.iloc[short].tolist())
    for i in np.flatnonzero(both & ((size_a > _WORD_BITS) | (size_b > _WORD_BITS))):
        out[i] = _lcs_long(a.iloc[i], b.iloc[i])
    return pd.Series(out)


# Marked as not deterministic so that the optimizer never repeats it for a filter on its result.
lcs_length = lcs_length.asNondeterministic()


def with_token_set_similarity(df: DataFrame, name: str, a: Column, b: Column) -> DataFrame:
    """Add ``name``: similarity in [0, 1] of two texts as sets of words; 0 when one is missing.

    With I the shared words, A and B each side's other words (sorted, joined by blanks): 1 when
    words are shared and a side has no others, else the best normalised insert/delete similarity
    among (I A, I B), (I, I A) and (I, I B). Only the first needs the two rests compared.
    """
    words_a = F.array_remove(F.array_distinct(F.split(a, " ")), "")
    words_b = F.array_remove(F.array_distinct(F.split(b, " ")), "")

    def joined(words: Column) -> Column:
        return F.array_join(F.sort_array(words), " ")

    parts = df.select(
        "*",
        joined(F.array_except(words_a, words_b)).alias("_only_a"),
        joined(F.array_except(words_b, words_a)).alias("_only_b"),
        F.length(F.array_join(F.array_intersect(words_a, words_b), " ")).alias("_shared"),
    )
    compared = parts.select("*", lcs_length(F.col("_only_a"), F.col("_only_b")).alias("_common"))

    len_a, len_b, shared = F.length("_only_a"), F.length("_only_b"), F.col("_shared")
    gap = F.when(shared > 0, 1).otherwise(0)
    with_a, with_b = shared + gap + len_a, shared + gap + len_b

    def ratio(distance: Column, total: Column) -> Column:
        return (F.lit(100.0) - F.lit(100.0) * distance / F.greatest(total, F.lit(1))) / F.lit(100.0)

    rest = ratio(len_a + len_b - 2 * F.col("_common"), with_a + with_b)
    against_shared = F.greatest(ratio(gap + len_a, shared + with_a), ratio(gap + len_b, shared + with_b))
    empty_a, empty_b = len_a == 0, len_b == 0
    similarity = (
        F.when(shared.isNull() | ((shared == 0) & (empty_a | empty_b)), 0.0)
        .when((shared > 0) & (empty_a | empty_b), 1.0)
        .when(shared > 0, F.greatest(rest, against_shared))
        .otherwise(rest)
    )
    return compared.withColumn(name, similarity).drop("_only_a", "_only_b", "_shared", "_common")
