"""Repetition inside documents by suffix arrays.

The words of a text are sorted by suffixes (prefix doubling), neighbouring suffixes give the
longest common prefixes. Every word position starts a repeated substring as long as the longer of
its suffix's common prefixes with both neighbours; those of at least ``MIN_REPEAT`` words are the
maximal repeats and their parts. Their spans are united, and a document fails if the union covers
too much of it or if the longest repeat is too long.

Many documents share one array, so the work is done by whole-array operations: a document's number
is part of its words, hence suffixes of different documents have no common prefix. Suffixes that
are alone with their prefix drop out of the doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from rowkin.llm.tables import keep_texts, text_slices

MIN_REPEAT = 10  # words
# Below the limit on windows, which words in long repeats count for too: at 0.5 it could never decide.
MAX_COVERED = 0.43  # share of the words that lie in repeats
MAX_REPEAT = 90  # words of the longest repeat
MIN_WORDS = 50
MAX_WINDOWS = 50  # per cent of words in repeated three-word windows

# White space between words, and the characters that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def doubled(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of integer words (all suffixes must differ at some word or end), and the classes per level.

    Two positions have the same class at level i exactly if their next 2**i words agree. ``words``
    must be such that no two runs are equal up to the end of the array; the caller's ends ensure it.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    starts = np.r_[True, words[order][1:] != words[order][:-1]]
    group = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    classes = np.empty(n, np.int64)
    classes[order] = group
    levels, width = [classes], 1
    size = np.bincount(group, minlength=n)
    open_at = np.flatnonzero(size[classes[order]] > 1)  # places in the order whose class has others
    while len(open_at):
        who = order[open_at]
        after = who + width
        following = np.where(after < n, classes[np.minimum(after, n - 1)] + 1, 0)
        own = classes[who]
        key = own * (n + 1) + following
        sub = np.argsort(key, kind="stable")
        key, who, own = key[sub], who[sub], own[sub]
        first = np.r_[True, key[1:] != key[:-1]]
        new_group = np.r_[True, own[1:] != own[:-1]]
        place = np.arange(len(key))
        within = place - np.maximum.accumulate(np.where(new_group, place, 0))
        start = np.maximum.accumulate(np.where(first, place, 0))
        order[own + within] = who
        classes = classes.copy()
        classes[who] = own + within[start]
        levels.append(classes)
        width *= 2
        size = np.bincount(np.cumsum(first) - 1)
        alone = size[np.cumsum(first) - 1] == 1
        open_at = (own + within)[~alone]
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix in words of each suffix with the one before it in the order; the first has 0."""
    n = len(order)
    length = np.zeros(n, np.int64)
    if n < 2:
        return length
    left, right = order[:-1].copy(), order[1:].copy()
    alive = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b, got = left[alive], right[alive], np.zeros(len(alive), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        step = same * (1 << level)
        a, b, got = a + step, b + step, got + step
    length[alive + 1] = got
    return length


def repeated_spans(codes: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Per word position the length of the longest substring from here that its document repeats."""
    n = len(codes)
    # A document's words and its end get numbers that no other document has.
    _, words = np.unique(document * (int(codes.max(initial=0)) + 2) + codes + 1, return_inverse=True)
    order, levels = doubled(words.reshape(-1))
    prefix = common_prefixes(order, levels)
    repeat = np.zeros(n, np.int64)
    repeat[order] = np.maximum(prefix, np.r_[prefix[1:], 0])
    return repeat


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The figures of each text, whole."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    document = np.repeat(np.arange(len(texts)), count)
    codes = pd.factorize(np.array([w for ws in split for w in ws], object))[0].astype(np.int64) if count.sum() else np.empty(0, np.int64)
    repeat = repeated_spans(codes, document) if len(codes) else codes
    n = len(codes)

    place = np.arange(n)
    window = np.where(repeat >= 3, place + 3, 0)
    in_window = np.maximum.accumulate(window) > place if n else np.empty(0, bool)
    ends = np.where(repeat >= MIN_REPEAT, place + repeat, 0)
    covered = np.maximum.accumulate(ends) > place if n else np.empty(0, bool)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, document, repeat)

    duplicates = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        lines = [line for line in text.split("\n") if line.strip(SPACES)]
        duplicates[i] = len(lines) - len(set(lines))
    return {
        "n_words": count,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": duplicates,
        "n_repeat_words": np.bincount(document[in_window], minlength=len(texts)),
        "covered_words": np.bincount(document[covered], minlength=len(texts)),
        "longest_repeat": longest,
    }


def verdicts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The figures, base_failed and kept of each text."""
    found = measure([t or "" for t in texts])
    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_WINDOWS * found["n_words"])
    fine = (found["covered_words"] <= MAX_COVERED * found["n_words"]) & (found["longest_repeat"] <= MAX_REPEAT)
    return found | {"base_failed": failed, "kept": ~failed & fine}


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, of which doc_id and text are read; null text has no words.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    covered_words, longest_repeat. Rows are judged one by one, so ids may be null or repeat.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            found = verdicts(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(found[c]) for c in COLUMNS]], names=["doc_id", *COLUMNS])

    kinds = [f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in COLUMNS]
    return docs.select("doc_id", "text").mapInArrow(work, ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *kinds]))


def keep_clean(docs: DataFrame) -> DataFrame:
    """Rows whose text passes."""
    return keep_texts(docs, lambda texts: verdicts(texts)["kept"])
