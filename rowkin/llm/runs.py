"""Periodic runs of words by seed and extension along diagonals.

A run of period q is a stretch of at least ``LEAST`` words and ``TURNS`` periods in which words q apart
are identical, q being the smallest such number, and that no neighbouring word extends. On the
diagonal of lag q (a text against itself moved by q words) it is a stretch of matches of at least
(TURNS - 1) * q words.

Seeds are k-grams. Lags are taken by octaves: for lags from 2**j up to 2**(j + 1) the k-grams have
2**(j + 1) words, at most what a run of such a period is guaranteed to overlap with itself. As k exceeds
the lag and q is the smallest period, a k-gram of a run occurs next exactly q words on, so the pairs of
an occurrence with the next one in the same document hold a seed of each run; there are fewer of them
than words, however often a k-gram is repeated.

A seed is extended to both sides along its diagonal. A table of how far each lag is covered keeps later
seeds of the same stretch from being extended again.

The k-grams of an octave are named from those of the octave before by sorting pairs of names, for many
documents at once; words that are alone with their k-gram drop out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from rowkin.llm.tables import text_slices

LEAST = 6  # words
TURNS = 4  # periods

Runs = list[tuple[int, int, int]]  # start, length, period


def seeds(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of each k-gram whose next occurrence in its document is a lag of the octave away.

    ``codes`` names the words of all documents in a row, ``ends`` is the end of each word's document.
    """
    places, lags = [], []
    names = codes.astype(np.int64)  # of the k-gram at each place, from 0 on
    at = np.arange(len(codes))  # places that are not alone with their k-gram and have a whole one
    width = 1
    while len(at):
        # k-grams of the double width: the names here and ``width`` words on.
        at = at[at + 2 * width <= ends[at]]
        key = names[at] * (names.max(initial=0) + 1) + names[at + width]
        order = np.lexsort((at, ends[at], key))
        key, at = key[order], at[order]
        same = (key[1:] == key[:-1]) & (ends[at[1:]] == ends[at[:-1]])
        lag = at[1:] - at[:-1]
        hit = same & (lag >= width) & (lag < 2 * width)
        places.append(at[:-1][hit])
        lags.append(lag[hit])
        first = np.r_[True, ~same] if len(at) else np.empty(0, bool)
        group = np.cumsum(first) - 1
        names = np.zeros(len(codes), np.int64)  # name 0: alone, which no seed has
        size = np.bincount(group) if len(at) else np.empty(0, int)
        shared = size[group] > 1 if len(at) else np.empty(0, bool)
        names[at[shared]] = group[shared] + 1
        at = np.sort(at[shared])
        width *= 2
        at = at[at + 2 * width <= ends[at]]
        at = at[names[at + width] > 0]
    return np.concatenate([np.empty(0, np.int64), *places]), np.concatenate([np.empty(0, np.int64), *lags])


def _matched(words: np.ndarray, left: int, right: int, limit: int, step: int) -> int:
    """How many words from the two places on agree, going up (step 1) or down (step -1), at most ``limit``."""
    done, size = 0, 16
    while done < limit:
        n = min(size, limit - done)
        a, b = left + step * done, right + step * done
        same = words[a: a + n] == words[b: b + n] if step > 0 else words[a - n + 1: a + 1][::-1] == words[b - n + 1: b + 1][::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done += n
        size *= 4
    return done


def runs_of(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, Runs]:
    """The runs of each document that has any, by the number of the document, sorted by start and period.

    Document d has the words ``codes[starts[d]:ends[d]]``.
    """
    end_of = np.repeat(ends, ends - starts)
    place, lag = seeds(codes, end_of)
    order = np.lexsort((place, lag))
    found: dict[int, Runs] = {}
    document = np.searchsorted(ends, place[order], side="right")
    covered: dict[int, int] = {}
    for i, q, d in zip(place[order].tolist(), lag[order].tolist(), document.tolist(), strict=True):
        if i < covered.get(q, 0):
            continue
        first, end = int(starts[d]), int(ends[d])
        up = _matched(codes, i, i + q, end - i - q, 1)
        down = _matched(codes, i - 1, i + q - 1, i - first, -1)
        covered[q] = i + up
        length = down + up + q
        if length >= max(LEAST, TURNS * q):
            found.setdefault(d, []).append((i - down - first, length, q))
    for runs in found.values():
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: Runs) -> str:
    """The words that stand in no run after its first period, joined by single spaces."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = (np.cumsum(drop[:-1]) == 0).tolist()
    return b" ".join([w for w, keep in zip(words, kept, strict=True) if keep]).decode("utf-8")


def detect(texts: list[str | None]) -> Iterator[tuple[int, Runs, str]]:
    """(words, runs, collapsed text) of each text."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    ends = np.cumsum(counts)
    every = np.empty(int(counts.sum()), object)
    every[:] = [w for words in split for w in words]
    codes = pd.factorize(every)[0].astype(np.int64) if len(every) else np.empty(0, np.int64)
    found = runs_of(codes, ends - counts, ends)
    for d, words in enumerate(split):
        runs = found.get(d, [])
        yield len(words), runs, collapsed(words, runs)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) per row of ``docs``.

    Of ``docs``, doc_id and text are read. Starts are word numbers from 0 on; runs are sorted by start,
    then period. ``collapsed`` is the text without the words that repeat a run's first period. A null
    text has no words, no runs and an empty collapsed text. Ids may be null or repeat: rows are looked
    at one by one. A text is looked at as a whole, in memory that grows with its number of words.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            n, runs, rest = zip(*detect(texts), strict=True) if texts else ((), (), ())
            fields = [[[run[i] for run in of] for of in runs] for i in range(3)]
            offsets = pa.array(np.r_[0, np.cumsum([len(of) for of in runs])].astype(np.int32))
            values = pa.StructArray.from_arrays([pa.array([x for of in field for x in of], pa.int64()) for field in fields], fields=list(RUN))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(rest, pa.string())],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
