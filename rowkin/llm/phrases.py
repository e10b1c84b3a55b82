"""Phrase collocations from truncated suffix subtrees, after vertical partitioning by memory budget.

Only words that are frequent enough can stand in a phrase, so they alone get numbers; all others end a
suffix as the end of a piece does. A suffix is truncated to ``DEPTH`` words.

Suffixes are partitioned by their prefixes as elastic-range construction of suffix trees does it: the
first words in a row, as far as their suffixes fill a memory budget, make a group; a word with more
suffixes than that is a prefix too frequent and is extended to the whole truncated suffix, whose hash
deals it among as many groups as it fills. Each group is built independently: its suffixes are sorted,
equal ones become a leaf, and a phrase's count is the total of the leaves below its node. Nodes above
a leaf of an extended prefix have parts in several groups, which are summed up.

Documents are read once, in units of some megabytes per language: a unit is kept as numbers of its own
distinct words, each distinct word is sent once and comes back with its number and group, and the unit
sends each group its distinct suffixes with their counts. So what is shuffled is combined before, no
word or language makes a task heavy, and whatever is read twice was written first.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.session import stage

DEPTH = 3  # words of a phrase at most
LEAST = 10  # occurrences of a phrase
COVERED = 50  # per cent of a phrase's occurrences inside one longer phrase from which on it is left out
MILLION = 1_000_000

UNIT_BYTES = 6 << 20
HELD_BYTES = 14 << 20  # texts of all languages that wait for their unit to fill, per task
GROUP_SUFFIXES = 1_000_000  # the memory budget of a group; sorting a suffix takes some hundred bytes

# What ends a piece. Inside pieces, words are divided by spaces and tabs.
ENDS = b".,;:!?\n\x0b\x0c\r"
_BREAK = b"\xff"  # no part of UTF-8
_ENDED = bytes.maketrans(ENDS, b"\n" * len(ENDS))


def words_and_breaks(texts: list[bytes]) -> list[bytes]:
    """The words of all texts with A-Z lowered, and a break after each piece."""
    text = b"\n".join(texts).lower().translate(_ENDED)
    return text.replace(b"\n", b" " + _BREAK + b" ").split()


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers below 2**32, byte by byte so that sorted and small ones compress."""
    planes = np.stack([c.astype("<u4") for c in columns]).view(np.uint8).reshape(len(columns), -1, 4)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes())


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 4, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(columns, -1)


def _unit(lang: str, texts: list[bytes], number: Iterator[int]) -> Iterator[dict]:
    stream = np.array(words_and_breaks(texts) + [_BREAK], object)
    codes, distinct = pd.factorize(stream)
    at = int(np.flatnonzero(distinct == _BREAK)[0])
    counts = np.bincount(codes, minlength=len(distinct))
    keep = np.arange(len(distinct)) != at
    renamed = np.where(keep, np.cumsum(keep), 0)  # 0 is a break, words are numbered from 1 on
    if keep.any():
        task = TaskContext.get()
        yield {"unit": f"{task.partitionId()}-{next(number)}", "lang": lang, "words": b" ".join(distinct[keep]).decode("utf-8"),
               "counts": counts[keep], "stream": _packed(renamed[codes])}


def units(docs: DataFrame, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """(unit, lang, words, counts, stream): distinct words in a row with their counts, and the texts as numbers of them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        number = itertools.count()
        kinds = pa.schema([("unit", pa.string()), ("lang", pa.string()), ("words", pa.string()), ("counts", pa.list_(pa.int64())), ("stream", pa.binary())])

        def sent(lang: str) -> Iterator[pa.RecordBatch]:
            size.pop(lang)
            for row in _unit(lang, held.pop(lang), number):
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema=kinds)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                if size[lang] >= unit_bytes:
                    yield from sent(lang)
                elif sum(size.values()) >= max(HELD_BYTES, unit_bytes):
                    yield from sent(max(size, key=size.get))
        for lang in list(held):
            yield from sent(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    return rows.mapInArrow(work, "unit string, lang string, words string, counts array<long>, stream binary")


def _words(cut: DataFrame) -> DataFrame:
    """(unit, lang, at, word, n): each distinct word of each unit."""
    zipped = F.arrays_zip(F.split("words", " ").alias("word"), F.col("counts").alias("n"))
    return cut.select("unit", "lang", F.posexplode(zipped).alias("at", "w")).select("unit", "lang", "at", F.col("w.word").alias("word"), F.col("w.n").alias("n"))


def numbered_words(cut: DataFrame, least: int, budget: int) -> DataFrame:
    """(lang, word, n, id, grp, parts): frequent words, numbered from 1 on, and the group of their suffixes.

    ``parts`` is into how many groups the suffixes of a word are dealt. The driver gets two numbers
    per partition of the shuffle.
    """
    counted = _words(cut).groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = stage(counted.withColumns({"part": F.spark_partition_id(), "row": row}), "phrase-words")
    sizes = kept.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).orderBy("part").collect()
    before, rows, suffixes = [], 1, 0
    for part in sizes:
        before.append((part["part"], rows, suffixes))
        rows, suffixes = rows + part["rows"], suffixes + part["n"]
    if rows >= 1 << 31:
        raise ValueError("more than 2**31 frequent words")
    offsets = kept.sparkSession.createDataFrame(before, "part int, rows_before long, suffixes_before long")
    running = F.sum("n").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    placed = kept.join(F.broadcast(offsets), "part").withColumn("filled", F.col("suffixes_before") + F.coalesce(running, F.lit(0)))
    return placed.select("lang", "word", "n", (F.col("rows_before") + F.col("row")).alias("id"), F.floor(F.col("filled") / budget).alias("grp"),
                         F.ceil(F.col("n") / budget).cast("int").alias("parts"))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _suffixes(unit: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """(grp, part, suffixes): the unit's distinct suffixes of two and three words and their counts, by group."""
    out: dict[str, list] = {"grp": [], "part": [], "suffixes": []}
    if unit.empty or found.empty:
        return pd.DataFrame(out)
    stream = _unpacked(unit["stream"].iloc[0], 1)[0]
    size = int(stream.max(initial=0)) + 1
    numbers, groups, parts = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.ones(size, np.int64)
    place = found["at"].to_numpy() + 1
    numbers[place] = found["id"].to_numpy(np.uint64)
    groups[place], parts[place] = found["grp"], found["parts"]
    first = stream[:-1]
    second, third = numbers[stream[1:]], numbers[np.r_[stream[2:], 0]]
    whole = (numbers[first] > 0) & (second > 0)
    first, second, third = first[whole], second[whole], third[whole]
    if not len(first):
        return pd.DataFrame(out)
    left, right = numbers[first] << np.uint64(32) | second, third
    spread = ((second * _MIX ^ third) * _MIX >> np.uint64(33)).astype(np.int64) % parts[first]
    order = np.lexsort((right, left, spread, groups[first]))
    left, right, group, spread = left[order], right[order], groups[first][order], spread[order]
    starts = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    counts = np.diff(np.r_[starts, len(left)])
    left, right, group, spread = left[starts], right[starts], group[starts], spread[starts]
    cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (spread[1:] != spread[:-1])])
    for a, b in zip(cuts, np.r_[cuts[1:], len(left)], strict=True):
        out["grp"].append(group[a])
        out["part"].append(spread[a])
        out["suffixes"].append(_packed(left[a:b] >> np.uint64(32), left[a:b] & np.uint64(0xFFFFFFFF), right[a:b], counts[a:b]))
    return pd.DataFrame(out)


def _totals(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Equal neighbours of sorted rows as one, with the total of their counts."""
    if not len(counts):
        return keys, counts
    starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    return tuple(k[starts] for k in keys), np.add.reduceat(counts, starts)


def _subtree(least: int):
    def subtree(group: pd.DataFrame) -> pd.DataFrame:
        first, second, third, counts = np.concatenate([_unpacked(s, 4) for s in group["suffixes"]], axis=1)
        order = np.lexsort((third, second, first))
        leaves, counts = _totals((first[order], second[order], third[order]), counts[order].astype(np.int64))
        nodes, inner = _totals(leaves[:2], counts)
        # A leaf is whole here; a node may have parts in other groups.
        deep = (leaves[2] > 0) & (counts >= least)
        return pd.concat([pd.DataFrame({"w1": nodes[0], "w2": nodes[1], "w3": 0, "a": inner}),
                          pd.DataFrame({"w1": leaves[0][deep], "w2": leaves[1][deep], "w3": leaves[2][deep], "a": counts[deep]})])

    return subtree


def phrase_counts(cut: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(w1, w2, w3, a): phrases of two (w3 = 0) and three words, by number, with at least ``least`` occurrences."""
    found = _words(cut).join(words, ["lang", "word"]).select("unit", "at", "id", "grp", "parts")
    sent = cut.select(F.col("unit").alias("of"), "stream").groupBy("of").cogroup(found.groupBy("unit")).applyInPandas(_suffixes, "grp long, part long, suffixes binary")
    nodes = sent.groupBy("grp", "part").applyInPandas(_subtree(least), "w1 long, w2 long, w3 long, a long")
    return nodes.groupBy("w1", "w2", "w3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _score(left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits: exact up to 10**16 occurrences."""
    return F.expr(f"({MILLION} * (cast(a as decimal(16,0)) * cast(a as decimal(16,0)))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def _scored(phrases: DataFrame, words: DataFrame, covered: int) -> DataFrame:
    """(w1, w2, w3, lang, a, l, r, score) of the phrases that no longer one covers, at the lowest-scoring cut."""
    one = lambda name: words.select(F.col("id").alias(f"w{name}"), F.col("n").alias(f"n{name}"))
    two = phrases.where("w3 = 0").drop("w3")
    three = phrases.where("w3 > 0")
    inside = three.select(F.col("a").alias("longer"), F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longest = inside.groupBy("p.w1", "p.w2").agg(F.max("longer").alias("longer"))
    pairs = two.join(longest, ["w1", "w2"], "left").where(f"longer IS NULL OR 100 * longer < {covered} * a").drop("longer")
    pairs = pairs.join(one(1), "w1").join(one(2), "w2")
    pairs = pairs.select("w1", "w2", F.lit(0).cast("long").alias("w3"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), _score("n1", "n2").alias("score"))
    begun = two.withColumnRenamed("a", "n12")
    ended = two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("n23"))
    triples = three.join(begun, ["w1", "w2"]).join(ended, ["w2", "w3"]).join(one(1), "w1").join(one(3), "w3")
    triples = triples.withColumns({"early": _score("n1", "n23"), "late": _score("n12", "n3")})
    early = F.col("early") <= F.col("late")
    triples = triples.select("w1", "w2", "w3", "a", F.when(early, F.col("n1")).otherwise(F.col("n12")).alias("l"),
                             F.when(early, F.col("n23")).otherwise(F.col("n3")).alias("r"), F.least("early", "late").alias("score"))
    return pairs.unionByName(triples)


def collocations(docs: DataFrame, top: int, least: int = LEAST, covered: int = COVERED,
                 unit_bytes: int = UNIT_BYTES, budget: int = GROUP_SUFFIXES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two and three words.

    Of ``docs``, lang and text are read; a null language is ``und``, a null text has no words, rows
    count one by one. ``a``, ``l`` and ``r`` are the occurrences of the phrase and of its parts at the
    lowest-scoring cut (of equal ones the first), ``n`` all words of the language. Phrases are ranked
    by score and ``a``, both falling, then by their bytes. Languages without such a phrase have no row.
    """
    cut = stage(units(docs, unit_bytes), "phrase-units")
    words = stage(numbered_words(cut, least, budget), "phrase-numbers")
    phrases = stage(phrase_counts(cut, words, least), "phrases")
    name = lambda i: words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"))
    scored = _scored(phrases, words, covered).join(words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("word1")), "w1")
    # Names are looked up for those only that can be among the first, ties at the end included.
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    first = scored.withColumn("rank", place).where(F.col("rank") <= top)
    named = first.join(name(2), "w2").join(name(3), "w3", "left").withColumn("phrase", F.concat_ws(" ", "word1", "word2", "word3"))
    total = cut.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = named.withColumn("rank", rank).where(F.col("rank") <= top).join(F.broadcast(total), "lang", "left")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
