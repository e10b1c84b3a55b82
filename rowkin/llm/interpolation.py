"""Language-model scores by deleted interpolation.

A bigram model over words: the probability of a word after its predecessor mixes the maximum
likelihood of the pair, that of the word alone, and an equal share for every word and one unknown.
The weights depend on how often the predecessor was seen, in buckets of powers of two. They are
learned by expectation maximisation: counts from a part of the training documents give the
estimates, the other part, which the counts were deleted of, gives the events. Scores then use the
counts of both parts.

Words and pairs are counted through units of documents (see ``units``), which are written once: a
unit sends each distinct word and pair once, as a hash with its count; a block sums them up and answers
with global counts. The number of blocks follows that of the units, so a block's size is bounded.
For the weights, events are summed up in a table whose size depends on its resolution alone
(quarters of a power of two), which is what the driver gets. Every training token is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.llm import units
from rowkin.llm.shingles import mixed
from rowkin.llm.tables import small_batches
from rowkin.session import stage

LEARNED, DELETED, HELD_OUT = 0, 1, 2  # folds: counts, events for the weights, scored only
RESOLUTION = 4  # steps per power of two in the table of events
ROUNDS = 50
LEAST_SHARE = 1e-6  # of the equal share, so that no word is impossible

_END = np.uint64(0x243F6A8885A308D3)
_STEP = np.uint64(0x9E3779B97F4A7C15)
UNIT_CHARS = 4_000_000  # a token takes some 150 bytes of a worker's memory while its unit is looked at
BLOCK_CHARS = 8_000_000  # of text per block, so that a block does not grow with the input; it gets some 60 bytes per word
_PAIR_BYTES = 6  # of a pair's hash, beside the number of its block


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, tokens per text): words with A-Z lowered, then one end token."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(w) + 1 for w in split], np.int64)
    codes, words = pd.factorize(np.array([w for ws in split for w in (*ws, b"")], object))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) if w else int(_END) for w in words], np.uint64)
    return hashes[codes] if len(codes) else np.empty(0, np.uint64), counts


class Unit:
    """The distinct words and pairs of a unit, sorted by block and hash, and where they occur."""

    def __init__(self, texts: list[str], blocks: int):
        self.words, self.counts = tokens(texts)
        starts = np.cumsum(self.counts) - self.counts
        before = np.r_[_END, self.words[:-1]]
        before[starts] = _END  # a text begins after an end
        pair = mixed(before * _STEP + self.words)
        n = np.uint64(blocks)
        self.word, self.word_at, self.word_n = np.unique(self.words, return_inverse=True, return_counts=True)
        order = np.argsort(self.word % n, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.word, self.word_n, self.word_at = self.word[order], self.word_n[order], back[self.word_at]
        key = ((pair % n) << np.uint64(8 * _PAIR_BYTES)) | (pair >> np.uint64(64 - 8 * _PAIR_BYTES))
        self.pair, self.pair_at, self.pair_n = np.unique(key, return_inverse=True, return_counts=True)
        self.before_at = np.r_[0, self.word_at[:-1]]
        end = np.flatnonzero(self.word == _END)
        self.before_at[starts] = end[0] if len(end) else 0
        self.starts = starts
        self.word_cuts = np.searchsorted(self.word % n, np.arange(blocks + 1, dtype=np.uint64))
        self.pair_cuts = np.searchsorted(self.pair >> np.uint64(8 * _PAIR_BYTES), np.arange(blocks + 1, dtype=np.uint64))

    def sent(self) -> Iterator[dict]:
        for block in range(len(self.word_cuts) - 1):
            w, p = slice(*self.word_cuts[block: block + 2]), slice(*self.pair_cuts[block: block + 2])
            if w.start < w.stop or p.start < p.stop:
                yield {"block": block, "words": units.planes(self.word[w], 8), "word_n": self.word_n[w].astype("<u4").tobytes(),
                       "pairs": units.planes(self.pair[p], _PAIR_BYTES), "pair_n": self.pair_n[p].astype("<u4").tobytes()}

    def counted(self, answers: pd.DataFrame, which: str) -> tuple[np.ndarray, np.ndarray]:
        """Global counts of the unit's words and pairs, ``which`` being learned or all."""
        word, pair = np.zeros(len(self.word)), np.zeros(len(self.pair))
        asked = 0
        for block, words, pairs in zip(answers["block"], answers[f"word_{which}"], answers[f"pair_{which}"], strict=True):
            for out, cuts, data in ((word, self.word_cuts, words), (pair, self.pair_cuts, pairs)):
                got = units.from_planes(data, 5)
                if len(got) != cuts[block + 1] - cuts[block]:
                    raise RuntimeError("a block gave no answer, or one of another size")
                out[cuts[block]: cuts[block + 1]] = got
                asked += len(got)
        if asked != len(self.word) + len(self.pair):
            raise RuntimeError("a block gave no answer, or one of another size")
        return word, pair


def _sent(blocks: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, fold, unit, payload in batch.itertuples(index=False):
                out = list(Unit(units.unpack(payload)[1], blocks).sent())
                if out:
                    yield pd.DataFrame(out).assign(part=part, fold=fold, unit=unit)

    return work


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    out = {"part": group["part"], "fold": group["fold"], "unit": group["unit"], "block": group["block"]}
    fold = group["fold"].to_numpy()
    totals = {}
    for kind, width in (("word", 8), ("pair", _PAIR_BYTES)):
        keys = [units.from_planes(k, width) for k in group[f"{kind}s"]]
        counts = np.concatenate([np.frombuffer(n, "<u4") for n in group[f"{kind}_n"]]).astype(np.float64)
        sizes = np.array([len(k) for k in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        of = np.repeat(fold, sizes)
        learned = np.bincount(at, np.where(of == LEARNED, counts, 0), len(distinct))
        every = np.bincount(at, np.where(of != HELD_OUT, counts, 0), len(distinct))
        cuts = np.cumsum(sizes)[:-1]
        for name, values in (("learned", learned), ("all", every)):
            out[f"{kind}_{name}"] = [units.planes(v.astype(np.uint64), 5) for v in np.split(values[at], cuts)]
            totals[f"{kind}_{name}"] = (values.sum(), (values > 0).sum())
    rows = pd.DataFrame(out)
    # The block's own totals, once, with its first answer.
    for name in ("learned", "all"):
        rows[f"tokens_{name}"] = [int(totals[f"word_{name}"][0])] + [0] * (len(rows) - 1)
        rows[f"types_{name}"] = [int(totals[f"word_{name}"][1])] + [0] * (len(rows) - 1)
    return rows


_ANSWER = ("part int, fold int, unit int, block int, word_learned binary, word_all binary, pair_learned binary, pair_all binary, "
           "tokens_learned long, types_learned long, tokens_all long, types_all long")


def _buckets(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(context + 1)).astype(np.int64)


def _level(share: np.ndarray) -> np.ndarray:
    """Share as a step from 1 on for share 1, 0 for share 0."""
    return np.where(share > 0, 1 + np.round(-RESOLUTION * np.log2(np.where(share > 0, share, 1))), 0).astype(np.int64)


def _events(blocks: int, n_tokens: int):
    def events(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if packs.empty:
            return pd.DataFrame({"bucket": [], "pair": [], "word": [], "n": []})
        unit = Unit(units.unpack(packs["payload"].iloc[0])[1], blocks)
        word, pair = unit.counted(answers, "learned")
        context = word[unit.before_at]
        cell = np.stack((_buckets(context), _level(pair[unit.pair_at] / np.maximum(context, 1)), _level(word[unit.word_at] / max(n_tokens, 1))))
        distinct, n = np.unique(cell, axis=1, return_counts=True)
        return pd.DataFrame({"bucket": distinct[0], "pair": distinct[1], "word": distinct[2], "n": n})

    return events


def learned_weights(events: pd.DataFrame, n_types: int) -> np.ndarray:
    """buckets x (pair, word, equal share) by expectation maximisation; a bucket without events gets the overall weights."""
    def share(level: pd.Series) -> np.ndarray:
        return np.where(level > 0, 2.0 ** (-(level - 1) / RESOLUTION), 0.0)

    def maximised(rows: pd.DataFrame) -> np.ndarray:
        each = np.stack((share(rows["pair"]), share(rows["word"]), np.full(len(rows), 1 / (n_types + 1))), axis=1)
        n, weights = rows["n"].to_numpy(float), np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            parts = each * weights
            weights = (n[:, None] * parts / parts.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
            weights = np.maximum(weights, LEAST_SHARE * np.array([0, 1, 1]))
            weights /= weights.sum()
        return weights

    overall = maximised(events) if len(events) else np.array([0.4, 0.4, 0.2])
    overall = np.maximum(overall, LEAST_SHARE) / np.maximum(overall, LEAST_SHARE).sum()
    out = np.tile(overall, (64, 1))
    for bucket, rows in events.groupby("bucket"):
        out[int(bucket)] = maximised(rows)
    out[0] = np.array([0.0, out[0][1], out[0][2]]) / (out[0][1] + out[0][2])  # a predecessor never seen tells nothing
    return out


def _scores(blocks: int, n_tokens: int, n_types: int, weights: np.ndarray):
    def scores(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if packs.empty:
            return pd.DataFrame({c: [] for c in columns})
        ids, texts = units.unpack(packs["payload"].iloc[0])
        unit = Unit(texts, blocks)
        word, pair = unit.counted(answers, "all")
        own, context = word[unit.word_at], word[unit.before_at]
        mix = weights[_buckets(context)]
        share = mix[:, 0] * pair[unit.pair_at] / np.maximum(context, 1) + mix[:, 1] * own / max(n_tokens, 1) + mix[:, 2] / (n_types + 1)
        base = np.log10((own + 1) / (n_tokens + n_types + 1))
        total = lambda values: np.add.reduceat(values, unit.starts)
        return pd.DataFrame({"doc_id": ids, "held_out": packs["fold"].iloc[0] == HELD_OUT, "n_tokens": unit.counts, "n_known": total((own > 0).astype(np.int64)),
                             "train_tokens": n_tokens, "base_score": total(base), "score": total(np.log10(share))}, columns=columns)

    return scores


def score(docs: DataFrame, held_out: Column, deleted: Column, chars: int = UNIT_CHARS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    Nothing is learned from ``held_out`` documents; among the others the ``deleted`` ones give the
    events for the weights. A null text is empty and has the end token alone. Rows with equal or
    null ids are scored one by one. Without training documents every token is unknown, and
    all share what the weights leave for unknown words.
    """
    fold = F.when(held_out, HELD_OUT).when(deleted, DELETED).otherwise(LEARNED)
    spark, key = docs.sparkSession, ["part", "fold", "unit"]
    packed = stage(units.packs(units.numbered(docs, fold), chars), "units")
    blocks = max(units.blocks_for(docs), packed.count() * chars // BLOCK_CHARS)
    with small_batches(spark, 4):  # a row is a unit
        asked = packed.mapInPandas(_sent(blocks), "block int, words binary, word_n binary, pairs binary, pair_n binary, part int, fold int, unit int")
        answers = stage(asked.groupBy("block").applyInPandas(_answer, _ANSWER), "counts")
    whole = answers.agg(*[F.sum(f"{a}_{b}").alias(f"{a}_{b}") for a in ("tokens", "types") for b in ("learned", "all")]).first()
    n_learned, n_tokens, n_types = (whole[c] or 0 for c in ("tokens_learned", "tokens_all", "types_all"))

    events = packed.where(F.col("fold") == DELETED).groupBy(*key).cogroup(answers.where(F.col("fold") == DELETED).groupBy(*key)).applyInPandas(
        _events(blocks, n_learned), "bucket int, pair int, word int, n long").groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).toPandas()
    weights = learned_weights(events, whole["types_learned"] or 0)
    scored = packed.groupBy(*key).cogroup(answers.groupBy(*key)).applyInPandas(
        _scores(blocks, n_tokens, n_types, weights),
        "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
