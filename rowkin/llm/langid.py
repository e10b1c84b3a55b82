"""Language identification with error-correcting output codes.

Each language gets a codeword. For every bit a binary classifier tells the languages whose bit is 1
from the others by the letter trigrams of a text: its weight for a trigram is the log ratio of the
trigram's smoothed share in both groups, languages counting equally. A text's margin per bit is the
mean weight of its trigrams over the mean absolute margin seen in training.

Decoding is loss-weighted: the loss of a language is the logistic loss of its codeword against the
margins, each bit weighted by how often its classifier was right on training texts of that
language. The language with the smallest loss wins; when the runner-up is close, the row is
flagged as ambiguous.

Training counts trigrams of all labelled texts. Spark sums the counts; what reaches the driver is
the model, with one number per language and trigram bucket, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.llm.tables import keep_texts, text_slices

BUCKETS = 1 << 14
SMOOTHING = 0.5
MAX_EXHAUSTIVE = 5  # up to so many languages every way to split them is a bit
BITS_PER_LOG2 = 10  # with more languages, so many random bits per doubling of their number
MAX_LANGUAGES = 512
SHARPNESS = 4.0
AMBIGUOUS_SHARE = 0.5  # below this share of the winner the row is flagged
SLICE_BYTES = 1 << 20
UNDETERMINED = "und"

# ASCII but for letters becomes space; other bytes are parts of letters mostly and stay.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte trigram of all texts, number of trigrams per text). Case is dropped."""
    parts = [b" " + (t or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" " for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - int(math.log2(BUCKETS)))).astype(np.int32)
    ends = np.cumsum(lengths)
    inside = np.ones(len(bucket), bool)
    for back in (1, 2):  # trigrams that reach over the end of a text
        at = ends - back
        inside[at[(at >= 0) & (at < len(bucket))]] = False
    per_text = np.maximum(lengths - 2, 0)
    return bucket[inside], per_text


def slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The batch in parts of about a megabyte of text; a longer text is a part of its own."""
    size = batch["text"].str.len().fillna(0).cumsum()
    for _, part in batch.groupby((size // SLICE_BYTES).to_numpy(), sort=False):
        yield part


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, 1 or -1
    weights: np.ndarray  # buckets x bits
    scale: np.ndarray  # bits
    trust: np.ndarray  # languages x bits, each language's sum to 1

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """texts x bits; a text without trigrams has zeros."""
        bucket, counts = trigrams(texts)
        out = np.zeros((len(texts), self.code.shape[1]))
        has = counts > 0
        if has.any():
            starts = (np.cumsum(counts) - counts)[has]
            for bit in range(out.shape[1]):
                out[has, bit] = np.add.reduceat(self.weights[bit][bucket], starts) / counts[has] / self.scale[bit]
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its share of all languages' evidence, ambiguity flag) per text."""
        z = np.clip(SHARPNESS * margins, -30, 30)
        loss = np.logaddexp(0, -z) @ np.where(self.code > 0, self.trust, 0).T + np.logaddexp(0, z) @ np.where(self.code < 0, self.trust, 0).T
        evidence = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
        share = evidence / evidence.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = share[np.arange(len(share)), best]
        return best, top, top < AMBIGUOUS_SHARE


def codewords(languages: list[str]) -> np.ndarray:
    """languages x bits of 1 and -1: all splits for few languages, else random ones that separate every pair."""
    k = len(languages)
    if k < 2:
        return np.ones((k, 0), int)
    if k <= MAX_EXHAUSTIVE:
        bits = [[1 if (split >> i) & 1 else -1 for i in range(k)] for split in range(1, 2 ** (k - 1))]
        return np.array(bits).T
    rng = np.random.default_rng(k)
    while True:
        code = rng.choice((-1, 1), (k, math.ceil(BITS_PER_LOG2 * math.log2(k))))
        if (np.abs(code.sum(axis=0)) < k).all() and len({tuple(r) for r in code}) == k:
            return code


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch):
            for lang, rows in part.groupby("lang"):
                bucket, _ = trigrams(rows["text"].tolist())
                found = np.bincount(bucket, minlength=BUCKETS)
                totals[lang] = totals[lang] + found if lang in totals else found
    for lang, found in totals.items():
        at = np.flatnonzero(found)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": found[at]})


def _hits(model: Model):
    number = {lang: i for i, lang in enumerate(model.languages)}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, seen = np.zeros(model.code.shape), np.zeros(len(model.languages))
        size = np.zeros(model.code.shape[1])
        for batch in batches:
            for part in slices(batch):
                part = part[part["lang"].isin(number)]
                lang = part["lang"].map(number).to_numpy(int)
                margins = model.margins(part["text"].tolist())
                np.add.at(hits, lang, margins * model.code[lang] > 0)
                np.add.at(seen, lang, 1)
                size += np.abs(margins).sum(axis=0)
        for i in np.flatnonzero(seen):
            yield pd.DataFrame({"lang": int(i), "bit": np.arange(hits.shape[1]), "hits": hits[i], "seen": seen[i], "size": size / len(np.flatnonzero(seen))})

    return work


def train(labelled: DataFrame) -> Model:
    """Learn from (text, lang).

    Rows without a language or text teach nothing; no rows give a model without languages. A language
    is known if one of its texts has a trigram: texts without any, an empty one for instance, teach
    nothing, and a language that has only such texts is never predicted. The driver gets one number
    per language and bucket, for ``MAX_LANGUAGES`` languages at most; more end with an error.
    """
    rows = labelled.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInPandas(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).limit(
        MAX_LANGUAGES * BUCKETS + 1).toPandas()
    languages = sorted(counted["lang"].unique())
    if len(counted) > MAX_LANGUAGES * BUCKETS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: clean the column of languages first")
    share = np.full((len(languages), BUCKETS), SMOOTHING)
    share[counted["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy(int), counted["bucket"].to_numpy(int)] += counted["n"].to_numpy(float)
    share /= share.sum(axis=1, keepdims=True) if languages else 1
    code = codewords(languages)
    weights = np.array([np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) for c in code.T]).reshape(-1, BUCKETS)
    bits = code.shape[1]
    plain = Model(languages, code, weights.astype(np.float32), np.ones(bits), np.full(code.shape, 1 / max(bits, 1)))
    if not bits:
        return plain
    measured = rows.mapInPandas(_hits(plain), "lang int, bit int, hits double, seen double, size double").groupBy("lang", "bit").agg(
        F.sum("hits").alias("hits"), F.sum("seen").alias("seen"), F.sum("size").alias("size")).toPandas()
    trust = np.full(code.shape, 1e-6)
    trust[measured["lang"], measured["bit"]] += measured["hits"] / measured["seen"]
    total = measured.groupby("bit")["size"].sum().reindex(range(bits)).to_numpy()
    texts = measured.groupby("lang")["seen"].first().sum()
    return Model(languages, code, plain.weights, np.maximum(total / texts, 1e-9), trust / trust.sum(axis=1, keepdims=True))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def labelled(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, ambiguity flag) of each text."""
    known = np.array([bool(model.languages) and has_letter(t) for t in texts], bool)
    best, top, close = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if known.any():
        best[known], top[known], close[known] = model.decode(model.margins([t for t, k in zip(texts, known, strict=True) if k]))
    names = [*model.languages, UNDETERMINED]
    return [names[i] for i in best], top, close


def predict(texts: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` and lang_pred, score (0 to 1), ambiguous per row of ``texts``.

    A text that is null or has no letter gets ``und``, score 0. Columns to keep must not be named
    like the results.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in text_slices(batches):
            names, top, close = labelled(own, model)
            kept = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(top), pa.array(close)],
                                             names=[*keep, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema.fields)
    return texts.select(*keep, "text").mapInArrow(work, f"{schema}, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """Rows whose language was determined and is not ambiguous."""
    def sure(texts: list[str | None]) -> np.ndarray:
        names, _, close = labelled(texts, model)
        return (np.array(names, object) != UNDETERMINED) & ~close

    return keep_texts(docs, sure)


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) per row; learns from the rows that are not held out."""
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, "doc_id", "held_out")
