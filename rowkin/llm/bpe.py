"""BPE encoding and decoding through a table of distinct words.

Texts are split at ASCII white space. The vocabulary's normaliser and pre-tokeniser never look
across white space, so a text's tokens are those of its words in a row. Each distinct word of the
corpus is encoded once, by the tokenizers library, in the block of its hash; every unit of
documents gets the ids of its own distinct words back and puts them at the words' positions.
A block streams through its task: it answers some units at a time and remembers a bounded number
of words, so its memory does not grow with the corpus. Words it had to forget are encoded again.

Decoding joins ids with the table of pieces, which has one row per id of the vocabulary and is
broadcast for that reason. Encoding a corpus and decoding it again decodes each distinct word of
a unit once; ``decode`` does the same for any table of ids.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.llm import units

WORDS_AT_ONCE = 20_000
REMEMBERED = 400_000  # words whose ids a block keeps; some 150 bytes each
ASKED_AT_ONCE = 64  # units that a block answers at a time
UNIT_CHARS = 8_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    if loaded.decoder is not None:
        raise ValueError("only vocabularies without a decoder are supported: their pieces are joined by spaces")
    return loaded


@lru_cache(maxsize=4)
def piece_list(path: str) -> list[str]:
    loaded = tokenizer(path)
    return [loaded.id_to_token(i) or "" for i in range(loaded.get_vocab_size(with_added_tokens=True))]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the vocabulary."""
    return spark.createDataFrame(list(enumerate(piece_list(path))), "id int, piece string")


def encoded(words: list[str], path: str) -> list[list[int]]:
    loaded, out = tokenizer(path), []
    for start in range(0, len(words), WORDS_AT_ONCE):
        out += [e.ids for e in loaded.encode_batch(words[start: start + WORDS_AT_ONCE], add_special_tokens=False)]
    return out


def encoded_flat(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids per word, the ids of all words in a row)."""
    sizes, ids = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for start in range(0, len(words), WORDS_AT_ONCE):
        lists = encoded(words[start: start + WORDS_AT_ONCE], path)
        sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        ids.append(np.fromiter(chain.from_iterable(lists), np.int32))
    return np.concatenate(sizes), np.concatenate(ids)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` with these starts and lengths, one after the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


class WordIds:
    """Ids of the words asked for so far; starts anew when it holds more than ``remembered`` words."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path, self.remembered = path, remembered
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts, self.sizes, self.ids = array("q"), array("q"), array("i")

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids per word, the ids of all words in a row); the words are distinct."""
        if len(self.place) > self.remembered:
            self.forget()
        new = [w for w in words if w not in self.place]
        sizes, ids = encoded_flat([w.decode() for w in new], self.path)
        for word in new:
            self.place[word] = len(self.place)
        self.starts.frombytes((len(self.ids) + np.cumsum(sizes) - sizes).tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.ids.frombytes(ids.tobytes())
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        lengths = np.frombuffer(self.sizes, np.int64)[at]
        return lengths, gathered(np.frombuffer(self.ids, np.int32), np.frombuffer(self.starts, np.int64)[at], lengths)


def dealt(words: Iterable[bytes], blocks: int) -> list[list[bytes]]:
    """Distinct words per block, sorted."""
    out: list[list[bytes]] = [[] for _ in range(blocks)]
    for word in words:
        out[zlib.crc32(word) % blocks].append(word)
    for block in out:
        block.sort()
    return out


def _send(blocks: int):
    def send(texts: list[str]) -> Iterator[dict]:
        found: set[bytes] = set()
        for text in texts:
            found.update(text.encode().split())
        for block, words in enumerate(dealt(found, blocks)):
            if words:
                yield {"block": block, "words": b" ".join(words).decode()}

    return send


_SIZE_BYTES, _ID_BYTES = 4, 3  # of what a block answers: ids per word, and each id


def _answer(path: str, known: WordIds | None = None):
    known = known or WordIds(path)

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        out = {c: asked[c].to_numpy() for c in ("part", "fold", "unit", "block")} | {"of": [], "sizes": [], "ids": []}
        for words in asked["words"]:
            data = words.encode()
            sizes, ids = known.of(data.split())
            out["of"].append(zlib.crc32(data))
            out["sizes"].append(units.planes(sizes, _SIZE_BYTES))
            out["ids"].append(units.planes(ids, _ID_BYTES))
        return pd.DataFrame(out)

    return answer


def _answers(path: str, remembered: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordIds(path, remembered)
        answer = _answer(path, known)
        for batch in batches:
            for start in range(0, len(batch), ASKED_AT_ONCE):
                yield answer(batch.iloc[start: start + ASKED_AT_ONCE])
        known.forget()
        units.give_back()

    return work


def _placed(path: str, blocks: int):
    def place(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        placed = put(packs, answers)
        units.give_back()
        return placed

    def put(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if packs.empty:
            return pd.DataFrame({"doc_id": [], "n_tokens": [], "ids": [], "decoded": []})
        doc_ids, texts = units.unpack(packs["payload"].iloc[0])
        got = {b: (of, sizes, ids) for b, of, sizes, ids in zip(answers["block"], answers["of"], answers["sizes"], answers["ids"], strict=True)}
        names = np.array(piece_list(path), object)
        number: defaultdict[bytes, int] = defaultdict(count().__next__)  # words in the order they are met
        met = [np.fromiter(map(number.__getitem__, text.encode().split()), np.int32) for text in texts]
        del texts
        order, flats, all_sizes = [], [], []
        for block, words in enumerate(dealt(number, blocks)):
            if not words:
                continue
            of, sizes, ids = got.get(block, (None, b"", b""))
            if of == zlib.crc32(b" ".join(words)):
                sizes, ids = units.from_planes(sizes, _SIZE_BYTES), units.from_planes(ids, _ID_BYTES)
            else:  # the unit was cut differently than when it asked
                sizes, ids = encoded_flat([w.decode() for w in words], path)
            order.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            all_sizes.append(sizes.astype(np.int64))
            flats.append(ids.astype(np.int32))
        place = np.empty(len(number), np.int64)  # of each word among all blocks' words in a row
        place[np.concatenate([np.empty(0, np.int64), *order])] = np.arange(len(number))
        del number
        flat = np.concatenate([np.empty(0, np.int32), *flats])
        sizes = np.concatenate([np.empty(0, np.int64), *all_sizes])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        named = names[flat].tolist()
        decoded = np.array([" ".join(named[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object)
        silent = not all(decoded)  # some words have no pieces
        all_ids, all_texts, counts = [], [], []
        for words in met:
            at = place[words]
            all_ids.append(gathered(flat, starts[at], sizes[at]))
            spelled = decoded[at].tolist()
            all_texts.append(" ".join(filter(None, spelled) if silent else spelled))
            counts.append(len(all_ids[-1]))
        return pd.DataFrame({"doc_id": doc_ids, "n_tokens": counts, "ids": all_ids, "decoded": all_texts})

    return place


def encode(docs: DataFrame, path: str, chars: int = UNIT_CHARS, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded) per row of ``docs``, of which doc_id and text are read.

    A null text is empty: no ids, decoded to empty text. Ids may be null or repeat; every row is encoded.
    """
    rows = units.numbered(units.repeatable(docs.select("doc_id", "text")), F.lit(0))
    blocks = units.blocks_for(docs)
    asked = units.items(rows, _send(blocks), "block int, words string", chars)
    answers = asked.groupBy("block").applyInPandas(_answers(path, remembered), "part int, fold int, unit int, block int, of long, sizes binary, ids binary")
    key = ["part", "fold", "unit"]
    placed = units.packs(rows, chars).groupBy(*key).cogroup(answers.groupBy(*key)).applyInPandas(
        _placed(path, blocks), "doc_id string, n_tokens long, ids array<int>, decoded string")
    return placed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(row key, decoded) for rows (row_key, ids array<int>): pieces joined by spaces, null ids decode to empty text.

    ``row_key`` must be unique. Ids that the vocabulary does not have are left out.
    """
    keyed = rows.select("row_key", F.posexplode_outer("ids").alias("pos", "id"))
    named = keyed.join(F.broadcast(pieces(rows.sparkSession, path)), "id", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))))
    return named.groupBy("row_key").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), " ").alias("decoded"))


def digests(encoded_rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return encoded_rows.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                               F.sha2("decoded", 256).alias("decoded_sha256"))
