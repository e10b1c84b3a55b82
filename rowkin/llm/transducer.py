"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

The vocabulary is compiled into one deterministic machine that reads the characters of a normalised
text. Its transitions carry the number of tokens they emit, so a text's token count is the sum along
its path and no token is ever built. A state has two parts:

* how far the pre-tokeniser is: nothing open, inside letters, inside other signs, or after an
  apostrophe that may begin a contraction;
* what the merges need to know of the open pre-token p. A token sequence is what BPE gives exactly if
  each two neighbours are what BPE gives for their joint text, and every prefix of such a sequence is
  such a sequence. So p's tokens follow from the last token of each of its prefixes, and only those
  prefixes matter after which p goes on as the beginning of some token. For each of them the state
  keeps the place in the tree of tokens, the last token, and the difference of token counts.

There are finitely many states, but far too many to list, so transitions are compiled when they are
first taken, and forgotten together when there are many. A word between white space is a path from
the empty state to itself; such paths are remembered whole.

Long texts are cut into chunks that different tasks count. A chunk's map says for a start state which
state it ends in and how many tokens it emits. It is first computed from the empty state, then, in
rounds, from every state in which the chunk before may end, until no start is missing. The states
forget their past at the first white space or change of script, so two rounds are usual. A text's maps
are composed by a parallel prefix scan.

Normaliser and classes of characters are asked from the vocabulary's own library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.session import stage

CHUNK_CHARS = 1 << 16
MAX_STATES = 200_000  # compiled at a time, per worker
MAX_WORDS = 400_000  # remembered at a time, and as many older ones, per worker

FINAL = 256  # added to the last byte of a pre-token
EMPTY, LETTERS, SIGNS, QUOTE = "", "L", "O", "'"
# What an apostrophe at the beginning of a pre-token is taken together with.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

ENDS = b".,;:!?"

State = tuple  # (mode, open places of the merges, last byte not yet read or -1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be printed, else the next unused one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The vocabulary's tokens as a tree over bytes, and which tokens may follow one another."""

    ROOT, START = 0, -1

    def __init__(self, model: dict):
        letters, end = byte_letters(), model["end_of_word_suffix"]
        self.symbols: list[tuple[int, ...]] = [()] * len(model["vocab"])
        for token, number in model["vocab"].items():
            body = token.removesuffix(end) if token != end else token
            values = [letters[c] for c in body]
            self.symbols[number] = (*values[:-1], values[-1] + (FINAL if body != token else 0))
        vocab = model["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.merged = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.parts = {token: (rank, *pair) for pair, (rank, token) in self.merged.items()}
        made = {token: rank for token, (rank, _, _) in self.parts.items()}
        if len(made) != len(self.merged) or any(max(made.get(a, -1), made.get(b, -1)) > r for r, a, b in self.parts.values()):
            raise ValueError("only vocabularies are supported in which each token comes from one merge, of tokens made before it")
        self.single = {s[0]: i for i, s in enumerate(self.symbols) if len(s) == 1}
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        for number, symbols in enumerate(self.symbols):
            node = self.ROOT
            for s in symbols:
                node = self.child.setdefault(node << 9 | s, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = number
        self.inner = {key >> 9 for key in self.child}
        self._fits: dict[tuple[int, int], bool] = {}
        self._edges: tuple[dict, dict] = {}, {}

    def encoded(self, symbols: tuple[int, ...]) -> list[int]:
        """Tokens by merging the best pair until none is left."""
        parts = [self.single[s] for s in symbols]
        while True:
            found = [(*self.merged[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merged]
            if not found:
                return parts
            _, token, at = min(found, key=lambda f: (f[0], f[2]))
            parts[at: at + 2] = [token]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at the left (0) or right (1) end while ``token`` is put together, and the rank at which each is merged on."""
        known = self._edges[side].get(token)
        if known is None:
            known, part, rank = [], token, len(self.merged)
            while part >= 0:
                known.append((part, rank))
                rank, *both = self.parts.get(part, (0, -1, -1))
                part = both[side]
            self._edges[side][token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``, or begin a pre-token.

        Both are put together on their own until two parts at the boundary have a merge that comes
        before the next merge of either; of equal merges the left one is first.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if left == self.START:
                known = self.encoded(self.symbols[right]) == [right]
            else:
                merged, none = self.merged.get, (len(self.merged), -1)
                known = not any((rank := merged((x, y), none)[0]) < before and rank <= after and rank < none[0]
                                for x, before in self.edge(left, 1) for y, after in self.edge(right, 0))
            if len(self._fits) >= MAX_STATES:
                self._fits.clear()
            self._fits[key] = known
        return known

    def read(self, places: tuple, symbol: int) -> tuple[tuple, int]:
        """(places after one more byte, tokens emitted; the number may fall when tokens merge)."""
        token, emitted, going = -1, 0, []
        tree, tokens, inner = self.child.get, self.token, self.inner
        for node, last, back in places:
            child = tree(node << 9 | symbol)
            if child is None:
                continue
            if child in inner:
                going.append((child, last, back))
            if token < 0 <= tokens[child] and self.fits(last, tokens[child]):
                token, emitted = tokens[child], 1 - back
        if emitted:
            going = [(n, last, back + emitted) for n, last, back in going]
        going.append((self.ROOT, token, 0))
        return tuple(going), emitted


NOTHING = ((Merges.ROOT, Merges.START, 0),)
RESET: State = (EMPTY, NOTHING, -1)


class Machine:
    """The compiled machine of one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            text = json.load(file)
        split, level = (text["pre_tokenizer"].get("pretokenizers") or [{}, {}])[:2]
        whole = [n["type"] for n in text["normalizer"].get("normalizers", [])]
        if (split.get("pattern", {}).get("Regex") != PATTERN or level.get("type") != "ByteLevel" or level.get("add_prefix_space")
                or whole != ["NFC", "Replace", "Lowercase"] or not text["model"]["end_of_word_suffix"]):
            raise ValueError("only word-level BPE vocabularies with the known pre-tokeniser are supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in text["added_tokens"]):
            raise ValueError("only special strings that match as they stand are supported")
        self.merges = Merges(text["model"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(text["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        loaded = Tokenizer.from_file(path)
        self.normalised, self.split = loaded.normalizer.normalize_str, loaded.pre_tokenizer.pre_tokenize_str
        self.kinds: dict[str, str] = {}
        self.words: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}  # words that were remembered before the present ones
        self.forget()

    def forget(self) -> None:
        self.states: list[State] = []
        self.number: dict[State, int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.numbered(RESET)

    def numbered(self, state: State) -> int:
        at = self.number.setdefault(state, len(self.states))
        if at == len(self.states):
            self.states.append(state)
        return at

    def kind(self, char: str) -> str:
        """L letter, N number, O other sign, or white space, as the pre-tokeniser sees it."""
        known = self.kinds.get(char)
        if known is None:
            spans = [span for _, span in self.split("a" + char + "!")]
            known = "N" if len(spans) == 3 else "L" if spans[0] == (0, 2) else "O" if spans[-1] == (1, 3) else " "
            self.kinds[char] = known
        return known

    def _opened(self, mode: str, places: tuple, char: str) -> tuple[State, int]:
        emitted, data = 0, char.encode("utf-8")
        for b in data[:-1]:
            places, n = self.merges.read(places, b)
            emitted += n
        return (mode, places, data[-1]), emitted

    def _whole(self, word: str) -> int:
        state, emitted = self._opened(LETTERS, NOTHING, word)
        return emitted + self.closed(state)

    def closed(self, state: State) -> int:
        """Tokens emitted when the pre-token ends here."""
        mode, places, last = state
        if mode == EMPTY:
            return 0
        if len(mode) == 2 and mode[0] == QUOTE:  # the apostrophe was no contraction after all
            return self._whole(QUOTE) + self._whole(mode[1])
        return self.merges.read(places, last + FINAL)[1]

    def step(self, state: State, char: str) -> tuple[State, int]:
        """One transition: the next state and the tokens emitted."""
        mode, places, last = state
        kind = self.kind(char)
        if mode == EMPTY:
            if kind == " ":
                return RESET, 0
            if kind == "N":
                return RESET, self._whole(char)
            if char == QUOTE:
                return (QUOTE, NOTHING, ord(QUOTE)), 0
            return self._opened(LETTERS if kind == "L" else SIGNS, NOTHING, char)
        if mode[0] == QUOTE:
            begun = mode + char
            if begun in CONTRACTIONS:
                return RESET, self._whole(begun)
            if len(mode) == 1 and any(c.startswith(begun) for c in CONTRACTIONS):
                return (begun, NOTHING, -1), 0
            if len(mode) == 2:
                after, emitted = self.step(RESET, mode[1])
                after, more = self.step(after, char)
                return after, self._whole(QUOTE) + emitted + more
        if (mode == LETTERS and kind == "L") or (mode in (SIGNS, QUOTE) and kind == "O"):
            places, emitted = self.merges.read(places, last)
            after, more = self._opened(LETTERS if kind == "L" else SIGNS, places, char)
            return after, emitted + more
        after, emitted = self.step(RESET, char)
        return after, self.closed(state) + emitted

    def walk(self, at: int, text: str) -> tuple[int, int]:
        """(state, tokens) after a normalised text."""
        emitted, table = 0, self.table
        for char in text:
            taken = table.get((at, char))
            if taken is None:
                after, n = self.step(self.states[at], char)
                taken = table[at, char] = self.numbered(after), n
            at = taken[0]
            emitted += taken[1]
        return at, emitted

    def _through(self, start: State, text: str) -> tuple[State, int]:
        """From a state through a raw text. Special strings end what is open and are one token each."""
        if len(self.states) > MAX_STATES:
            self.forget()
        state, emitted, done = start, 0, 0
        for found in self.special.finditer(text):
            at, n = self.walk(self.numbered(state), self.normalised(text[done: found.start()]))
            emitted += n + self.closed(self.states[at]) + 1
            state, done = RESET, found.end()
        rest = text[done:].lower() if text.isascii() else self.normalised(text[done:])
        at, n = self.walk(self.numbered(state), rest)
        return self.states[at], emitted + n

    def _word(self, word: bytes) -> int:
        stem, n = word[:-1], self.older.get(word)
        if n is None and word[-1] in ENDS and stem.isalpha():  # a sign after a letter begins a pre-token of its own
            n = self.count(stem) + self.count(word[-1:])
        elif n is None:
            state, emitted = self._through(RESET, word.decode("utf-8"))
            n = emitted + self.closed(state)
        if len(self.words) >= MAX_WORDS:
            self.words, self.older = {}, self.words
        self.words[word] = n
        return n

    def count(self, text: bytes) -> int:
        """Tokens of a whole text."""
        total = 0
        if b"<" not in text:  # in special strings the case of letters matters
            text = text.lower()
        for word in text.split():
            n = self.words.get(word)
            total += self._word(word) if n is None else n
        return total

    def map_from(self, start: State, text: str) -> tuple[State, int]:
        """A chunk's map at one start state: (end state, tokens emitted). Words inside are counted as wholes."""
        data = text.encode("utf-8")
        words = data.split()
        if len(words) < 3:
            return self._through(start, text)
        first, last = data.index(words[0]) + len(words[0]), data.rindex(words[-1])
        head, before = self._through(start, data[:first].decode("utf-8") + " ")
        tail, after = self._through(RESET, data[last:].decode("utf-8"))
        return tail, before + self.closed(head) + self.count(data[first:last]) + after


@lru_cache(maxsize=2)
def machine(path: str) -> Machine:
    return Machine(path)


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that normalisation may compose with the one before, or move."""
    second = {chr(int(parts[1], 16)) for c in range(0x110000)
              if len(parts := unicodedata.decomposition(chr(c)).split()) == 2 and not parts[0].startswith("<")}
    hangul = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    moved = {chr(c) for c in range(0x300, 0x110000) if unicodedata.combining(chr(c))}
    return frozenset(second | hangul | moved)


def chunks(text: str, chars: int, special: re.Pattern) -> list[str]:
    """A text cut every ``chars`` characters or as soon after that as normalisation and special strings allow."""
    if len(text) <= chars:
        return [text]
    apart, taboo = joining(), [found.span() for found in special.finditer(text)]
    cuts, place = [0], 0
    while len(text) - cuts[-1] > chars:
        at = cuts[-1] + chars
        while True:
            while place < len(taboo) and taboo[place][1] <= at:
                place += 1
            if place < len(taboo) and taboo[place][0] < at:
                at = taboo[place][1]
            elif at < len(text) and text[at] in apart:
                at += 1
            else:
                break
        if at >= len(text):
            break
        cuts.append(at)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def _written(state: State) -> str:
    return json.dumps(state)


def _read(state: str) -> State:
    mode, places, last = json.loads(state)
    return mode, tuple(map(tuple, places)), last


def _parts(path: str, chars: int, id_type: pa.DataType | None = None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = machine(path)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_tokens", "long", "at", "text")}
            of, ids = [], batch.column("doc_id")
            for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                text = text or b""
                cut = chunks(text.decode("utf-8"), chars, compiled.special) if len(text) > chars else [None]
                whole = len(cut) == 1
                key = None if whole else uuid.uuid4().hex
                for at, part in enumerate(cut):
                    of.append(row)
                    for name, value in (("n_bytes", len(text)), ("n_tokens", compiled.count(text) if whole else None), ("long", key),
                                        ("at", None if whole else at), ("text", None if whole else part)):
                        out[name].append(value)
            kinds = {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "long": pa.string(), "at": pa.int32(), "text": pa.string()}
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), *[pa.array(out[c], t) for c, t in kinds.items()]],
                                             names=["doc_id", *kinds])

    return work


def _mapped(path: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = machine(path)
        for batch in batches:
            found = [compiled.map_from(_read(start), text) for start, text in zip(batch["start"], batch["text"], strict=True)]
            yield pd.DataFrame({"long": batch["long"], "at": batch["at"], "start": batch["start"],
                                "end": [_written(e) for e, _ in found], "emitted": [n for _, n in found]})

    return work


_MAP = "long string, at int, start string, end string, emitted long"


def prefix_scan(ends: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row i becomes the composition of rows 0 to i, in a logarithmic number of steps.

    ``ends[i, s]`` is the state that map i leads to from state s, or -1 where it is not defined, and
    ``emitted[i, s]`` its count.
    """
    step = 1
    while step < len(ends):
        first, count = ends[:-step], emitted[:-step]
        known = first >= 0
        via = np.where(known, first, 0)
        then, more = np.take_along_axis(ends[step:], via, axis=1), np.take_along_axis(emitted[step:], via, axis=1)
        ends = np.concatenate((ends[:step], np.where(known, then, -1)))
        emitted = np.concatenate((emitted[:step], np.where(known, count + more, 0)))
        step *= 2
    return ends, emitted


def _composed(path: str):
    def composed(group: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([pd.Series([_written(RESET)]), group["start"], group["end"]], ignore_index=True))
        n = len(group)
        shape = (int(group["at"].max()) + 1, len(names))
        ends, emitted = np.full(shape, -1), np.zeros(shape, np.int64)
        ends[group["at"], codes[1: n + 1]] = codes[n + 1:]
        emitted[group["at"], codes[1: n + 1]] = group["emitted"]
        ends, emitted = prefix_scan(ends, emitted)
        total = int(emitted[-1, 0]) + machine(path).closed(_read(names[ends[-1, 0]]))
        return pd.DataFrame({"long": [group["long"].iloc[0]], "n_tokens": [total]})

    return composed


def _all_maps(pieces: DataFrame, path: str) -> DataFrame:
    """The maps of all chunks, at the empty state and at every state in which the chunk before may end."""
    spread = max(8, pieces.sparkSession.sparkContext.defaultParallelism)
    empty = F.lit(_written(RESET))
    maps = stage(pieces.withColumn("start", empty).repartition(spread, "long", "at").mapInPandas(_mapped(path), _MAP), "chunk-maps")
    latest = maps
    while True:
        reached = latest.select("long", (F.col("at") + 1).alias("at"), F.col("end").alias("start")).distinct()
        missing = reached.join(maps, ["long", "at", "start"], "left_anti").join(pieces, ["long", "at"])
        latest = stage(missing.repartition(spread, "long", "at", "start").mapInPandas(_mapped(path), _MAP), "chunk-maps")
        if latest.isEmpty():
            return maps
        maps = maps.unionByName(latest)


def count_tokens(docs: DataFrame, path: str, chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row of ``docs``, of which doc_id and text are read.

    ``n_tokens`` is what the vocabulary's library gives for the whole text without added special
    tokens; special strings inside a text are one token each. A null or empty text has none. Ids may
    be null or repeat; every row is counted. Texts over ``chars`` bytes are cut into chunks; a text's
    maps, some hundred bytes per chunk, meet in one group.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("doc_id", "text").mapInArrow(
        _parts(path, chars), f"doc_id {kind}, n_bytes long, n_tokens long, long string, at int, text string")
    parts = stage(parts, "token-counts")
    pieces = parts.where("long IS NOT NULL")
    short = parts.where("long IS NULL").select("doc_id", "n_bytes", "n_tokens")
    if pieces.isEmpty():
        return short
    totals = _all_maps(pieces.select("long", "at", "text"), path).groupBy("long").applyInPandas(_composed(path), "long string, n_tokens long")
    return short.unionByName(pieces.where("at = 0").select("doc_id", "n_bytes", "long").join(totals, "long").drop("long"))
