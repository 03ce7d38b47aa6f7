"""Byte-level BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

A text is split at the strings of added tokens, then into words by the vocabulary's split pattern; no merge reaches over a word.
A word's bytes are its first symbols, linked to their neighbours. The queue holds (rank, place) of every pair of neighbours that the
vocabulary merges; the least one is taken, and skipped as stale if the pair at that place is another by now; a merge links past the right
symbol and queues the two new pairs. So a word of n bytes takes n log n steps, whatever its length. Words that recur in
a task are merged once (a table of bounded size). Decoding concatenates the vocabulary's byte strings.

The vocabulary's JSON file is read on the driver and broadcast (its size is that of the file, not of the data). Texts are encoded where they are read; nothing
is shuffled.

Results for odd input: null and empty texts have no ids (0 tokens, the digests of no bytes); a text's whole length is used; strings of
added tokens inside texts become their ids, unless ``plain``; equal rows get equal results; an empty table gives no rows; further
columns are ignored except those asked for.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import text_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the split pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of text at whose edges the pattern always splits: each but a text's first begins with a blank or a line end after another sign.
RUNS = re.compile(r" \S++(?![^\S \n])|\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: Runs and words of more characters are encoded each time; a table of known ones is renewed once it has so many.
LONG, KNOWN = 64, 1 << 18
#: An entry of the queue is rank << PLACE | place.
PLACE = 40
LAST = (1 << PLACE) - 1


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it is visible Latin-1, else the next one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """shown: bytes of each id. ranks: rank of each pair, as left << bits | right; made: the id that each rank's merge makes. first: id of each byte.
    added: ids of added tokens by their strings."""

    shown: list[bytes]
    ranks: dict[int, int]
    made: list[int]
    first: list[int]
    added: dict[str, int]
    bits: int
    content: bytes = field(repr=False, default=b"")

    @staticmethod
    def from_json(path: str = VOCABULARY) -> Vocabulary:
        with open(path, "rb") as f:
            content = f.read()
        whole = json.loads(content)
        model, added = whole["model"], whole["added_tokens"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        split = whole["pre_tokenizer"] or {}
        if model["type"] != "BPE" or odd or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or whole["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {odd or split}")
        ids, signs = model["vocab"], byte_signs()
        shown = [b""] * (1 + max([*ids.values(), *(t["id"] for t in added)]))
        for token, i in ids.items():
            shown[i] = bytes(signs[c] for c in token)
        for t in added:
            shown[t["id"]] = t["content"].encode()
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        ranks: dict[int, int] = {}
        bits = len(shown).bit_length()
        for r, (a, b) in enumerate(pairs):
            ranks[ids[a] << bits | ids[b]] = r
        by_byte = {b: ids[c] for c, b in signs.items()}
        return Vocabulary(shown, ranks, [ids[a + b] for a, b in pairs], [by_byte[b] for b in range(256)], {t["content"]: t["id"] for t in added}, bits, content)


def merged(symbols: list[int], ranks: dict[int, int], made: list[int], bits: int) -> list[int]:
    """``symbols`` after all merges, least rank first, leftmost on ties."""
    n, rank_of = len(symbols), ranks.get
    now = [rank_of(a << bits | b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]  # rank of the pair that begins at each place
    queue = [r << PLACE | i for i, r in enumerate(now) if r >= 0]
    heapify(queue)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        top = heappop(queue)
        at, rank = top & LAST, top >> PLACE
        if now[at] != rank:
            continue  # stale: one of the two has been merged meanwhile
        right = after[at]
        new = symbols[at] = made[rank]
        symbols[right] = now[at] = -1
        after[at] = beyond = after[right]
        if beyond < n:
            now[right] = -1
            before[beyond] = at
            now[at] = r = rank_of(new << bits | symbols[beyond], -1)
            if r >= 0:
                heappush(queue, r << PLACE | at)
        left = before[at]
        if left >= 0:
            now[left] = r = rank_of(symbols[left] << bits | new, -1)
            if r >= 0:
                heappush(queue, r << PLACE | left)
    return [s for s in symbols if s >= 0]


@functools.lru_cache(1)
def unassigned() -> str:
    """A class of the characters without a category in Python's Unicode tables: on these, other libraries' tables may differ."""
    spans: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"


class Known(dict):
    """Results of ``make`` by key, at most about twice KNOWN: those not asked for since the table was last full go. Long keys aren't kept."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        made = self.old.pop(key, None) or self.make(key)
        if len(key) <= LONG:
            self[key] = made
        return made

    def turn(self) -> None:
        if len(self) > KNOWN:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Encodes texts in one task."""

    def __init__(self, vocabulary: Vocabulary, odd: str, plain: bool = False):
        import regex

        self.table = byte_table(vocabulary.shown)
        first, ranks, made, bits = vocabulary.first, vocabulary.ranks, vocabulary.made, vocabulary.bits

        def word_ids(word: str) -> bytes:
            ids = merged([first[b] for b in word.encode()], ranks, made, bits)
            return struct.pack(f"<{len(ids)}I", *ids)

        self.words, self.runs = Known(word_ids), Known(self._run)
        self.find, self.content = regex.compile(PATTERN).findall, vocabulary.content
        self.odd, self.least = re.compile(odd), chr(int(odd[3:11], 16))
        added = {} if plain else {s: struct.pack("<I", i) for s, i in vocabulary.added.items()}
        self.added, self.cut = added, re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.library = None

    def _run(self, run: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(run) if run.isascii() or max(run) < self.least or not self.odd.search(run) else self._split(run)))

    def _split(self, run: str) -> list[str]:
        """Words of a run with characters on which Unicode tables may differ, by the library's own tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.content.decode()).pre_tokenizer
        return [run[a:b] for _, (a, b) in self.library.pre_tokenize_str(run)]

    def __call__(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        self.words.turn()
        self.runs.turn()
        if self.cut is None or not any(s in text for s in self.added):
            return b"".join(map(self.runs.__getitem__, RUNS.findall(text)))
        return b"".join(self.added.get(part) or b"".join(map(self.runs.__getitem__, RUNS.findall(part))) for part in self.cut.split(text))


def byte_table(shown: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each id's begin, and the end)."""
    return np.frombuffer(b"".join(shown), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in shown])]).astype(np.int64)


def shown_bytes(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The vocabulary's byte strings of ``ids``, one after the other."""
    data, starts = table
    at = ids.astype(np.int64)
    lengths = starts[at + 1] - starts[at]
    ends = np.cumsum(lengths)
    return data[np.repeat(starts[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def encoded(docs: DataFrame, vocabulary: Vocabulary | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), plain: bool = False) -> DataFrame:
    """The columns ``keep`` with ids. plain: strings of added tokens are ordinary text."""
    types = dict(docs.dtypes)
    make = lambda pack, texts: [pa.array([None if t is None else np.frombuffer(pack(t), "<u4").astype(np.int32) for t in texts], pa.list_(pa.int32()))]
    return _by_text(docs, vocabulary, text_col, keep, plain, make, {"ids": "array<int>"}, types)


def decoded(ids: DataFrame, vocabulary: Vocabulary | None = None, ids_col: str = "ids") -> DataFrame:
    """``ids`` with the column text; ids outside of the vocabulary raise."""
    shared = ids.sparkSession.sparkContext.broadcast((vocabulary or Vocabulary.from_json()).shown)
    names = ids.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(shared.value)
        for b in batches:
            got = [None if x is None else shown_bytes(np.array(x, np.int64), table).decode("utf-8", "replace") for x in b.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*names, "text"])

    return text_batches(ids).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in ids.dtypes) + ", text string")


def digests(docs: DataFrame, vocabulary: Vocabulary | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n_tokens and the digests of the ids and of the text that they decode to."""

    def make(pack: Encoder, texts: list[str | None]) -> list[pa.Array]:
        ids = [pack(t or "") for t in texts]
        text = [shown_bytes(np.frombuffer(x, "<u4"), pack.table).decode("utf-8", "replace") for x in ids]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text])]

    return _by_text(docs, vocabulary, text_col, keep, False, make, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, dict(docs.dtypes))


def _by_text(docs: DataFrame, vocabulary: Vocabulary | None, text_col: str, keep: tuple[str, ...], plain: bool, make: Callable, out: dict[str, str], types: dict[str, str]) -> DataFrame:
    """The columns ``keep`` and those that ``make`` gets from (encoder, texts), half a megabyte of texts at a time."""
    shared = docs.sparkSession.sparkContext.broadcast([vocabulary or Vocabulary.from_json(), unassigned()])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value  # one list for all tasks of a Python process, so what one task has merged the next one knows
        if len(state) == 2:
            state.append(Encoder(*state, plain))
        pack = state[2]
        for b in batches:
            at = 0
            while at < b.num_rows:
                first, size, texts = at, 0, []
                while at < b.num_rows and size < 1 << 19:
                    texts.append(b.column(width)[at].as_py())
                    size += len(texts[-1] or "")
                    at += 1
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(first, at - first) for i in range(width)), *make(pack, texts)], names=[*keep, *out])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} {t}" for c, t in out.items())])
    return text_batches(docs).select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)
