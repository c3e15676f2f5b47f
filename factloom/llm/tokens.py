"""Encoding a corpus with a public byte-level BPE tokenizer.

Texts are split into pre-tokens in Arrow batches; the ``tokenizers`` library encodes every distinct pre-token of a
worker once, and a document's ids are gathered from that table with numpy. A byte-level BPE never merges across
pre-tokens, so this gives exactly the ids of the whole text, which ``tests/llm`` checks against whole-text encoding.

Defined cases: a null or empty text has no ids; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DEFAULT_TOKENIZER = "byte_bpe_50k"
#: Distinct pre-tokens a worker keeps; beyond it the table starts anew, which costs time and changes no result.
MAX_WORDS = 1_000_000
#: Rows to an Arrow slice, so that a worker holds one slice's pre-tokens at a time.
SLICE = 64


def tokenizer_path(name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> str:
    """File of a tokenizer: under ``folder``, or where the public collection is installed."""
    if folder:
        return f"{folder.rstrip('/')}/{name}.json"
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


#: Classes of characters in the split rule; MARK stands between texts.
OTHER, LETTER, NUMBER, SPACE, MARK = range(5)
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(sys.maxunicode + 2, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = SPACE
    out[sys.maxunicode + 1] = MARK
    return out


def pretokens(char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of a row of code points in which texts are parted by MARK.

    The split rule: runs of one class; a blank before a run of letters, digits or other marks belongs to it; of
    other white space before such a run the last character stands alone; a lone apostrophe that no blank precedes
    takes s, t, m, d, re, ve or ll behind it.
    """
    kind = char_classes()[char]
    n = len(char)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == MARK
    run = np.flatnonzero(first)
    # the last white space character of a run before a word opens a token; the word behind a blank does not
    word = run[(kind[run] != SPACE) & (kind[run] != MARK)]
    word = word[word > 0]
    word = word[kind[word - 1] == SPACE]
    first[word - 1] = True
    first[word[char[word - 1] == 32]] = False
    # contractions
    padded = np.concatenate([char, np.full(3, sys.maxunicode + 1, char.dtype)])
    q = np.flatnonzero((char == 39) & first)
    q = q[kind[np.minimum(q + 1, n - 1)] == LETTER]
    if len(q):
        a, b = padded[q + 1], padded[q + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        size = np.where(one, 2, np.where(two, 3, 0))
        q, size = q[size > 0], size[size > 0]
        first[q + 1] = False
        rest = q + size
        rest = rest[rest < n]
        first[rest[kind[rest] == LETTER]] = True
    start = np.flatnonzero(first)
    return start, np.append(start[1:], n)


def splits_as_here(path: str) -> bool:
    """Whether a tokenizer's file asks for just the split rule of ``pretokens``, on texts as they stand."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    return bool(plain and not spec.get("normalizer") and (spec.get("model") or {}).get("type", "BPE") == "BPE")


class WordTable:
    """Ids of pre-tokens, as one flat array with starts and lengths.

    Pre-tokens are looked up by a 64-bit polynomial hash and then compared character by character; texts in which two
    different words share a hash are encoded whole, as are all texts by a tokenizer with another split rule or with a
    normalizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.whole = not splits_as_here(path)
        self.power = self.inverse = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.text, self.chars = np.empty(1 << 16, np.uint32), 0
        self.start, self.size, self.begin, self.length = (np.empty(1 << 14, np.int64) for _ in range(4))

    def _add(self, hashes: list[int], words: list[np.ndarray]) -> None:
        texts = [w.tobytes().decode("utf-32-le") for w in words]
        for h, word, enc in zip(hashes, words, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            ids, k = enc.ids, len(self.at)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while self.chars + len(word) > len(self.text):
                self.text = np.concatenate([self.text, np.empty_like(self.text)])
            if k == len(self.start):
                self.start, self.size, self.begin, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size, self.begin, self.length))
            self.flat[self.used : self.used + len(ids)] = ids
            self.text[self.chars : self.chars + len(word)] = word
            self.start[k], self.size[k], self.begin[k], self.length[k] = self.used, len(ids), self.chars, len(word)
            self.used += len(ids)
            self.chars += len(word)
            self.at[h] = k

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 18)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
                self.inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]))

    def _all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ``encode`` gives, by the library on whole texts."""
        rows = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.int32), *rows]), np.array([len(r) for r in rows], np.int64)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Word numbers of all texts in a row, and the count of words in each; None where two words share a hash."""
        if len(self.at) > MAX_WORDS:
            self.clear()
        mark = np.full(1, sys.maxunicode + 1, np.uint32)
        parts = [x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), np.uint32), mark)]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        char = np.concatenate(parts)
        start, end = pretokens(char)
        kept = char[start] != mark[0]
        marks = np.flatnonzero(~kept)
        counts = np.diff(np.concatenate([[-1], marks])) - 1
        start, end = start[kept], end[kept]
        if not len(start):
            return np.empty(0, np.int64), counts
        self._powers(len(char) + 1)
        with np.errstate(over="ignore"):
            mixed = (char.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
            mixed *= self.power[: len(char)]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
            hashed = (total[end] - total[start]) * self.inverse[start]
            hashed ^= hashed >> np.uint64(31)
        code, known = pd.factorize(hashed)
        keys = known.tolist()
        number = [self.at.get(h, -1) for h in keys]
        new = [k for k, x in enumerate(number) if x < 0]
        if new:
            seen = np.empty(len(keys), np.int64)
            seen[code[::-1]] = np.arange(len(code))[::-1]
            self._add([keys[k] for k in new], [char[start[seen[k]] : end[seen[k]]] for k in new])
            number = [self.at[h] for h in keys]
        at = np.asarray(number, np.int64)[code]
        size = end - start
        if not np.array_equal(size, self.length[at]):
            return None
        before = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        if not np.array_equal(char[np.repeat(start - before, size) + step], self.text[np.repeat(self.begin[at] - before, size) + step]):
            return None
        return at, counts

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        found = None if self.whole else self.words(texts)
        if found is None:
            return self._all(texts)[1]
        at, counts = found
        total = np.concatenate([[0], np.cumsum(self.size[at])])
        end = np.cumsum(counts)
        return total[end] - total[end - counts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the count of ids in each."""
        found = None if self.whole else self.words(texts)
        if found is None:
            return self._all(texts)
        at, counts = found
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])]
        end = np.cumsum(counts)
        return ids, total[end] - total[end - counts]


_TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """The table of this worker; it lives as long as the worker does."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]


def byte_values() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by rule.

    Bytes that print as themselves keep their character; the others, in order, take the characters from 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def id_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    from tokenizers import Tokenizer

    back, t = byte_values(), Tokenizer.from_file(path)
    return [bytes(back[c] for c in t.id_to_token(i)) if all(c in back for c in t.id_to_token(i)) else t.id_to_token(i).encode() for i in range(t.get_vocab_size())]


def char_offsets(ids: np.ndarray, path: str) -> np.ndarray:
    """Character in which each id's first byte lies; ids that split a character share it."""
    table = id_bytes(path)
    pieces = [table[i] for i in ids]
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return char[np.cumsum(size) - size].astype(np.int32) if len(raw) else np.empty(0, np.int32)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def _by_size(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``, a row for each row of ``docs``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for keys, texts in _slices(batches):
            ids, counts = table.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _by_size(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def encode_with_offsets(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, starts)``: ``starts`` holds for each id the character, from 0, in which its first byte lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for keys, texts in _slices(batches):
            ids, counts = table.encode(texts)
            end = np.cumsum(counts)
            starts = [char_offsets(ids[e - n : e], path) for e, n in zip(end, counts)]
            offsets = pa.array(np.concatenate([[0], end]).astype(np.int32))
            flat = np.concatenate(starts) if starts else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "ids", "starts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _by_size(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` without building the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for keys, texts in _slices(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(table.lengths(texts), pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _by_size(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from ids, by reversing the byte table.

    Bytes are joined before they are read as UTF-8, so characters split over ids come back whole; a character cut
    by the end of the ids becomes U+FFFD. Null ids give a null text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = id_bytes(path)
        for batch in batches:
            texts = [None if ids is None else b"".join([table[i] for i in ids]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
