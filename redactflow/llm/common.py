"""Helpers that the operators of this subpackage share: written intermediate
tables, access to the bytes of an Arrow text column, and vectorised hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.session import shared_dir, ship_package

#: Bytes of text that one vectorised step takes at once; temporary arrays are about eight times as large.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back:
    several branches then read it once, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id) -> "F.Column":
    """The evaluation fold: crc32 of the decimal doc_id, modulo 5, is 0 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def hash_sample(df: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows of ``df``, chosen by the hash of doc_id: the same ones
    wherever they lie, and without gathering any rows to choose from."""
    share = int(min(1.0, rows / max(1, df.count())) * (1 << 32))
    return df.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 32)) < share)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and its row offsets (a null row is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]] if n else raw[:0], at - at[0]


def row_steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input reaches each bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Random 64-bit values of the byte values, from a fixed seed.
BYTE_VALUES = np.random.default_rng(20240601).integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, b in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class SpanHash:
    """Hashes of byte spans of one buffer, from prefix sums: equal spans have equal hashes."""

    def __init__(self, raw: np.ndarray):
        powers, self.inverse = _power_tables(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * powers[:len(raw)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of one text, A-Z lower-cased, in order.
    A text over the step size is cut at white space, so memory follows the step and not the text."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + STEP_BYTES)
        if end < len(raw):
            blank = np.flatnonzero(_SPACE[raw[at:end]])
            while not len(blank) and end < len(raw):  # one very long word
                more = min(len(raw), end + STEP_BYTES)
                blank = np.flatnonzero(_SPACE[raw[end:more]]) + (end - at)
                end = more
            end = at + int(blank[-1]) + 1 if len(blank) else end
        part = _LOWER[raw[at:end]]
        starts, ends = word_bounds(part)
        if len(starts):
            out.append(SpanHash(part)(starts, ends))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_SPACE[raw]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[raw]


def binary_bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column without nulls, one row after another."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)


def byte_class(*members: str) -> np.ndarray:
    """A table over the byte values, true for the given ASCII characters and ranges ("a-z")."""
    out = np.zeros(256, bool)
    for m in members:
        out[ord(m[0]):ord(m[-1]) + 1] = True
    return out


def words_within(raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer of texts; ``blank`` says which bytes
    part words, and a word never goes from one text into the next."""
    word = ~blank[raw]
    head, tail = word.copy(), word.copy()
    head[1:] &= ~word[:-1]
    tail[:-1] &= ~word[1:]
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    head[cut] = word[cut]
    tail[cut - 1] = word[cut - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def word_dictionary(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The words as a dictionary-encoded array: exact numbers, in order of first occurrence."""
    change = np.zeros(len(raw) + 1, np.int8)
    change[starts] += 1
    np.add.at(change, ends, -1)
    data = raw[np.cumsum(change[:-1], dtype=np.int8).astype(bool)]
    offsets = np.append(0, np.cumsum(ends - starts))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()


def word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of ``word_dictionary``."""
    return word_dictionary(raw, starts, ends).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def windows_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Ordered 64-bit hashes of the ``n``-word windows."""
    h = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(_BASE) + words[k:k + len(h)])
    return h


def shingle_set(raw: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of one text; a shorter
    text is one shingle of all its words; a text without words has none."""
    words = word_hashes(raw)
    if not len(words):
        return words
    return np.unique(windows_hash(words, min(n, len(words))))
