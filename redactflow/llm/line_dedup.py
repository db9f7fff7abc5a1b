"""Corpus-wide line deduplication that can be undone.

Exact reference counts (line key -> number of documents that hold it) are the
truth; they lie in a written table, cut into shards by the key.  Beside each
shard of counts lies a cuckoo filter of the keys that reach the threshold.
A batch's keys are tried against the filters first; only the few that pass are
looked up exactly, so a filter's false alarms never drop a line.  Inserting
documents adds their keys' counts, deleting documents takes them off again, and
keys that cross the threshold enter or leave their shard's filter; every
version of the index is a new table, so the one before it stays readable.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased; blank lines have no key.  Null and empty texts are one empty line.
Rows that share a doc_id count as documents of their own, as do rows without one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.llm.common import stage, table

LEAST_DOCS = 10
_BLANKS = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes | None]:
    """One 16-byte key per line; None for a blank line."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(_BLANKS).lower()
        out.append(hashlib.blake2b(key, digest_size=16).digest() if key else None)
    return out


def key_rows(docs: DataFrame) -> DataFrame:
    """key, once per row of ``docs`` that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [k for t in b.column(0) for k in set(line_keys(t.as_py())) - {None}]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])

    return docs.select("text").mapInArrow(run, "key binary")


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit fingerprints, two buckets per key.

    Insertions and deletions of a key's fingerprint; ``has`` is never wrong
    about a key that is in.  Keys come as 16 bytes that are already random.
    """

    WIDTH, KICKS = 4, 500

    def __init__(self, slots: np.ndarray):
        self.slots, self.mask = slots, len(slots) - 1

    @classmethod
    def for_keys(cls, n: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(n / (0.8 * cls.WIDTH))).bit_length(), cls.WIDTH), "<u2"))

    @classmethod
    def of(cls, keys: list[bytes]) -> Cuckoo:
        """A filter that holds ``keys``; made anew, and larger, when an insertion finds no place."""
        n = len(keys)
        while True:
            made = cls.for_keys(n)
            if all(made.insert(k) for k in keys):
                return made
            n = 2 * n + 8

    def places(self, prints: np.ndarray, first: np.ndarray) -> np.ndarray:
        return first ^ ((prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) & np.uint64(self.mask)

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys given as an (n, 2) array of 64-bit words."""
        prints = (keys[:, 1] & np.uint64(0xFFFF)).astype("<u2")
        prints[prints == 0] = 1
        first = keys[:, 0] & np.uint64(self.mask)
        return prints, first, self.places(prints, first)

    def one(self, key: bytes) -> tuple[int, int, int]:
        prints, first, second = self.split(np.frombuffer(key, "<u8").reshape(1, 2))
        return int(prints[0]), int(first[0]), int(second[0])

    def insert(self, key: bytes) -> bool:
        print_, *buckets = self.one(key)
        for b in buckets:
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = print_
                return True
        b = buckets[print_ & 1]
        for k in range(self.KICKS):
            at = (print_ + k) % self.WIDTH
            print_, self.slots[b, at] = int(self.slots[b, at]), print_
            b = int(self.places(np.array([print_], "<u2"), np.array([b], np.uint64))[0])
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = print_
                return True
        return False

    def delete(self, key: bytes) -> bool:
        print_, *buckets = self.one(key)
        for b in buckets:
            there = np.flatnonzero(self.slots[b] == print_)
            if len(there):
                self.slots[b, there[0]] = 0
                return True
        return False

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self.split(keys)
        own = prints[:, None]
        return (self.slots[first] == own).any(axis=1) | (self.slots[second] == own).any(axis=1)


#: Frequent keys of a shard, on average: what one task builds a filter from.
SHARD_KEYS = 100_000
#: Bytes of filters, and of exact frequent keys, up to which they are sent to every task.
FILTER_BYTES, KEY_BYTES = 32 << 20, 8 << 20


@dataclass(frozen=True)
class LineIndex:
    """counts (key, n) and filters (shard, slots) as written tables."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    least: int

    @classmethod
    def of(cls, docs: DataFrame, least: int = LEAST_DOCS, shards: int | None = None) -> LineIndex:
        """The index of ``docs``; the number of shards follows from that of the frequent keys."""
        counts = stage(key_rows(docs).groupBy("key").agg(F.count("*").alias("n")), "counts")
        return cls._from_counts(counts, least, shards)

    @classmethod
    def _from_counts(cls, counts: DataFrame, least: int, shards: int | None = None) -> LineIndex:
        often = counts.where(F.col("n") >= least).select("key")
        shards = shards or max(16, -(-often.count() // SHARD_KEYS))
        return cls(counts, stage(_built(often, shards), "filters"), shards, least)

    def often(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.least).select("key")

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index as if these documents had never been inserted."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, step: int) -> LineIndex:
        change = stage(key_rows(docs).groupBy("key").agg(F.sum(F.lit(step)).cast("long").alias("n")), "change")
        both = self.counts.select("key", "n", F.col("n").alias("old")).union(change.select("key", "n", F.lit(0).cast("long")))
        counts = stage(both.groupBy("key").agg(F.sum("n").alias("n"), F.sum("old").alias("old")).where("n > 0 or old > 0"), "counts")
        kept = counts.where("n > 0").select("key", "n")
        if kept.where(F.col("n") >= self.least).count() > 2 * SHARD_KEYS * self.shards:  # outgrown: more shards
            return self._from_counts(kept, self.least)
        up, down = (F.col("n") >= self.least) & (F.col("old") < self.least), (F.col("n") < self.least) & (F.col("old") >= self.least)
        crossed = counts.where(up | down).select(shard(self.shards).alias("shard"), "key", up.alias("enters"))

        def apply(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            number = (keys if len(keys) else old)["shard"].iloc[0]
            filter_ = Cuckoo(np.frombuffer(old["slots"].iloc[0], "<u2").reshape(-1, Cuckoo.WIDTH).copy()) if len(old) else Cuckoo.for_keys(len(keys))
            for key, enters in zip(keys["key"], keys["enters"]):
                if not enters:
                    filter_.delete(bytes(key))
            for key, enters in zip(keys["key"], keys["enters"]):
                if enters and not filter_.insert(bytes(key)):
                    return pd.DataFrame({"shard": [number], "slots": [b""]})  # full: made anew from the counts below
            return pd.DataFrame({"shard": [number], "slots": [filter_.slots.tobytes()]})

        filters = stage(crossed.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(apply, "shard int, slots binary"), "filters")
        full = filters.where(F.length("slots") == 0).select("shard")
        anew = _built(kept.where(F.col("n") >= self.least).select("key"), self.shards, full)
        return replace(self, counts=kept, filters=stage(filters.where(F.length("slots") > 0).union(anew), "filters"))

    def sent_filters(self, limit: int = FILTER_BYTES) -> dict[int, bytes] | None:
        """The filters by shard if they are at most ``limit`` bytes together."""
        size = self.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
        return {r["shard"]: bytes(r["slots"]) for r in self.filters.toLocalIterator()} if size <= limit else None

    def sent_keys(self, limit: int = KEY_BYTES) -> bytes | None:
        """The frequent keys one after another if they are at most ``limit`` bytes."""
        often = self.often()
        return b"".join(bytes(r["key"]) for r in often.toLocalIterator()) if 16 * often.count() <= limit else None


class Lookup:
    """Which keys may be frequent, by the filters (all may be, without them)."""

    def __init__(self, slots: dict[int, bytes] | None, shards: int):
        self.filters = None if slots is None else {s: Cuckoo(np.frombuffer(x, "<u2").reshape(-1, Cuckoo.WIDTH)) for s, x in slots.items()}
        self.shards = shards

    def maybe(self, keys: list[bytes]) -> np.ndarray:
        out = np.full(len(keys), self.filters is None)
        if self.filters and keys:
            words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            number = shard_of(words, self.shards)
            order = np.argsort(number, kind="stable")
            bounds = np.searchsorted(number[order], np.arange(self.shards + 1))
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                if s in self.filters:
                    own = order[bounds[s]:bounds[s + 1]]
                    out[own] = self.filters[s].has(words[own])
        return out


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words[:, 1] >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def shard(shards: int):
    """The shard of ``key``, from its bytes 12 to 15, little-endian, as in ``shard_of``."""
    number = F.conv(F.concat(*[F.hex(F.substring("key", i, 1)) for i in (16, 15, 14, 13)]), 16, 10).cast("long")
    return (number % shards).cast("int")


def _built(keys: DataFrame, shards: int, only: DataFrame | None = None) -> DataFrame:
    """shard, slots: a filter for each shard that has keys (and is in ``only``)."""

    def build(b: pd.DataFrame) -> pd.DataFrame:
        made = Cuckoo.of(sorted(map(bytes, b["key"])))
        return pd.DataFrame({"shard": b["shard"].iloc[:1], "slots": [made.slots.tobytes()]})

    placed = keys.select(shard(shards).alias("shard"), "key")
    if only is not None:
        placed = placed.join(only, "shard", "left_semi")
    return placed.groupBy("shard").applyInPandas(build, "shard int, slots binary")


def without_frequent_lines(docs: DataFrame, index: LineIndex, filter_bytes: int = FILTER_BYTES, key_bytes: int = KEY_BYTES) -> DataFrame:
    """The columns of ``docs`` with new texts, and n_lines, n_dropped (which take the place of columns of that name).

    The filters go to the tasks if they are at most ``filter_bytes`` together, and
    the exact frequent keys, which have the last word, if they are at most
    ``key_bytes``: then the texts stay where they are.  Beyond that the keys that
    pass the filters are joined with the counts, and the texts with what is found,
    by the hash of the text.  (Whose hash it is doesn't matter: only frequent keys are found.)
    """
    docs = docs.drop("n_lines", "n_dropped")
    filters, exact = index.sent_filters(filter_bytes), index.sent_keys(key_bytes)
    sent, shards = docs.sparkSession.sparkContext.broadcast((filters, exact)), index.shards
    if exact is not None:
        return _cut(docs, sent, shards)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value[0], shards)
        for b in batches:
            held = [(i, k) for i, t in enumerate(b.column(1)) for k in set(line_keys(t.as_py())) - {None}]
            found = np.flatnonzero(lookup.maybe([k for _, k in held])).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([held[i][0] for i in found], pa.int64())), pa.array([held[i][1] for i in found], pa.binary())], ["_text", "key"])

    maybe = docs.select(F.xxhash64("text").alias("_text"), "text").mapInArrow(candidates, "_text long, key binary").distinct()
    keys = maybe.join(index.often(), "key").groupBy("_text").agg(F.collect_set("key").alias("_keys"))
    joined = docs.withColumn("_text", F.xxhash64("text")).join(keys, "_text", "left").drop("_text")
    return _cut(joined, sent, shards)


def _cut(docs: DataFrame, sent, shards: int) -> DataFrame:
    """The texts without their frequent lines: those of the row's ``_keys``, or else of the keys that were sent."""
    names = [n for n in docs.columns if n != "_keys"]
    kind = docs.select(*[f"`{n}`" for n in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, exact = sent.value
        lookup = Lookup(slots, shards)
        known = None if exact is None else frozenset(exact[i:i + 16] for i in range(0, len(exact), 16))
        for b in batches:
            at = b.schema.get_field_index("text")
            column = b.column(at).to_pylist()
            keys = list(map(line_keys, column))
            if known is None:
                often = [set(x.as_py() or ()) for x in b.column(b.schema.get_field_index("_keys"))]
                gone = [[k in own for k in ks] for ks, own in zip(keys, often)]
            else:
                flat = [k for ks in keys for k in ks if k]
                hits = {flat[i] for i in np.flatnonzero(lookup.maybe(flat)).tolist()} & known
                gone = [[k in hits for k in ks] for ks in keys]
            texts, lines, dropped = [], [], []
            for t, flags in zip(column, gone):
                texts.append("\n".join(x for x, out in zip(t.split("\n"), flags) if not out) if any(flags) else t)
                lines.append(len(flags))
                dropped.append(sum(flags))
            columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(kind))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*kind.names, "n_lines", "n_dropped"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    order = [*[f"`{n}`" for n in names], *(["_keys"] if "_keys" in docs.columns else [])]
    return docs.select(*order).mapInArrow(run, f"{ddl}, n_lines long, n_dropped long")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = without_frequent_lines(docs, LineIndex.of(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_line_reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts after documents are inserted and others deleted: the index of all documents, the conversations'
    turns put in, and the documents without a language label of English taken out again."""
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    out = docs.where(~F.col("lang").eqNullSafe("en"))
    index = LineIndex.of(docs).insert(turns.select("text")).delete(out.select("text"))
    slots, shards = index.sent_filters(1 << 62), index.shards
    sent = spark.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value, shards)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lookup.maybe(b.column(0).to_pylist()))], ["key", "n", "in_filter"])

    # every key of the threshold is in its filter; of the others a few may seem to be
    checked = index.counts.mapInArrow(run, "key binary, n long, in_filter boolean")
    often = F.col("n") >= index.least
    return checked.groupBy("n").agg(F.count("*").alias("n_keys"), F.count_if(often & ~F.col("in_filter")).alias("n_lost")).select(
        F.col("n").alias("n_docs"), "n_keys", "n_lost")


#: The same in DuckDB.
OP8_COUNTS_SQL = """
WITH t AS (SELECT text FROM documents WHERE lang = 'en' UNION ALL SELECT text FROM conversations),
r AS (SELECT row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS lines FROM t),
k AS (SELECT DISTINCT row, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT row, unnest(lines) AS line FROM r)),
c AS (SELECT key, count(*) AS n FROM k WHERE key <> '' GROUP BY key)
SELECT n::BIGINT AS n_docs, count(*)::BIGINT AS n_keys, 0::BIGINT AS n_lost FROM c GROUP BY n
"""
#: The same in DuckDB.
OP8_SQL = """
WITH l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
           FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, true AS often FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(often)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY row
"""
