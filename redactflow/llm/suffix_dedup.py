"""Removal of repeated byte strings: every byte under a string of ``length``
bytes that also starts earlier in the corpus goes.

A suffix array cut at ``length`` bytes puts equal strings side by side; it is
built block by block, from a cover of sample positions whose names are computed
first.

1.  Cover.  The sample is chosen by content: of the ``anchor``-byte strings in
    each window the one with the least hash is its anchor.  As in a difference
    cover, equal windows hold a sample at equal offsets, and so resolve their
    ties by the sample's name; but one position in 37 is a sample, where a
    cover by position needs one in eight.  Neighbouring windows with one anchor
    are a run, which its anchor and its bytes name.
2.  Counting.  Anchors are counted over the corpus.  A bit sketch, sized by the
    corpus's bytes, tells the second scan which anchors recur; it may name too many, never too few.
3.  Within a task a run that repeats an earlier one is settled at once; only the
    first of each goes to the shuffle, so a passage of a third of all documents
    sends one row per batch.
4.  Suffix buckets.  Runs are dealt to buckets by anchor, and one bucket is
    sorted at a time: equal runs follow each other, and all but the first are
    repeats.  Where an anchor has different runs, the first of each fetches its
    bytes, and the windows are sorted by name in buckets of their own.  An
    anchor with very many runs (what surrounds a very common line) leaves the
    buckets: its runs and windows are grouped one by one by distributed aggregations.
5.  The repeated ranges of a document are joined to its text and cut out.  The
    texts are shuffled once, for this join and for fetching the bytes.

Positions count as earlier by doc_id, then by offset.  Null and empty texts
have no bytes.  Equal rows with one doc_id are one document; different texts
under one doc_id are documents of their own, in the order of their hashes.  Rows
without doc_id stay whole and count as nowhere.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.llm.common import SpanHash, row_steps, stage, table, text_bytes

LENGTH, ANCHOR = 100, 28
#: A longer document is scanned in blocks of this many bytes (a run never spans two).
BLOCK = 1 << 21
_POSITION = np.uint64(24)


def runs(raw: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """Runs of windows with one anchor: anchor hash, run hash, row, start in ``raw``, windows; and the hasher."""
    hashed = SpanHash(raw)
    empty = np.zeros(0, np.int64)
    if len(raw) < length:
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, hashed
    at = np.arange(len(raw) - anchor + 1)
    names = hashed(at, at + anchor)
    least = (names >> _POSITION << _POSITION) | at.astype(np.uint64)
    width, size = length - anchor + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[:size - width], least[width - size:])
    sample = (least & np.uint64((1 << 24) - 1)).astype(np.int64)  # of each window
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(sample)]
    whole = np.arange(len(sample)) + length <= offsets[row + 1]  # windows never cross documents
    begins = whole.copy()
    begins[1:] &= (sample[1:] != sample[:-1]) | ~whole[:-1]
    start = np.flatnonzero(begins)
    breaks = np.flatnonzero(np.append(begins | ~whole, True))
    windows = breaks[np.searchsorted(breaks, start, "right")] - start
    return names[sample[start]], hashed(start, start + windows - 1 + length), row[start], start, windows, hashed


def scanned(batch: pa.RecordBatch, length: int, anchor: int):
    """Per step of a batch (doc_id, text): its bytes, and of its runs the anchor and run hashes, row, offset in the row, start, windows."""
    raw, at = text_bytes(batch.column(1))
    for i, j in row_steps(at):
        for block in range(at[i], max(at[j] - length + 1, at[i] + 1), BLOCK) if j == i + 1 else (at[i],):
            end = min(at[j], block + BLOCK + length - 1) if j == i + 1 else at[j]
            part = raw[block:end]
            edges = np.array([0, len(part)]) if j == i + 1 else at[i:j + 1] - block
            a, s, row, start, windows, _ = runs(part, edges, length, anchor)
            yield part, a, s, row + i, start + block - at[row + i], start, windows


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges, per document number."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(doc * span + end)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * span + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - doc[first] * span


def later(*keys: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each key's first place (by document, offset), and of those that repeat it elsewhere."""
    order = np.lexsort((at, doc, *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = order[np.flatnonzero(new)]
    own = first[np.cumsum(new) - 1]
    other = (doc[order] != doc[own]) | (at[order] != at[own])
    return first, order[other]


#: Bits of the sketch: four for each anchor that the corpus is expected to have, 128 MB at most.
LEAST_BITS, MOST_BITS = 20, 30


def sketch_bits(n_bytes: int, length: int, anchor: int) -> int:
    """An anchor comes every (length - anchor + 2) / 2 bytes on average."""
    anchors = 2 * n_bytes // (length - anchor + 2)
    return min(MOST_BITS, max(LEAST_BITS, (4 * anchors).bit_length()))


def recurring(docs: DataFrame, length: int, anchor: int, bits: int) -> bytes:
    """A sketch of ``2**bits`` bits: anchors that recur.  Half a hash counts an
    anchor while halves seldom meet (a larger corpus takes whole ones): two that
    share it are marked without need, which costs rows and no result."""
    wide = bits > 28

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, a, *_ in scanned(b, length, anchor):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if wide else (a >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["a"])

    seen = docs.mapInArrow(run, "a long" if wide else "a int").groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    chunk = min(bits, 19)
    place = F.shiftrightunsigned("a", (64 if wide else 32) - bits)
    marks = seen.select(F.shiftright(place, chunk).cast("int").alias("chunk"), place.bitwiseAND((1 << chunk) - 1).alias("bit"))

    def build(b: pd.DataFrame) -> pd.DataFrame:
        bit = np.zeros(1 << chunk, np.uint8)
        bit[b["bit"].to_numpy()] = 1
        return pd.DataFrame({"chunk": b["chunk"].iloc[:1], "again": [np.packbits(bit, bitorder="little").tobytes()]})

    again, width = bytearray(1 << (bits - 3)), 1 << (chunk - 3)
    for r in marks.groupBy("chunk").applyInPandas(build, "chunk int, again binary").toLocalIterator():
        again[r["chunk"] * width:(r["chunk"] + 1) * width] = r["again"]
    return bytes(again)


def _has(sketch: np.ndarray, a: np.ndarray, bits: int) -> np.ndarray:
    place = (a >> np.uint64(64 - bits)).astype(np.int64)
    return (sketch[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def open_runs(docs: DataFrame, length: int, anchor: int, bits: int) -> DataFrame:
    """doc_id, start, windows, a, s: runs whose anchor recurs.  ``a`` is null where the task
    itself has seen an earlier equal run (then [start, start + windows + length - 1) is a repeat)."""
    sent = docs.sparkSession.sparkContext.broadcast(recurring(docs, length, anchor, bits))
    names = ["doc_id", "start", "windows", "a", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            found = []
            for _, a, s, row, start, _, windows in scanned(b, length, anchor):
                keep = _has(again, a, bits)
                found.append([x[keep] for x in (a, s, row, start, windows)])
            if not found:
                continue
            a, s, row, start, windows = (np.concatenate([f[k] for f in found]) for k in range(5))
            order = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)[1]
            first, repeats = later(a, s, doc=order[row], at=start)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[first])), *(pa.array(x[first].view(np.int64)) for x in (start, windows, a, s))], names)
            doc, lo, hi = merged(row[repeats], start[repeats], start[repeats] + windows[repeats] + length - 1)
            none = pa.nulls(len(doc), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(lo), pa.array(hi - lo - length + 1), none, none], names)

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, start long, windows long, a long, s long")


def sorted_runs(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """doc_id, start, windows, a: sorts buckets of runs.  ``a`` is null for a repeat, and
    set for the first of each run where its anchor has different ones; single runs go."""
    buckets = -(-rows.count() // bucket_rows) or 1

    def resolve(b: pd.DataFrame) -> pd.DataFrame:
        a, s, start, windows = (b[c].to_numpy(np.int64) for c in ("a", "s", "start", "windows"))
        doc = np.unique(b["doc_id"].to_numpy(), return_inverse=True)[1]
        first, repeats = later(a, s, doc=doc, at=start)
        # firsts are in order of (anchor, run)
        own, several = a[first], np.zeros(len(first), bool)
        several[1:] |= own[1:] == own[:-1]
        several[:-1] |= own[1:] == own[:-1]
        first = first[several]
        both = np.concatenate([repeats, first])
        marks = pd.array(np.concatenate([np.zeros(len(repeats), np.int64), a[first]]), "Int64")
        marks[:len(repeats)] = pd.NA
        return pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[both], "start": start[both], "windows": windows[both], "a": marks})

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(resolve, f"doc_id {dict(rows.dtypes)['doc_id']}, start long, windows long, a long")


def crowded_runs(rows: DataFrame) -> DataFrame:
    """The same for anchors with very many rows, by aggregation and join: no group meets in one task."""
    first = stage(rows.groupBy("a", "s").agg(F.min(F.struct("doc_id", "start")).alias("first")), "first")
    placed = rows.join(first, ["a", "s"])
    place = F.struct("doc_id", "start")
    return placed.select("doc_id", "start", "windows", F.when(place == F.col("first"), F.col("a")).alias("a"))


def window_names(texts: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the runs: run number, place in the run, name."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    which = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[which] + place
    return which, place, SpanHash(raw)(at, at + length)


def with_bytes(open_: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """doc_id, start, windows, a, crowded and the run's bytes: one row per document is joined to its text."""
    runs_of = open_.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "a", "crowded")).alias("runs"))
    joined = docs.join(runs_of, "doc_id").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(b.column(1))
            for i in range(0, b.num_rows, 200):
                lists = b.column(2).slice(i, 200)
                flat = lists.flatten()
                start, windows, a, crowded = flat.flatten()
                row = np.repeat(np.arange(i, i + len(lists)), lists.value_lengths().to_numpy())
                lo = at[row] + start.to_numpy()
                texts = [raw[x:y].tobytes() for x, y in zip(lo.tolist(), (lo + windows.to_numpy() + length - 1).tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), start, windows, a, crowded, pa.array(texts, pa.binary())], ["doc_id", "start", "windows", "a", "crowded", "bytes"])

    return joined.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, start long, windows long, a long, crowded boolean, bytes binary")


def sorted_windows(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Repeated ranges (doc_id, start, end): sorts the windows of one bucket of runs at a time."""

    def resolve(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("a", kind="stable")
        a, start, windows = (b[c].to_numpy(np.int64) for c in ("a", "start", "windows"))
        ids, doc = np.unique(b["doc_id"].to_numpy(), return_inverse=True)
        texts, out, at = b["bytes"].to_numpy(), [], 0
        while at < len(b):  # runs of whole anchors at a time: bounds the windows in memory
            stop = min(len(b), at + 20_000)
            while stop < len(b) and a[stop] == a[stop - 1]:
                stop += 1
            which, place, name = window_names([bytes(x) for x in texts[at:stop]], windows[at:stop], length)
            run = which + at
            _, repeats = later(a[run], name, doc=doc[run], at=start[run] + place)
            out.append((doc[run][repeats], (start[run] + place)[repeats], (start[run] + place)[repeats] + length))
            at = stop
        doc, lo, hi = merged(*(np.concatenate([x[k] for x in out]) for k in range(3)))
        return pd.DataFrame({"doc_id": ids[doc], "start": lo, "end": hi})

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(resolve, f"doc_id {dict(rows.dtypes)['doc_id']}, start long, end long")


def crowded_windows(rows: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many runs, by a distributed aggregation per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 5000):
                doc_id, start, windows, a, texts = b.slice(i, 5000).columns
                which, place, name = window_names(texts.to_pylist(), windows.to_numpy(), length)
                yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(which)), pa.array(start.to_numpy()[which] + place), a.take(pa.array(which)), pa.array(name.view(np.int64))], ["doc_id", "start", "a", "name"])

    kind = dict(rows.dtypes)["doc_id"]
    seen = rows.select("doc_id", "start", "windows", "a", "bytes").mapInArrow(run, f"doc_id {kind}, start long, a long, name long")
    first = stage(seen.groupBy("a", "name").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "name", "first"), "first")
    again = seen.join(first, ["a", "name"]).where(F.struct("doc_id", "start") != F.col("first"))
    return again.select("doc_id", "start", (F.col("start") + length).alias("end"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, bits: int | None = None, bucket_rows: int = 10_000, crowded: int = 4_000) -> DataFrame:
    """doc_id, ranges (start, end; they may overlap) of the bytes to remove, for documents that have any.  A doc_id stands for one text."""
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    if bits is None:
        bits = sketch_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, length, anchor)
    rows = stage(open_runs(docs, length, anchor, bits), "runs")
    span = F.col("start") + F.col("windows") + (length - 1)
    settled = rows.where(F.col("a").isNull()).select("doc_id", "start", span.alias("end"))
    rows = rows.where(F.col("a").isNotNull())
    many = stage(rows.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("a"), "crowded")
    few = sorted_runs(rows.join(many, "a", "left_anti"), bucket_rows).withColumn("crowded", F.lit(False))
    busy = crowded_runs(stage(rows.join(many, "a", "left_semi"), "busy")).withColumn("crowded", F.lit(True))
    judged = stage(few.union(busy), "judged")
    repeats = judged.where(F.col("a").isNull()).select("doc_id", "start", span.alias("end"))
    fetched = stage(with_bytes(judged.where(F.col("a").isNotNull()), docs, length), "fetched")
    buckets = -(-fetched.count() // bucket_rows) or 1
    windows = sorted_windows(fetched.where("not crowded"), length, buckets).union(crowded_windows(fetched.where("crowded"), length))
    found = settled.union(repeats).union(windows)
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def document_keys(docs: DataFrame) -> Column:
    """What tells the documents apart and puts them in order: doc_id, unless some id has several
    texts; then doc_id and the text's hash as bytes that sort alike."""
    text = F.xxhash64("text")
    several = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b")
    if several.isEmpty():
        return F.col("doc_id")
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        return F.unhex(F.concat(digits(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), digits(text)))
    return F.unhex(F.concat(F.hex(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit("00"), digits(text)))


def without_repeats(docs: DataFrame, length: int = LENGTH, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    docs = docs.withColumn("key", document_keys(docs))
    ranges = stage(repeated_ranges(docs.select(F.col("key").alias("doc_id"), "text"), length, **settings), "ranges").withColumnRenamed("doc_id", "at_doc")
    joined = docs.join(ranges, F.col("key") == F.col("at_doc"), "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(b.column(1))
            sizes, removed, spans, kept = np.diff(at), [], [], []
            for i, ranges in enumerate(b.column(2)):
                text = raw[at[i]:at[i + 1]]
                if ranges.is_valid:
                    values = ranges.values.flatten()
                    change = np.zeros(len(text) + 1, np.int32)
                    np.add.at(change, np.minimum(values[0].to_numpy(), len(text)), 1)
                    np.add.at(change, np.minimum(values[1].to_numpy(), len(text)), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    text = text[~gone]
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(text.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB (windows by the md5 of their bytes, read as hexadecimal digits from parts of 512 bytes).
OP7_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, o, substr(h, 2 * o + 1, 1222) AS part FROM (SELECT r, h, unnest(range(0, greatest(length(h) // 2 - 99, 0), 512)) AS o FROM d)),
w AS MATERIALIZED (SELECT r, o + k AS s, md5_number(substr(part, 2 * k + 1, 200)) AS x
                   FROM (SELECT *, unnest(range(0, least(512, length(part) // 2 - 99))) AS k FROM b)),
f AS (SELECT x, min(r * 1000000000000 + s) AS first FROM w GROUP BY x HAVING count(*) > 1),
rep AS (SELECT r, s FROM w JOIN f USING (x) WHERE r * 1000000000000 + s > first),
cut AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM rep),
runs AS (SELECT r, min(s) AS a, max(s) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY s) AS k FROM cut) GROUP BY r, k),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS h
         FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.h, '') || substr(d.h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
