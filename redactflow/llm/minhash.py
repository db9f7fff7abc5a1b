"""Near-duplicate classes of documents by one-permutation hashing.

1.  A document's set is its distinct five-word shingles (64-bit hashes).  Rows
    with equal sets form a class, which one document stands for from here on.
2.  One permutation: the hash range is cut into bins and each bin keeps its
    least hash.  An empty bin takes the value of another bin, which a fixed
    random sequence of its own picks (optimal densification), so small sets
    still give independent signature entries.
3.  Bands of the signature are bucket keys.  Two sets of similarity 0.75 miss
    each other in all 32 bands of 4 entries with a probability of 5e-6.
4.  A bucket emits a star: one edge from its centre to each other class.  Every
    edge is confirmed on the full sets.
5.  Confirmed edges give components.  Classes of one bucket that lie in
    different components could still be linked by a pair that no star held;
    those pairs, and only those, are then confirmed as well.

Null, empty and blank texts have empty sets and are linked with nothing.  Rows
without a doc_id are linked with nothing and kept.  Rows that share a doc_id
are one node, linked if any of their texts is.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.llm.common import mix, shingle_set, stage, table, text_bytes
from redactflow.llm.components import components

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
#: For each bin the sequence of bins it asks for a value when empty.
_DONORS = np.random.default_rng(20240602).integers(0, BINS, (BINS, 24 * BINS))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One least hash per bin of a sorted, non-empty set; empty bins are densified."""
    first = np.searchsorted(shingles, _EDGES)
    last = np.append(first[1:], len(shingles))
    full = last > first
    values = shingles[np.minimum(first, len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    width = 64
    while len(empty):
        donors = _DONORS[empty, :width]
        found = full[donors]
        pick = found.argmax(axis=1)
        ok = found[np.arange(len(empty)), pick]
        if width >= _DONORS.shape[1]:  # practically never: take the next full bin
            order = np.flatnonzero(full)
            values[empty] = values[order[np.searchsorted(order, empty) % len(order)]]
            break
        values[empty[ok]] = values[donors[ok, pick[ok]]]
        empty = empty[~ok]
        width = min(width * 8, _DONORS.shape[1])
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, distinct between bands."""
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        key = mix(key + values[k::ROWS])
    return key


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (16 bytes, null without words), bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(b.column(1))
            sizes, ids, bands = [], [], []
            for i in range(b.num_rows):
                s = shingle_set(raw[at[i]:at[i + 1]], WORDS)
                sizes.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(signature(s)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "bands"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id binary, bands array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have a similarity of ``percent`` or more."""
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    both = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None  # rows of one centre follow each other
        for batch in batches:
            (raw_a, at_a), (raw_b, at_b) = text_bytes(batch.column(2)), text_bytes(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                text = raw_a[at_a[i]:at_a[i + 1]].tobytes()
                if text != last:
                    last, last_set = text, shingle_set(raw_a[at_a[i]:at_a[i + 1]], WORDS)
                other = shingle_set(raw_b[at_b[i]:at_b[i + 1]], WORDS)
                if 100 * min(len(last_set), len(other)) < percent * max(len(last_set), len(other)):
                    continue
                common = len(np.intersect1d(last_set, other, assume_unique=True))
                keep[i] = common and 100 * common >= percent * (len(last_set) + len(other) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    kind = dict(pairs.dtypes)["a"]
    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The set's hashes as bits, 4096 of them or, for more than 1024 shingles, 65536."""
    bits = np.zeros(4096 if len(shingles) <= 1024 else 65536, np.uint8)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def unsettled_pairs(buckets: DataFrame, parts: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of one bucket but of two components that could still be links.

    Two bounds from above spare most members of a large family of edited copies,
    and neither drops a link: a shingle that no other document of these buckets
    has can't be common to two of them, and a shingle whose bit is missing in
    another document's bitmap is missing in that document.  Pairs that fail
    them are never emitted.
    """
    placed = buckets.join(parts, "node", "left").select("key", "node", "centre", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    left = stage(placed.join(stage(mixed, "mixed"), "key"), "left")
    texts = docs.join(left.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            for i in range(0, batch.num_rows, 200):
                sets = [shingle_set(raw[at[k]:at[k + 1]], WORDS) for k in range(i, min(i + 200, batch.num_rows))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 200), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x) for x in sets], pa.list_(pa.int64())),
                     pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "n", "bits", "shingles"])

    kind = dict(docs.dtypes)["doc_id"]
    sets = stage(texts.select("doc_id", "text").mapInArrow(run, f"node {kind}, n long, bits array<long>, shingles array<long>"), "shingles")
    alone = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    alone = alone.where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    sizes = sets.select("node", "n", "bits").join(alone, "node", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    rows = left.join(sizes.where(100 * F.col("common") >= percent * F.col("n")), "node")
    rows = stage(rows.select("key", "node", "centre", "component", "n", "common", "bits"), "rows")
    one = rows.withColumnRenamed("node", "a")
    two = rows.select("key", F.col("node").alias("b"), F.col("component").alias("b_component"), F.col("n").alias("b_n"), F.col("common").alias("b_common"), F.col("bits").alias("b_bits"))
    enough = lambda most: 100 * most >= percent * (F.col("n") + F.col("b_n") - most)
    absent = F.aggregate(F.zip_with("bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda x, y: x + y)
    bound = F.when(F.size("bits") == F.size("b_bits"), enough(F.col("n") - absent)).otherwise(F.lit(True))
    pairs = one.join(two, (one["key"] == two["key"]) & (F.col("a") < F.col("b")) & (F.col("component") != F.col("b_component"))
                     & (F.col("a") != F.col("centre")) & enough(F.least("common", "b_common")) & bound)
    return stage(pairs.select("a", "b").distinct(), "pairs")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    sets = stage(document_sets(docs), "sets")
    known = sets.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = stage(known.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "classes")
    rows = classes.select(F.explode("bands").alias("key"), "node")
    centres = stage(rows.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("most")).where("centre < most").select("key", "centre"), "centres")
    buckets = stage(rows.join(centres, "key"), "buckets")
    stars = buckets.where("node > centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    # from here on only documents of shared buckets matter
    near = docs.select("doc_id", "text").join(buckets.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    near = stage(near.where(F.col("text").isNotNull()), "near")
    # an id that several classes have links them
    several = known.select("doc_id", "set_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    shared = known.join(several, "doc_id").join(classes.select("set_id", "node"), "set_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = stage(confirmed(stars, near).union(shared).where("a != b"), "links")
    parts = stage(components(links), "parts")
    links = links.union(confirmed(unsettled_pairs(buckets, parts, near), near))
    parts = stage(components(links), "parts")

    home = stage(classes.select("set_id", "node").join(parts, "node", "left").select("set_id", F.coalesce("component", "node").alias("component")), "home")
    return sets.join(home, "set_id", "left").select(
        "doc_id", "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same in DuckDB, by all pairs that share a shingle.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.root),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
