"""Phrases whose words occur together more often than by chance.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and
those into words at blanks and tabs; all counts are per language.  Phrases are
found level by level, as by Apriori: a phrase is a candidate only if its first
and its last words, one fewer each, are frequent phrases.

Words are counted first; frequent ones get numbers, and every document is written
once as the row of its words' numbers, 0 for a break or a rare word.  At each
further level a double-array trie of the frequent phrases of the level below is
broadcast.  A task walks it from all positions of its numbers at once.  Where the
states of two neighbouring positions both accept, the phrases overlap in all but
their outer words: that is an Apriori-safe candidate, and it is counted at its
pair of accepting states.  The shards' counts are packed by the hash of the
candidate and added up bucket by bucket.  Candidates are taken from
the text instead of being enumerated beforehand, since a very common word
alone would pair each of its predecessors with each of its successors.

A trie holds about ``trie_phrases`` phrases at most, which bounds the broadcast; of
more phrases several tries are made, one pass over the numbers for each, and a
candidate then needs its first words to be frequent and its last word too.  A phrase
belongs to one trie, so its counts are whole in each.  The same holds for the
words' numbers: ``dictionary_words`` at most in a broadcast, with a pass for each.
Both give the same counts.

Null and empty texts hold no words; a null language is ``und``; null and equal
ids are never looked at; equal rows count each; an empty table gives no rows; columns besides text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactflow.llm.common import binary_bytes, byte_class, lower_bytes, mix, row_steps, stage, table, text_bytes, word_dictionary, words_within
from redactflow.llm.double_array import DoubleArray

LEAST_COUNT = 100
LONGEST = 5
FIRST = 2000
TRIE_PHRASES = 1 << 20
DICTIONARY_WORDS = 1 << 20
HELD_KEYS = 1 << 21
STEP_CODES = 1 << 22
BUCKET_WORDS = 1 << 21
BREAK = byte_class(*".,;:!?", "\x0a-\x0d")
BLANK = byte_class(" ", "\t") | BREAK


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


class Words:
    """The words of some rows: each one's distinct (language, word), whether a break is before it, and each row's first word."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        raw, offsets = text_bytes(texts)
        raw = lower_bytes(raw)
        starts, ends = words_within(raw, offsets, BLANK)
        breaks = np.append(0, np.cumsum(BREAK[raw]))
        self.first = np.searchsorted(starts, offsets)
        before = np.append(0, breaks[ends[:-1]]) if len(ends) else ends
        self.broken = breaks[starts] > before
        self.broken[self.first[:-1][self.first[:-1] < len(starts)]] = True
        coded = word_dictionary(raw, starts, ends)
        langs = langs.dictionary_encode()
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(self.first))
        size = max(1, len(coded.dictionary))
        pairs, self.pair, self.count = np.unique(lang * size + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
        self.langs = langs.dictionary.take(pa.array(pairs // size))
        self.words = coded.dictionary.take(pa.array(pairs % size))


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in groups of bounded size (a longer text comes alone)."""
    for b in batches:
        _, offsets = text_bytes(b["text"])
        for i, j in row_steps(offsets, 1 << 22):
            yield b.slice(i, j - i)


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """lang, word (bytes), f of every word found ``least`` times or more; a row without word has the count of all words of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            w = Words(b["lang"], b["text"])
            yield pa.RecordBatch.from_arrays([w.langs, w.words.cast(pa.binary()), pa.array(w.count)], ["lang", "word", "n"])
            langs, lang = np.unique(w.langs.to_numpy(zero_copy_only=False), return_inverse=True)
            if len(langs):
                n = np.bincount(lang, w.count).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.nulls(len(n), pa.binary()), pa.array(n)], ["lang", "word", "n"])

    counted = texts.mapInArrow(run, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | F.col("word").isNull())


def shards(rows: DataFrame, key: list[str], most: int) -> Iterator[pa.Table]:
    """The rows on the driver, ``most`` at a time on average, dealt by the hash of the key."""
    n = -(-rows.count() // most)
    for k in range(n):
        yield rows.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k).toArrow()


def numbered(spark: SparkSession, words: DataFrame, most: int) -> tuple[DataFrame, list[Broadcast]]:
    """Every frequent word's number, from 1 on, as a table (lang, word, id, f) and as dictionaries to broadcast."""
    parts, dictionaries, base = [], [], 0
    for t in shards(words, ["lang", "word"], most):
        t = t.append_column("id", pa.array(np.arange(base + 1, base + 1 + len(t)), pa.int32()))
        parts.append(stage(spark.createDataFrame(t), "words"))
        dictionaries.append(spark.sparkContext.broadcast((t["lang"].combine_chunks().dictionary_encode(), t["word"].combine_chunks(), base + 1)))
        base += len(t)
    return reduce(DataFrame.unionByName, parts), dictionaries


_dictionary: tuple[object, dict] = (None, {})


def dictionary_of(shared: Broadcast) -> dict[str, dict[bytes, int]]:
    """language -> word -> number; the worker keeps the last one."""
    global _dictionary
    if _dictionary[0] is not shared.value:
        langs, words, base = shared.value
        names = langs.dictionary.to_pylist()
        out: dict[str, dict[bytes, int]] = {x: {} for x in names}
        for k, (lang, word) in enumerate(zip(langs.indices.to_numpy().tolist(), words.to_numpy(zero_copy_only=False).tolist()), base):
            out[names[lang]][word] = k
        _dictionary = (shared.value, out)
    return _dictionary[1]


def numbers_of(texts: DataFrame, dictionaries: list[Broadcast]) -> DataFrame:
    """codes of each document: its words' numbers (little-endian 32-bit), 0 at its start, for every break and for words without a number."""
    out = texts
    for k, shared in enumerate(dictionaries):
        last = k + 1 == len(dictionaries)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k, last=last) -> Iterator[pa.RecordBatch]:
            known = dictionary_of(shared)
            for b in steps(batches):
                w = Words(b["lang"], b["text"])
                ids = [known.get(x, {}).get(y, 0) for x, y in zip(w.langs.to_numpy(zero_copy_only=False).tolist(), w.words.to_numpy(zero_copy_only=False).tolist())]
                code = np.array(ids, np.int32)[w.pair] if ids else np.zeros(0, np.int32)
                if k:  # what earlier dictionaries gave
                    code |= np.frombuffer(b"".join(b["codes"].to_pylist()), "<i4")
                if not last:
                    cut = pa.array(4 * w.first, pa.int32())
                    codes = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, cut.buffers()[1], pa.py_buffer(code.astype("<i4"))])
                    yield pa.RecordBatch.from_arrays([b["lang"], b["text"], codes], ["lang", "text", "codes"])
                    continue
                yield pa.RecordBatch.from_arrays([with_breaks(code, w.broken, w.first)], ["codes"])

        columns = ["lang", "text"] + (["codes"] if k else [])
        out = stage(out.select(*columns).mapInArrow(run, "codes binary" if last else "lang string, text string, codes binary"), "codes")
    return out


def with_breaks(code: np.ndarray, broken: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each row's numbers with a 0 before every word that a break is before; runs of 0 shrink to one."""
    breaks = np.append(0, np.cumsum(broken))
    bound = first + breaks[first]  # where each row begins among the numbers with breaks
    full = np.zeros(bound[-1], "<i4")
    full[np.arange(len(code)) + breaks[1:]] = code
    keep = full > 0
    keep[1:] |= full[:-1] > 0
    keep[bound[bound < len(full)]] = True
    cut = pa.array(4 * np.append(0, np.cumsum(keep))[bound], pa.int32())
    return pa.BinaryArray.from_buffers(pa.binary(), len(first) - 1, [None, cut.buffers()[1], pa.py_buffer(full[keep])])


def longer_phrases(codes: DataFrame, phrases: np.ndarray, both: bool, least: int, buckets: int) -> DataFrame:
    """w1..wk and f of the frequent phrases that go on from ``phrases``.  ``both``:
    ``phrases`` are all the frequent ones of their length, so a candidate's last words must be among them as well.

    A task packs its candidates' numbers and counts into one row for each of ``buckets``
    (by the hash of the candidate), and the rows of a bucket are added up together."""
    k = phrases.shape[1] + 1
    shared = codes.sparkSession.sparkContext.broadcast((DoubleArray(phrases), phrases))
    names = [f"w{i + 1}" for i in range(k)]

    def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bucket = (mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        key, n = key[order], n[order]
        parts = [(np.diff(key[i:j], prepend=0).astype("<i8").tobytes(), n[i:j].astype("<i8").tobytes()) for i, j in zip(cut[some].tolist(), cut[some + 1].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], ["bucket", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, size = shared.value[0], [], 0
        for b in batches:
            codes = binary_bytes(b.column(0)).view("<i4")
            for at in range(0, len(codes), STEP_CODES):
                numbers = np.append(codes[at:at + STEP_CODES + k], np.zeros(k, "<i4"))
                state = trie.walk(numbers)
                here = np.flatnonzero(state[:min(STEP_CODES, len(codes) - at)] >= 0)
                if both:
                    here = here[state[here + 1] >= 0]
                follow = numbers[here + k - 1]
                here, follow = here[follow > 0], follow[follow > 0]
                held.append(np.unique(state[here] << 32 | follow, return_counts=True))
                size += len(held[-1][0])
                if size > HELD_KEYS:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > HELD_KEYS // 2:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*summed(held))

    def add(t: pa.Table) -> pa.Table:
        held = [(np.cumsum(np.frombuffer(x, "<i8")), np.frombuffer(n, "<i8")) for x, n in zip(t["keys"].to_pylist(), t["counts"].to_pylist())]
        key, n = summed(held)
        key, n = key[n >= least], n[n >= least]
        words = shared.value[1][key >> 32]
        return pa.table([*(pa.array(words[:, i], pa.int32()) for i in range(k - 1)), pa.array(key & 0xFFFFFFFF, pa.int32()), pa.array(n)], [*names, "f"])

    packed = codes.mapInArrow(run, "bucket long, keys binary, counts binary")
    return packed.groupBy("bucket").applyInArrow(add, ", ".join(f"{x} int" for x in names) + ", f long")


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return key, np.bincount(place, np.concatenate([h[1] for h in held]), len(key)).astype(np.int64)


def frequent_phrases(spark: SparkSession, texts: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST,
                     trie_phrases: int = TRIE_PHRASES, dictionary_words: int = DICTIONARY_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases: lang, w (word numbers), f, of 1 to ``longest`` words; words: id, word; totals: lang, n) of ``texts`` (lang, text)."""
    counted = stage(word_counts(texts, least), "word_counts")
    totals = counted.where("word is null").select("lang", F.col("f").alias("n"))
    # a bucket holds a few million of the positions' candidates, whatever their number
    buckets = max(16, (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS)
    words = counted.where("word is not null")
    if words.isEmpty():
        none = spark.createDataFrame([], "lang string, w array<int>, f long")
        return none, spark.createDataFrame([], "id int, word string"), totals
    vocabulary, dictionaries = numbered(spark, words, dictionary_words)
    codes = numbers_of(texts, dictionaries)
    below, key = vocabulary.select(F.col("id").alias("w1"), "f"), ["w1"]
    levels = [below]
    for k in range(2, longest + 1):
        found = []
        single = below.count() <= trie_phrases
        for t in shards(below.select(*key), key, trie_phrases):
            phrases = np.stack([t[c].to_numpy() for c in key], 1).astype(np.int64).reshape(-1, k - 1)
            phrases = phrases[np.lexsort(phrases.T[::-1])]
            if len(phrases):
                found.append(stage(longer_phrases(codes, phrases, single, least, buckets), "phrases"))
        key = [f"w{i + 1}" for i in range(k)]
        if not found:
            break
        below = reduce(DataFrame.union, found)
        levels.append(below)
    arrays = [x.select(F.array(*[c for c in x.columns if c != "f"]).alias("w"), "f") for x in levels]
    langs = vocabulary.select(F.col("id").alias("_id"), "lang")
    phrases = reduce(DataFrame.union, arrays).join(langs, F.get("w", F.lit(0)) == F.col("_id")).select("lang", "w", "f")
    return stage(phrases, "levels"), vocabulary.select("id", F.col("word").cast("string").alias("word")), totals


def scored(phrases: DataFrame, totals: DataFrame, absorb: int = 100) -> DataFrame:
    """lang, w, a, l, r, n, score of every phrase of two words or more, at its weakest cut,
    unless a longer one takes it in that has ``absorb`` per cent of its count or more.
    (One longer by one word is enough to look at: it has at least the count of any longer still.)"""
    longer = phrases.where(F.size("w") > 1)
    cut = longer.select("lang", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.withColumn("left", F.slice("w", F.lit(1), F.col("k"))).withColumn("right", F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")))
    count = lambda name, f: phrases.select(F.col("w").alias(name), F.col("f").alias(f))
    floor = F.expr("(cast(1000 as decimal(4,0)) * (cast(a as decimal(17,0)) * cast(n as decimal(17,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    cut = cut.join(count("left", "l"), "left").join(count("right", "r"), "right").join(totals, "lang").withColumn("score", floor)
    best = cut.groupBy("w").agg(F.min(F.struct("score", "k", "lang", "a", "l", "r", "n")).alias("x")).select("w", "x.*")
    inner = longer.where(F.size("w") > 2).select("f", F.explode(F.array(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1))).alias("w"))
    inner = inner.groupBy("w").agg(F.max("f").alias("most"))
    kept = best.join(inner, "w", "left").where(F.col("most").isNull() | (100 * F.col("most") < absorb * F.col("a")))
    return kept.select("lang", "w", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def spelled(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with the phrase of the word numbers ``w``, joined by one space."""
    parts = rows.select("w", F.posexplode("w").alias("pos", "id")).join(words, "id")
    text = parts.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return rows.join(text, "w")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, first: int = FIRST, absorb: int = 100, **limits: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` phrases by score, count and spelling."""
    phrases, words, totals = frequent_phrases(spark, texts_of(docs), least, longest, **limits)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = scored(phrases, totals, absorb).withColumn("rank", F.rank().over(order)).where(F.col("rank") <= first)  # with ties
    order = order.orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled(near, words).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
c AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
cut AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, j, array_to_string(list_slice(string_split(c.phrase, ' '), 1, j), ' ') AS lp,
         array_to_string(list_slice(string_split(c.phrase, ' '), j + 1, c.k), ' ') AS rp
  FROM c, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE j < c.k),
s AS (
  SELECT cut.lang, cut.phrase, cut.k, a, l.f AS l, r.f AS r, n.n, j, ((1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut JOIN c l ON l.lang = cut.lang AND l.phrase = lp JOIN c r ON r.lang = cut.lang AND r.phrase = rp JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT * FROM b WHERE NOT EXISTS (
    SELECT 1 FROM c y WHERE y.lang = b.lang AND y.k > b.k AND y.f * 100 >= 100 * b.a AND contains(' ' || y.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
