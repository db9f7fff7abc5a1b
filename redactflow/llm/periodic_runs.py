"""Runs of words that repeat with a period, and texts with the repeats collapsed.

A run is a longest stretch of consecutive words in which words ``q`` apart are
equal, ``q`` being its smallest period, of ``max(least, power * q)`` words or more.

Frequency splitting comes first: a word of a run occurs ``power`` times in it,
so a word that occurs less often within its segment (at first the whole text)
is in no run and splits the segment there.  The pieces are counted anew, until
no segment changes; pieces of fewer than ``least`` words go.  Prose leaves next to nothing.

The lag scan then runs over what survives, for lags up to 8, 9 to 16, 17 to 32
and so on.  In the class of lags (k/2, k] each position is labelled with the
distance to the next equal window of k words; k words hold a whole period, so
within a run of period q that distance is q everywhere, and nowhere else.  A
stretch of equal labels therefore is a run, found once, with its smallest
period, at a cost of n log n for the class however many lags it spans.

Words are numbered exactly (by a dictionary, not by hashes).  Null and empty
texts, and texts of white space, have no words, no runs and an empty collapsed
text; equal rows, repeated and null ids stay rows of their own; an empty table
gives no rows; columns besides doc_id and text are not read.  A text is worked
on alone when it is longer than a step, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.functions.arrays import let
from redactflow.llm.common import byte_class, row_steps, table, text_bytes, word_numbers, words_within

LEAST_WORDS = 24
POWER = 3
BLANK = byte_class("\x20", "\x09-\x0d")


def rare_words_out(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int, power: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the segments that survive splitting at rare words, in order."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    n_words = int(words.max()) + 1 if len(words) else 1
    while len(starts):
        wide = lengths >= least
        starts, lengths = starts[wide], lengths[wide]
        if not len(starts):
            break
        at, segment = positions(starts, lengths)
        _, code, count = np.unique(segment * n_words + words[at], return_inverse=True, return_counts=True)
        often = count[code] >= power
        changed = np.zeros(len(starts), bool)
        changed[segment[~often]] = True
        done.append((starts[~changed], lengths[~changed]))
        live = often & changed[segment]
        at, segment = at[live], segment[live]
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(at) != 1) | (np.diff(segment) != 0)
        begin = np.flatnonzero(first)
        starts, lengths = at[begin], np.diff(np.append(begin, len(at)))
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, lengths = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(starts)
    return starts[order], lengths[order]


def positions(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the segments one after another, and the segment of each."""
    segment = np.repeat(np.arange(len(starts)), lengths)
    before = np.cumsum(lengths) - lengths
    return np.arange(len(segment)) + (starts - before)[segment], segment


def longer_windows(names: np.ndarray, left: np.ndarray, m: int, k: int) -> np.ndarray:
    """Names of the k-word windows from those of the m-word windows (m <= k <= 2m); -1 where fewer than k words are left."""
    out = np.full(len(names), -1, np.int64)
    at = np.flatnonzero(left >= k)
    if len(at):
        out[at] = np.unique(names[at] * (int(names.max()) + 1) + names[at + k - m], return_inverse=True)[1]
    return out


def lag_scan(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int, power: int) -> np.ndarray:
    """Rows (start, length, period) of all runs in the segments."""
    found = [np.zeros((0, 3), np.int64)]
    low, k, m = 0, least // power, 1
    at, segment = positions(starts, lengths)
    left = (starts + lengths)[segment] - at
    names = np.unique(words[at], return_inverse=True)[1].astype(np.int64) if len(at) else at
    while len(at):
        while m < k:
            m, names = min(2 * m, k), longer_windows(names, left, m, min(2 * m, k))
        whole = np.flatnonzero(names >= 0)
        order = whole[np.argsort(segment[whole] * (int(names.max()) + 1) + names[whole], kind="stable")]
        again = (names[order[1:]] == names[order[:-1]]) & (segment[order[1:]] == segment[order[:-1]])
        lag = np.zeros(len(at), np.int64)
        lag[order[:-1][again]] = (order[1:] - order[:-1])[again]
        label = np.where((lag > low) & (lag <= k), lag, 0)
        first = label > 0
        first[1:] &= (label[1:] != label[:-1]) | (segment[1:] != segment[:-1])
        begin = np.flatnonzero(first)
        stop = np.flatnonzero(np.append((label[1:] != label[:-1]) | (segment[1:] != segment[:-1]), True) & (label > 0))
        period = label[begin]
        length = stop - begin + k + period
        long = length >= np.maximum(least, power * period)
        found.append(np.stack([at[begin], length, period], 1)[long])
        low, k = k, 2 * k
        # a longer period repeats a window of these lengths too, and needs room for itself
        keep = np.zeros(len(starts), bool)
        keep[segment[lag > 0]] = True
        keep &= lengths >= power * (low + 1)
        live = keep[segment]
        at, left, names = at[live], left[live], names[live]
        segment = (np.cumsum(keep) - 1)[segment[live]]
        starts, lengths = starts[keep], lengths[keep]
    return np.concatenate(found)


def runs_of(words: np.ndarray, ends: np.ndarray, least: int = LEAST_WORDS, power: int = POWER) -> np.ndarray:
    """Rows (start, length, period), by start and period, of the texts that end before the word numbers ``ends``."""
    starts = np.append(0, ends[:-1]).astype(np.int64)
    runs = lag_scan(words, *rare_words_out(words, starts, ends - starts, least, power), least, power)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse_batch(column: pa.Array, least: int, power: int) -> list[pa.Array]:
    """n_words, runs and collapsed text of the rows of a text column."""
    raw, offsets = text_bytes(column)
    starts, ends = words_within(raw, offsets, BLANK)
    first = np.searchsorted(starts, offsets)  # the first word of each text
    runs = runs_of(word_numbers(raw, starts, ends), first[1:], least, power)
    text = np.searchsorted(first, runs[:, 0], "right") - 1
    # the words of a run after its first period go
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    # a kept word takes its bytes and one blank, the last one of a text its bytes alone
    of = np.searchsorted(first, kept, "right") - 1
    more = np.append(of[1:] == of[:-1], False) if len(kept) else np.zeros(0, bool)
    edge = np.zeros(len(raw) + 2, np.int8)
    edge[starts[kept]] += 1
    np.add.at(edge, ends[kept] + more, -1)
    take = np.cumsum(edge[:len(raw)]).astype(bool)
    out = np.where(BLANK[raw], np.uint8(0x20), raw)[take]
    size = np.append(0, np.cumsum(take))[offsets].astype(np.int32)
    collapsed = pa.StringArray.from_buffers(len(column), pa.py_buffer(size), pa.py_buffer(out))
    fields = [pa.array(x) for x in (runs[:, 0] - first[text], runs[:, 1], runs[:, 2])]
    lists = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(text, np.arange(len(column) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return [pa.array(np.diff(first)), lists, collapsed]


def collapse_runs(docs: DataFrame, least: int = LEAST_WORDS, power: int = POWER) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and collapsed
    (the words outside the repeats, joined by one space) of every row of ``docs``."""
    if power < 3 or least < 2 * power:
        raise ValueError("a run has at least three periods and six words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = text_bytes(b.column(1))
            for i, j in row_steps(offsets):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), *collapse_batch(part.column(1), least, power)], ["doc_id", "n_words", "runs", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, the first of equal ones; null without runs."""
    better = lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), better))


def looped_text(doc_id: Column, text: Column) -> Column:
    """The contract's planted loops: where the id's crc32 is a multiple of ten, the text's tail repeats a few of its words."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def loop(w: Column) -> Column:
        n = F.size(w)
        place = F.struct((g % n).cast("int").alias("a"))
        return let(place, lambda b: let((F.floor((n - b["a"]) / (3 + g % 8)) + 1).cast("int"), lambda p: F.array_join(F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.element_at(w, F.when(i < b["a"], i).otherwise(b["a"] + (i - b["a"]) % p) + 1)), " ")))

    return F.when((h % 10 == 0) & text.isNotNull(), let(words, lambda w: F.when(F.size(w) > 0, loop(w)).otherwise(text))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = collapse_runs(docs.select("doc_id", looped_text(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])
    lines = F.array_join(F.transform("runs", lambda x: F.concat(line(x), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
