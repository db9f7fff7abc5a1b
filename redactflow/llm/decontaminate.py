"""Benchmark passages in documents, found with a bounded number of edits.

Texts are compared as their letters and digits, lower-cased, every other run
of characters one space.  An item of m characters may be met with k edits (a
fixed share of m).  Pigeonhole: cut into k + 1 pieces, the item still has one
piece without an edit wherever it occurs, so exact hits of all pieces (one
automaton over all items) lead to every occurrence.  Each hit fixes a narrow
band of the text, and Myers' bit-parallel algorithm verifies the item's edit
distance there, one machine step per character over the whole item.

Only the benchmark goes to the tasks, and its size is checked; a larger one is
cut into groups of items, and each group scans the documents on its own.  Texts are
scanned one by one, so neither a hot source nor a group of copies gathers
anywhere.  Null and blank texts and items match nothing; an item shorter than
``least_chars`` is met without edits and as whole words only, as others would match by chance.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.llm.common import table

EDIT_SHARE = 0.07
LEAST_CHARS = 40
GROUP_CHARS = 8 << 20
_OTHER = re.compile(r"[\W_]+")
#: Letters of scripts that put no blanks between words (Thai to Lao, Burmese, Khmer, Chinese and Japanese).
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def plain(text: str | None) -> str:
    """Lower-cased letters and digits, all else one space."""
    return _OTHER.sub(" ", unicodedata.normalize("NFC", text or "").lower()).strip()


def word_edge(text: str, at: int) -> bool:
    """Whether a word may begin or end before position ``at`` of a plain text."""
    return at in (0, len(text)) or " " in text[at - 1:at + 1] or _UNSPACED.search(text, at - 1, at + 1) is not None


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """(least distance, end) over all substrings of ``text``; ends early below nothing over ``most``.

    One bit per pattern character: ``plus`` and ``minus`` hold where a column's
    distances rise and fall from one row to the next.
    """
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        same = where.get(c, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        rise, fall = minus | (full & ~(diagonal | plus)), plus & diagonal
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        vertical = same | minus
        plus, minus = fall | (full & ~(vertical | rise)), rise & vertical
        if distance < best:
            best, at = distance, j + 1
            if best == 0:
                break
    return (best, at) if best <= most else (m, 0)


@dataclass(frozen=True)
class Items:
    """Items as (id, plain text, edits), ready to be searched for."""

    items: tuple[tuple[int, str, int], ...]
    short: tuple[tuple[int, str], ...] = ()  # (id, plain text) of those that are met without edits, as whole words

    @classmethod
    def of(cls, rows: list[tuple[int, str]], edit_share: float, least_chars: int) -> Items:
        texts = [(i, plain(t)) for i, t in rows]
        long = tuple((i, t, int(edit_share * len(t))) for i, t in texts if t and len(t) >= least_chars)
        return cls(long, tuple((i, t) for i, t in texts if 0 < len(t) < least_chars))

    def automaton(self) -> ahocorasick.Automaton:
        """Pieces of all items, each with (item number, offset of the piece in the item); short ones are whole, numbered after the others."""
        a = ahocorasick.Automaton()
        for n, (_, text) in enumerate(self.short, len(self.items)):
            a.add_word(text, [*a.get(text, []), (n, 0, len(text))])
        for n, (_, text, edits) in enumerate(self.items):
            cuts = [len(text) * k // (edits + 1) for k in range(edits + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                piece = text[lo:hi]
                a.add_word(piece, [*a.get(piece, []), (n, lo, hi)])
        if len(a):
            a.make_automaton()
        return a

    def matches(self, automaton, text: str) -> dict[int, tuple[int, int]]:
        """item id -> (distance, end in the plain text) of its closest occurrence within its edits."""
        if not len(automaton):
            return {}
        found: dict[int, tuple[int, int]] = {}
        done: dict[int, list[int]] = {}  # item -> where bands already verified begin
        for end, places in automaton.iter(text):
            for n, lo, hi in places:
                if n >= len(self.items):
                    item = self.short[n - len(self.items)][0]
                    if found.get(item, (1, 0))[0] and word_edge(text, end + 1 - hi) and word_edge(text, end + 1):
                        found[item] = 0, end + 1
                    continue
                item, pattern, edits = self.items[n]
                start = end + 1 - hi  # of the item, were there no edit
                if found.get(item, (1, 0))[0] == 0 or any(abs(start - x) <= edits for x in done.get(n, ())[-8:]):
                    continue
                done.setdefault(n, []).append(start)
                begin = max(0, start - 2 * edits)
                distance, at = myers(pattern, text[begin:start + len(pattern) + 2 * edits], edits)
                if distance <= edits and distance < found.get(item, (edits + 1, 0))[0]:
                    found[item] = distance, begin + at
        return found


def item_groups(benchmark: DataFrame, edit_share: float, least_chars: int, group_chars: int = GROUP_CHARS) -> Iterator[Items]:
    """The items in groups of at most ``group_chars`` characters: what one scan sends to the tasks."""
    rows, size = [], 0
    for r in benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct().toLocalIterator():
        if rows and size + len(r["text"]) > group_chars:
            yield Items.of(rows, edit_share, least_chars)
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield Items.of(rows, edit_share, least_chars)


def leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The columns of ``docs`` with items (ids of the benchmark items found, ascending),
    distances and ends (in the plain text), which take the place of columns of those names."""
    out = docs.drop("items", "distances", "ends")
    empty = F.array().cast("array<long>")
    out = out.withColumns({"items": empty, "distances": empty, "ends": empty})
    for group in item_groups(benchmark, edit_share, least_chars):
        out = _scan(out, group)
    return out


def _scan(docs: DataFrame, group: Items) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(group)
    three = ["items", "distances", "ends"]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = sent.value.automaton()
        for batch in texts:
            rows = []
            for t in batch:
                found = sorted(sent.value.matches(automaton, plain(t)).items())
                rows.append(([i for i, _ in found], [d for _, (d, _) in found], [e for _, (_, e) in found]))
            yield pd.DataFrame(rows, columns=three)

    search = F.pandas_udf(run, "struct<items: array<long>, distances: array<long>, ends: array<long>>")
    found = docs.withColumn("_found", search(F.col("text")))
    return found.withColumns({c: F.concat(F.col(c), F.col("_found")[c]) for c in three}).drop("_found")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), "items", "distances", "ends", (F.size("items") > 0).alias("contaminated"))
