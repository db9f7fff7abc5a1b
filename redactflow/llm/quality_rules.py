"""Quality rules as a ledger of failure bits, in DataFrame functions only.

Each rule is evaluated once over the whole text; its bit and the measurements
behind it are stored.  A policy is a named version that says which rules count
(a bit mask), so policies can change, and their ablations be computed, without
reading a text again.

Null texts have no words; empty and blank texts likewise (they fail the base
rules).  Rows repeat as often as they come; no key, line or word is grouped
across rows, so there is nothing that could be skewed and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.llm.common import stage, table

WINDOW = 8
_BLANK = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often (and in whatever lambda) it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words that the text holds twice or more, the first one included."""
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        repeats = let(ordered, lambda o: F.filter(o, lambda x, i: (F.get(o, i - 1)["h"] == x["h"]) | (F.get(o, i + 1)["h"] == x["h"])))
        starts = F.array_sort(F.transform(repeats, lambda x: x["at"]))
        runs = let(starts, lambda p: F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))))
        return F.aggregate(runs, F.lit(0), lambda a, x: a + x)

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) > window, counted).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(
        "doc_id", text.alias("text"),
        F.array_remove(F.split(text, "[ \\x09-\\x0D]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_BLANK)) != "").alias("lines"),
    )
    return cut.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )


_M = F.col
#: The rules: name -> its failure as an expression over the measurements.  A rule's bit is its place.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: _M("n_words") < 20,
    "repeated_windows": lambda: 100 * _M("n_repeat_words") > 30 * _M("n_words"),
    "symbols": lambda: 100 * _M("n_symbols") > 30 * _M("n_words"),
    "repeated_lines": lambda: 100 * _M("n_dup_lines") > 60 * _M("n_lines"),
    "short_words": lambda: _M("word_chars") < 2 * _M("n_words"),
    "long_words": lambda: _M("word_chars") > 20 * _M("n_words"),
    "upper_case": lambda: 100 * _M("n_upper") > 50 * _M("word_chars"),
}
BASE = ("few_words", "repeated_windows")
#: Policy version -> the rules that count in it.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in POLICIES[policy])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``bits``: one failure bit per rule."""
    bits = F.lit(0).cast("long")
    for k, fails in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(fails(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("bits", bits)


def passes(policy: str) -> Column:
    return F.col("bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that fail nothing else
    (kept if the rule went), and the bits that fail together with it.  The rows
    are first counted by their bits, of which there are few."""
    by_bits = entries.groupBy(F.col("bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in enumerate(RULES) if name in POLICIES[policy]])
    each = by_bits.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.bit_or(F.when(fails, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias("fails_with"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), passes(CURRENT).alias("kept"), "n_lines", "n_upper", "bits")


def op6_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every policy version and each of its rules: the documents that fail it, those that only it fails, and what fails with it."""
    # the ledger is evaluated once; every policy reads its bits
    entries = stage(ledger(table(spark, sf_dir, "documents")).select("bits"), "ledger")
    out = [ablation(entries, policy).withColumn("policy", F.lit(policy)) for policy in POLICIES]
    return reduce(DataFrame.union, out).select("policy", "rule", "n_failed", "n_only", "fails_with")


#: The same in DuckDB.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
c AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS lines FROM d),
win AS (SELECT row, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM c)),
dup AS (SELECT row, w FROM win GROUP BY row, w HAVING count(*) > 1),
spots AS (SELECT DISTINCT row, unnest(range(i, i + 8)) AS at FROM win JOIN dup USING (row, w)),
rep AS (SELECT row, count(*) AS n FROM spots GROUP BY row),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper
      FROM c LEFT JOIN rep USING (row)),
b AS (SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (100 * n_symbols > 30 * n_words)::BIGINT
             + 8 * (100 * n_dup_lines > 60 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
             + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (100 * n_upper > 50 * word_chars)::BIGINT) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, n_lines, n_upper, bits FROM b
"""


def _ablation_sql() -> str:
    """The ablation in DuckDB, rule by rule over the documents' bits."""
    entries = OP6_SQL.strip()
    rules = " UNION ALL ".join(
        f"SELECT '{policy}' AS policy, '{name}' AS rule, {1 << k} AS bit, {mask(policy)} AS mask"
        for policy in POLICIES for k, name in enumerate(RULES) if name in POLICIES[policy])
    return f"""WITH e AS MATERIALIZED (SELECT bits FROM ({entries})), r AS ({rules})
SELECT policy, rule, count(*) FILTER (WHERE e.bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (WHERE e.bits & mask = bit)::BIGINT AS n_only,
       coalesce(bit_or(e.bits & mask) FILTER (WHERE e.bits & bit <> 0), 0)::BIGINT AS fails_with
FROM e CROSS JOIN r GROUP BY policy, rule"""


OP6_ABLATION_SQL = _ablation_sql()
