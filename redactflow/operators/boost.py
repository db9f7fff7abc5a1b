"""Confidence boost from nearby anchor words, and domain-pattern tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactflow.functions.text import CONTEXT_RADIUS, WHOLE, context_slice, context_slice_of, cut_text

# FIXED VALUES: anchor categories and their words, boost step and cap.
ANCHOR_WORDS = {
    "salary": ["amount", "income", "wage", "compensation", "payment"],
    "patient": ["patient", "medical", "diagnosis", "treatment", "hospital"],
    "account": ["account", "account_number", "balance", "transaction"],
    "identification": ["id", "passport", "driver", "license", "ssn"],
}
BOOST_STEP = 0.05
BOOST_CAP = 1.0


def anchor_boost(slice_lower: Column, held: Column | None = None) -> Column:
    """0.05 per category with any word occurring as a substring of the slice.

    Added one category at a time from 0.0, as the reference does, so the
    floating-point sums are the same.  ``held``: ``held_words`` of the whole text;
    words that it doesn't hold aren't looked for in the slice.
    """
    total = F.lit(0.0)
    for words in ANCHOR_WORDS.values():
        hit = None
        for w in words:
            c = slice_lower.contains(w)
            if held is not None:
                c = held[w] & c
            hit = c if hit is None else (hit | c)
        total = total + F.when(hit, F.lit(BOOST_STEP)).otherwise(F.lit(0.0))
    return total


def held_words(text: Column) -> Column:
    """``struct<word: boolean, ...>``: which anchor words the whole text holds."""
    from redactflow.functions.arrays import let

    return let(F.lower(text), lambda low: F.struct(*[low.contains(w).alias(w) for words in ANCHOR_WORDS.values() for w in words]))


def boosted_confidence(confidence: Column, text: Column, start: Column, end: Column,
                       radius: int = CONTEXT_RADIUS) -> Column:
    from redactflow.functions.arrays import let

    # the slice is bound once; it is tested against all anchor words
    return let(context_slice(text, start, end, radius),
               lambda sl: F.least(confidence + anchor_boost(sl), F.lit(BOOST_CAP)))


#: The boost of so many categories, added one after another.
_BOOSTS = [0.0]
for _ in ANCHOR_WORDS:
    _BOOSTS.append(_BOOSTS[-1] + BOOST_STEP)


def anchor_places(low: Column, held: Column) -> Column:
    """``array<struct<c, s, e>>``: where the anchor words of category ``c`` lie in a lower-cased text.
    A text is cut in front of each of its words (``held_words``), so overlapping ones are found too: every piece but the first begins with one."""
    def places(c: int, w: str) -> Column:
        def one(acc: Column, piece: Column) -> Column:
            found = F.struct(F.lit(c).alias("c"), acc["at"].alias("s"), (acc["at"] + len(w)).alias("e"))
            return F.struct((acc["at"] + F.length(piece)).alias("at"),
                            F.when((acc["at"] > 0) | low.startswith(w), F.concat(acc["got"], F.array(found))).otherwise(acc["got"]).alias("got"))

        start = F.struct(F.lit(0).alias("at"), none.alias("got"))
        return F.when(held[w], F.aggregate(F.split(low, f"(?={w})"), start, one, lambda acc: acc["got"])).otherwise(none)

    none = F.array().cast("array<struct<c:int,s:int,e:int>>")
    # a word that begins with another one of its category adds nothing
    words = [(c, w) for c, ws in enumerate(ANCHOR_WORDS.values()) for w in ws if not any(w != v and w.startswith(v) for v in ws)]
    return F.concat(*[places(c, w) for c, w in words])


def context_boost(entities: Column, text: Column, radius: int = CONTEXT_RADIUS) -> Column:
    """Boost every entity of the row's array; entities are never added or dropped.

    A short text's anchor words are looked up once and an entity takes those within its reach.
    A longer one is cut into chunks once, so each slice costs its own length only; so is one
    whose lower-cased form has other offsets.
    """
    from redactflow.functions.arrays import let

    def boosted(x: Column, boost: Column) -> Column:
        return x.withField("confidence", F.least(x["confidence"] + boost, F.lit(BOOST_CAP)))

    def by_slice(doc: Column, x: Column) -> Column:
        return boosted(x, let(context_slice_of(doc["pieces"], x["s"], x["e"], radius), lambda sl: anchor_boost(sl, doc["held"])))

    def by_place(places: Column, x: Column) -> Column:
        near = F.filter(places, lambda p: (p["s"] >= x["s"] - radius) & (p["e"] <= x["e"] + radius))
        categories = F.size(F.array_distinct(F.transform(near, lambda p: p["c"])))
        return boosted(x, F.element_at(F.array(*[F.lit(b) for b in _BOOSTS]), categories + 1))

    def of_text(found: Column, doc: Column) -> Column:
        short = (F.octet_length(text) <= WHOLE) & (F.length(doc["low"]) == F.length(text))
        return F.when(short, let(anchor_places(doc["low"], doc["held"]), lambda places: F.transform(found, lambda x: by_place(places, x)))).otherwise(
            let(F.struct(cut_text(text).alias("pieces"), doc["held"].alias("held")), lambda d: F.transform(found, lambda x: by_slice(d, x))))

    # the entities are bound first: unbound, the whole detection would be planned and run at each use
    return let(entities, lambda found: F.when(F.size(found) == 0, found).otherwise(
        let(F.struct(F.lower(text).alias("low"), held_words(text).alias("held")), lambda doc: of_text(found, doc))))


def domain_pattern_lookup(patterns: DataFrame, domain: str) -> DataFrame:
    """Patterns of one domain as (pattern_name, regex, boost); for a repeated
    name the row with the highest id wins."""
    return (patterns.where(F.col("domain") == domain)
            .groupBy("pattern_name")
            .agg(F.max_by(F.struct(F.col("pattern_regex").alias("regex"),
                                   F.col("confidence_boost").alias("boost")), F.col("id")).alias("p"))
            .select("pattern_name", F.col("p.regex").alias("pattern_regex"),
                    F.col("p.boost").alias("confidence_boost")))


def apply_domain_boost(entities: DataFrame, patterns: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """Add the stored boost of every pattern of the entity's domain whose regex
    matches the entity text (capped at 1.0).

    ``entities`` needs ``domain``, ``text`` and ``confidence``.  Of rows with
    one domain and pattern name the one of the highest id counts.  The pattern
    table is packed into one array per domain and joined on ``domain``: it is
    broadcast only when its rows are within ``max_bytes``, so the entity side
    then never moves.
    """
    from redactflow.plans.joins import sized_broadcast

    latest = (patterns.groupBy("domain", "pattern_name")
              .agg(F.max_by(F.struct("pattern_regex", "confidence_boost"), F.col("id")).alias("p"))
              .select("domain", "p.pattern_regex", "p.confidence_boost"))
    packed = (latest.groupBy("domain")
              .agg(F.collect_list(F.struct("pattern_regex", "confidence_boost")).alias("_pats")))
    joined = entities.join(sized_broadcast(packed, max_bytes), "domain", "left")
    boost = F.aggregate(F.coalesce(F.col("_pats"), F.array().cast("array<struct<pattern_regex:string,confidence_boost:double>>")),
                        F.lit(0.0),
                        lambda acc, p: acc + F.when(F.regexp_like(F.col("text"), p["pattern_regex"]),
                                                    p["confidence_boost"]).otherwise(F.lit(0.0)))
    return (joined.withColumn("confidence", F.least(F.col("confidence") + boost, F.lit(BOOST_CAP)))
            .drop("_pats"))


def detect_domain_patterns(docs: DataFrame, patterns: DataFrame, domain: str, text_col: str = "text",
                           id_col: str = "doc_id", max_patterns: int = 200, max_bytes: int = 4 << 20) -> DataFrame:
    """Spans of the domain's stored patterns in each document (whole text):
    (id, pattern_name, start_char, end_char, text).

    Up to ``max_patterns`` patterns become literals of the plan (compiled
    once per task, no join).  More are found through an index of the literals
    that they need, broadcast up to ``max_bytes`` (see ``operators.patterns``):
    only patterns that can match a text are searched in it.  Both forms search alike and give the same spans.
    """
    from redactflow.operators.patterns import indexed_spans, literal_index, literal_spans

    pats = domain_pattern_lookup(patterns, domain)
    few = pats.limit(max_patterns + 1).collect()
    if len(few) <= max_patterns:
        return literal_spans(docs, [(p.pattern_name, p.pattern_regex) for p in few], text_col, id_col)
    return indexed_spans(docs, literal_index(pats), text_col, id_col, max_bytes, max_patterns or 200)
