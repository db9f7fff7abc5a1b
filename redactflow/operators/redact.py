"""Redaction of document rows: replacements, splice, metadata, pseudonyms,
term replacement, merged (overlap-free) form and annotation.

All operators take the row's entity array in document order (s, e, window)
and work on the row, so redaction adds no shuffle to the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactflow.functions.arrays import first_of_groups, fold_collect, group_starts, let, memoized, sort_structs
from redactflow.functions.masks import mask_full, mask_partial, mask_placeholder, pseudonym_prefix, replacement
from redactflow.functions.text import cut_text, html_escape, slice_of

REDACTION_ORDER = [("s", True), ("e", False), ("window_id", False)]
DOCUMENT_ORDER = [("s", False), ("e", False), ("window_id", False)]


def redaction_order(entities: Column) -> Column:
    """Start descending; equal starts keep document order (end, window ascending)."""
    return sort_structs(entities, REDACTION_ORDER)


def document_order(entities: Column) -> Column:
    return sort_structs(entities, DOCUMENT_ORDER)


def _named_keys(entities: Column) -> Column:
    """``array<struct<i, text, entity_type, name, members>>``: the distinct (text, type)
    keys by first encounter in redaction order, their names, and where in ``entities`` they occur.

    First encounter numbers a key; its number counts the names handed out so
    far that start with the same ``USER_<TYP>`` prefix, so types sharing their
    first three letters share one counter.  Keys are found by one sort and cut
    out as slices of it, so the work is that of sorting the entities.
    """
    def entry(x: Column, i: Column) -> Column:
        return F.struct(x["text"].alias("text"), x["entity_type"].alias("entity_type"), i.alias("i"), x["j"].alias("j"))

    placed = F.transform(entities, lambda x, j: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["window_id"].alias("window_id"), x["text"].alias("text"), x["entity_type"].alias("entity_type"), j.alias("j")))
    entries = F.array_sort(F.transform(sort_structs(placed, REDACTION_ORDER), entry))

    def keys(b: Column) -> Column:
        n = F.size(b["sorted"])

        def key(p: Column, g: Column) -> Column:
            first = F.element_at(b["sorted"], p)
            width = F.coalesce(F.get(b["starts"], g + 1), n + 1) - p
            return F.struct(pseudonym_prefix(first["entity_type"]).alias("prefix"), first["i"].alias("i"), first["text"].alias("text"),
                            first["entity_type"].alias("entity_type"), p.alias("p"), width.alias("width"))

        return F.array_sort(F.transform(b["starts"], key))  # by prefix, then first encounter

    def named(b: Column) -> Column:
        prefixes = F.transform(b["keys"], lambda k: k["prefix"])
        firsts = let(prefixes, lambda p: F.transform(F.array_distinct(p), lambda x: F.struct(x.alias("prefix"), F.array_position(p, x).cast("int").alias("start"))))

        def name(firsts: Column) -> Column:  # a key's number is its distance from its prefix's first (there are as many prefixes as types at most)
            return F.transform(b["keys"], lambda k, i: F.struct(
                k["i"].alias("i"), k["text"].alias("text"), k["entity_type"].alias("entity_type"),
                F.concat(k["prefix"], F.lit("_"), (i + 2 - F.element_at(F.filter(firsts, lambda s: s["prefix"] == k["prefix"]), 1)["start"]).cast("string")).alias("name"),
                F.transform(F.slice(b["sorted"], k["p"], k["width"]), lambda e: e["j"]).alias("members")))

        return F.array_sort(let(firsts, name))

    with_starts = lambda e: F.struct(e.alias("sorted"), group_starts(e, ["text", "entity_type"]).alias("starts"))
    with_keys = lambda b: F.struct(b["sorted"].alias("sorted"), keys(b).alias("keys"))
    return let(let(let(entries, with_starts), with_keys), named)


@memoized
def with_replacements(entities: Column, mode: str, pseudonymize: bool = False) -> Column:
    """Add a ``replacement`` field to each entity (array in any order)."""
    if mode not in ("full", "placeholder", "partial") and pseudonymize:
        def body(arr: Column) -> Column:
            names = F.flatten(F.transform(_named_keys(arr), lambda k: F.transform(k["members"], lambda j: F.struct(j.alias("j"), k["name"].alias("name")))))
            return F.zip_with(arr, F.array_sort(names), lambda x, y: x.withField("replacement", y["name"]))

        return let(entities, body)
    return F.transform(entities, lambda x: x.withField(
        "replacement", replacement(mode, x["text"], x["entity_type"])))


#: Settled text that the overlapping splice carries along before it puts it aside.
CARRY = 4096


def splice_fold(text: Column, entities_redaction_order: Column) -> Column:
    """Replace spans one by one in redaction order, slicing the current text by
    the original offsets (exact even when spans overlap).

    Everything right of the last replaced start is settled but for its first
    characters: a later span that reaches past that start cuts into them, never
    deeper than the longest span.  So the fold carries only that head; text
    behind it goes to a list, and the work is linear in text and spans.
    """
    def over(pieces: Column, n: Column, spans: Column, reach: Column) -> Column:
        init = F.struct(n.alias("at"), F.lit("").alias("head"), F.array().cast("array<string>").alias("done"))

        def step(acc, x):
            gap = slice_of(pieces, x["e"], acc["at"])
            rest = F.when(x["e"] > acc["at"], F.substring(acc["head"], x["e"] - acc["at"] + 1, 2147483647)).otherwise(acc["head"])

            def placed(head: Column) -> Column:
                long = F.length(head) > reach + CARRY
                return F.struct(
                    x["s"].alias("at"), F.when(long, F.substring(head, F.lit(1), reach)).otherwise(head).alias("head"),
                    F.when(long, F.concat(acc["done"], F.array(F.substring(head, reach + 1, F.lit(2147483647))))).otherwise(acc["done"]).alias("done"))

            return let(F.concat(x["replacement"], gap, rest), placed)

        return F.aggregate(spans, init, step, lambda acc: F.concat(
            slice_of(pieces, F.lit(0), acc["at"]), acc["head"], F.array_join(F.reverse(acc["done"]), "")))

    bound = F.struct(cut_text(text).alias("pieces"), F.length(text).alias("n"), entities_redaction_order.alias("spans"))
    return let(bound, lambda b: F.when(F.size(b["spans"]) == 0, text).otherwise(
        let(F.array_max(F.transform(b["spans"], lambda x: x["e"] - x["s"])), lambda reach: over(b["pieces"], b["n"], b["spans"], reach))))


def _splice(text: Column, spans: Column, gap_form) -> Column:
    """Gaps (through ``gap_form``) and replacements of non-overlapping spans joined, linear in text and spans."""
    def body(b: Column) -> Column:
        arr, pieces = b["spans"], b["pieces"]

        def piece(x, i):
            prev_end = F.when(i == 0, F.lit(0)).otherwise(F.element_at(arr, F.greatest(i, F.lit(1)))["e"])
            return F.concat(gap_form(slice_of(pieces, prev_end, x["s"])), x["replacement"])

        last_end = F.element_at(arr, -1)["e"]
        return F.concat(F.array_join(F.transform(arr, piece), ""), gap_form(slice_of(pieces, last_end, b["n"])))

    return let(spans, lambda arr: F.when(F.size(arr) == 0, gap_form(text)).otherwise(
        let(F.struct(arr.alias("spans"), cut_text(text).alias("pieces"), F.length(text).alias("n")), body)))


def splice_linear(text: Column, entities_document_order: Column) -> Column:
    """One pass over non-overlapping spans in document order."""
    return _splice(text, entities_document_order, lambda gap: gap)


def has_overlap(entities_document_order: Column) -> Column:
    """True if some span starts before the previous one ends (or shares its start)."""
    def body(arr: Column) -> Column:
        return F.exists(F.sequence(F.lit(2), F.greatest(F.size(arr), F.lit(2))), lambda i: (
            (F.size(arr) >= 2)
            & ((F.try_element_at(arr, i)["s"] < F.try_element_at(arr, i - 1)["e"])
               | (F.try_element_at(arr, i)["s"] == F.try_element_at(arr, i - 1)["s"]))))

    return let(entities_document_order, body)


@memoized
def redact_text(text: Column, entities_with_replacement: Column) -> Column:
    """Redacted text, same result as the ordered splice; uses the linear form
    when no spans overlap."""
    def body(arr: Column) -> Column:
        return let(document_order(arr), lambda doc: F.when(
            has_overlap(doc), splice_fold(text, redaction_order(arr))).otherwise(splice_linear(text, doc)))

    return let(entities_with_replacement, body)


@memoized
def redaction_metadata(entities_with_replacement: Column, timestamp: Column | None = None,
                       include_original: bool = True) -> Column:
    """One struct per redaction in redaction order."""
    def one(x):
        fields = []
        if include_original:
            fields.append(x["text"].alias("original_text"))
        fields += [
            x["entity_type"].alias("entity_type"),
            x["replacement"].alias("replacement"),
            F.struct(x["s"].alias("start"), x["e"].alias("end")).alias("position"),
            x["confidence"].alias("confidence"),
        ]
        if timestamp is not None:
            fields.append(timestamp.alias("timestamp"))
        return F.struct(*fields)

    return F.transform(redaction_order(entities_with_replacement), one)


# ---- overlap-free forms -------------------------------------------------------

def merge_overlaps(entities_document_order: Column) -> Column:
    """Islands of overlapping spans: ``array<struct<s, e, n, entity_type>>``;
    the island keeps the type of its first span (document order)."""
    def islands(b: Column) -> Column:
        def one(p: Column, g: Column) -> Column:
            width = F.coalesce(F.get(b["starts"], g + 1), F.size(b["spans"]) + 1) - p
            first, end = F.element_at(b["spans"], p), F.array_max(F.transform(F.slice(b["spans"], p, width), lambda x: x["e"]))
            return F.struct(first["s"].alias("s"), end.alias("e"), width.alias("n"), first["entity_type"].alias("entity_type"))

        return F.transform(b["starts"], one)

    def body(arr: Column) -> Column:
        # the fold carries the furthest end so far and collects the places where an island starts
        def step(reach: Column, y: Column) -> tuple[Column, Column, Column]:
            return F.greatest(reach, y["e"]), reach.isNull() | (y["s"] >= reach), y["i"]

        ends = F.transform(arr, lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), (i + 1).alias("i")))
        return F.struct(arr.alias("spans"), fold_collect(ends, F.lit(None).cast("int"), step, "int").alias("starts"))

    return let(let(entities_document_order, body), islands)


def redact_merged(text: Column, entities: Column, mode: str) -> Column:
    """Merge overlapping spans, then replace each island once (linear splice)."""
    islands = merge_overlaps(document_order(entities))
    if mode != "placeholder":  # the other masks are made of the island's text
        islands = let(cut_text(text), lambda cut: F.transform(islands, lambda x: x.withField("text", slice_of(cut, x["s"], x["e"]))))
    else:
        islands = F.transform(islands, lambda x: x.withField("text", F.lit("")))
    with_repl = with_replacements(islands, mode if mode in ("full", "placeholder", "partial") else "full")
    return splice_linear(text, with_repl)


def greedy_nonoverlap(entities_document_order: Column) -> Column:
    """Left to right, skip a span starting before the end of the last kept one."""
    def body(arr: Column) -> Column:
        # the fold collects places, not spans
        def step(end: Column, y: Column) -> tuple[Column, Column, Column]:
            keep = y["s"] >= end
            return F.when(keep, y["e"]).otherwise(end), keep, y["i"]

        spans = F.transform(arr, lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), (i + 1).alias("i")))
        return F.transform(fold_collect(spans, F.lit(0), step, "int"), lambda i: F.element_at(arr, i))

    return let(entities_document_order, body)


def annotate_spans(text: Column, entities: Column) -> Column:
    """Escaped text with ``<mark title="TYPE">span<sup>TYPE</sup></mark>`` around
    the spans kept by ``greedy_nonoverlap`` (ordered by start, stable)."""
    kept = greedy_nonoverlap(document_order(entities))
    marked = let(cut_text(text), lambda cut: F.transform(kept, lambda x: x.withField("replacement", F.concat(
        F.lit('<mark title="'), html_escape(x["entity_type"]), F.lit('">'),
        html_escape(slice_of(cut, x["s"], x["e"])),
        F.lit("<sup>"), html_escape(x["entity_type"]), F.lit("</sup></mark>")))))

    return _splice(text, marked, html_escape)


def term_replacements(metadata: Column, mode: str) -> Column:
    """Distinct original texts, longest first, each with its replacement; when a
    term has several types the last metadata row decides."""
    def repl(term: Column, etype: Column) -> Column:
        if mode == "placeholder":
            return mask_placeholder(etype)
        if mode == "partial":
            return mask_partial(term)
        return mask_full(term)

    def body(md: Column) -> Column:
        # one sort brings a term's rows together, the last one first
        rows = F.transform(md, lambda m, i: F.struct(m["original_text"].alias("term"), (-i).alias("i"), m["entity_type"].alias("entity_type")))
        return first_of_groups(F.array_sort(F.filter(rows, lambda r: F.length(r["term"]) > 0)), ["term"])

    def ordered(rows: Column) -> Column:
        by_length = F.array_sort(F.transform(rows, lambda r: F.struct((-F.length(r["term"])).alias("n"), r["term"].alias("term"), r["entity_type"].alias("entity_type"))))
        return F.transform(by_length, lambda r: F.struct(r["term"].alias("term"), repl(r["term"], r["entity_type"]).alias("repl")))

    return let(let(metadata, body), ordered)


def redact_terms(text: Column, terms: Column) -> Column:
    """Replace every occurrence of each term anywhere in the text, longest first."""
    return F.aggregate(terms, text, lambda acc, t: F.replace(acc, t["term"], t["repl"]))


def pseudonym_entries(entities: Column) -> Column:
    """The document's pseudonym dictionary as
    ``array<struct<k: struct<text, entity_type>, n: name>>`` (each key once, by
    first encounter), read from the row: no shuffle to deduplicate."""
    return F.transform(_named_keys(entities), lambda k: F.struct(
        F.struct(k["text"].alias("text"), k["entity_type"].alias("entity_type")).alias("k"), k["name"].alias("n")))
