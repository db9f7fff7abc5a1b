"""Span detection, window dedup, rebase, document dedup, handle removal.

Everything here is an expression over the document row (arrays of structs),
so detection needs no shuffle: a document and all of its windows and spans
stay in the task that read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactflow.functions.arrays import first_of_groups, fold_collect, group_starts, let, sort_structs
from redactflow.functions.spans import find_spans, leading_span
from redactflow.functions.text import context_windows
from redactflow.operators.rules import NAME_BLOCKLIST, NAME_TOKEN_SHAPE, PY_SPACE_EXTRA, Rule
from redactflow.operators.scan import scan_windows

ENTITY_TYPE = T.StructType([
    T.StructField("s", T.IntegerType()),
    T.StructField("e", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("window_id", T.IntegerType()),
])
ENTITIES_TYPE = T.ArrayType(ENTITY_TYPE)

_TOKEN_SPLIT = rf"(?U)[\s{PY_SPACE_EXTRA}]+"


def looks_like_name(value: Column) -> Column:
    """2 to 4 whitespace-separated tokens, each letters (ASCII) with ' or -,
    none of them a blocked word."""
    blocked = F.array(*[F.lit(w) for w in NAME_BLOCKLIST])
    ok_token = lambda t: t.rlike("^" + NAME_TOKEN_SHAPE + "$") & ~F.array_contains(blocked, F.lower(t))
    return let(F.filter(F.split(F.trim(F.regexp_replace(value, _TOKEN_SPLIT, " ")), " "), lambda t: F.length(t) > 0),
               lambda tokens: (F.size(tokens) >= 2) & (F.size(tokens) <= 4) & F.forall(tokens, ok_token))


def _guarded(text: Column, rule: Rule, spans: Column) -> Column:
    g = rule.guard
    if g is None:
        return spans
    literal = g.isascii() and not any(c in g for c in "\\[](){}.*+?|^$") and not rule.ignore_case
    cond = text.contains(g) if (literal or g == "@") else text.rlike(rule.java_guard)
    return F.when(cond, spans).otherwise(F.array().cast(ENTITIES_TYPE))


def rule_entities(text: Column, rule: Rule, window_id: Column | None = None, mark: Column | None = None) -> Column:
    """Entities of one rule in ``text`` (window offsets); ``mark`` as in ``find_spans``."""
    raw = leading_span(text, rule.java) if rule.anchored else find_spans(text, rule.java, rule.group, mark)
    if rule.name_check:
        raw = F.filter(raw, lambda x: looks_like_name(x["text"]))
    wid = window_id if window_id is not None else F.lit(None).cast("int")
    tagged = F.transform(raw, lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["text"].alias("text"),
        F.lit(rule.entity_type).alias("entity_type"),
        F.lit(float(rule.confidence)).alias("confidence"),
        F.lit(rule.source).alias("source"),
        F.lit(rule.rank).cast("int").alias("rank"),
        wid.alias("window_id"),
    ))
    return _guarded(text, rule, tagged)


def union_detectors(text: Column, rules: Sequence[Rule], window_id: Column | None = None,
                    external: Column | None = None, mark: Column | None = None) -> Column:
    """Concatenation of all rule results in rule order, then external spans."""
    parts = [rule_entities(text, r, window_id, mark) for r in rules]
    if external is not None:
        parts.append(external)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def dedup_window_spans(entities: Column) -> Column:
    """Per exact (s, e): keep the highest confidence; ties go to the lowest rank
    (the first one emitted)."""
    srt = sort_structs(entities, [("s", False), ("e", False), ("confidence", True), ("rank", False)])
    return first_of_groups(srt, ["s", "e"])


def rebase(entities: Column, offset: Column) -> Column:
    return F.transform(entities, lambda x: x.withField("s", x["s"] + offset).withField("e", x["e"] + offset))


def external_by_window(external: Column, windows: Column, size: int, overlap: int) -> Column:
    """``struct<spans, at>``: the external spans (document offsets), once for each
    window that holds them, in window order, and where each window's lie.

    Which windows hold a span follows from its start and end, so no window is
    tested against the document's span list.  A marker for every window is
    sorted in before its spans; the markers' places are the windows' bounds.
    """
    step = size - overlap

    def held(x: Column, k: Column) -> Column:
        first = F.greatest(F.ceil((x["e"] - size) / step), F.lit(0)).cast("int")
        last = F.least(F.floor(x["s"] / step).cast("int"), F.size(windows) - 1)
        entry = lambda i: F.struct(i.alias("window_id"), k.alias("k"), x.alias("x"))
        return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), entry)).otherwise(F.array().cast(kind))

    kind = T.ArrayType(T.StructType([T.StructField("window_id", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("x", ENTITY_TYPE)]))
    markers = F.transform(windows, lambda w: F.struct(w["window_id"].alias("window_id"), F.lit(-1).alias("k"), F.lit(None).cast(ENTITY_TYPE).alias("x")))
    sorted_in = F.array_sort(F.concat(F.flatten(F.transform(external, held)), markers))
    return let(sorted_in, lambda r: F.struct(r.alias("spans"), F.filter(
        F.transform(r, lambda y, p: F.when(y["k"] < 0, p + 1)), lambda p: p.isNotNull()).alias("at")))


def external_in_window(placed: Column, w: Column) -> Column:
    """The external spans lying inside window ``w``, at window offsets: what a
    model run on the window text would have reported."""
    start = F.element_at(placed["at"], w["window_id"] + 1) + 1
    stop = F.coalesce(F.get(placed["at"], w["window_id"] + 1), F.size(placed["spans"]) + 1)
    return F.transform(F.slice(placed["spans"], start, stop - start), lambda y: y["x"].withField("s", y["x"]["s"] - w["start_char"])
                       .withField("e", y["x"]["e"] - w["start_char"]).withField("window_id", w["window_id"]))


# Necessary condition for every unanchored default rule: e-mail needs "@",
# the digit rules a (Unicode) digit, links "/" or "www.", labels ":" or "-",
# the registration label "reg" (any case; no other character folds to r, e,
# g or w).  A character class and two substring tests, far cheaper than the
# alternation of all rule guards.
DEFAULT_PREFILTER = "default-prefilter"
_PREFILTER_CLASS = r"[@:/\-\p{Nd}]"


def prefilter(text: Column, guard: str) -> Column:
    if guard == DEFAULT_PREFILTER:
        low = F.lower(text)
        return text.rlike(_PREFILTER_CLASS) | low.contains("reg") | low.contains("www.")
    return text.rlike(guard)


def combined_guard(rules: Sequence[Rule]) -> str | None:
    """One regex matching wherever any guarded rule could match, or ``None``
    when some unanchored rule has no guard.  Each rule implies its guard, so a
    window failing this test can hold hits of the anchored rules only."""
    from redactflow.operators.rules import DEFAULT_RULES

    defaults = {(r.pattern, r.ignore_case) for r in DEFAULT_RULES}
    if all((r.pattern, r.ignore_case) in defaults for r in rules if not r.anchored) and any(
            r.guard for r in rules if not r.anchored):
        return DEFAULT_PREFILTER
    parts = []
    for r in rules:
        if r.anchored:
            continue
        if r.guard is None:
            return None
        parts.append(("(?iU:" if r.ignore_case else "(?U:") + r.guard + ")")
    return "|".join(parts) if parts else None


def detect_windows(text: Column, rules: Sequence[Rule], size: int = 500, overlap: int = 100,
                   dedup: bool = True, external: Column | None = None) -> Column:
    """All windows' entities at document offsets, in window order.

    Most windows hold nothing: a window failing the combined guard evaluates
    only the anchored rules (one cheap anchored regex) instead of the whole
    rule set.  ``external``: optional array of entity structs at document
    offsets from another detector (a model); merged per window after the
    rules, before the window dedup, as the reference merges its model results."""
    step = size - overlap
    if step <= 0:
        raise ValueError("window overlap must be smaller than the window size")

    def settled(ents: Column, i: Column) -> Column:
        # one rule alone never reports one span twice: the dedup is needed only
        # when several detectors meet
        several = dedup and len(rules) + (external is not None) > 1
        return rebase(dedup_window_spans(ents) if several else ents, (i * step).cast("int"))

    # a column without lambdas: Spark doesn't take a Python function out of an expression whose input holds some
    found = scan_windows(rules, size, step, combined_guard(rules) == DEFAULT_PREFILTER)(F.make_valid_utf8(text))
    if external is not None:
        def by_window(doc: Column) -> Column:
            return F.transform(doc["windows"], lambda w: external_in_window(doc["external"], w))

        bound = let(context_windows(text, size, overlap), lambda ws: F.struct(ws.alias("windows"), external_by_window(external, ws, size, overlap).alias("external")))
        found = F.zip_with(found, let(bound, by_window), lambda ents, ext: F.concat(ents, ext))
    return F.flatten(F.transform(found, settled))


_KEY = ["s", "e", "entity_type", "text"]


def dedup_document_spans(entities: Column) -> Column:
    """Per (s, e, type, text): highest confidence, first window; ordered by
    (s, e, first window)."""
    def merged(b: Column) -> Column:
        def one(p: Column, g: Column) -> Column:
            width = F.coalesce(F.get(b["starts"], g + 1), F.size(b["sorted"]) + 1) - p
            highest = F.array_max(F.transform(F.slice(b["sorted"], p, width), lambda y: y["confidence"]))
            first = F.element_at(b["sorted"], p)
            return F.when(width == 1, first).otherwise(first.withField("confidence", highest))

        return F.when(b["sorted"].isNotNull(), F.transform(b["starts"], one))

    def body(arr: Column) -> Column:
        with_starts = let(arr, lambda a: F.struct(a.alias("sorted"), group_starts(a, _KEY).alias("starts")))
        return sort_structs(let(with_starts, merged), [("s", False), ("e", False), ("window_id", False)])

    # one sort brings a span's rows together, its first window first
    return body(sort_structs(entities, [(k, False) for k in _KEY] + [("window_id", False)]))


def drop_handles_in_urls(entities: Column) -> Column:
    """Remove PROFILE_HANDLE entities lying inside a URL entity of the document.

    In order of start (URLs before handles of the same start) a handle is
    inside a URL if the furthest URL end so far reaches its own end.  The
    others keep their order, that of ``dedup_document_spans``.
    """
    def body(arr: Column) -> Column:
        is_url = lambda x: x["entity_type"] == "URL"
        # (start, URLs first, end, handle or not, place) in natural order; the fold collects places, not entities
        order = F.array_sort(F.transform(arr, lambda x, i: F.struct(
            x["s"].alias("s"), F.when(is_url(x), 0).otherwise(1).alias("k"), x["e"].alias("e"), (x["entity_type"] == "PROFILE_HANDLE").alias("handle"), (i + 1).alias("i"))))

        def step(reach: Column, y: Column) -> tuple[Column, Column, Column]:
            return F.when(y["k"] == 0, F.greatest(reach, y["e"])).otherwise(reach), ~(y["handle"] & (reach >= y["e"])), y["i"]

        kept = F.transform(F.array_sort(fold_collect(order, F.lit(-1), step, "int")), lambda i: F.element_at(arr, i))
        both = F.exists(arr, is_url) & F.exists(arr, lambda x: x["entity_type"] == "PROFILE_HANDLE")
        return F.when(both, kept).otherwise(arr)

    return let(entities, body)


def length_confidence(text: Column) -> Column:
    """0.95 for texts longer than 3 characters, else 0.70 (scalar helper)."""
    return F.when(F.length(text) > 3, F.lit(0.95)).otherwise(F.lit(0.70))


def external_entities(s: Column, e: Column, text: Column, entity_type: Column, score: Column,
                      threshold: float, rank: int | Column = 12, source: str = "statistical") -> Column:
    """One external span as an entity struct, or null when its score is below
    the threshold (the model results obey the threshold)."""
    ent = F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), text.alias("text"),
                   entity_type.alias("entity_type"), score.cast("double").alias("confidence"),
                   F.lit(source).alias("source"), (F.lit(rank) if isinstance(rank, int) else rank).cast("int").alias("rank"),
                   F.lit(None).cast("int").alias("window_id"))
    return F.when(score >= threshold, ent)
