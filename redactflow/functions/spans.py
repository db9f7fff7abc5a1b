"""Spans of regex matches as Spark column expressions (no UDF).

Spark has no "find all with positions".  ``regexp_extract_all`` over
``\\G((?s:.*?))(P)`` returns, for every match of ``P`` in order, the text
skipped since the previous match (group 1) and the match (group 2): the lazy
gap tries each next position in turn, which is exactly how ``find`` moves, and
``\\G`` ties every match to the end of the previous one.  A running sum over
gap and match lengths then gives code-point offsets.  The pattern is a
literal, so Spark compiles it once per task, not once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN_TYPE = T.StructType([
    T.StructField("s", T.IntegerType()),
    T.StructField("e", T.IntegerType()),
    T.StructField("text", T.StringType()),
])
SPANS_TYPE = T.ArrayType(SPAN_TYPE)


def _split_flags(java_pattern: str) -> tuple[str, str]:
    if java_pattern.startswith("(?") and ")" in java_pattern:
        head = java_pattern[: java_pattern.index(")") + 1]
        if head[2:-1].isalpha():
            return head, java_pattern[len(head):]
    return "", java_pattern


def gap_match_pattern(java_pattern: str) -> str:
    """``P`` -> ``\\G((?s:.*?))(P)``; P's own groups shift by two."""
    flags, body = _split_flags(java_pattern)
    return flags + r"\G((?s:.*?))(" + body + ")"


# A private-use character marks match edges in the single-scan form: the first
# of these that the text doesn't hold.  A text that holds them all takes the
# two-scan form, whose patterns have their references shifted with the groups.
MARKS = tuple(chr(0xE000 + i) for i in range(8))
MARK = MARKS[0]


def _shift_references(pattern: Column) -> Column:
    """Back-references of a pattern whose groups shift by two."""
    for d in range(7, 0, -1):
        pattern = F.regexp_replace(pattern, rf"(?<!\\)((?:\\\\)*)\\{d}(?!\d)", rf"$1\\{d + 2}")
    return pattern


def _positions(parts: Column, group: int) -> Column:
    """Offsets from ``parts`` = array<struct<g, m[, c]>> (gap, match, group)."""
    init = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS_TYPE).alias("out"))

    def step(acc, z):
        end = acc["pos"] + F.length(z["g"]) + F.length(z["m"])
        if group:
            span = F.struct((end - F.length(z["c"])).alias("s"), end.alias("e"), z["c"].alias("text"))
        else:
            span = F.struct((acc["pos"] + F.length(z["g"])).alias("s"), end.alias("e"),
                            z["m"].alias("text"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(parts, init, step, lambda acc: acc["out"])


def _spans_two_scans(text: Column, java_pattern: str | Column, group: int) -> Column:
    if isinstance(java_pattern, str):
        flags, body = _split_flags(java_pattern)
        flags, body = F.lit(flags), F.lit(body)
    else:
        flags = F.regexp_extract(java_pattern, r"^(\(\?[A-Za-z]+\))?", 0)
        body = F.substr(java_pattern, F.length(flags) + 1)
    gm = F.concat(flags, F.lit(r"\G((?s:.*?))("), _shift_references(body), F.lit(")"))
    gaps = F.regexp_extract_all(text, gm, F.lit(1))
    matches = F.regexp_extract_all(text, gm, F.lit(2))
    if group:
        parts = F.arrays_zip(gaps.alias("g"), matches.alias("m"),
                             F.regexp_extract_all(text, gm, F.lit(2 + group)).alias("c"))
    else:
        parts = F.arrays_zip(gaps.alias("g"), matches.alias("m"))
    return _positions(parts, group)


#: Private-use characters of the first plane, and the longest texts of which a free one is certain to be among them.
PRIVATE_USE = "".join(map(chr, range(0xE000, 0xF900)))
MOST_CHARS = len(PRIVATE_USE) - 1


def free_mark(text: Column, most_chars: int, may_hold: Column | bool = True) -> Column:
    """A character that ``text``, of at most ``most_chars`` (up to ``MOST_CHARS``) code points,
    doesn't hold: of one more private-use characters than that, one is always free.  Where
    ``may_hold`` (of a text around this one) is false, the first one is."""
    free = F.element_at(F.array_except(F.split(F.lit(PRIVATE_USE[:most_chars + 1]), ""), F.split(text, "")), 1)
    return F.when(may_hold, free).otherwise(F.lit(MARK)) if isinstance(may_hold, Column) else free


def with_free_mark(text: Column, most_chars: int, may_hold: Column, body: Callable[[Column | None], Column]) -> Column:
    """``body(mark)`` with a free mark of ``text`` bound once; of a text that may be longer than
    ``MOST_CHARS``, ``body(None)``: each search then looks for a mark itself."""
    from redactflow.functions.arrays import let

    return let(free_mark(text, most_chars, may_hold), body) if most_chars <= MOST_CHARS else body(None)


def _spans_one_scan(text: Column, java_pattern: str | Column, group: int, mark: str | Column = MARK) -> Column:
    """One regex pass: ``regexp_replace`` writes MARK match MARK [group MARK]
    around every match, and a split on the single MARK character (Java's
    fast path, no pattern compile) yields gap, match[, group] in turn."""
    from redactflow.functions.arrays import let

    if isinstance(mark, str):
        repl = mark + "$0" + mark + (f"${group}" + mark if group else "")
    else:
        repl = F.concat(mark, F.lit("$0"), mark, *([F.lit(f"${group}"), mark] if group else []))
    stride = 3 if group else 2
    pieces = F.split(F.regexp_replace(text, java_pattern, repl), mark, -1)

    def body(p: Column) -> Column:
        k = (F.size(p) - 1) / stride
        idx = F.sequence(F.lit(0), (k - 1).cast("int"))

        def part(i):
            fields = [F.element_at(p, i * stride + 1).alias("g"), F.element_at(p, i * stride + 2).alias("m")]
            if group:
                fields.append(F.element_at(p, i * stride + 3).alias("c"))
            return F.struct(*fields)

        return F.when(F.size(p) > 1, _positions(F.transform(idx, part), group)).otherwise(
            F.array().cast(SPANS_TYPE))

    return let(pieces, body)


def find_spans(text: Column, java_pattern: str | Column, group: int = 0, mark: Column | None = None) -> Column:
    """All non-overlapping matches of ``java_pattern`` (a string or a column) in ``text``.

    Returns ``array<struct<s:int, e:int, text:string>>`` with 0-based,
    half-open code-point offsets, in match order; the same spans for a string
    and a column, with the pattern's own groups and back-references as they are.  ``group=1`` reports
    capture group 1, which must end where the match ends (true for every
    contextual rule), so its start is ``match end - length(group 1)``.
    ``mark``: a character known to be free in ``text`` (see ``free_mark``); one search form is then planned, else three.
    """
    if mark is not None:
        return _spans_one_scan(text, java_pattern, group, mark)
    free = F.coalesce(*[F.when(~text.contains(m), F.lit(m)) for m in MARKS[1:]])
    marked = F.when(free.isNull(), _spans_two_scans(text, java_pattern, group)).otherwise(
        _spans_one_scan(text, java_pattern, group, free))
    return F.when(text.contains(MARK), marked).otherwise(_spans_one_scan(text, java_pattern, group))


def leading_span(text: Column, java_pattern: str) -> Column:
    """Span of group 1 of an anchored pattern (``^...``), as a 0/1-element array."""
    whole = F.regexp_extract(text, java_pattern, 0)
    g1 = F.regexp_extract(text, java_pattern, 1)
    span = F.struct((F.length(whole) - F.length(g1)).alias("s"), F.length(whole).alias("e"),
                    g1.alias("text"))
    return F.when(F.length(g1) > 0, F.array(span)).otherwise(F.array().cast(SPANS_TYPE))
