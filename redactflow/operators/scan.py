"""Matches of all rules in a text's windows, found by the rules' own ``re`` patterns in Arrow batches.

Array expressions are interpreted node by node, so building one span out of a
replaced and split window costs far more than the match itself.  Here only the
matching leaves the JVM; every later step (window and document dedup, rebase,
handles, boost, redaction) stays an expression over the returned array.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from redactflow.operators.rules import NAME_BLOCKLIST, NAME_TOKEN_SHAPE, Rule

ENTITIES = "array<struct<s:int,e:int,text:string,entity_type:string,confidence:double,source:string,rank:int,window_id:int>>"


def scan_windows(rules: Sequence[Rule], size: int, step: int, default_prefilter: bool) -> Callable[[Column], Column]:
    """A function on a text column: for each of the windows of ``context_windows`` its entities at window
    offsets, in rule order (null for a null text).

    ``default_prefilter``: windows without what every unanchored default rule needs
    (``detect.DEFAULT_PREFILTER``) are searched by the anchored rules only.  The
    inner function holds all that it needs, so tasks need no copy of this package.
    """
    literal = lambda r: r.guard if r.guard == "@" else None
    specs = [(*r.python, r.group, r.name_check, r.anchored, literal(r)) for r in rules]
    constants = [[r.entity_type for r in rules], [float(r.confidence) for r in rules], [r.source for r in rules], [r.rank for r in rules]]
    shape, blocked = NAME_TOKEN_SHAPE, frozenset(NAME_BLOCKLIST)

    @F.arrow_udf(f"array<{ENTITIES}>")
    def scan(documents: pa.Array) -> pa.Array:
        token, some = re.compile(shape), re.compile(r"[@:/\-\d]")

        def is_name(value: str) -> bool:
            tokens = value.split()
            return 2 <= len(tokens) <= 4 and all(token.fullmatch(t) and t.lower() not in blocked for t in tokens)

        def may_match(window: str) -> bool:
            return some.search(window) is not None or "reg" in (low := window.lower()) or "www." in low

        every = [(k, re.compile(pattern, flags), *rest) for k, (pattern, flags, *rest) in enumerate(specs)]
        leading = [r for r in every if r[4]]
        starts, ends, texts, kinds, ids, sizes, windows = [], [], [], [], [], [], []
        for document in documents.to_pylist():
            places = range(0, len(document or ""), step)
            windows.append(None if document is None else len(places))
            for window_id, at in enumerate(places):
                window, before = document[at:at + size], len(starts)
                for k, pattern, group, check, anchored, guard in every if not default_prefilter or may_match(window) else leading:
                    if guard is not None and guard not in window:
                        continue
                    for m in pattern.finditer(window):
                        found = m[group]
                        if (check and not is_name(found)) or (anchored and not found):
                            continue
                        start, end = m.span(group)
                        starts.append(start)
                        ends.append(end)
                        texts.append(found)
                        kinds.append(k)
                        ids.append(window_id)
                sizes.append(len(starts) - before)

        def offsets(counts: list) -> pa.Array:
            at, out = 0, []
            for c in counts:
                out.append(None if c is None else at)
                at += c or 0
            return pa.array([*out, at], pa.int32())

        of_rule = [pa.array(c, t).take(pa.array(kinds, pa.int32())) for c, t in zip(constants, (pa.string(), pa.float64(), pa.string(), pa.int32()))]
        fields = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string()), *of_rule, pa.array(ids, pa.int32())]
        spans = pa.StructArray.from_arrays(fields, ["s", "e", "text", "entity_type", "confidence", "source", "rank", "window_id"])
        return pa.ListArray.from_arrays(offsets(windows), pa.ListArray.from_arrays(offsets(sizes), spans))

    return scan
