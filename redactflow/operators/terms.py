"""Replacement of many terms in a text, in one pass.

The meaning is that of replacing the terms one after another, longest first,
each everywhere in the text that the earlier ones left.  One automaton over all
terms finds every occurrence in a single pass; occurrences are then settled in
the terms' order, and one that touches a settled one is dropped.  That is the
same as long as no term can occur in, or reach into, a replacement.  Whether one
can is tested on the document's own terms and replacements; where it can
(partial masks, whose edges are letters), the terms are replaced one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_terms(text: str, terms: Sequence[str], replacements: Sequence[str]) -> str:
    """``text`` with each term (longest first, as given) replaced by its replacement."""
    if len(terms) < 4 or not settled_once(terms, replacements):
        for t, r in zip(terms, replacements):
            text = text.replace(t, r)
        return text
    found: dict[int, list[int]] = {}
    for end, k in automaton(terms).iter(text):
        found.setdefault(k, []).append(end + 1 - len(terms[k]))
    if not found:
        return text
    taken, cuts = bytearray(len(text)), []
    for k in sorted(found):
        n = len(terms[k])
        for at in found[k]:  # ascending; a settled span is no shorter, so it covers an end of any span that it touches
            if not taken[at] and not taken[at + n - 1]:
                taken[at:at + n] = b"\1" * n
                cuts.append((at, at + n, replacements[k]))
    cuts.sort()
    out, done = [], 0
    for start, stop, r in cuts:
        out += (text[done:start], r)
        done = stop
    return "".join([*out, text[done:]])


def automaton(terms: Sequence[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        if t not in a:
            a.add_word(t, k)
    a.make_automaton()
    return a


def settled_once(terms: Sequence[str], replacements: Sequence[str]) -> bool:
    """No term can match inside a replacement or across one of its ends."""
    distinct = set(replacements)
    if "" in distinct or "" in terms:
        return False
    edges = {r[0] for r in distinct} | {r[-1] for r in distinct}
    if any(not edges.isdisjoint(t) for t in terms):
        return False
    # the terms hold no edge, so a match over two joined replacements can't be
    return next(automaton(terms).iter("".join(distinct)), None) is None


def redact_terms_pass(df: DataFrame, text_col: str, terms: Column, out_col: str) -> DataFrame:
    """Adds ``out_col``: the text with the row's ``terms`` (array<struct<term, repl>>, longest first) replaced.
    A null text stays null; null terms replace nothing."""
    from redactflow.session import ship_package

    ship_package(df.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series, names: pd.Series, masks: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or n is None else replace_terms(t, list(n), list(m)) for t, n, m in zip(texts, names, masks)], dtype=object)

    bound = df.withColumn("_terms", terms)
    return bound.withColumn(out_col, run(F.col(text_col), F.col("_terms.term"), F.col("_terms.repl"))).drop("_terms")
