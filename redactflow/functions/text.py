"""Text preparation expressions: normalization, windows, context slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES: window geometry and boost radius of the reference pipeline.
WINDOW_SIZE = 500
WINDOW_OVERLAP = 100
CONTEXT_RADIUS = 100

# Python's ``\s`` (what the reference collapses) is Java's (?U)\s plus U+001C..U+001F.
PY_WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
# Control characters still present after the whitespace pass (all others are spaces).
CONTROL_CHARS = r"[\x00-\x08\x0e-\x1b]"

# schema of one element of ``context_windows`` (without the optional context)
WINDOW_TYPE = T.StructType([
    T.StructField("window_id", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("start_char", T.IntegerType()),
    T.StructField("end_char", T.IntegerType()),
    T.StructField("length", T.IntegerType()),
])


def normalize_text(text: Column) -> Column:
    """Collapse whitespace runs to one space, drop control characters, trim.

    Same order as the reference: the whitespace pass runs first, so a control
    character between two spaces leaves two spaces behind.
    """
    spaced = F.regexp_replace(text, PY_WHITESPACE_RUN, " ")
    return F.trim(F.regexp_replace(spaced, CONTROL_CHARS, ""))


def make_valid_text(text: Column) -> Column:
    """Drop bytes that are not valid UTF-8 (read as U+FFFD by Spark)."""
    return F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))


def chunks(text: Column, step: int) -> Column:
    """The text cut into consecutive pieces of ``step`` code points (last one
    shorter), in one linear regex pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))


def context_windows(text: Column, size: int = WINDOW_SIZE, overlap: int = WINDOW_OVERLAP,
                    context: int = 0) -> Column:
    """Windows of ``size`` chars every ``size - overlap`` chars, as an array on the row.

    Starts 0, step, 2*step ... while start < length; empty text gives none.
    Built from the step-sized chunks of one pass: window i is chunks i, i+1, ...
    cut to ``size``, so the work is linear in the text, where ``substring`` at
    each window start would walk the UTF-8 bytes from the beginning every time.
    """
    from redactflow.functions.arrays import let

    step = size - overlap
    if step <= 0:
        raise ValueError("window overlap must be smaller than the window size")
    per = -(-size // step)  # chunks per window

    def window(ch: Column, total: Column, c: Column, i: Column) -> Column:
        content = F.substring(F.array_join(F.slice(ch, i + 1, per), ""), 1, size) if per > 1 else c
        start = i * step
        fields = [i.cast("int").alias("window_id"), content.alias("content"),
                  start.cast("int").alias("start_char"),
                  F.least(start + size, total).cast("int").alias("end_char"),
                  F.length(content).alias("length")]
        if context:
            # the window widened by ``context`` chars each side (clamped), and its start
            before = -(-context // step)
            lo = F.greatest(i - before, F.lit(0))
            wide = F.array_join(F.slice(ch, lo + 1, before + per + -(-context // step)), "")
            cut = start - context - lo * step
            ctx_start = F.greatest(start - context, F.lit(0))
            fields += [F.substring(wide, F.greatest(cut, F.lit(0)) + 1, size + context + (start - ctx_start))
                       .alias("context"), ctx_start.cast("int").alias("context_start")]
        return F.struct(*fields)

    # the text length is computed once per row, not once per window
    return let(F.struct(chunks(text, step).alias("ch"), F.length(text).alias("n")),
               lambda b: F.transform(b["ch"], lambda c, i: window(b["ch"], b["n"], c, i)))


#: Code points per chunk of a text that is sliced at many places, and bytes up to which it stays whole.
CHUNK = 512
WHOLE = 2048


def cut_text(text: Column) -> Column:
    """A text made ready for many slices: short ones as they are, longer ones in chunks.

    ``substring`` walks from the text's beginning.  That is the cheapest way
    for a short text; in a long one only the chunks in reach are touched, so many slices stay linear.
    """
    return F.struct(F.when(F.octet_length(text) <= WHOLE, text).alias("whole"),
                    F.when(F.octet_length(text) > WHOLE, chunks(text, CHUNK)).alias("chunks"))


def slice_of(cut: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of the text of ``cut_text``."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((end - 1) / CHUNK).cast("int")
    reach = F.array_join(F.slice(cut["chunks"], first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return (F.when(end <= start, F.lit("")).when(cut["whole"].isNotNull(), F.substring(cut["whole"], start + 1, end - start))
            .otherwise(F.substring(reach, start - first * CHUNK + 1, end - start)))


def context_slice(text: Column, start: Column, end: Column, radius: int = CONTEXT_RADIUS) -> Column:
    """Lower-cased text from ``start - radius`` (clamped at 0) to ``end + radius``."""
    lo = F.greatest(start - radius, F.lit(0))
    return F.lower(F.substring(text, lo + 1, end + radius - lo))


def context_slice_of(cut: Column, start: Column, end: Column, radius: int = CONTEXT_RADIUS) -> Column:
    """``context_slice`` of the text of ``cut_text``."""
    return F.lower(slice_of(cut, F.greatest(start - radius, F.lit(0)), end + radius))


def html_escape(text: Column) -> Column:
    """Escape ``& < > " '`` the way ``html.escape`` does (quote=True)."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    out = F.replace(out, F.lit('"'), F.lit("&quot;"))
    return F.replace(out, F.lit("'"), F.lit("&#x27;"))
