"""Replacement expressions for the redaction modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: mask characters and formats of the redaction modes.
BLOCK_CHAR = "█"
EMPTY_FULL_MASK = "████"
PARTIAL_CHAR = "X"
PARTIAL_KEEP = 2
PARTIAL_MIN_LEN = 4
PSEUDONYM_PREFIX = "USER_"
MODES = ("full", "placeholder", "partial")


def mask_full(text: Column) -> Column:
    """One block per character; four blocks for an empty text."""
    return F.when(F.length(text) == 0, F.lit(EMPTY_FULL_MASK)).otherwise(
        F.repeat(F.lit(BLOCK_CHAR), F.length(text)))


def mask_placeholder(entity_type: Column) -> Column:
    return F.concat(F.lit("<"), entity_type, F.lit(">"))


def mask_partial(text: Column) -> Column:
    """Up to four chars: all X; longer: first two chars kept, rest X."""
    n = F.length(text)
    return F.when(n <= PARTIAL_MIN_LEN, F.repeat(F.lit(PARTIAL_CHAR), n)).otherwise(
        F.concat(F.substring(text, 1, PARTIAL_KEEP), F.repeat(F.lit(PARTIAL_CHAR), n - PARTIAL_KEEP)))


def pseudonym_prefix(entity_type: Column) -> Column:
    """``USER_`` + first three letters of the type, upper-cased."""
    return F.concat(F.lit(PSEUDONYM_PREFIX), F.upper(F.substring(entity_type, 1, 3)))


def replacement(mode: str, text: Column, entity_type: Column, pseudonym: Column | None = None,
                pseudonymize: bool = False) -> Column:
    """Dispatch in the reference order: full, placeholder, partial, then pseudonym
    if enabled, else the full mask."""
    if mode == "full":
        return mask_full(text)
    if mode == "placeholder":
        return mask_placeholder(entity_type)
    if mode == "partial":
        return mask_partial(text)
    if pseudonymize:
        if pseudonym is None:
            raise ValueError("pseudonym column required when pseudonymize is on")
        return pseudonym
    return mask_full(text)
