"""Many stored patterns over many texts: an index of the literals that patterns need.

A regular expression can match only where every literal run that it cannot do
without stands; of alternatives, one of their runs.  Each pattern is listed under a
piece of such a run (of each alternative's), as long as ``LENGTHS`` allow and the one that the
fewest patterns share.  A text's own pieces then say which patterns can match in
it, and only those are searched.  Both sides meet in a join on the hash of a piece.
A text has far more pieces than patterns in reach: a filter of a few bits
for each listed piece goes to all tasks, and pieces that it doesn't know never
leave theirs.  So the work is that of the texts' lengths and of the candidates.

Runs hold ASCII characters only and are compared in lower case, which is exact for
a pattern that tells cases apart and for one that doesn't.  Patterns without
such a run, or with syntax that the scan doesn't follow, are searched in every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactflow.functions.arrays import let
from redactflow.functions.spans import find_spans
from redactflow.plans.joins import by_shuffle

GRAM = 3
#: Lengths of pieces; a run gives pieces of the greatest that it has.
LENGTHS = (3, 4, 5, 6, 8, 12)
#: Bits of the filter for each listed piece, and its most bytes (beyond, more pieces of texts pass it in vain).
FILTER_BITS = 32
FILTER_BYTES = 64 << 20
#: Bits of one row of the filter (those of Spark's bitmap functions).
_ROW_BITS = 32768


def required_clauses(pattern: str) -> list[list[str]]:
    """Sets of literal runs (lower case, ASCII, three characters or more): every match of ``pattern`` holds a run of each."""
    try:
        clauses = _Scan(pattern).alternatives(top=True)
    except (ValueError, IndexError):
        return []
    return [list(c) for c in sorted({tuple(sorted({r.lower() for r in c})) for c in clauses if all(len(r) >= GRAM for r in c)})]


def required_runs(pattern: str) -> list[str]:
    """Literal runs (lower case, ASCII, three characters or more) that every match of ``pattern`` holds."""
    return [c[0] for c in required_clauses(pattern) if len(c) == 1]


def pieces_of(run: str) -> list[str]:
    n = max(k for k in LENGTHS if k <= len(run))
    return sorted({run[i:i + n] for i in range(len(run) - n + 1)})


def piece_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A 63-bit hash of every piece of ``length`` code points."""
    if len(codes) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(codes) - length + 1, length, np.uint64)
        for k in range(length):
            h = (h ^ codes[k:len(codes) - length + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h >> np.uint64(1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class _Scan:
    """A walk over a pattern that keeps what is certain to be matched and forgets the rest."""

    def __init__(self, pattern: str):
        self.p, self.i, self.unicode_case = pattern, 0, False

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alternatives(self, top: bool = False) -> list[tuple[str, ...]]:
        """The clauses of a group's body; of several alternatives one holds, so a clause of each makes one of all."""
        branches = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            branches.append(self.sequence())
        if top and self.i < len(self.p):
            raise ValueError("unbalanced")
        if len(branches) == 1:
            return branches[0]
        best = [max(b, key=lambda c: min(map(len, c)), default=()) for b in branches]
        return [sum(best, ())] if all(best) else []

    def sequence(self) -> list[tuple[str, ...]]:
        runs: list[str] = []
        run = ""
        clauses: list[tuple[str, ...]] = []
        while (c := self.peek()) and c not in "|)":
            char, inner = self.atom(c)
            least, many = self.quantifier()
            if char is not None and least and char.isascii() and not (self.unicode_case and char.lower() in "iks"):
                run += char
                if many:  # repeated: what follows the first one is unknown
                    runs.append(run)
                    run = ""
            else:
                runs.append(run)
                run = ""
                if least:
                    clauses += inner
        return clauses + [(r,) for r in [*runs, run] if r]

    def atom(self, c: str) -> tuple[str | None, list[tuple[str, ...]]]:
        """A literal character, or the certain clauses of a group; neither for all else."""
        self.i += 1
        if c == "\\":
            return self.escape(), []
        if c == "[":
            return self.char_class(), []
        if c == "(":
            return None, self.group()
        if c in "^$.":
            return None, []
        if c in "*+?{":
            raise ValueError("nothing to repeat")
        return c, []

    def escape(self) -> str | None:
        c = self.p[self.i]
        self.i += 1
        if not c.isalnum():
            return c
        if c in "pP" and self.peek() == "{":
            self.i = self.p.index("}", self.i) + 1
        elif c not in "dDwWsSbBAzZhHvVRntrf123456789" and c not in "pP":
            raise ValueError("an escape that isn't followed")
        return None

    def char_class(self) -> str | None:
        start = self.i
        if self.peek() == "^":
            self.i += 1
        first = True
        while first or self.p[self.i] != "]":
            if self.p[self.i] == "[" or self.p.startswith("&&", self.i):
                raise ValueError("a nested class")
            self.i += 2 if self.p[self.i] == "\\" else 1
            first = False
        body = self.p[start:self.i]
        self.i += 1
        return body if len(body) == 1 and body not in "^\\" else None

    def group(self) -> list[tuple[str, ...]]:
        certain = True
        if self.peek() == "?":
            self.i += 1
            if self.p.startswith("P<", self.i) or (self.peek() == "<" and self.p[self.i + 1] not in "=!"):
                self.i = self.p.index(">", self.i) + 1
            elif self.peek() in ":>":
                self.i += 1
            elif self.peek() in "=!":
                self.i, certain = self.i + 1, False
            elif self.p.startswith(("<=", "<!"), self.i):
                self.i, certain = self.i + 2, False
            else:
                stop = min(k for k in (self.p.find(")", self.i), self.p.find(":", self.i)) if k >= 0)
                flags = self.p[self.i:stop]
                if not flags or not flags.isalpha() or set(flags) - set("imsuU"):
                    raise ValueError("flags that aren't followed")
                self.unicode_case |= bool({"u", "U"} & set(flags))
                self.i = stop + 1
                if self.p[stop] == ")":
                    return []
        runs = self.alternatives()
        if self.peek() != ")":
            raise ValueError("unbalanced")
        self.i += 1
        return runs if certain else []

    def quantifier(self) -> tuple[bool, bool]:
        """Whether the atom before is certain, and whether it may be repeated."""
        c, least, many = self.peek(), True, False
        if c in ("*", "+", "?"):
            self.i += 1
            least, many = c == "+", True
        elif c == "{":
            stop = self.p.index("}", self.i)
            low = self.p[self.i + 1:stop].split(",")[0]
            if not low.isdigit():
                raise ValueError("a brace that isn't a count")
            self.i, least, many = stop + 1, int(low) > 0, True
        if many and self.peek() in ("?", "+") and self.peek():
            self.i += 1
        return least, many


def literal_index(patterns: DataFrame) -> DataFrame:
    """``patterns`` (pattern_name, pattern_regex) with ``clauses`` and ``pieces``: the pieces under which
    each is listed (one of each alternative), null for those that any text may match."""
    from redactflow.session import ship_package

    ship_package(patterns.sparkSession)

    @F.pandas_udf("array<array<string>>")
    def clauses_of(regexes: pd.Series) -> pd.Series:
        return regexes.map(required_clauses)

    @F.pandas_udf("array<string>")
    def cut(runs: pd.Series) -> pd.Series:
        return runs.map(pieces_of)

    with_clauses = patterns.withColumn("clauses", clauses_of("pattern_regex"))
    runs = with_clauses.select("pattern_name", F.posexplode("clauses").alias("clause", "c")).select("pattern_name", "clause", F.posexplode("c").alias("way", "run"))
    listed = runs.select("pattern_name", "clause", "way", F.explode(cut("run")).alias("piece"))
    shared = listed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    one = listed.join(by_shuffle(shared), "piece").groupBy("pattern_name", "clause", "way").agg(F.min(F.struct("n", (-F.length("piece")).alias("k"), "piece")).alias("b"))
    ways = one.groupBy("pattern_name", "clause").agg(F.sum("b.n").alias("n"), F.max("b.k").alias("k"), F.collect_set("b.piece").alias("pieces"))
    best = ways.groupBy("pattern_name").agg(F.min_by("pieces", F.struct("n", "k", "clause")).alias("pieces"))
    return with_clauses.join(by_shuffle(best), "pattern_name", "left")


def indexed_spans(docs: DataFrame, index: DataFrame, text_col: str, id_col: str, max_bytes: int = 4 << 20, max_patterns: int = 200) -> DataFrame:
    """(id, pattern_name, start_char, end_char, text): all spans of the patterns of ``literal_index``.

    An index of at most ``max_bytes`` is broadcast and no text moves; with a larger one the
    texts' pieces are shuffled, and each text once."""
    from redactflow.session import cut_lineage

    index = cut_lineage(index)
    listed = index.where("pieces is not null")
    size = listed.agg(F.sum(F.octet_length("pattern_regex") + F.octet_length("pattern_name") + F.octet_length(F.array_join(F.flatten("clauses"), "")) + 64)).first()[0]
    found = [_listed_spans(docs, listed, text_col, id_col, size <= max_bytes)] if size else []
    free = index.where("pieces is null").select("pattern_name", "pattern_regex")
    number = free.count()
    for k in range(-(-number // max_patterns)):  # a few hundred patterns at a time become literals of the plan
        block = free.where(F.pmod(F.xxhash64("pattern_name"), F.lit(-(-number // max_patterns))) == k).collect()
        if block:
            found.append(literal_spans(docs, [(p.pattern_name, p.pattern_regex) for p in block], text_col, id_col))
    if not found:
        return literal_spans(docs, [], text_col, id_col)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _places(h, bits: int):
    """The two bits of a hash in the filter (of a number or an array of them)."""
    return h & (bits - 1), (h >> 31) & (bits - 1)


def _filter(keys: DataFrame) -> tuple[int, np.ndarray]:
    """The number of bits, and the bytes with two bits set for each ``key``."""
    number = keys.count()
    bits = _ROW_BITS
    while bits < FILTER_BITS * number and bits < 8 * FILTER_BYTES:
        bits *= 2
    low, high = F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftright("key", 31).bitwiseAND(F.lit(bits - 1))
    places = keys.select(F.explode(F.array(low, high)).alias("p"))
    rows = places.groupBy(F.floor(F.col("p") / _ROW_BITS).alias("row")).agg(F.bitmap_construct_agg((F.col("p") % _ROW_BITS)).alias("b")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        at = r["row"] * (_ROW_BITS // 8)
        out[at:at + _ROW_BITS // 8] = np.frombuffer(bytes(r["b"]), np.uint8)
    return bits, out


def _listed_spans(docs: DataFrame, index: DataFrame, text_col: str, id_col: str, small: bool) -> DataFrame:
    """The spans of the patterns that are listed under pieces; a ``small`` index is broadcast."""
    from redactflow.session import cut_lineage, ship_package

    spark = docs.sparkSession
    ship_package(spark)

    @F.pandas_udf("long")
    def hashed(pieces: pd.Series) -> pd.Series:
        return pd.Series([int(piece_hashes(_codes(p), len(p))[0]) for p in pieces], dtype="int64")

    listed = cut_lineage(index.withColumn("piece", F.explode("pieces")).withColumn("key", hashed("piece")))
    lengths = sorted(r["k"] for r in listed.select(F.length("piece").alias("k")).distinct().collect())
    sent = spark.sparkContext.broadcast(_filter(listed.select("key").distinct()))

    @F.pandas_udf("array<long>")
    def keys_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits, known = sent.value

        def own(text: str | None) -> np.ndarray:
            if text is None:
                return np.zeros(0, np.int64)
            codes = _codes(text)
            h = np.concatenate([np.zeros(0, np.uint64), *(piece_hashes(codes, k) for k in lengths)]).astype(np.int64)
            low, high = _places(h, bits)
            return np.unique(h[(known[low >> 3] >> (low & 7) & 1 == 1) & (known[high >> 3] >> (high & 7) & 1 == 1)])

        for batch in texts:
            yield pd.Series([own(t) for t in batch], dtype=object)

    low = F.lower(F.col("_text"))
    texts = docs.select(id_col, F.col(text_col).alias("_text")).withColumn("_keys", keys_of(low))
    if small:
        found = texts.withColumn("key", F.explode_outer("_keys")).where("key is not null").join(F.broadcast(listed), "key")
    else:
        texts = cut_lineage(texts.withColumn("_row", F.monotonically_increasing_id()))
        hits = texts.select("_row", F.explode_outer("_keys").alias("key")).where("key is not null")
        found = texts.join(by_shuffle(hits.join(by_shuffle(listed), "key")), "_row")
    # a pattern that a text meets under several pieces is searched under the first of them
    first = lambda t: F.get(F.filter("pieces", lambda p: t.contains(p)), 0)
    holds = let(low, lambda t: (first(t) == F.col("piece")) & F.forall("clauses", lambda c: F.exists(c, lambda r: t.contains(r))))
    spans = found.where(holds).select(id_col, "pattern_name", find_spans(F.col("_text"), F.col("pattern_regex")).alias("sp"))
    return _rows(spans, id_col)


def literal_spans(docs: DataFrame, patterns: list[tuple[str, str]], text_col: str, id_col: str) -> DataFrame:
    """The spans of a few patterns, each a literal of the plan (compiled once per task)."""
    if not patterns:
        return docs.select(id_col, F.lit("").alias("pattern_name"), F.lit(0).cast("long").alias("start_char"),
                           F.lit(0).cast("long").alias("end_char"), F.lit("").alias("text")).where("false")
    per = F.array(*[F.struct(F.lit(n).alias("pattern_name"), find_spans(F.col(text_col), r).alias("sp")) for n, r in patterns])
    return _rows(docs.select(id_col, F.inline(per)), id_col)


def _rows(spans: DataFrame, id_col: str) -> DataFrame:
    out = spans.select(id_col, "pattern_name", F.posexplode_outer("sp").alias("p", "x")).where(F.col("p").isNotNull())
    return out.select(id_col, "pattern_name", F.col("x.s").cast("long").alias("start_char"),
                      F.col("x.e").cast("long").alias("end_char"), F.col("x.text").alias("text"))
