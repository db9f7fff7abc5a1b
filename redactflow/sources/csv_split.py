"""Multi-line CSV files read in splits: one large file spreads over tasks.

A line break ends a record unless it stands in a quoted field, and whether it
does depends on everything before it.  At the start of a line there are only
two cases, though: within quotes or not.  So a block of lines is a function from
the state before it to the state after it, one of {keep, turn, always out,
always in}, and the state before each block follows from a prefix scan over
these functions, one small row per block.  A second pass then cuts the records;
one that goes over block ends is put together from its fragments.

The records are those that the whole-file reader gives (``decode_records``):
all fields joined by spaces, the first record left out as header, empty rows
left out, invalid UTF-8 bytes dropped.  A file with a record that can't be
parsed gives no rows, only its message.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactflow.functions.text import normalize_text
from redactflow.plans.joins import sized_broadcast
from redactflow.session import cut_lineage, ship_package
from redactflow.sources.files import Undecodable, decode_records

_TOKENS = re.compile(b'[",\r]|[^",\r]+')
_FRAGMENT_ROWS = 1000


def quoted_after(line: bytes, quoted: bool) -> bool:
    """Whether the line break after ``line`` stands in a quoted field."""
    if b'"' not in line:
        return quoted
    state = "quoted" if quoted else "start"
    for token in _TOKENS.findall(line):
        if token == b'"':
            state = {"start": "quoted", "quoted": "quote", "quote": "quoted"}.get(state, state)
        elif state == "quoted":
            continue
        elif token in (b",", b"\r"):
            state = "start"
        else:
            state = "field"  # a quote in it is a plain character
    return state == "quoted"


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, block (where its split begins in the file) and line of every line, blocks in one piece and in order."""
    files = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """The task's blocks in turn, each with its lines."""
    from itertools import groupby

    rows = ((p, k, line) for b in batches for p, k, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
    for (p, k), lines in groupby(rows, key=lambda r: r[:2]):
        yield p, k, (x[2] for x in lines)


def block_states(lines: DataFrame) -> DataFrame:
    """path, block, quoted: whether each block begins in a quoted field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, block, some in _blocks(batches):
            out, inside = False, True
            for line in some:
                out, inside = quoted_after(line, out), quoted_after(line, inside)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([out]), pa.array([inside])], ["path", "block", "out", "inside"])

    blocks = cut_lineage(lines.mapInArrow(run, "path string, block long, out boolean, inside boolean"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("out") & ~F.col("inside")).cast("int")).over(before), F.lit(0))
    fixed = F.col("out") == F.col("inside")  # the state after it is known, whatever came before
    blocks = blocks.withColumn("turns", turns)
    known = F.last(F.when(fixed, F.struct("out", "turns")), ignorenulls=True).over(before)
    blocks = blocks.withColumn("known", known)
    state = F.coalesce(F.col("known.out").cast("int"), F.lit(0)) + F.col("turns") - F.coalesce("known.turns", F.lit(0))
    return blocks.select("path", "block", (state % 2 == 1).alias("quoted"))


def read_csv_split(spark: SparkSession, path: str, pattern: str = "*.csv", csv_header: bool = True, normalize: bool = True) -> DataFrame:
    """path, record (from 0), text, message of every record of the CSV files under ``path``; one row with
    a message and without a text for each file that can't be parsed."""
    ship_package(spark)
    lines = _lines(spark, path, pattern)
    states = block_states(lines).withColumnRenamed("path", "_path").withColumnRenamed("block", "_block")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (path, block, seq, raw, opens, closes): whole records together, and fragments that go on before or after the block."""
        from itertools import groupby

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (p, k, quoted), group in groupby(rows, key=lambda r: (r[0], r[1], r[3])):
            state, held, seq, whole, out = quoted, [], 0, [], []
            closes = quoted  # the fragment in hand began before the block
            for _, _, line, _ in group:
                held.append(line)
                state = quoted_after(line, state)
                if state:
                    continue
                if closes:
                    out.append((p, k, -1, b"\n".join(held), False, True))
                else:
                    whole += held
                    if len(whole) >= _FRAGMENT_ROWS:
                        out.append((p, k, seq, b"\n".join(whole), False, False))
                        seq, whole = seq + 1, []
                closes, held = False, []
                if len(out) >= 16:
                    yield _batch(out)
                    out = []
            if whole:
                out.append((p, k, seq, b"\n".join(whole), False, False))
            if held:
                out.append((p, k, 1 << 40, b"\n".join(held), True, closes))
            if out:
                yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "block", "seq", "raw", "opens", "closes"])

    # one row for each block: broadcast only if it is measured small
    known = lines.join(sized_broadcast(states), (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    pieces = cut_lineage(known.select("path", "block", "line", "quoted").mapInArrow(cut, "path string, block long, seq long, raw binary, opens boolean, closes boolean"))
    # fragments of one record: the one that opens it, any that go through a block, the one that closes it
    parts = pieces.where("opens or closes")
    order = Window.partitionBy("path").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("which", F.sum((F.col("opens") & ~F.col("closes")).cast("int")).over(order))
    joined = parts.groupBy("path", "which").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "raw"))).alias("f")).select(
        "path", F.col("f")[0]["block"].alias("block"), F.lit(1 << 40).cast("long").alias("seq"), F.transform("f", lambda x: x["raw"]).alias("raws"))
    whole = pieces.where("not opens and not closes").select("path", "block", "seq", F.array("raw").alias("raws"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, k, seq, raws in zip(*(c.to_pylist() for c in b.columns)):
                raw = b"\n".join(raws)
                try:
                    texts, message = decode_records(".csv", raw, csv_header=False, keep_empty=True), None
                except Undecodable as e:
                    texts, message = [None], str(e)
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([p] * n), pa.array([k] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array(range(n), pa.int64()),
                                                  pa.array(texts, pa.string()), pa.array([message] * n, pa.string())], ["path", "block", "seq", "i", "text", "message"])

    rows = cut_lineage(whole.union(joined).mapInArrow(decode, "path string, block long, seq long, i long, text string, message string"))
    bad = rows.where("message is not null").groupBy("path").agg(F.min("message").alias("message"))
    first = rows.groupBy("path").agg(F.min(F.struct("block", "seq", "i")).alias("first"))
    kept = rows.join(bad.select("path"), "path", "left_anti").join(first, "path")
    if csv_header:
        kept = kept.where(F.struct("block", "seq", "i") != F.col("first"))
    kept = kept.where("text is not null").select("path", "block", "seq", "i", "text")
    # a record's number: those of the blocks before, and its place in its own
    totals = kept.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("path", "block").orderBy("seq", "i")) - 1
    numbered = kept.join(totals.select("path", "block", base.alias("base")), ["path", "block"]).withColumn("record", F.col("base") + place)
    text = normalize_text(F.col("text")) if normalize else F.col("text")
    good = numbered.select("path", F.col("record").cast("long").alias("record"), text.alias("text"), F.lit(None).cast("string").alias("message"))
    return good.unionByName(bad.select("path", F.lit(None).cast("long").alias("record"), F.lit(None).cast("string").alias("text"), "message"))
