"""Token counts from flat, unindexed token files.

The files are nothing but little-endian unsigned 16-bit ids, each document
followed by the end-of-document id.  A file holds whole documents of about
``file_ids`` ids together, or one longer document alone, so its size follows from the
ids and not from a number of documents, and files are what tasks share out.  A scan cuts them into blocks, finds the
end ids of each block in one vectorised comparison, and keeps of a block only
its length and its end positions.  A prefix scan over the blocks of a file then
gives what each block's first document carries in from the blocks before it
and how many documents ended before it, so documents may span any number of blocks.

Null texts and texts without tokens count 0; repeated and null ids stay rows of
their own; ids after a file's last end id are a last document of their own.
The counts are matched to doc_id by the place in the file: if the source's rows
come in another number than its documents, the job fails instead of miscounting.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactflow.llm.common import stage, table
from redactflow.llm.packing import tokenizer_path
from redactflow.llm.tokens import encoder
from redactflow.session import shared_dir

END_OF_DOCUMENT = 49407
FILE_IDS = 1 << 24
BLOCK_IDS = 1 << 20


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_OF_DOCUMENT, file_ids: int = FILE_IDS) -> None:
    """Flat files of the documents of a partition, in row order.
    The text sink writes a file's bytes as they are; the end id of its last document is the line separator."""
    end = int(end_id).to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, size = encoder(tokenizer, specials_as_text=True), [], 0
        file = lambda: pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], ["ids"])
        for b in batches:
            for text in b.column(0):
                ids = np.frombuffer(encode(text.as_py()), "<u4").astype("<u2").tobytes()
                if held and size + len(ids) // 2 >= file_ids:
                    yield file()
                    held, size = [], 0
                held.append(ids)
                size += len(ids) // 2 + 1
        if held:
            yield file()

    (docs.select("text").mapInArrow(run, "ids binary").select(F.col("ids").cast("string"))
     .write.option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path))


def scan_blocks(files: DataFrame, end_id: int, block_ids: int) -> DataFrame:
    """path, block, n_ids, ends (positions of the end id in the block) of ``files`` (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                ids = np.frombuffer(content.as_buffer() or b"", "<u2")
                for k, at in enumerate(range(0, len(ids), block_ids)):
                    block = ids[at:at + block_ids]
                    ends = np.flatnonzero(block == end_id).astype("int32")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.as_py()]), pa.array([k], pa.int32()), pa.array([len(block)], pa.int64()),
                         pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends))],
                        ["path", "block", "n_ids", "ends"])

    return files.select("path", "content").mapInArrow(run, "path string, block int, n_ids long, ends array<int>")


def count_documents(spark: SparkSession, path: str, end_id: int = END_OF_DOCUMENT, block_ids: int = BLOCK_IDS) -> DataFrame:
    """path, ordinal (from 0), first_id, n_tokens of every document of the flat files under ``path``."""
    blocks = scan_blocks(spark.read.format("binaryFile").load(path), end_id, block_ids)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    scanned = blocks.select(
        "*",
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("ended"),
        F.max("block").over(whole).alias("last"),
    )
    # the first id after the last end id before the block: where the document that runs into it began
    ends_at = F.when(F.size("ends") > 0, F.col("base") + F.try_element_at("ends", F.lit(-1)) + 1)
    scanned = scanned.withColumn("began", F.coalesce(F.max(ends_at).over(before), F.lit(0)))
    tail = F.when((F.col("block") == F.col("last")) & (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(-1)) + 1 < F.col("n_ids")), F.array(F.col("n_ids").cast("int")))
    open_end = F.concat("ends", F.coalesce(tail, F.array().cast("array<int>")))
    rows = scanned.select("path", "base", "ended", "began", open_end.alias("ends"), F.posexplode(open_end).alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("began")).otherwise(F.col("base") + F.try_element_at("ends", F.greatest(F.col("k"), F.lit(1))) + 1)
    return rows.select("path", (F.col("ended") + F.col("k")).alias("ordinal"), start.alias("first_id"), (F.col("base") + F.col("end") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, tokenizer: str, file_ids: int = FILE_IDS) -> DataFrame:
    """doc_id, n_tokens, first_id (ids before it in its file) of every document, written to and counted from flat files."""
    write_token_files(docs, path, tokenizer, file_ids=file_ids)
    counts = count_documents(docs.sparkSession, path)
    name = [F.regexp_extract("path", r"part-(\d+)-[^/]*-c(\d+)[^/]*$", k).cast("long") for k in (1, 2)]
    named = stage(counts.select(name[0].cast("int").alias("part"), name[1].alias("file"), "ordinal", "first_id", "n_tokens"), "counted")
    # the documents in the files of the same partition before this one
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = named.groupBy("part", "file").agg(F.count("*").alias("n")).select("part", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = named.join(files, ["part", "file"]).select("part", (F.col("base") + F.col("ordinal")).alias("place"), "first_id", "n_tokens")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ids = docs.select("doc_id", F.spark_partition_id().alias("part"), place.alias("place"))
    both = ids.withColumn("known", F.lit(True)).join(placed, ["part", "place"], "full")
    lost = F.raise_error(F.lit("the token files and the documents don't correspond")).cast("long")
    return both.select("doc_id", F.when(F.col("known") & F.col("n_tokens").isNotNull(), F.col("n_tokens")).otherwise(lost).alias("n_tokens"), "first_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark, 'llm')}/tokens-{uuid.uuid4().hex}"
    return token_counts(table(spark, sf_dir, "documents"), path, tokenizer_path())
