"""File sources: manifest, validation, format routing and text decoding.

Files are rows of Spark's ``binaryFile`` source.  The size check reads only
``path`` and ``length``; content is read only for files within the size
limit (the length filter is pushed into the scan).  ``ingest_files`` checks
and decodes in that one pass, file by file, so each file keeps its own columns
and shape; a file that gives no document is a row with the reason.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.functions.text import make_valid_text, normalize_text
from redactflow.session import cut_lineage, ship_package

# FIXED VALUES: supported formats, size limit, ZIP signature and exempt
# formats, and the verdict messages of the file checks.
SUPPORTED_FORMATS = (".txt", ".csv", ".pdf", ".json", ".docx", ".xlsx")
MAX_FILE_SIZE_MB = 100
ZIP_SIGNATURE_HEX = "504B0304"
LEGITIMATE_ZIP_FORMATS = (".docx", ".xlsx", ".ppt", ".pptx", ".jar")
MSG_NOT_FOUND = "File not found: "
MSG_TOO_LARGE = "File exceeds max size of {}MB"
MSG_ZIP_BOMB = "Potential ZIP bomb detected"
MSG_PASSED = "File validation passed"
MSG_UNSUPPORTED = "Unsupported file format: "
MSG_NO_DECODER = "No decoder for format: "
MSG_NO_RECORDS = "No records in file"

# Formats decoded here; the others are listed in the README under "Not built".
DECODED_FORMATS = (".txt", ".csv", ".json")


def norm_path(path: Column) -> Column:
    """``file:/x``, ``file:///x`` and ``/x`` as one key."""
    return F.regexp_replace(path, r"^file:/+", "/")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_format(path: Column) -> Column:
    """Lower-cased extension with its dot (``''`` when there is none)."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
            .load(path))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name, file_size_bytes, file_format, file_hash (SHA-256 hex)."""
    files = list_files(spark, path)
    return files.select(
        "path", file_name(F.col("path")).alias("file_name"),
        F.col("length").alias("file_size_bytes"), file_format(F.col("path")).alias("file_format"),
        F.sha2(F.col("content"), 256).alias("file_hash"))


def validate_files(spark: SparkSession, path: str, max_file_size_mb: int = MAX_FILE_SIZE_MB,
                   expected: Sequence[str] = ()) -> DataFrame:
    """Accept or reject each file with the reason: size over the limit, ZIP
    signature in a format that is not ZIP-based, unsupported format.  Paths in
    ``expected`` that are not on storage are rejected as not found.

    Returns path, file_name, file_size_bytes, file_format, is_valid, message.
    """
    limit = max_file_size_mb * 1024 * 1024
    listing = list_files(spark, path)
    fmt = file_format(F.col("path"))
    # Oversized files are judged from the listing alone: the binaryFile source
    # takes the ``length`` filter as a pushed filter and never reads their bytes.
    big = (listing.where(F.col("length") > limit).select("path", "length")
           .withColumn("message", F.lit(MSG_TOO_LARGE.format(max_file_size_mb))))
    small = listing.where(F.col("length") <= limit).select("path", "length", "content")
    header_is_zip = F.upper(F.hex(F.substring(F.col("content"), 1, 4))) == ZIP_SIGNATURE_HEX
    small = small.select("path", "length", (
        F.when(~fmt.isin(*LEGITIMATE_ZIP_FORMATS) & header_is_zip, F.lit(MSG_ZIP_BOMB))
        .when(~fmt.isin(*SUPPORTED_FORMATS), F.concat(F.lit(MSG_UNSUPPORTED), fmt))
        .otherwise(F.lit(MSG_PASSED))).alias("message"))
    out = big.unionByName(small).select(
        "path", file_name(F.col("path")).alias("file_name"), F.col("length").alias("file_size_bytes"),
        fmt.alias("file_format"), (F.col("message") == MSG_PASSED).alias("is_valid"), "message")
    if expected:
        want = spark.createDataFrame([(p,) for p in expected], "path string")
        present = out.select(norm_path(F.col("path")).alias("key"))
        missing = (want.join(present, norm_path(want["path"]) == present["key"], "left_anti")
                   .select("path", file_name(F.col("path")).alias("file_name"),
                           F.lit(None).cast("long").alias("file_size_bytes"),
                           file_format(F.col("path")).alias("file_format"), F.lit(False).alias("is_valid"),
                           F.concat(F.lit(MSG_NOT_FOUND), F.col("path")).alias("message")))
        out = out.unionByName(missing)
    return out


def accepted_and_quarantined(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where("is_valid"), validated.where("NOT is_valid")


class Undecodable(ValueError):
    """A file of an accepted format whose content can't be read as records."""


def decode_records(fmt: str, content: bytes, csv_header: bool = True, keep_empty: bool = False) -> list[str | None]:
    """The texts of one file's records, nothing left out.

    ``.txt``: the whole file (invalid UTF-8 bytes dropped).  ``.csv``: one text
    per row, all its fields joined by spaces, whatever the number of fields in
    the header or in other rows; quoted line breaks stay within their field.
    ``.json``: one text per record (an array's elements, or the one value),
    keys in the order of the file and nulls kept.  ``keep_empty``: empty CSV
    rows are null instead of being left out.
    """
    if fmt == ".txt":
        return [content.decode("utf-8", "ignore")]
    if fmt == ".csv":
        csv.field_size_limit(1 << 30)
        try:
            rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig", "ignore"), newline=""), strict=True))
        except csv.Error as e:
            raise Undecodable(f"Error reading CSV: {e}") from e
        return [" ".join(r) if r else None for r in rows[1 if csv_header else 0:] if r or keep_empty]
    try:
        value = json.loads(content.decode("utf-8-sig"))
    except (ValueError, RecursionError) as e:
        raise Undecodable(f"Error reading JSON: {e}") from e
    return [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in (value if isinstance(value, list) else [value])]


_FILE_COLUMNS = "path string, file_name string, file_size_bytes long, file_format string, file_hash string"


def ingest_files(spark: SparkSession, path: str, max_file_size_mb: int = MAX_FILE_SIZE_MB, csv_header: bool = True,
                 normalize: bool = True, formats: Sequence[str] = DECODED_FORMATS) -> DataFrame:
    """Every file under ``path`` in one pass: a row per record with its text, or
    a row without text and with the reason where a file is rejected, has no
    decoder, can't be parsed or holds no record.

    Columns: path, file_name, file_size_bytes, file_format, file_hash (SHA-256;
    null for a file over the size limit, which is never read), record (from
    0), text, message.  Sub-folders are read, and formats are told by the
    extension in any case; each file is opened once.
    """
    ship_package(spark)
    limit, chosen = max_file_size_mb * 1024 * 1024, tuple(formats)
    listing = list_files(spark, path)
    about = [F.col("path"), file_name(F.col("path")).alias("file_name"), F.col("length").alias("file_size_bytes"),
             file_format(F.col("path")).alias("file_format")]
    big = listing.where(F.col("length") > limit).select(
        *about, F.lit(None).cast("string").alias("file_hash"), F.lit(None).cast("int").alias("record"),
        F.lit(None).cast("string").alias("text"), F.lit(MSG_TOO_LARGE.format(max_file_size_mb)).alias("message"))
    small = listing.where(F.col("length") <= limit).select(*about, F.sha2("content", 256).alias("file_hash"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _FILE_COLUMNS.split(", ")]
        for batch in batches:
            for file in batch.itertuples(index=False):
                texts, message = [], check_content(file.file_format, bytes(file.content[:4]))
                if message == MSG_PASSED and file.file_format not in chosen:
                    message = MSG_NO_DECODER + file.file_format
                if message == MSG_PASSED:
                    try:
                        texts = decode_records(file.file_format, bytes(file.content), csv_header)
                        message = MSG_PASSED if texts else MSG_NO_RECORDS
                    except Undecodable as e:
                        message = str(e)
                n = max(1, len(texts))
                out = pd.DataFrame({c: [getattr(file, c)] * n for c in names})
                out["record"] = pd.array(range(n) if texts else [None], "Int32")
                out["text"], out["message"] = texts or [None], message
                yield out

    read = small.mapInPandas(run, _FILE_COLUMNS + ", record int, text string, message string")
    out = big.unionByName(read)
    return out.withColumn("text", normalize_text(F.col("text"))) if normalize else out


def check_content(fmt: str, head: bytes) -> str:
    if fmt not in LEGITIMATE_ZIP_FORMATS and head.hex().upper() == ZIP_SIGNATURE_HEX:
        return MSG_ZIP_BOMB
    return MSG_PASSED if fmt in SUPPORTED_FORMATS else MSG_UNSUPPORTED + fmt


def documents_and_quarantine(ingested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records as documents, and the files that gave none with their reason."""
    return (ingested.where(F.col("text").isNotNull()).drop("message"),
            ingested.where(F.col("text").isNull()).drop("text", "record"))


def _read(spark: SparkSession, path: str, fmt: str, normalize: bool) -> DataFrame:
    docs, _ = documents_and_quarantine(ingest_files(spark, path, normalize=normalize, formats=(fmt,)))
    return docs.select("path", "text")


#: Files that one task reads.
FILES_PER_READ = 1000
#: Bytes of files that a task hands on at once.
_READ_BYTES = 8 << 20
#: The folder name of a null key, as Spark's writers have it.
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def local_path(path: str) -> str | None:
    """The plain form of a path on a mounted file system, null for other storage and for patterns.

    Spark reaches such files through Hadoop's local file system, which starts processes for
    each file written, lists all in the driver, and counts each one read as 4 MB of a task.
    There they are written, listed and read by the tasks themselves."""
    plain = re.sub(r"^file:/+", "/", path)
    if re.search(r"[{}\[\]*?\\]", plain) or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", plain):
        return None
    return os.path.abspath(plain)


def _visible(name: str) -> bool:
    """What Spark's listing takes for data."""
    if name.startswith(("_metadata", "_common_metadata")):
        return True
    return not ((name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_"))


def _entries(folder: str) -> Iterator[tuple[str, bool]]:
    """Path, and whether it is a folder, of what lies in ``folder``."""
    with os.scandir(folder) as inside:
        for e in inside:
            if _visible(e.name):
                yield e.path, e.is_dir()


def _walk(folder: str) -> Iterator[str]:
    folders = [folder]
    while folders:
        for path, is_folder in _entries(folders.pop()):
            if is_folder:
                folders.append(path)
            else:
                yield path


def local_listing(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (as Spark names it) of every file under ``root``: folders are dealt to tasks, no list is in the driver."""
    ship_package(spark)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                yield from _batches([(folder, False)] if os.path.isfile(folder) else _entries(folder))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, is_folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _batches((x, False) for x in (_walk(path) if is_folder else [path]))

    kind = "path string, folder boolean"
    first = cut_lineage(spark.createDataFrame([(root,)], "path string").coalesce(1).mapInArrow(top, kind))
    tasks = min(-(-first.count() // 8), 8 * spark.sparkContext.defaultParallelism)
    files = first.repartition(max(1, tasks)).mapInArrow(below, kind)
    return files.select(F.concat(F.lit("file:"), "path").alias("path"))


def _batches(rows: Iterator[tuple[str, bool]], size: int = 10000) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, bool]] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], ["path", "folder"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], ["path", "folder"])


def local_contents(files: DataFrame, files_per_task: int = FILES_PER_READ) -> DataFrame:
    """``path, content`` of ``files`` (``path``), dealt to tasks by their number."""
    files = cut_lineage(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, contents, size = [], [], 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
        for b in batches:
            for path in b.column(0).to_pylist():
                with open(path.removeprefix("file:"), "rb") as f:
                    contents.append(f.read())
                paths.append(path)
                size += len(contents[-1])
                if size >= _READ_BYTES:
                    yield whole()
                    paths, contents, size = [], [], 0
        if paths:
            yield whole()

    tasks = -(-files.count() // files_per_task)
    return files.repartition(max(1, tasks)).mapInArrow(run, "path string, content binary")


def write_text_files(docs: DataFrame, path: str, key: str, files_per_task: int) -> None:
    """The texts of each ``key`` (a number) as lines of one file, in a folder of its own: ``task=../key=../part-..txt``.

    A task's folders lie in one folder, which is moved into place when it is whole; what is left of an
    attempt that was cut short stays hidden from readers."""
    tasks = max(1, -(-docs.count() // files_per_task))
    dealt, root = docs.repartition(tasks, key), local_path(path)
    if root is None:
        dealt.select("text", key, F.spark_partition_id().alias("task")).write.partitionBy("task", key).text(path)
        return
    os.makedirs(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        attempt, open_key, file = f"{root}/.task={task}-{TaskContext.get().taskAttemptId()}", None, None
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if file is None or k != open_key:
                    if file is not None:
                        file.close()
                    folder, open_key = f"{attempt}/{key}={_NULL_FOLDER if k is None else k}", k
                    os.makedirs(folder)
                    file = open(f"{folder}/part-{task:05d}.txt", "wb")
                file.write((text or b"") + b"\n")
        if file is not None:
            file.close()
            try:
                os.rename(attempt, f"{root}/task={task}")
            except OSError:  # another attempt has put it in place
                if not os.path.isdir(f"{root}/task={task}"):
                    raise
        yield pa.RecordBatch.from_arrays([pa.array([int(file is not None)], pa.int32())], ["written"])

    rows = dealt.select(key, F.col("text").cast("binary").alias("text")).sortWithinPartitions(key)  # bytes as they are, also those that aren't UTF-8
    rows.mapInArrow(run, "written int").agg(F.sum("written")).collect()


def read_text_files(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """One document per ``.txt`` file: invalid UTF-8 bytes dropped, then normalized."""
    root = local_path(path)
    if root is not None and not os.path.exists(root):
        root = None  # Spark's listing says what is missing
    files = (list_files(spark, path) if root is None else local_listing(spark, root)).where(file_format(F.col("path")) == ".txt")
    text = make_valid_text(F.col("content").cast("string"))
    return (files if root is None else local_contents(files)).select("path", (normalize_text(text) if normalize else text).alias("text"))


def read_csv_files(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """One document per CSV row, each file with its own columns."""
    return _read(spark, path, ".csv", normalize)


def read_json_files(spark: SparkSession, path: str, normalize: bool = True, pattern: str | None = None) -> DataFrame:
    """One document per JSON record (a file holds one record or an array of
    records), non-ASCII kept.  ``pattern``: take the files of that glob as JSON."""
    if pattern is None:
        return _read(spark, path, ".json", normalize)
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch.itertuples(index=False):
                texts = decode_records(".json", bytes(file.content))
                yield pd.DataFrame({"path": [file.path] * len(texts), "text": texts})

    out = files.select("path", "content").mapInPandas(run, "path string, text string")
    return out.withColumn("text", normalize_text(F.col("text"))) if normalize else out


def load_documents(spark: SparkSession, path: str, max_file_size_mb: int = MAX_FILE_SIZE_MB, csv_header: bool = True) -> DataFrame:
    """The documents of all decoded files, with path, file columns and record;
    ``ingest_files`` also has the files that gave none."""
    docs, _ = documents_and_quarantine(ingest_files(spark, path, max_file_size_mb, csv_header))
    return docs
