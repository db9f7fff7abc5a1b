"""CSV files read in splits, and pseudonyms that hold over a stream."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from redactflow.operators.report import pseudonymize_corpus
from redactflow.operators import redact as R
from redactflow.plans.scrub import detect
from redactflow.sources.csv_split import quoted_after, read_csv_split
from redactflow.sources.files import Undecodable, decode_records
from redactflow.streaming.stream import run_pseudonyms


def test_quoted_after_a_line():
    for line, out, inside in [(b"a,b", False, True), (b'a,"b', True, False), (b'"a""b",c', False, False), (b'x"y', False, False), (b'a"",b', False, True),
                              (b'"a"', False, True), (b'","', False, False), (b'","a', False, True), (b'a\r"b', True, False), (b"", False, True), (b'""', False, True), (b'"""', True, False)]:
        got = quoted_after(line, False), quoted_after(line, True)
        whole = lambda before: _open(before + line)
        assert got[0] == out == whole(b""), line
        if got[1] is not inside:
            assert got[1] == _open(b'"' + line), line


def _open(text):
    """Whether a quoted field is open at the end, by the csv module: a line break there belongs to the field."""
    rows = list(csv.reader(io.StringIO((text + b"\n!END").decode(), newline="")))
    return not (rows and rows[-1] == ["!END"])


@pytest.fixture
def small_splits(spark):
    """Sets the size of a split; the default is put back."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def size(n):
        for k in keys:
            spark.conf.set(k, str(n))

    yield size
    for k, v in before.items():
        spark.conf.set(k, v)


def content(seed, rows=60):
    r = random.Random(seed)
    field = lambda: r.choice(["", "a", "b c", '"q"', '"x\ny"', '"x, ""y""\n\n,z"', 'st"ray', "é\xa0", '"\r\n"', "long " * r.randint(1, 9), '"' + "in\n" * r.randint(1, 12) + '"'])
    lines = [",".join(field() for _ in range(r.randint(1, 4))) for _ in range(rows)]
    return ("h1,h2\n" + r.choice(["\n", "\r\n"]).join(lines) + r.choice(["", "\n", "\n\n"])).encode()


@pytest.mark.parametrize("split", [7, 64, 500, 1 << 20])
def test_splits_give_the_whole_files_records(spark, tmp_path, small_splits, split):
    files = {f"f{k}.csv": content(k) for k in range(4)} | {"bom.csv": b"\xef\xbb\xbfa,b\n1,2\n", "empty.csv": b"", "one.csv": b"only,header", "bytes.csv": b"h\n\xffx,\xc3\n", "bad.csv": b'h\n"a"b,c\n1,2\n', "open.csv": b'h\n1\n"never\nclosed\n'}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    small_splits(split)
    got = {}
    for row in read_csv_split(spark, str(tmp_path), normalize=False).collect():
        got.setdefault(row.path.split("/")[-1], []).append((row.record, row.text, row.message))
    for name, data in files.items():
        try:
            want = [(i, t, None) for i, t in enumerate(decode_records(".csv", data))]
            assert sorted(got.pop(name, [])) == want, name
        except Undecodable as e:
            assert [x[:2] for x in got.get(name, [])] == [(None, None)] and got.pop(name)[0][2].startswith(str(e)[:18]), name
    assert not got


def test_one_file_lies_in_many_splits(spark, tmp_path, small_splits):
    (tmp_path / "big.csv").write_bytes(b"h\n" + b"".join(b'%d,"line\nline %d"\n' % (i, i) for i in range(5000)))
    small_splits(4096)
    out = read_csv_split(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert {r.record: r.text for r in out.collect()} == {i: f"{i} line line {i}" for i in range(5000)}
    assert read_csv_split(spark, str(tmp_path), csv_header=False).count() == 5001


# ---- names over a stream --------------------------------------------------------------

TEXTS = ["Mail a@b.org and c@d.org", "Again a@b.org, call 555-123-4567", None, "", "c@d.org x@y.org", "Name: Ann Lee wrote to a@b.org", "z@z.org 555-123-4567 555-987-6543"]


def test_stream_names_hold_and_restart(spark, tmp_path):
    schema = "doc_id long, text string"
    source = str(tmp_path / "in")
    for i, t in enumerate(TEXTS[:4]):  # one file and one micro-batch each
        spark.createDataFrame([(i, t)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    docs, names = run_pseudonyms(stream(), path, checkpoint)
    early = {(r.text, r.entity_type): r.pseudonym for r in names.collect()}
    assert docs.count() == 4 and len(early) == 3
    # a last batch that was cut short after it wrote: its commit is lost, so it is run again
    (tmp_path / "checkpoint" / "commits" / "3").unlink()
    for crc in (tmp_path / "checkpoint" / "commits").glob(".3.crc"):
        crc.unlink()
    for i, t in enumerate(TEXTS[4:], 4):
        spark.createDataFrame([(i, t)], schema).coalesce(1).write.mode("append").parquet(source)
    docs, names = run_pseudonyms(stream(), path, checkpoint)
    late = {(r.text, r.entity_type): r.pseudonym for r in names.collect()}
    assert early.items() <= late.items()
    found = detect(spark.createDataFrame(list(enumerate(TEXTS)), schema)).select("doc_id", F.posexplode(R.redaction_order(F.col("entities"))).alias("seq", "x"))
    rows = found.select("doc_id", F.col("seq").cast("long").alias("seq"), "x.text", "x.entity_type")
    assert late == {(r.text, r.entity_type): r.pseudonym for r in pseudonymize_corpus(rows).collect()}
    text = {r.doc_id: r.redacted_text for r in docs.collect()}
    assert len(text) == docs.count() == len(TEXTS)
    assert text[1].startswith("Again " + late["a@b.org", "EMAIL"] + ", call ") and text[2] is None and text[3] == ""
