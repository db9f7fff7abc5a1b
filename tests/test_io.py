"""F10 file checks, file sources, sinks, streaming and the driver contract."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from redactflow.plans.scrub import ScrubConfig, scrub
from redactflow.sources import files as FS
from redactflow.sources import sinks as SK


def _tmpdir():
    return tempfile.mkdtemp(prefix="redactflow-test-")


def _write(d, name, data: bytes):
    with open(os.path.join(d, name), "wb") as f:
        f.write(data)
    return os.path.join(d, name)


def test_f10_validation(spark):
    d = _tmpdir()
    _write(d, "b.txt", b"PK\x03\x04rest")
    _write(d, "b.docx", b"PK\x03\x04rest")
    _write(d, "a.txt", b"ab\xffcd")
    _write(d, "a.xml", b"<x/>")
    _write(d, "big.txt", b"x" * (2 * 1024 * 1024 + 1))
    out = FS.validate_files(spark, d, max_file_size_mb=2, expected=[os.path.join(d, "missing.txt")])
    got = {r.file_name: (r.is_valid, r.message) for r in out.collect()}
    assert got["b.txt"] == (False, "Potential ZIP bomb detected")
    assert got["b.docx"] == (True, "File validation passed")
    assert got["a.txt"] == (True, "File validation passed")
    assert got["a.xml"] == (False, "Unsupported file format: .xml")
    assert got["big.txt"] == (False, "File exceeds max size of 2MB")
    assert got["missing.txt"][0] is False and got["missing.txt"][1].startswith("File not found: ")


def test_manifest_and_text_source(spark):
    import hashlib
    d = _tmpdir()
    _write(d, "a.txt", b"ab\xffcd\n\n  e")
    m = FS.file_manifest(spark, d).first()
    assert (m.file_name, m.file_size_bytes, m.file_format) == ("a.txt", 10, ".txt")
    assert m.file_hash == hashlib.sha256(b"ab\xffcd\n\n  e").hexdigest()
    assert FS.read_text_files(spark, d).first().text == "abcd e"


def test_csv_and_json_sources(spark):
    d = _tmpdir()
    _write(d, "p.csv", b"name,mail\nAnn Lee,ann@x.org\nBob,bob@y.com\n")
    _write(d, "q.json", json.dumps({"user": "Zoë", "mail": "z@q.io"}, ensure_ascii=False).encode())
    csv_texts = sorted(r.text for r in FS.read_csv_files(spark, d).collect())
    assert csv_texts == ["Ann Lee ann@x.org", "Bob bob@y.com"]
    js = FS.read_json_files(spark, d).first().text
    assert "Zoë" in js and "z@q.io" in js
    docs = FS.load_documents(spark, d)
    assert docs.count() == 3


def test_sinks(spark, docs):
    d = docs("mail a@b.co and 4111111111111111")
    out = scrub(d, cfg=ScrubConfig(mode="placeholder"))
    root = _tmpdir()
    assert SK.write_outputs(out, os.path.join(root, "txt"), "txt")
    assert SK.write_outputs(out, os.path.join(root, "json"), "json")
    assert SK.write_outputs(out, os.path.join(root, "csv"), "csv")
    try:
        SK.write_outputs(out, os.path.join(root, "x"), "xml")
        raise AssertionError("expected ValueError")
    except ValueError as e:
        assert "Unsupported format" in str(e)
    js = spark.read.json(os.path.join(root, "json")).first()
    assert js.redacted_text == "mail <EMAIL> and <CREDIT_CARD>"
    assert "original_text" not in js.redaction_metadata[0].asDict()
    csv = spark.read.option("header", True).csv(os.path.join(root, "csv")).collect()
    assert len(csv) == 2
    empty = scrub(docs("nothing here"))
    assert SK.write_metadata_csv(empty, os.path.join(root, "csv2")) is False
    rep = SK.audit_report_rows(out, "placeholder").first()
    assert rep.redaction_stats.total_redacted == 2 and rep.redaction_stats.audit_entries == 2
    assert list(rep.compliance_certifications) == ["gdpr", "hipaa", "ccpa", "dpdp"]
    names = spark.range(1).select(SK.output_names(SK.file_stem(F.lit("/in/cv.final.pdf"))).alias("n")).first().n
    assert (names.redacted, names.metadata, names.audit) == ("cv.final_redacted.txt", "cv.final_metadata.json",
                                                             "cv.final_audit.json")


def test_pseudonym_map_in_json_rows(spark, docs):
    out = scrub(docs("a@b.co then a@b.co and c@d.io"), cfg=ScrubConfig(mode="pseudonym", pseudonymize=True))
    row = SK.metadata_json_rows(out, include_original=True).first()
    assert row.redacted_text == "USER_EMA_2 then USER_EMA_2 and USER_EMA_1"
    assert dict(row.pseudonym_map) == {"a@b.co_EMAIL": "USER_EMA_2", "c@d.io_EMAIL": "USER_EMA_1"}


def test_default_json_holds_no_original_text(spark, docs):
    secrets = ["a@b.co", "c@d.io", "123-45-6789"]
    for mode in ("full", "placeholder", "pseudonym"):
        out = scrub(docs("mail a@b.co then a@b.co, c@d.io and SSN 123-45-6789"), cfg=ScrubConfig(mode=mode, pseudonymize=mode == "pseudonym"))
        path = os.path.join(_tmpdir(), "json")
        SK.write_metadata_json(out, path)
        written = "".join(r.value for r in spark.read.text(path).collect())
        assert "redaction_metadata" in written and not any(x in written for x in secrets), mode


def test_clashing_pseudonym_keys(spark):
    entity = "struct<window_id:int,rank:int,s:int,e:int,text:string,entity_type:string,confidence:double,replacement:string>"
    rows = [(1, "t", [(0, 0, 5, 6, "a", "B_C", 1.0, "USER_B_C_1"), (0, 0, 0, 3, "a_B", "C", 1.0, "USER_C_1")], [])]
    meta = "array<struct<original_text:string,entity_type:string>>"
    out = spark.createDataFrame(rows, f"doc_id long, redacted_text string, entities array<{entity}>, redaction_metadata {meta}")
    assert dict(SK.metadata_json_rows(out, include_original=True).first().pseudonym_map) == {"a_B_C": "USER_C_1"}


def test_loading_is_lossless(spark):
    d = _tmpdir()
    os.makedirs(os.path.join(d, "sub"))
    _write(d, "a.csv", b"id,text\n1,plain\n2,\"two\nlines\"\n")
    _write(d, "b.csv", b"id,text,phone,mail\n1,hello,555-123-4567,bob@y.org\n2,more,x,y,extra@cell.org\n")
    _write(d, "C.CSV", b"h\nupper@case.org\n")
    _write(d, os.path.join("sub", "d.csv"), b"h\nsub@folder.org\n")
    _write(d, "F.JSON", '[{"z": null, "a": "é"}, {"b": [1, {"c": "deep@key.org"}]}]'.encode())
    _write(d, "g.json", b'{"one": 1}')
    _write(d, "bad.json", b'{"one": ')
    _write(d, "empty.csv", b"h\n")
    _write(d, "t.TXT", b"some text")
    _write(d, "h.pdf", b"%PDF-1.4")
    _write(d, "i.xml", b"<x/>")
    _write(d, "z.txt", b"PK\x03\x04")
    _write(d, "huge.txt", b"x" * (1024 * 1024 + 1))
    got = FS.ingest_files(spark, d, max_file_size_mb=1)
    docs, bad = FS.documents_and_quarantine(got)
    texts = {}
    for r in docs.orderBy("record").collect():
        texts.setdefault(r.file_name, []).append(r.text)
    assert texts == {
        "a.csv": ["1 plain", "2 two lines"], "b.csv": ["1 hello 555-123-4567 bob@y.org", "2 more x y extra@cell.org"],
        "C.CSV": ["upper@case.org"], "d.csv": ["sub@folder.org"], "F.JSON": ['{"z":null,"a":"é"}', '{"b":[1,{"c":"deep@key.org"}]}'],
        "g.json": ['{"one":1}'], "t.TXT": ["some text"]}
    why = {r.file_name: r.message for r in bad.collect()}
    assert set(why) == {"bad.json", "empty.csv", "h.pdf", "i.xml", "z.txt", "huge.txt"} and why["h.pdf"] == "No decoder for format: .pdf"
    assert why["bad.json"].startswith("Error reading JSON") and why["empty.csv"] == "No records in file"
    assert set(texts) | set(why) == {r.file_name for r in FS.list_files(spark, d).select(FS.file_name(F.col("path")).alias("file_name")).collect()}
    assert FS.load_documents(spark, d, 1).count() == 10
    assert FS.load_documents(spark, d, 1, csv_header=False).count() == 15


def test_process_files(spark):
    from redactflow.plans.files import process_files

    d, out = _tmpdir(), os.path.join(_tmpdir(), "out")
    _write(d, "a.csv", b"id,mail\n1,ann@x.org\n2,bob@y.org\n")
    _write(d, "b.txt", b"call ann@x.org")
    _write(d, "c.pdf", b"%PDF")
    rows = {r.file_name: r for r in process_files(spark, d, out).collect()}
    assert (rows["a.csv"].status, rows["a.csv"].documents, rows["a.csv"].entities_found, dict(rows["a.csv"].by_type)) == ("completed", 2, 2, {"EMAIL": 2})
    assert list(rows["b.txt"].output_files) == ["b_redacted.txt", "b_metadata.json", "b_audit.json"] and rows["b.txt"].file_size == 14
    assert rows["c.pdf"].status == "rejected" and rows["c.pdf"].message == "No decoder for format: .pdf"
    texts = sorted(r.redacted_text for r in spark.read.parquet(f"{out}/redacted").collect())
    assert len(texts) == 3 and not any("@" in t for t in texts)
    run = spark.read.json(f"{out}/run").first()
    assert (run.total_redacted, run.audit_entries) == (3, 3)


def test_stream_scrub_matches_batch(spark):
    from redactflow.streaming.stream import run_to_table, stream_scrub
    src = "/root/testdata/sf0.001"
    batch = {r.doc_id: r.redacted_text for r in scrub(spark.read.parquet(f"{src}/documents.parquet")
                                                      .select("doc_id", "text")).collect()}
    schema = spark.read.parquet(f"{src}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{src}/documents.parq*").select("doc_id", "text")
    run_to_table(stream_scrub(stream), "t_stream_scrub")
    got = {r.doc_id: r.redacted_text for r in spark.table("t_stream_scrub").collect()}
    assert got == batch


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["doc_id", "redacted_text"] and df.count() >= 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 60


def test_null_and_empty_texts(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a@b.co")], "doc_id long, text string")
    rows = {r.doc_id: r for r in scrub(d).collect()}
    assert rows[1].entities == [] and rows[1].redacted_text is None
    assert rows[2].entities == [] and rows[2].redacted_text == ""
    assert rows[3].redacted_text == "██████"


def test_stream_entity_counts_window_and_watermark(spark):
    """Counts per event-time hour; a row arriving after the watermark passed
    its window is dropped (append mode emits closed windows only)."""
    import datetime as dt
    from redactflow.streaming.stream import stream_entity_counts
    d = _tmpdir()
    t0 = dt.datetime(2024, 1, 1, 0, 10)
    batches = [[(t0, "user 00000001 click"), (t0 + dt.timedelta(minutes=20), "user 00000002 view")],
               [(t0 + dt.timedelta(hours=3), "user 00000003 view")],
               [(t0 + dt.timedelta(minutes=5), "user 00000004 late")]]
    schema = "ts timestamp, text string"
    src = os.path.join(d, "in")
    os.makedirs(src)
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    counts = stream_entity_counts(stream, "ts", F.col("text"), window="1 hour", watermark="1 hour")
    q = (counts.writeStream.format("memory").queryName("t_counts").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ckpt")).start())
    try:
        for i, b in enumerate(batches):
            spark.createDataFrame(b, schema).coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
            import time
            time.sleep(0.2)
            q.processAllAvailable()
        spark.createDataFrame([(t0 + dt.timedelta(hours=6), "user 00000005 x")], schema).coalesce(1) \
            .write.parquet(os.path.join(src, "b9"))
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.w.start.hour, r.entity_type): r.n for r in spark.table("t_counts").collect()}
    assert got[(0, "REGISTRATION_NUMBER")] == 2  # the late row of hour 0 is not counted
