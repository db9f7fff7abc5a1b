"""Rows whose work is far larger than their bytes are dealt to tasks by their number."""

import pytest
from pyspark.sql import functions as F

from redactflow import tables as TB
from redactflow.plans.joins import ROWS_PER_TASK, SPREAD


@pytest.fixture
def as_found(spark):
    """Inputs keep their splits, as in a session that doesn't deal them."""
    before = spark.conf.get(SPREAD)
    spark.conf.set(SPREAD, "0")
    yield spark
    spark.conf.set(SPREAD, before)


def test_forms_spread_by_rows(as_found, tmp_path):
    """One file of one row group, and most rows of one key."""
    n = 3 * ROWS_PER_TASK
    key = F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7)
    rows = as_found.range(0, n, 1, 1).select(key.alias("c_custkey"), F.lit("Customer#1").alias("c_name"), F.lit(3).alias("c_nationkey"),
                                             F.lit("BUILDING").alias("c_mktsegment"))
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    for texts in (TB.customer_forms(as_found, str(tmp_path)), TB.long_forms(as_found, str(tmp_path))):
        sizes = [r["count"] for r in texts.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and len(sizes) == 3 and max(sizes) < 1.1 * ROWS_PER_TASK


def test_range_bounds_run_no_plan_twice(as_found):
    """The first pass of a range partitioning reads written rows: each row is made once."""
    from redactflow.plans.versions import in_ranges

    made = as_found.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    ranged = in_ranges(as_found.range(0, 1000, 1, 2).select(counted.asNondeterministic()("id").alias("k"), F.lit(1).alias("o")), "k", "o", 4)
    assert ranged.count() == 1000 and made.value == 1000


def test_src_text_moves_one_folder_per_task(as_found, tmp_path, monkeypatch):
    """Files of a task share a folder; each document is a file, read back under its id."""
    import os

    from redactflow import catalog

    out = str(tmp_path / "files")
    monkeypatch.setattr(catalog, "_fresh_dir", lambda spark, name: out)
    as_found.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("a  b\n"), F.col("id").cast("string")).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.text for r in catalog.q_src_text(as_found, str(tmp_path)).collect()}
    assert rows == {i: f"a b {i}" for i in range(600)}
    top = [d for d in os.listdir(out) if "=" in d]
    assert len(top) == 3 and sum(len(os.listdir(f"{out}/{d}")) for d in top) == 600


def test_rule_forms_match_as_written(spark):
    """The Java forms with a cheap leading boundary find what the plain forms find, beyond ASCII too."""
    from redactflow.operators.rules import DEFAULT_RULES, RULES_BY_NAME, WB, java_regex

    parts = ["a.b@c.de", "%x@y.org|", "é+1 (555) 123-4567", "(555)123-4567é", "_555-123-4567", "1234 5678 9012", "٣٣٣-12-3456", "١٢٣٤٥٦٧٨", "4111111111111111",
             "10.0.0.255", "www.x.org/a", "ſhttps://h.org/u@m.org", "Reg No: RX-0001", "Kname: Ann Lee", "name: Ann Leeé", "twitter.com/ann's", "İ@İ.com", "ı.K@ſ.net"]
    texts = [a + sep + b for a in parts for b in parts for sep in ("", " ", ".", "_", "-", "é", "+")]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    for r in (r for r in DEFAULT_RULES if not r.anchored):
        found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(r.group))  # noqa: B023, E731
        assert df.where(found(r.java) != found(java_regex(r.pattern, r.ignore_case))).count() == 0, r.name
    assert WB not in RULES_BY_NAME["detect_aadhaar"].java  # one look-behind and one look-ahead
    assert "]++" in RULES_BY_NAME["detect_email"].java


def test_boost_looks_for_held_words_only(spark):
    from redactflow.operators.boost import anchor_boost, held_words

    df = spark.createDataFrame([("an Income of 5, his PASSPORT", "income"), ("none", "income passport"), (None, "id"), ("ssn", "x")], "text string, near string")
    rows = df.select(anchor_boost(F.col("near"), held_words(F.col("text"))).alias("b")).collect()
    assert [round(r.b, 4) for r in rows] == [0.05, 0.0, 0.0, 0.0]


def test_boost_of_short_texts_by_place(spark):
    """Places of the anchor words give the boosts that the slices give: overlapping words, reaches' ends, shifted offsets, long texts."""
    import random

    from redactflow.operators.boost import anchor_boost, anchor_places, context_boost, held_words
    from redactflow.operators.detect import ENTITIES_TYPE
    from redactflow.functions.text import context_slice

    low = spark.createDataFrame([("treatmentreatment account_number id",)], "text string")
    got = low.select(anchor_places(F.col("text"), held_words(F.col("text"))).alias("p")).first().p
    assert sorted((p.c, p.s, p.e) for p in got) == [(1, 0, 9), (1, 8, 17), (2, 18, 25), (3, 33, 35)]

    rnd = random.Random(7)
    words = "treatmentreatment patient SSN ſſn Kid İd i̇d account_number accoun transaction wage éß .".split()
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (1, 2, 5, 30, 60, 400) for _ in range(6)] + ["no such wörd " * 9, ""]
    ents = lambda t: [(s, s + n, t[s:s + n], "URL", 0.9 + 0.04 * (n % 3), "x", 0, 0) for s in range(0, len(t), 13) for n in (1, 5)]
    df = spark.createDataFrame([(i, t, ents(t)) for i, t in enumerate(texts)], f"id int, text string, ents {ENTITIES_TYPE.simpleString()}").repartition(4)
    by_slice = F.transform("ents", lambda x: F.least(x["confidence"] + anchor_boost(F.lower(context_slice(F.col("text"), x["s"], x["e"]))), F.lit(1.0)))
    by_place = F.transform(context_boost(F.col("ents"), F.col("text")), lambda x: x["confidence"])
    assert df.where(~by_slice.eqNullSafe(by_place)).count() == 0


def test_struct_sorts_in_natural_order(spark):
    """Stable, each key in its direction, without a comparator lambda; a span keeps its first window and its highest confidence."""
    import io
    import random
    from contextlib import redirect_stdout

    from redactflow.functions.arrays import sort_structs
    from redactflow.operators.detect import ENTITIES_TYPE, dedup_document_spans

    rnd = random.Random(3)
    rows = [(rnd.randrange(4), rnd.randrange(4), rnd.choice("ab"), rnd.choice(("URL", "EMAIL")), rnd.choice((0.9, 0.98, 1.0, float("nan"))), "x", i, rnd.randrange(3))
            for i in range(200)]
    df = spark.createDataFrame([(rows,), ([],), (None,)], f"e {ENTITIES_TYPE.simpleString()}")
    found = df.select(sort_structs(F.col("e"), [("s", True), ("confidence", True), ("window_id", False)]).alias("x"), dedup_document_spans(F.col("e")).alias("d"))
    x, empty, null = found.collect()
    as_great = lambda c: float("inf") if c != c else c
    assert [y["rank"] for y in x.x] == [r[6] for r in sorted(rows, key=lambda r: (-r[0], -as_great(r[4]), r[7]))]
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[1], r[3], r[2]), []).append(r)
    expected = sorted((k[0], k[1], min(r[7] for r in g), k[2], k[3], max(as_great(r[4]) for r in g)) for k, g in groups.items())
    assert [(y.s, y.e, y.window_id, y.entity_type, y.text, as_great(y.confidence)) for y in x.d] == expected
    assert empty.x == [] and empty.d == [] and null.x is None and null.d is None
    with redirect_stdout(io.StringIO()) as plan:
        found.explain(True)
    assert "sort_array" in plan.getvalue() and "array_sort(" not in plan.getvalue()


def test_scan_forms_match_as_written():
    """The forms that ``re`` scans quickly find what the rule texts find, folded letters and digits beyond ASCII too."""
    import random
    import re

    from redactflow.operators.rules import DEFAULT_RULES, SCAN_FORMS, Rule

    parts = ["a.b@c.de", "é+1 (555) 123-4567", "(555)123-4567é", "_555-123-4567", "1234 5678 9012", "٣٣٣-12-3456", "4111111111111111", "378282246310005", "5512345678901234",
             "10.0.0.255", "256.1.1.1", "01.002.3.4", "249.199.99.9", "www.x.org/a", "ſhttps://h.org/u@m.org", "Reg No: RX-0001", "REGISTRATION number#AB-12345", "Kname: Ann Lee",
             "ſtudent - Bo Al", "twitter.com/ann's", "HTTPS://WWW.X.COM/abc.", "wWw.lınkedİn.com/in/q-1", "İnstagram.com/ab", "1-555-204-7731", "+1.5552047731", "1(555)2047731",
             "000-12-3456", "666-12-3456", "900-12-3456", "060-12-0000", "x.com/abc", "\n", "\x1c", "0", "+", "("]
    rnd = random.Random(5)
    texts = [a + sep + b for a in parts for b in parts for sep in ("", " ", ".", "_", "-", "é", "1")]
    texts += ["".join(rnd.choice("0123456789" * 3 + "+-.() é_a1٣9@/:\n") for _ in range(rnd.randrange(60))) for _ in range(5000)]
    for r in DEFAULT_RULES:
        spans = lambda pattern: [[m.span(r.group) for m in pattern.finditer(t)] for t in texts]  # noqa: B023, E731
        assert spans(re.compile(*r.python)) == spans(re.compile(r.pattern, re.IGNORECASE if r.ignore_case else 0)), r.name
    assert len(SCAN_FORMS) == 10
    assert Rule("own", "OWN", r"\bx\b", 1.0, 0).python == (r"\bx\b", re.IGNORECASE)


def test_rules_are_matched_outside_array_expressions(spark):
    """No match is made into a span node by node; texts with every mark, invalid bytes, nulls and empty ones keep their spans."""
    import io
    from contextlib import redirect_stdout

    from redactflow.plans.scrub import ScrubConfig, detect
    from tests.pymodel import entities

    texts = ["", "x" * 399 + " a@b.org " + "y" * 480 + " c@d.org", "Ann Lee wrote: ssn 321-54-9876, name: Bo Li", " a@b.org " * 90, "plain " * 300, "é\U0001F600 a@b.org"]
    df = spark.createDataFrame([*enumerate(texts), (98, None)], "doc_id int, text string").unionByName(
        spark.sql("SELECT 99 AS doc_id, CAST(X'FF612E62406D2E6F7267206E' AS STRING) AS text"))
    found = detect(df, cfg=ScrubConfig())
    rows = {r.doc_id: [(x.s, x.e, x.text, x.entity_type, round(x.confidence, 6), x.window_id) for x in r.entities] for r in found.select("doc_id", "entities").collect()}
    assert rows.pop(98) == [] and [x[:4] for x in rows.pop(99)] == [(1, 10, "a.b@m.org", "EMAIL")]
    assert rows == {i: [(x[0], x[1], x[2], x[3], round(x[4], 6), x[5]) for x in entities(t)] for i, t in enumerate(texts)}
    with redirect_stdout(io.StringIO()) as plan:
        found.explain(True)
    assert "ArrowEvalPython" in plan.getvalue() and "regexp_replace" not in plan.getvalue()


def test_islands_fold_places(spark):
    """Islands of spans over blocks of the fold, with the fold carrying numbers and not islands."""
    import io
    import random
    from contextlib import redirect_stdout

    from redactflow.operators.detect import ENTITIES_TYPE
    from redactflow.operators.redact import merge_overlaps

    rnd = random.Random(11)
    docs = [[], None]
    for n in (1, 2, 127, 128, 129, 400):
        at = sorted((s := rnd.randrange(6 * n), s + rnd.randrange(1, 14)) for _ in range(n))
        docs.append([(s, e, "x", rnd.choice(("URL", "EMAIL")), 1.0, "r", 0, 0) for s, e in at])
    docs.append([(5 * i, 5 * i + 6, "x", "URL", 1.0, "r", 0, 0) for i in range(300)])  # one island
    df = spark.createDataFrame([*enumerate(docs)], f"i int, ents {ENTITIES_TYPE.simpleString()}").select("i", merge_overlaps(F.col("ents")).alias("m"))
    for i, got in df.collect():
        want = []
        for s, e, _, kind, *_ in docs[i] or []:
            if want and s < want[-1][1]:
                want[-1][1:3] = max(e, want[-1][1]), want[-1][2] + 1
            else:
                want.append([s, e, 1, kind])
        assert [[*x] for x in got] == want
    with redirect_stdout(io.StringIO()) as plan:
        df.explain(True)
    assert "cast(array() as array<int>)" in plan.getvalue()


def test_text_files_without_a_process_each(as_found, tmp_path):
    """Written and read by the tasks: a null text, repeated and null keys, bytes that aren't UTF-8, hidden files, sub-folders; no task per few files."""
    import os

    from redactflow.sources.files import FILES_PER_READ, list_files, local_path, read_text_files, write_text_files

    root = str(tmp_path / "out")
    docs = as_found.sql("SELECT * FROM VALUES (1L, X'61FF62'), (2L, null), (3L, X'63'), (3L, X'64'), (null, X'65'), (-4L, X'') AS t(doc_id, b)")
    docs = docs.select("doc_id", F.col("b").cast("string").alias("text")).union(as_found.range(100, 1300).select("id", F.col("id").cast("string")))
    write_text_files(docs, f"file://{root}", "doc_id", 250)
    assert sorted(os.listdir(root)) == [f"task={k}" for k in range(5)]  # no .crc, nothing left of attempts
    os.makedirs(f"{root}/_not")
    os.makedirs(f"{root}/_x=1/deep er")
    for name in ("_not/a.txt", "_b.txt", ".c.txt", "d.TXT", "e.csv", "_x=1/deep er/f.txt", "_x=1/g.txt._COPYING_"):
        with open(f"{root}/{name}", "w") as f:
            f.write(name)
    found = read_text_files(as_found, f"file://{root}")
    rows = {r.path: r.text for r in found.collect()}
    listed = {r.path for r in list_files(as_found, root).select("path").collect()}
    assert set(rows) == {p for p in listed if p.lower().endswith(".txt")} and len(rows) == 1207
    texts = {p.split("/")[-2]: t for p, t in rows.items()}
    assert texts["doc_id=1"] == "ab" and texts["doc_id=2"] == "" and sorted(texts["doc_id=3"].split()) == ["c", "d"] and texts["doc_id=-4"] == ""
    assert texts["doc_id=__HIVE_DEFAULT_PARTITION__"] == "e" and texts["doc_id=777"] == "777" and texts["deep er"] == "_x=1/deep er/f.txt"
    assert found.rdd.getNumPartitions() == -(-1207 // FILES_PER_READ)
    one = f"{root}/d.TXT"
    assert [tuple(r) for r in read_text_files(as_found, one).collect()] == [(f"file:{one}", "d.TXT")]
    assert local_path("hdfs://h/a") is None and local_path("/a/*.txt") is None and local_path("file:///a b") == "/a b"
