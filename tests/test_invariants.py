"""Invariants and an independent model on random texts."""

import random

from pyspark.sql import functions as F

from redactflow.plans.scrub import ScrubConfig, detect, entity_rows, scrub
from tests import pymodel

PIECES = ["john@example.com", "a.b@c.org", "+1 (555) 123-4567", "5551234567", "123-45-6789", "4111111111111111",
          "192.168.0.1", "300.1.1.1", "https://github.com/alice", "linkedin.com/in/bob-x", "Reg No: AB-123456",
          "Name: Jane Doe", "patient - john smith", "regulation", "id", "income", "hospital", "Élan", "é12345678",
          "1234 5678 9012", "12345678901", "Ann Lee", "\n", "  ", ".", ",", "x", "wage",
          "ınstagram.com/abc", "İnstagram.com/x_y", "ſtudent: Ann Lee", "K@x.com", "ıd@x.com", "name: ıvan Lee",
          "Reg no: ab-123456", "(555) 123-4567", "\x1c", "\xa0", "3782 822463 10005", "5512345678901234",
          "١٢٣٤٥٦٧٨٩", "١٢٣-٤٥-٦٧٨٩", "\u2003", "\x85", "John\u2003Smith", "Ｊohn", "x\u0301y"]


def random_texts(n, seed=7):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.randint(0, 160)
        out.append(" ".join(rnd.choice(PIECES) for _ in range(k)))
    out += ["", "John Smith went home", ("a " * 242) + "john@example.com.org tail"]
    return out


def test_matches_independent_model(spark, docs):
    texts = random_texts(60) + random_texts(60, seed=23)
    got = {r.doc_id: [(x.s, x.e, x.text, x.entity_type, round(x.confidence, 6), x.window_id) for x in r.entities]
           for r in detect(docs(*texts)).collect()}
    for i, t in enumerate(texts):
        want = [(s, e, tx, ty, round(c, 6), w) for s, e, tx, ty, c, w in pymodel.entities(t)]
        assert got[i] == want, t


def test_redaction_matches_model(spark, docs):
    texts = random_texts(30, seed=11)
    out = {r.doc_id: r.redacted_text for r in scrub(docs(*texts), cfg=ScrubConfig(mode="placeholder")).collect()}
    for i, t in enumerate(texts):
        assert out[i] == pymodel.redact(t, pymodel.entities(t), lambda tx, ty: f"<{ty}>")


def test_span_text_and_full_mask_length(spark, docs):
    d = docs(*random_texts(40, seed=3))
    doc = d.withColumnRenamed("text", "doc_text")
    rows = entity_rows(detect(d)).join(doc, "doc_id").where(
        F.substring("doc_text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) != F.col("text"))
    assert rows.count() == 0
    out = scrub(d, cfg=ScrubConfig(mode="full"))
    assert out.where(F.length("redacted_text") != F.length("text")).count() == 0
    assert out.count() == d.count()


def test_guards_do_not_change_results(spark, docs):
    d = docs(*random_texts(40, seed=5))
    a = detect(d, cfg=ScrubConfig(guards=True)).select("doc_id", "entities").collect()
    b = detect(d, cfg=ScrubConfig(guards=False)).select("doc_id", "entities").collect()
    assert sorted(a) == sorted(b)


def test_linear_splice_equals_fold(spark, docs):
    from redactflow.operators import redact as R
    d = detect(docs(*random_texts(40, seed=9)))
    e = R.with_replacements(F.col("entities"), "placeholder")
    out = d.select(R.splice_fold(F.col("text"), R.redaction_order(e)).alias("a"),
                   R.redact_text(F.col("text"), e).alias("b"))
    assert out.where("a != b").count() == 0


def test_exploded_plan_equals_row_plan(spark, docs):
    from redactflow.plans.exploded import entity_table_exploded
    from redactflow import tables as TB
    cols = ["doc_id", "idx", "text", "entity_type", "start_char", "end_char", "window_id"]
    d = docs(*random_texts(50, seed=13))
    for src in (d, TB.customer_forms(spark, "/root/testdata/sf0.001"), TB.documents(spark, "/root/testdata/sf0.01")):
        a = entity_rows(detect(src)).select(*cols, F.round("confidence", 6).alias("c"))
        b = entity_table_exploded(src, spread_windows=4).select(*cols, F.round("confidence", 6).alias("c"))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
