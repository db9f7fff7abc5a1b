"""Joins of tables made of small rows: the planner's size is that of the files, so none may be broadcast for it."""

import pytest
from pyspark.sql import functions as F


def planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture
def keys(spark, tmp_path):
    """Four rows in a file; each is worth thousands in what is made of it."""
    spark.range(4).write.parquet(f"{tmp_path}/keys")
    return spark.read.parquet(f"{tmp_path}/keys")


def test_sized_broadcast_or_shuffle(keys):
    from redactflow.plans.joins import sized_broadcast

    assert "BroadcastHashJoin" in planned(keys.join(sized_broadcast(keys), "id"))
    assert "SortMergeJoin" in planned(keys.join(sized_broadcast(keys, 8), "id"))


def test_knowledge_is_not_broadcast_for_the_size_of_its_keys(spark, keys):
    from redactflow.operators.report import knowledge_build, knowledge_lookup

    many = keys.select(F.explode(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999)).alias("n"))
    ents = many.select(F.concat(F.lit("Ann Lee "), F.col("n").cast("string")).alias("text"), F.lit("PERSON_NAME").alias("entity_type"))
    asked = spark.createDataFrame([("Ann Lee 7",), ("Ann Lee 7",), ("ann lee 7",), (None,)], "text string")
    found = knowledge_lookup(asked, knowledge_build(ents))
    assert sorted((r.text or "", r.kb_type, r.kb_frequency) for r in found.collect()) == [
        ("", None, None), ("Ann Lee 7", "PERSON_NAME", 1), ("Ann Lee 7", "PERSON_NAME", 1), ("ann lee 7", None, None)]
    assert "Broadcast" not in planned(found)


def test_overlapping_spans_are_not_broadcast_for_the_size_of_their_keys(keys):
    from redactflow.operators.report import overlap_pairs

    spans = keys.select(F.col("id").alias("doc_id"), F.posexplode(F.sequence(F.lit(0), F.lit(1998), F.lit(2))).alias("idx", "start_char"))
    pairs = overlap_pairs(spans.withColumn("end_char", F.col("start_char") + 3))
    assert sorted(map(tuple, pairs.collect())) == [(d, i, i + 1) for d in range(4) for i in range(999)]
    assert "Broadcast" not in planned(pairs)


def test_dictionary_keys_are_not_broadcast_for_the_size_of_their_texts(spark, keys, monkeypatch):
    from redactflow.operators import report

    name = lambda n: F.concat(F.lit("Ann Lee "), n.cast("string"))
    ents = keys.select(F.col("id").alias("doc_id"), F.posexplode(F.sequence(F.lit(0), F.lit(499))).alias("seq", "n"))
    ents = ents.select("doc_id", "seq", name(F.col("doc_id") * 500 + F.col("n")).alias("text"), F.lit("PERSON_NAME").alias("entity_type"))
    known = spark.createDataFrame([("Ann Lee 3", "PERSON_NAME", "USER_PER", 7, "USER_PER_7"), ("Ann Lee 3", "EMAIL", "USER_EMA", 1, "USER_EMA_1")],
                                  report.PSEUDONYM_SCHEMA)
    joined = []
    # the checkpoint hides the first join from the plan of the result
    monkeypatch.setattr("redactflow.session.cut_lineage", lambda df: joined.append(planned(df)) or df.checkpoint())
    added = report.extend_pseudonyms(known, ents, ranges=3)
    assert "SortMergeJoin" in joined[0] and "Broadcast" not in joined[0]
    rows = {r.text: r.number for r in added.collect()}
    assert rows == {f"Ann Lee {i}": i + (8 if i < 3 else 7) for i in range(2000) if i != 3}
    last = [line for line in planned(added).splitlines() if "HashJoin [prefix" in line]
    assert len(last) == 1 and "BuildRight" in last[0]  # the offsets, not the keys


def test_entities_of_a_corpus_are_not_broadcast_for_the_size_of_their_keys(keys):
    import re

    from redactflow.operators.detect import ENTITIES_TYPE
    from redactflow.operators.report import with_corpus_pseudonyms

    spans = F.transform(F.sequence(F.lit(0), F.lit(499)), lambda n: F.struct(
        (n * 9).alias("s"), (n * 9 + 5).alias("e"), F.concat(F.lit("Ann Lee "), (F.col("id") * 400 + n).cast("string")).alias("text"),
        F.lit("PERSON_NAME").alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit("x").alias("source"), F.lit(0).alias("rank"), F.lit(0).alias("window_id")))
    docs = keys.select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, spans).otherwise(F.array()).cast(ENTITIES_TYPE).alias("entities"))
    out = with_corpus_pseudonyms(docs)
    rows = {r.doc_id: {x.text: x.replacement for x in r.entities} for r in out.collect()}
    # the last span of a text is met first
    order = [f"Ann Lee {n}" for n in [*range(499, -1, -1), *range(899, 499, -1), *range(1299, 899, -1)]]
    names = {t: f"USER_PER_{i}" for i, t in enumerate(order, 1)}
    assert rows == {d: {f"Ann Lee {n}": names[f"Ann Lee {n}"] for n in range(d * 400, d * 400 + 500)} for d in range(3)} | {3: {}}
    plan = planned(out)
    assert len(re.findall("SortMergeJoin", plan)) == 2 and re.findall(r"HashJoin \[(\w+)#", plan) == ["prefix"]


def test_patterns_and_texts_are_not_broadcast_for_the_size_of_their_keys(keys):
    from redactflow.operators.patterns import indexed_spans, literal_index

    number = F.concat(F.lit("RX-"), F.lpad(F.col("n").cast("string"), 6, "0"))
    many = keys.select(F.explode(F.sequence(F.col("id") * 100, F.col("id") * 100 + 99)).alias("n"))
    index = literal_index(many.select(number.alias("pattern_name"), F.concat(number, F.lit("\\.")).alias("pattern_regex")))
    assert planned(index).count("SortMergeJoin") == 2 and "Broadcast" not in planned(index)
    docs = many.where("n % 50 = 7").select(F.col("n").alias("doc_id"), F.concat(F.lit("no rx-000001. but "), number, F.lit(". twice "), number, F.lit(".")).alias("text"))
    spans = indexed_spans(docs, index, "text", "doc_id", max_bytes=1)
    name = lambda n: f"RX-{n:06d}"
    assert sorted(map(tuple, spans.collect())) == sorted((n, name(n), s, s + 10, name(n) + ".") for n in range(7, 400, 50) for s in (18, 35))
    assert planned(spans).count("SortMergeJoin") == 2 and "Broadcast" not in planned(spans)
