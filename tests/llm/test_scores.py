"""op6, op9, op10 and the pipeline."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from redactflow.llm import decontaminate, language_id, line_dedup, minhash, packing, pu_quality, quality_rules
from redactflow.llm.common import held_out, table

SF = "/root/testdata/sf0.001"


def plain_rules(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    seen, spots = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            spots.update(k for i in at for k in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(spots))


def test_rules(corpus, words):
    a = words(1, 12)
    texts = [None, "", " \n\t", "one", a, f"{a}\n{a}\n {a}", f"{a} {a} {words(2, 30)}", "x # y | & <b>", "é è \x85 ü", words(3, 3000) + " " + a + " " + a, "w " * 20, "w " * 8 + "w"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, a)]
    docs = corpus(rows)
    out = quality_rules.ledger(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        text = a if r.doc_id is None else texts[r.doc_id]
        n, chars, symbols, dup, rep = plain_rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert (r.bits & quality_rules.mask("base") != 0) == (n < 20 or 100 * rep > 30 * n)
    assert quality_rules.ledger(docs.limit(0)).count() == 0


def test_ablation(spark):
    rows = [(0,)] * 3 + [(1,)] * 2 + [(3,), (4,), (5,)]
    out = quality_rules.ablation(spark.createDataFrame(rows, "bits long"), "v1").collect()
    got = {r.rule: (r.n_failed, r.n_only, r.fails_with) for r in out}
    assert got == {"few_words": (4, 2, 7), "repeated_windows": (1, 0, 3), "symbols": (2, 1, 5), "repeated_lines": (0, 0, 0)}


def test_held_out(spark):
    out = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_kneser_ney_sums_to_one():
    text = "the cat sat on the mat. that cat! " * 3 + "a dog"
    grams = language_id.ngrams(text)
    m = language_id.kneser_ney({"x": np.unique(grams, return_counts=True)})
    alphabet = sorted(set(text.replace(".", " ").replace("!", " ")))
    for context in ("   ", "the", "at ", "zzz", " ca", "qat"):
        packed = [sum(ord(c) << 16 * (3 - k) for k, c in enumerate(context + x)) for x in alphabet]
        p = np.exp(m.log_probability(np.array(packed, np.uint64), 4)[:, 0].astype(float))
        # one more symbol stands for all that were never seen
        assert p.sum() + np.exp(m.log_probability(np.array([sum(ord(c) << 16 * (3 - k) for k, c in enumerate(context + "ж"))], np.uint64), 4)[0, 0]) == pytest.approx(1, abs=1e-4)


def test_ngrams():
    assert language_id.ngrams("12 !") .size == 0 and language_id.ngrams("").size == 0
    unpack = lambda g: ["".join(chr(int(x) >> 16 * k & 0xFFFF) for k in (3, 2, 1, 0)) for x in g]
    assert unpack(language_id.ngrams("..Ab1 c")) == ["   a", "  ab", " ab ", "ab c", "b c "]


def test_ngram_counts(corpus):
    rows = [(1, "ab ab", "x"), (2, "ab", "x"), (3, "ab", "y"), (4, None, "x"), (5, "zz", None)]
    docs = corpus(rows).where("lang is not null and text is not null")
    got = {(r.lang, r.gram): r.n for r in language_id.ngram_counts(docs).collect()}
    want = {}
    for _, t, lang in rows[:3]:
        for g in language_id.ngrams(t).view(np.int64).tolist():
            want[lang, g] = want.get((lang, g), 0) + 1
    assert got == want


def test_language_id(spark, corpus):
    out = language_id.op9_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == 1000 and (held.lang == held.lang_pred).mean() > 0.99 and held.score.between(0, 1).all() and held.accepted.mean() > 0.95
    models = language_id.fit(table(spark, "/root/testdata/sf0.01", "documents"))
    edge = corpus([(1, None, "en"), (2, "", "en"), (3, "12 34 !?", "de"), (4, "the and that of", None), (4, "the and that of", None), (None, "der und die", None), (5, "the of " * 400_000, None), (6, "ЖЖЖ щщщ", None)])
    got = {r.doc_id: r for r in language_id.identify(edge, models).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [got[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert got[4].lang_pred == got[5].lang_pred == "en" and got[None].lang_pred == "de" and not got[6].accepted
    assert language_id.identify(edge.limit(0), models).count() == 0
    assert language_id.fit(edge.limit(0)) is None and language_id.identify(edge, None).where("lang_pred = 'und'").count() == 8


def test_a_small_table_keeps_its_most_frequent_ngrams(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    models = language_id.fit(docs.where(~held_out("doc_id")), most=3000)
    out = language_id.identify(docs, models).join(docs.select("doc_id", "lang"), "doc_id")
    assert len(models.grams[-1].hashes) <= 3000 and out.where("lang = lang_pred").count() > 950


def test_models_over_the_array_size_keep_every_count(spark, corpus):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "lang", "text")
    few = corpus([(10_000, "xhosa qhubeka qwela", "xh"), (10_001, "qhuba xolela", "xh")]).select("doc_id", "lang", "text")
    docs = docs.union(few)
    edge = docs.union(corpus([(20_000, "ЖЖЖ щщщ xhosa", None), (20_001, None, None), (20_002, "12 !", None), (20_001, "", None)]).select("doc_id", "lang", "text"))
    whole, tables = language_id.fit(docs), language_id.fit(docs, most=3000)
    assert whole.langs == tables.langs and len(tables.grams[-1].hashes) <= 3000 < len(whole.grams[-1].hashes)
    assert tables.limit == pytest.approx(whole.limit, abs=1e-4)
    of = lambda m: sorted(((r.doc_id, r.lang_pred, r.score, r.entropy) for r in language_id.identify(edge, m).collect()), key=lambda r: r[:2])
    got, want = of(tables), of(whole)
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) == edge.count()
    assert [r[3] for r in got if r[3] is not None] == pytest.approx([r[3] for r in want if r[3] is not None], abs=1e-4)
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-2)
    assert {r[1] for r in got if r[0] in (10_000, 10_001)} == {"xh"}


def test_quality_classifier(spark, corpus):
    sf = "/root/testdata/sf0.01"
    out = pu_quality.op10_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and held.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.3)).all()
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = pu_quality.fit(docs, labels)
    edge = corpus([(1, None), (2, ""), (2, ""), (None, "a b c"), (3, "word " * 300_000)])
    got = pu_quality.scored(edge, model)
    assert got.count() == 5 and got.where("score between 0 and 1 and predicted = cast(score >= 0.3 as int)").count() == 5
    assert set(got.columns) == {*edge.columns, "predicted"}
    assert pu_quality.scored(edge.limit(0), model).count() == 0
    nothing = pu_quality.fit(docs, labels.limit(0))
    assert pu_quality.scored(edge, nothing).where("score = 0.5").count() == 5
    assert pu_quality.fit(docs.limit(0), labels).prior is not None


def test_non_negative_risk_separates():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (3000, 4)), rng.normal(-1.5, 1, (900, 4))
    m = pu_quality.non_negative_pu(good[:1500], np.concatenate([good[1500:], bad]), 1500 / 2400)
    assert (m.margin(good) > 0).mean() > 0.95 and (m.margin(bad) < 0).mean() > 0.95


def plain_pipeline(spark, sf):
    """The pipeline's decisions, each stage recomputed from the last one's rows by plain loops (the classifier's scores are its own)."""
    docs = table(spark, sf, "documents")
    kept = corpus_pipeline.quality(spark, docs, sf).toPandas()
    rows = dict(zip(kept.doc_id, kept.text))
    held = {}
    for i, t in rows.items():
        for x in {x.strip(" \t\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in t.split("\n")}:
            held.setdefault(x, []).append(i)
    often = {x for x, ids in held.items() if x and len(ids) >= 10}
    rows = {i: "\n".join(x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) not in often) for i, t in rows.items()}
    from tests.llm.test_duplicates import distance, plain_classes

    classes = plain_classes(sorted(rows.items()))
    rows = {i: t for i, t in rows.items() if classes[i] == i}
    items = [decontaminate.plain(r.text) for r in table(spark, sf, "benchmark").collect()]
    clean = {}
    for i, t in rows.items():
        p = decontaminate.plain(t)
        near = [x for x in items if x in p or any(x[k:k + 12] in p for k in range(0, len(x) - 12, 12)) and distance(x, p) <= int(0.07 * len(x))]
        if not near:
            clean[i] = t
    return clean


def test_pipeline(spark):
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    want = plain_pipeline(spark, SF)
    assert set(pieces.doc_id) == set(want)
    encode = packing.encoder(packing.tokenizer_path())
    lengths = {i: len(encode(t)) // 4 + 1 for i, t in want.items()}
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == lengths
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_duplicates", "benchmark_decontamination", "packing"]


def test_pipeline_stages_keep_columns_and_take_odd_rows(spark, corpus):
    docs = corpus([(1, None), (2, ""), (3, "some ordinary words that make a line"), (3, "some ordinary words that make a line"), (None, "no id"), (None, "no id")])
    for name, step in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            out = step(spark, some, SF)
            assert out.columns == docs.columns and out.count() <= some.count(), name
    kept = corpus_pipeline.near_copies(spark, docs, SF)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3]


def test_near_copies_keep_other_texts_under_a_reused_id(spark, words):
    a, b, c = words(1, 50), words(2, 50), words(3, 50)
    rows = [(1, a, "x"), (2, a + " end", "x"), (2, b, "z"), (2, b, "y"), (3, c, "x"), (3, None, "x"), (4, b, "x"), (None, a, "x")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        kept = {(r.doc_id, r.text, r.source) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()}
        assert kept == {(1, a, "x"), (2, b, "y"), (3, c, "x"), (3, None, "x"), (None, a, "x")}


def test_sql_queries(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for query, sql in ((quality_rules.op6_quality_rules, quality_rules.OP6_SQL), (line_dedup.op8_line_dedup, line_dedup.OP8_SQL)):
        ours, theirs = query(spark, SF).toPandas(), con.sql(sql).df()
        assert ours.sort_values("doc_id").reset_index(drop=True).equals(theirs[list(ours.columns)].sort_values("doc_id").reset_index(drop=True).astype(ours.dtypes.to_dict()))


def test_near_duplicates_of_the_table(spark):
    from tests.llm.test_duplicates import plain_classes

    docs = table(spark, SF, "documents").toPandas()
    out = minhash.op4_minhash_near_dedup(spark, SF).toPandas()
    assert dict(zip(out.doc_id, out.component_id)) == plain_classes(list(zip(docs.doc_id, docs.text)))
