"""op9: n-grams over cuts, a plain Kneser-Ney model, many languages."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from redactflow.llm import language_id as L


def test_ngrams_are_the_same_for_any_part_size():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("abcé  ..1\nΣσςİ中ж😀𝒜") for _ in range(r.randint(0, 60)))
        whole = L.ngrams(text).tolist()
        for limit in (1, 2, 3, 5, 16, 59, 60, 61):
            assert L.ngrams(text, limit).tolist() == whole
    long = "word after word " * 150_000  # over one part of the operator itself
    assert len(long) > L.STEP_BYTES and len(L.ngrams(long)) == len(long)


def plain_model(texts, size):
    """Interpolated Kneser-Ney by the book: {order: {ngram: count}} with continuation counts below the highest order."""
    counts = {4: Counter()}
    for t in texts:
        symbols = "".join(c if c.isalpha() else " " for c in t.lower())
        padded = "   " + " ".join(symbols.split()) + " "
        counts[4].update(padded[i:i + 4] for i in range(len(padded) - 3))
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    discounts = {o: min(0.95, max(0.05, sum(n == 1 for n in c.values()) / max(1, sum(n == 1 for n in c.values()) + 2 * sum(n == 2 for n in c.values())))) for o, c in counts.items()}
    totals, kinds = defaultdict(Counter), defaultdict(Counter)
    for o, c in counts.items():
        for g, n in c.items():
            totals[o][g[:-1]] += n
            kinds[o][g[:-1]] += 1

    def p(gram):
        o = len(gram)
        if not o:
            return 1 / size
        context, lower = gram[:-1], p(gram[1:])
        if not totals[o][context]:
            return lower
        return max(counts[o][gram] - discounts[o], 0) / totals[o][context] + discounts[o] * kinds[o][context] / totals[o][context] * lower

    return p


def prose(seed, letters, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def taught():
    return {"xx": [prose(1, "abcde", 40), "abc abd!"], "yy": [prose(2, "cdefé", 50)], "zz": ["efg 12 efg", prose(3, "efgh", 9)]}


def test_probabilities_and_entropies_match_a_plain_model(spark, taught):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, texts in taught.items() for t in texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letters = {c for texts in taught.values() for t in texts for c in "".join(x if x.isalpha() else " " for x in t.lower())} | {" "}
    plain = {lang: plain_model(texts, len(letters) + 1) for lang, texts in taught.items()}
    asked = [prose(9, "abcdefgh", 12), "abc", "é e", "ж zzz", prose(2, "cdefé", 5)]
    edge = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for most in (16_000_000, 150):  # arrays, and tables
        models = L.fit(docs, most=most)
        assert (models.tables is None) == (most > 1000)
        for row in L.identify(edge, models).collect():
            symbols = " ".join("".join(c if c.isalpha() else " " for c in asked[row.doc_id].lower()).split()) + " "
            padded = "   " + symbols
            h = {lang: -sum(math.log(p(padded[i:i + 4])) for i in range(len(symbols))) / len(symbols) for lang, p in plain.items()}
            best = min(h, key=h.get)
            assert row.lang_pred == best and row.entropy == pytest.approx(h[best], rel=1e-4)
            evidence = {lang: math.exp(-(x - h[best]) * max(1.0, len(symbols) / 10)) for lang, x in h.items()}
            assert row.score == pytest.approx(1 / sum(evidence.values()), rel=1e-3)


def test_a_hundred_languages(spark):
    alphabets = ["".join(chr(0x400 + (7 * k + j) % 256) if k % 2 else chr(0x61 + (3 * k + 2 * j) % 26) + "" for j in range(6)) + chr(0x4E00 + k) for k in range(100)]
    rows = [(100 * k + i, prose(k * 1000 + i, alphabets[k], 60), f"l{k:02d}") for k in range(100) for i in range(2 if k == 5 else 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = docs.where("doc_id % 100 > 0")
    right = []
    for most in (16_000_000, 20_000):  # the second is far less than n-grams times languages
        models = L.fit(taught, most=most)
        assert len(models.langs) == 100 and models.grams[-1].rows.size <= most and np.isfinite(models.limit).all()
        out = L.identify(docs.where("doc_id % 100 = 0"), models).join(docs.select("doc_id", "lang"), "doc_id").collect()
        right.append({r.doc_id: (r.lang_pred, round(r.entropy, 3)) for r in out})
        assert sum(r.lang_pred == r.lang for r in out) >= 97
    assert right[0] == right[1]


def test_rare_languages_are_calibrated(spark):
    rows = [(i, prose(i, "abcdef", 30), "big") for i in range(3000)] + [(10_000 + i, prose(i, "uvwxyz", 30), "rare") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = L.language_sample(docs, 100).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in taken}["rare"] == 4 and 50 < {r.lang: r["count"] for r in taken}["big"] < 200
    models = L.fit(docs, calibration_rows=100)
    assert np.isfinite(models.limit).all()
    assert not L.identify(spark.createDataFrame([(1, "ж щ ю " * 9)], "doc_id long, text string"), models).first().accepted


def test_limits_are_the_quantiles_of_all_rows(spark):
    r = random.Random(3)
    values = {"a": [r.gauss(2, 0.3) for _ in range(3000)], "b": [1.5] * 50 + [1.5 + 1e-7, 9.25], "c": [0.7]}
    rows = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "lang string, entropy double")
    for share in (0.999, 0.5):
        got = L.entropy_limits(rows, share)
        assert got == {k: pytest.approx(float(np.quantile(v, share)), abs=1e-9) for k, v in values.items()}


def test_every_training_row_sets_the_limit(spark):
    docs = spark.createDataFrame([(i, prose(i, "abcdef", 30), "big") for i in range(1500)] + [(9_000, "abcdef " * 2 + "ffaaffaa", "big")], "doc_id long, text string, lang string")
    models = L.fit(docs, reject_share=0.0)
    assert models.limit[0] == pytest.approx(L.identify(docs, models).where("lang_pred = 'big'").agg({"entropy": "max"}).first()[0], abs=1e-9)
