"""op13: double arrays against dictionaries, phrases against a plain count."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactflow.llm import collocations as C
from redactflow.llm.double_array import DoubleArray


def test_double_array_finds_every_phrase():
    r = np.random.default_rng(0)
    for _ in range(150):
        m, top, n = int(r.integers(1, 5)), int(r.choice([3, 60, 64, 70, 5000, 300_000])), int(r.integers(0, 400))
        phrases = np.unique(r.integers(1, top, (n, m)), axis=0).reshape(-1, m)
        text = r.integers(0, top + 50, 300)
        for row in phrases[r.integers(0, len(phrases), 30)] if len(phrases) else []:
            at = r.integers(0, 300 - m)
            text[at:at + m] = row
        known = {tuple(x): k for k, x in enumerate(phrases.tolist())}
        trie = DoubleArray(phrases)
        assert trie.walk(text.astype("<i4")).tolist() == [known.get(tuple(text[i:i + m].tolist()), -1) for i in range(300)]
        assert trie.nbytes <= 8 * (len(phrases) * (64 + m * len(trie.shifts)) + 200)


def brute(rows, least, longest, first=2000, absorb=100):
    counts, totals = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            f.update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n, kept = totals[lang], []
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        for p, a in often.items():
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and 100 * b >= absorb * a and inside(q) for q, b in often.items()):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows(words):
    out = [(words(s, 30 + s, 25).replace(" a", ". A").replace(" b", "\tB,b "), ["en", "de", None, "und"][s % 4]) for s in range(60)]
    out += [("San Jose\x0bsan jose, san jose é É\xa0x", "en")] * 5 + [("one two three four five six " * 4, "de")] * 3
    return out + [(None, "en"), ("", None), (" ., ;", "xx"), ("\t", None), ("x", "yy"), ("hapax", "de")]


@pytest.mark.parametrize(("least", "first", "absorb", "limits"), [
    (3, 2000, 100, {}), (2, 7, 100, {}), (5, 2000, 60, {}), (10**6, 5, 100, {}),
    (3, 2000, 100, {"trie_phrases": 20}), (3, 50, 100, {"dictionary_words": 9, "trie_phrases": 40})])
def test_phrases_match_a_plain_count(spark, corpus, rows, least, first, absorb, limits):
    docs = corpus([(i % 7 if i else None, t, g) for i, (t, g) in enumerate(rows)])
    got = C.collocations(spark, docs, least, 5, first, absorb, **limits)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 5, first, absorb)


def test_held_counts_are_passed_on(spark, corpus, rows, monkeypatch):
    monkeypatch.setattr(C, "HELD_KEYS", 50)
    monkeypatch.setattr(C, "STEP_CODES", 97)
    got = C.collocations(spark, corpus([(1, t, g) for t, g in rows]), 3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 5)


def test_scores_past_64_bits(spark):
    a, n = 3 * 10**12 + 7, 4 * 10**13 + 1
    phrases = spark.createDataFrame([("en", [1], 5 * 10**12 + 1), ("en", [2], a + 5), ("en", [1, 2], a)], "lang string, w array<int>, f long")
    row = C.scored(phrases, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert (row.l, row.r, row.n, row.score) == (5 * 10**12 + 1, a + 5, n, 1000 * a * n // ((5 * 10**12 + 1) * (a + 5)))


def test_empty_table(spark, corpus):
    assert C.collocations(spark, corpus([(1, "x", "en")]).where("false")).collect() == []
    assert C.collocations(spark, corpus([(1, "x y", "en")]).select("text", F.col("lang")), least=1).count() == 1
