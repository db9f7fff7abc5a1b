"""op11: runs and collapsed texts against their definition."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from redactflow.llm import periodic_runs as R

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(words, least=24, power=3):
    """All runs, straight from the definition."""
    out = []
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, power * q) and not any(all(words[t] == words[t + r] for t in range(i, i + n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def odd_texts(seed):
    r = random.Random(seed)
    texts = [None, "", " \n\t", "a " * 30, " a b " * 12]
    for _ in range(8):
        k, t = r.choice([1, 2, 3, 5, 20]), []
        while len(t) < r.choice([5, 40, 150]):
            if r.random() < 0.4:
                unit = [r.choice("abcdefghijklmnopqrst"[:k]) for _ in range(r.randint(1, 20))]
                t += (unit * r.randint(1, 9))[:r.randint(1, 100)]
            else:
                t.append(r.choice("abcdé") + str(r.randint(0, 5 * k)))
        texts.append("".join(w + r.choice([" ", "\n", "\t  "]) for w in t) if r.random() < 0.5 else " " + " ".join(t))
    return texts


@pytest.mark.parametrize(("least", "power"), [(24, 3), (6, 3), (10, 4), (7, 3)])
def test_batches_match_the_definition(least, power):
    for seed in range(40):
        texts = odd_texts(seed)
        n, runs, text = R.collapse_batch(pa.array(texts, pa.string()), least, power)
        for t, count, found, out in zip(texts, n.to_pylist(), runs.to_pylist(), text.to_pylist()):
            words = WORD.findall(t or "")
            want = brute(words, least, power)
            assert (count, [(x["start"], x["length"], x["period"]) for x in found]) == (len(words), want)
            assert out == collapsed(words, want)


def test_long_periods_and_long_texts(spark, corpus):
    r = random.Random(5)
    unit = [f"w{r.randint(0, 10**9)}" for _ in range(30_000)]
    text = " ".join(["start", *unit * 3, *unit[:7], "end", *"xy" * 400_000])
    rows = {x.doc_id: x for x in R.collapse_runs(corpus([(1, text), (2, "no loops here")])).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(1, 90_007, 30_000), (90_009, 800_000, 2)]
    assert len(rows[1].collapsed.split()) == 2 + 30_000 + 2 and rows[2].runs == []


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(collapsed(words, runs))


def test_query_matches_the_definition(spark, corpus, words, tmp_path):
    rows = [(i, t) for i, t in enumerate([t for s in range(3) for t in odd_texts(s)] + [words(s, 20 * s) for s in range(1, 60)])]
    rows += [(7, rows[7][1]), (None, "a b " * 20), (None, None)]
    corpus(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, R.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(*r) for r in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)


def test_empty_table(spark, corpus):
    assert R.collapse_runs(corpus([(1, "x")]).where("false")).collect() == []
    assert R.collapse_runs(corpus([(1, "x")]).select(F.lit("k").alias("doc_id"), "text")).first().doc_id == "k"


def test_short_powers_are_refused(corpus):
    with pytest.raises(ValueError, match="three periods"):
        R.collapse_runs(corpus([(1, "x")]), power=2)
