"""op2, op4, op7, op8: leaks, near copies, repeated strings and lines, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactflow.llm import components, decontaminate, line_dedup, minhash, suffix_dedup
from redactflow.llm.common import shingle_set


def edited(text, rng, share):
    return " ".join("zz%d" % rng.randrange(10**6) if rng.random() < share else w for w in text.split())


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_classes(rows):
    """doc_id -> component by all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    s = [(i, sets(t)) for i, t in rows]
    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


@pytest.fixture(scope="module")
def family(words):
    rng, rows = random.Random(3), []
    for f in range(6):
        base = words(100 + f, rng.choice([3, 8, 60, 200]))
        for share in (0, 0, 0.01, 0.03, 0.05, 0.05, 0.08):
            rows.append((len(rows) * 3 + 1, edited(base, rng, share)))
    hot = words(7, 120)
    rows += [(1000 + i, edited(hot, rng, 0.035)) for i in range(60)]
    return rows + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One two"), (2004, "one TWO"), (2005, "one two three")]


def test_near_duplicates(corpus, family):
    docs = corpus([*family, (1, family[0][1]), (None, family[0][1])])
    out = minhash.near_duplicates(docs).toPandas()
    want = plain_classes(family)
    known = out[out.doc_id.notna()]
    assert len(out) == len(family) + 2 and out.doc_id.isna().sum() == 1 and out[out.doc_id.isna()].kept.all()
    assert {int(r.doc_id): int(r.component_id) for r in known.itertuples()} == want
    assert (known.kept == (known.doc_id == known.component_id)).all()
    texts = dict(family)
    assert all(r.n_shingles == len(sets(texts[int(r.doc_id)])) for r in known.itertuples())
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_id_with_two_texts_links_their_classes(corpus, words):
    a, b = words(1, 50), words(2, 50)
    out = minhash.near_duplicates(corpus([(1, a), (2, a), (2, b), (3, b), (4, "other words that stand quite alone")])).select("doc_id", "component_id").distinct().collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_shingles_do_not_depend_on_steps(monkeypatch, words):
    from redactflow.llm import common

    raw = np.frombuffer(("x" * 500 + " " + words(1, 300) + "  ").encode(), np.uint8)
    whole = shingle_set(raw)
    monkeypatch.setattr(common, "STEP_BYTES", 64)
    assert (shingle_set(raw) == whole).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    out = components.components(spark.createDataFrame(edges + edges[:3], "a long, b long")).collect()
    assert {r.node: r.component for r in out} == root and len(out) == len(root)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_repeats(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k:k + length]
            if w in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, bytes(x for x, g in zip(raw, gone) if not g))
    return out


@pytest.mark.parametrize("settings", [{}, {"crowded": 2, "bits": 12, "bucket_rows": 50}])
def test_repeated_strings(corpus, words, settings):
    rng, rows = random.Random(6), []
    passages = [words(50 + k, 40) for k in range(4)] + ["é" * 90]
    for i in range(60):
        parts = [words(1000 + i, rng.randrange(0, 60))] + [rng.choice(passages) for _ in range(rng.randrange(3))] + [words(2000 + i, 10)]
        rows.append((i, edited(" ".join(parts), rng, rng.choice([0, 0, 0.02]))))
    rows += [(100, "ab" * 400), (101, "x" * 99), (102, "x" * 100), (103, "x" * 100), (104, None), (105, ""), (106, rows[0][1]), (5, rows[5][1])]
    out = suffix_dedup.without_repeats(corpus([*rows, (None, rows[1][1])]), **settings).toPandas()
    want = plain_repeats(rows[:-1], 100)
    assert len(out) == len(rows) + 1
    for r in out.itertuples():
        got = (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
        assert got == (want[r.doc_id] if r.doc_id == r.doc_id else (len(rows[1][1].encode()), 0, 0, rows[1][1].encode()))
    if not settings:
        assert suffix_dedup.without_repeats(corpus(rows).limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_different_texts_under_one_id(spark, corpus, words, kind):
    """They are documents of their own: no byte goes that repeats nothing."""
    from pyspark.sql import functions as F

    a, b, c = words(1, 60), words(2, 70), words(3, 80)
    rows = [(7, a), (7, b), (7, f"{c} {a}"), (7, b), (8, f"x {b}"), (-2, f"{words(9, 50)} {c}"), (9, "own"), (None, a)]
    docs = corpus(rows).withColumn("doc_id", F.col("doc_id").cast(kind))
    got = sorted((str(r.doc_id), bytes(r.kept).decode(), r.n_removed) for r in suffix_dedup.without_repeats(docs).collect())
    hashed = {t: h for t, h in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    unsigned = lambda t: hashed[t] % (1 << 64)
    own = sorted({(i, unsigned(t), t) for i, t in rows if i is not None}, key=lambda x: ((x[0] if kind == "long" else str(x[0]).encode()), x[1]))
    want = plain_repeats([(n, t) for n, (_, _, t) in enumerate(own)], 100)
    kept = {(i, t): want[n] for n, (i, _, t) in enumerate(own)}
    assert got == sorted((str(i), *((t, 0) if i is None else (kept[i, t][3].decode(), kept[i, t][1]))) for i, t in rows)


def test_sketches_grow_with_the_corpus():
    assert suffix_dedup.sketch_bits(0, 100, 28) == 20 and suffix_dedup.sketch_bits(1 << 45, 100, 28) == 30
    assert suffix_dedup.sketch_bits(864_000_000, 100, 28) == 27


def test_wide_hashes_give_the_same(corpus, words):
    rows = [(i, f"{words(i, 30)} {words(100 + i % 3, 40)}") for i in range(12)]
    small, wide = (sorted((r.doc_id, bytes(r.kept)) for r in suffix_dedup.without_repeats(corpus(rows), bits=b).collect()) for b in (20, 29))
    assert small == wide and any(len(k) < 230 for _, k in small) and all(len(k) > 100 for _, k in small)


def test_long_documents_are_scanned_in_blocks(monkeypatch, words):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "BLOCK", 512)
    monkeypatch.setattr(suffix_dedup, "row_steps", lambda at: iter([(0, 1)]))
    text = words(1, 700)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    starts = [x for _, _, _, _, start, _, windows in suffix_dedup.scanned(batch, 100, 28) for s, n in zip(start, windows) for x in range(s, s + n)]
    assert starts == list(range(len(text) - 99))


def plain_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for n, (_, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(n)
    often = {k for k, v in held.items() if k and len(v) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in often]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def line_rows(words):
    rng = random.Random(8)
    stock = [words(k, 5) for k in range(12)] + ["É x", "é x", "", "  "]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str])(rng.choice(stock[:rng.choice([3, 16])])) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (None, stock[0]), (7, rows[7][1])]


def found_lines(docs, index):
    out = line_dedup.without_frequent_lines(docs, index).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out)


def test_lines(corpus, words):
    rows = line_rows(words)
    docs = corpus(rows)
    index = line_dedup.LineIndex.of(docs, least=10, shards=4)
    assert found_lines(docs, index) == plain_lines(rows, 10)
    out = line_dedup.without_frequent_lines(docs, index)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"} and out.where("key = 'k'").count() == len(rows)
    for limits in ({"key_bytes": -1}, {"filter_bytes": -1}, {"key_bytes": -1, "filter_bytes": -1}):  # joins instead of broadcasts
        assert sorted(map(str, line_dedup.without_frequent_lines(docs, index, **limits).collect())) == sorted(map(str, out.collect()))
    empty = docs.limit(0)
    assert line_dedup.without_frequent_lines(empty, line_dedup.LineIndex.of(empty)).count() == 0


def test_many_rows_without_id(corpus, words):
    rows = line_rows(words) + [(None, f"{words(i, 4)}\nshared line") for i in range(300)]
    for limit in (line_dedup.KEY_BYTES, -1):
        index = line_dedup.LineIndex.of(corpus(rows))
        out = line_dedup.without_frequent_lines(corpus(rows), index, key_bytes=limit).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out) == plain_lines(rows, 10)


def test_shards_follow_the_keys(corpus, words, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    rows = [(i, "\n".join(f"line {k}" for k in range(i % 7, 60 + i % 9))) for i in range(40)]
    index = line_dedup.LineIndex.of(corpus(rows[:20]))
    assert index.shards >= 25 and found_lines(corpus(rows[:20]), index) == plain_lines(rows[:20], 10)
    more = [(100 + i, "\n".join(f"other {k}" for k in range(80))) for i in range(12)]
    grown = index.insert(corpus(more))
    assert grown.shards > index.shards and found_lines(corpus(rows[:20] + more), grown) == plain_lines(rows[:20] + more, 10)


def test_lines_can_be_undone(corpus, words):
    rows = line_rows(words)
    first, second = corpus(rows[:35]), corpus(rows[35:])
    index = line_dedup.LineIndex.of(first, least=10, shards=4)
    both = index.insert(second)
    counts = lambda x: {(bytes(r.key), r.n) for r in x.counts.collect()}
    assert counts(both) == counts(line_dedup.LineIndex.of(corpus(rows), least=10, shards=4))
    assert found_lines(corpus(rows), both) == plain_lines(rows, 10)
    back = both.delete(second)
    assert counts(back) == counts(index)
    assert found_lines(first, back) == plain_lines(rows[:35], 10)


def test_cuckoo():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(3000)]
    words = lambda k: np.frombuffer(b"".join(k), "<u8").reshape(-1, 2)
    f = line_dedup.Cuckoo.of(keys[:2000])
    assert f.has(words(keys[:2000])).all() and f.has(words(keys[2000:])).mean() < 0.01
    assert all(f.delete(k) for k in keys[:1000])
    assert f.has(words(keys[1000:2000])).all() and f.has(words(keys[:1000])).mean() < 0.01


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(9)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 70)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))
        if rng.random() < 0.5:
            t += p[:len(p) // 2] + "c" + p[len(p) // 2 + 1:] + t
        want = distance(p, t)
        assert decontaminate.myers(p, t, len(p))[0] == want


def test_leaks(spark, corpus, words):
    rng = random.Random(10)
    items = [(k, words(300 + k, 30).capitalize() + ".") for k in range(12)] + [(50, None), (51, ""), (52, "too short")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def hurt(t, edits):
        t = list(decontaminate.plain(t))
        for _ in range(edits):
            k = rng.randrange(len(t))
            t[k:k + 1] = rng.choice([[], ["q"], [t[k], "w"]])
        return "".join(t)

    rows = []
    for k, t in items[:12]:
        around = words(500 + k, 50)
        most = int(decontaminate.EDIT_SHARE * len(decontaminate.plain(t)))
        rows += [(10 * k, around + t + around), (10 * k + 1, t.upper().replace(" ", " \n- ")), (10 * k + 2, around + " " + hurt(t, most) + " " + around),
                 (10 * k + 3, around + t[:len(t) // 2] + around), (10 * k + 4, around)]
    rows += [(900, None), (901, ""), (902, items[0][1] + " and " + items[1][1]), (902, items[0][1] + " and " + items[1][1]), (None, items[2][1])]
    docs = corpus(rows)
    out = decontaminate.leaks(docs, bench).collect()
    want = lambda r: [] if r.doc_id in (900, 901) else [0, 1] if r.doc_id == 902 else [2] if r.doc_id is None else [r.doc_id // 10] if r.doc_id % 10 < 3 else []
    assert all(r["items"] == want(r) for r in out) and len(out) == len(rows)
    plain = [(i, decontaminate.plain(t)) for i, t in items if len(decontaminate.plain(t)) >= 40]
    for r in out[:20]:
        t = decontaminate.plain(r.text)
        assert r["items"] == [i for i, p in plain if distance(p, t) <= int(decontaminate.EDIT_SHARE * len(p))]
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert all(r["items"] == [] for r in decontaminate.leaks(docs, bench.limit(0)).collect())
    groups = list(decontaminate.item_groups(bench, 0.07, 40, group_chars=300))
    assert len(groups) > 3 and sum(len(g.items) for g in groups) == 12


def test_short_items_are_found_as_whole_words(spark, corpus, words):
    bench = spark.createDataFrame([(1, "What is the art of war?"), (2, "巴黎是哪个国家的首都？"), (3, "Who?"), (4, " ?! "), (5, words(1, 30)), (6, "art of war")], "item_id long, text string")
    rows = [(1, "So: WHAT is -- the art of war, then"), (2, "问题：请问巴黎是哪个国家的首都呢"), (3, "what is the smart of warm"), (4, "whose"), (5, "a. Who"), (6, None), (7, words(1, 30) + " who"), (8, "what is the art if war")]
    out = {r.doc_id: r for r in decontaminate.leaks(corpus(rows), bench).collect()}
    assert {i: r["items"] for i, r in out.items()} == {1: [1, 6], 2: [2], 3: [], 4: [], 5: [3], 6: [], 7: [3, 5], 8: []}
    assert out[1].distances == [0, 0] and out[1].ends == [len("so what is the art of war")] * 2
