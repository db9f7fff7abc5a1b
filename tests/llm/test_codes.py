"""op12: byte-level ids against the tokenizer, directly addressable codes, files and their digests."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from redactflow.llm import byte_tokens, dac_files as D
from redactflow.llm.packing import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
SIGNS = [*"abstmdrevl'  \n\t\r--.,1 2'’éß²½ªµ×÷\xa0\x85　\x0b\x1c\x1f​中文かな😀𝟘̀ЖאͰ'''<|>", "<|endoftext|>", "'s", "'ll", "'re", " '", "   "]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def encoded(texts):
    out = [[] for _ in texts]
    for k, ids in byte_tokens.byte_encoder(PATH).encode_column(pa.array(texts, pa.string())):
        out[k] += ids.tolist()
    return out


def test_ids_are_the_tokenizers(whole, monkeypatch):
    r = random.Random(3)
    for _ in range(300):
        texts = ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 30))) for _ in range(8)] + [None, ""]
        assert encoded(texts) == list(map(whole, texts))
    monkeypatch.setattr(byte_tokens, "PART_BYTES", 100)
    monkeypatch.setattr(byte_tokens.long_text_parts, "__defaults__", (100,))
    for _ in range(60):
        text = "".join(r.choice([*SIGNS, *"ab cd ef gh" * 20]) for _ in range(r.randint(0, 1500)))
        assert encoded([text]) == [whole(text)]
    text = "x" * 30_000 + " " + "y " * 5000
    assert encoded([text, "z"]) == [whole(text), whole("z")]


def test_codes_give_any_token():
    r = np.random.default_rng(1)
    for t in range(120):
        n, top = int(r.integers(1, 3000)), int(r.choice([1, 2, 300, 50257, 1 << 20, 1 << 24]))
        ids = (r.integers(0, top, n) if t % 2 else np.minimum(r.zipf(1.2, n), top)).astype(np.uint32)
        codes, places = D.Codes.of(ids), r.integers(0, n, 400)
        a, b = sorted(r.integers(0, n + 1, 2).tolist())
        assert (codes.at(places) == ids[places]).all() and (codes.stretch(a, b) == ids[a:b]).all()


def test_widths_are_the_best():
    ids = np.array([1] * 1000 + [60_000] * 10, np.uint32)
    cost = lambda widths: sum((ids >> sum(widths[:k]) > 0).sum() * (w + (k + 1 < len(widths)) * (1 + 32 / D.SUPER)) if k else len(ids) * (w + (len(widths) > 1) * (1 + 32 / D.SUPER))
                              for k, w in enumerate(widths))
    assert cost(D.chunk_widths(ids)) == min(
        cost([a, b, 16 - a - b][:3 if 16 - a - b else 2]) for a in range(1, 9) for b in range(1, 9) if 0 <= 16 - a - b <= 8)
    assert D.chunk_widths(np.zeros(5, np.uint32)) == [1]


def test_joined_crc():
    for a, b in ((b"", b"x"), (b"hello", b"world!!"), (b"q" * 1000, b"z" * 12345), (b"abc", b"")):
        assert D.crc_of_joined(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_documents_over_blocks_and_files(spark, corpus, words, whole, tmp_path):
    rows = [(i, words(i, i * 7 % 300)) for i in range(60)] + [(5, "twice"), (5, words(5, 35)), (None, None), (None, "no id"), (-3, ""), (99, words(7, 20_000))]
    path = str(tmp_path / "tokens")
    D.write_files(corpus(rows).repartition(3), path, PATH, block_ids=100, file_blocks=7, part_bytes=1 << 16)
    got = D.document_digests(spark, path).withColumn("doc_id", F.col("doc_id").cast("long")).orderBy("part", "number").collect()
    want = sorted(((i, [*whole(t), 0]) for i, t in rows), key=lambda r: (r[0] is not None, r[0]))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    digest = lambda i, ids: (i if i is not None else -10**9, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted(digest(r.doc_id, [])[:1] + (r.n_tokens, r.ids_crc32) for r in got) == sorted(digest(*w) for w in want)
    at = {}
    for r in got:  # gapless in each part
        assert r["first"] == at.get(r.part, 0)
        at[r.part] = r["first"] + r.n_tokens
    # any token, without its neighbours
    stream = {p: [] for p in at}
    for piece in sorted(D.read_pieces(spark, path).collect(), key=lambda p: (p.part, p["first"] + p.before)):
        stream[piece.part] += np.frombuffer(piece.ids, "<u4").tolist()
    asked = [(p, k) for p in at for k in (0, 1, at[p] // 2, at[p] - 1, at[p], -1)] + [(10**6, 0)]
    found = D.tokens_at(spark, path, spark.createDataFrame(asked, "part long, place long")).collect()
    assert sorted((t.part, t.place, t.token) for t in found) == sorted((p, k, stream[p][k]) for p, k in set(asked) if p in at and 0 <= k < at[p])


def test_query_gives_places_of_all_documents(spark, corpus, words, whole, tmp_path):
    rows = [(i, words(i, i)) for i in range(40)] + [(41, None)]
    corpus(rows).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in D.op12_token_id_output(spark, str(tmp_path)).collect()}
    at = 0
    for i, t in rows:
        ids = [*whole(t), 0]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_table_and_damaged_file(spark, corpus, tmp_path):
    corpus([(1, "x")]).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert D.op12_token_id_output(spark, str(tmp_path)).collect() == []
    with pytest.raises(ValueError, match="damaged"):
        list(D.blocks_of(b"\0" * 100))
