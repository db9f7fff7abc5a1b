"""op1, op3, op5: pages, packing and token files."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from redactflow.llm import html_extract, packing, token_files
from redactflow.llm.tokens import Encoder

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy now</div><div class="layout"><aside>See also</aside><article><h1>A &amp; B</h1>
<p>First   line
of <b>the text.<br><p>Second&nbsp;one &lt;x&gt;.</p><ul><li>one<li>two</ul><p>Hi.</p><form>Name <input></form></article>
<section id="comments"><article><p>A reader comment that is quite long, longer than the article's own lines are, by far.</p></article></section></div>
<footer>&copy; me</footer></body></html>"""


def test_extract_page():
    assert html_extract.extract(PAGE) == "A & B\nFirst line of the text.\nSecond one <x>.\none\ntwo\nHi."


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<nav>menu</nav>", ""),
    ("<div class='ad'>buy<article><p>The text is here.</p></article>", "The text is here."), ("</p></div>x", "x"),
    ("<div><div class=sidebar>links here</div><div><p>The long text of the page, which has no article element.</p><p>Short.</p></div></div>",
     "The long text of the page, which has no article element.\nShort."),
])
def test_extract_edges(html, text):
    assert html_extract.extract(html) == text


LONG, HALF, PART = "long words of it " * 40, "some words of it " * 20, "a few words here " * 6


@pytest.mark.parametrize("inner", ["blockquote", "section", "pre", "ul", "table", "div"])
def test_the_region_holds_all_content(inner):
    text = {"ul": f"<li>{LONG}</li>", "table": f"<tr><td>{LONG}</td></tr>"}.get(inner, LONG)
    html = f"<body><div class=menu>x</div><div><h1>Head</h1><p>{PART}</p><{inner}>{text}</{inner}><p>{PART}</p></div></body>"
    assert html_extract.extract(html).split("\n") == ["Head", PART.strip(), LONG.strip(), PART.strip()]


def test_sibling_articles_are_kept():
    html = f"<body><div>Top</div><article><h1>One</h1><p>{LONG}</p></article><article><h1>Two</h1><p>{HALF}</p></article></body>"
    assert html_extract.extract(html).split("\n") == ["One", LONG.strip(), "Two", HALF.strip()]


@pytest.mark.parametrize("mark", ["with-sidebar", "has_comments", "layout hasSidebar", "no-comments"])
def test_a_wrapper_is_not_what_its_class_says_it_has(mark):
    html = f'<body><div class="{mark}"><div><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar">links</div><div class="sidebar-box">more links</div></div></body>'
    assert html_extract.extract(html).split("\n") == [LONG.strip()] * 2


def test_extract_pages(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "<p>" + "long " * 200_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_extract.extract_pages(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 0), (1, 57), (1, 57), (2, 999_999)]
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


TEXTS = ["", "The cat's 12 hats; don't!", "ÀÉ naïve Straße İstanbul ΣΑΣ ς", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "x\x1cy\x85z\xa0w v", "é 日本語 🙂🙂",
         "a" * 3000, "tabs\tand\nlines\r\n " * 50, "don't we'll I'M they've 'tis"]


@pytest.mark.parametrize("as_text", [False, True])
def test_word_ids_are_the_tokenizers(as_text):
    path = packing.tokenizer_path()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = as_text
    own = Encoder(path, as_text, cache_words=20)
    for t in TEXTS:
        assert np.frombuffer(own(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert own(None) == b""


def test_long_texts_are_cut_at_blanks(monkeypatch):
    from redactflow.llm import tokens

    monkeypatch.setattr(tokens, "SLICE_CHARS", 16)
    own, text = Encoder(packing.tokenizer_path()), "some words here and there, " * 40 + "a" * 50
    assert np.frombuffer(own(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit():
    lengths = np.array([6, 5, 5, 4, 3, 3, 2, 2, 10])
    numbers, offsets = packing.best_fit(lengths, 10)
    fill = {}
    for n, o, x in sorted(zip(numbers, offsets, lengths)):
        assert fill.get(n, 0) == o
        fill[n] = o + x
    assert sorted(fill.values()) == [10, 10, 10, 10]
    # tightest window against a plain search
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 500)
    numbers, _ = packing.best_fit(lengths, 64)
    rooms, plain = [], np.empty(500, int)
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= lengths[i]]
        k = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(64)
        rooms[k] -= lengths[i]
    assert len(set(numbers)) == len(rooms)


def test_pack(spark, corpus, words):
    rows = [(1, words(1, 40)), (2, None), (2, ""), (3, words(2, 900)), (3, words(2, 900)), (None, "x"), (4, words(3, 30))]
    docs, path = corpus(rows), packing.tokenizer_path()
    out = packing.pack(docs, path, sequence=256, bucket_pieces=4).toPandas()
    own = Tokenizer.from_file(path)
    want = sorted(len(own.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert out["length"].sum() == sum(want) and (out["length"] <= 256).all()
    ids = np.array([*own.encode(rows[3][1], add_special_tokens=False).ids, 2], "<u4")
    three = out[out.doc_id == 3]
    assert sorted(three.ids_crc32) == sorted(2 * [zlib.crc32(ids[s:s + n].tobytes()) for s, n in set(zip(three.start, three.length))])
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 256
    assert packing.pack(docs.limit(0), path).count() == 0


def test_token_counts(spark, corpus, words, tmp_path):
    rows = [(i, words(i, i * 7)) for i in range(40)] + [(3, words(3, 21)), (90, None), (91, " \n"), (None, "a b")]
    docs = corpus(rows).repartition(3, "n")
    own = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted((i or -1, len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for file_ids in (1, 600, token_files.FILE_IDS):  # each document alone (many are longer), some together, all of a partition
        out = token_files.token_counts(docs, str(tmp_path / f"t{file_ids}"), packing.tokenizer_path(), file_ids=file_ids).collect()
        assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == [(i or -1, n) for i, n in want]
    sizes = lambda name: [n for f in (tmp_path / name).glob("part-*") if (n := f.stat().st_size)]
    assert len(sizes("t1")) == len(rows)  # besides the empty file of a partition without rows
    longest = max(n for _, n in want)
    assert longest > 600 and len(sizes("t600")) > 6 and max(sizes("t600")) <= 2 * (longest + 1)
    assert sum(n > 2 * 600 for n in sizes("t600")) <= sum(n > 600 for _, n in want)  # only a longer document's own
    assert token_files.token_counts(docs.limit(0), str(tmp_path / "e"), packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 9, 50)
    ids = np.concatenate([np.append(rng.integers(0, 400, n), 49407) for n in lengths] + [np.arange(4)]).astype("<u2")
    (tmp_path / "a").write_bytes(ids.tobytes())
    (tmp_path / "b").write_bytes(b"")
    out = token_files.count_documents(spark, str(tmp_path), block_ids=block).orderBy("ordinal").collect()
    assert [r.n_tokens for r in out] == [*lengths.tolist(), 4]
    assert [r.first_id for r in out] == np.concatenate([[0], np.cumsum(lengths + 1)]).tolist()
