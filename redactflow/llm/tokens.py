"""Token ids of whole texts with a public tokenizer file, one word at a time.

The tokenizer lower-cases, normalises and splits at white space before it
merges, so the ids of a text are the ids of its words one after another, and a
bounded cache of words saves most of the work.  Words of letters up to U+017F
go straight to the tokenizer's merge model; any other text goes through the
whole tokenizer, word by word.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import regex
from tokenizers import Tokenizer

#: Texts of other characters than these (or with "<|", which may spell a special token) take the tokenizer's whole path.
_OTHER = re.compile("[^\x00-\x1b\x20-įı-ſ]|<\\|")
#: White space as the tokenizer's own expression has it.
_BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")
SLICE_CHARS = 1 << 20


class WordCache(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes; emptied when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[word] = ids = self.make(word)
        return ids


class Encoder:
    """Encodes with the tokenizer file at ``path``; ``specials_as_text`` reads the special tokens' strings as ordinary text."""

    def __init__(self, path: str, specials_as_text: bool = False, cache_words: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.model = self.tokenizer.model
        with open(path) as f:
            split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces_of = regex.compile(split).findall
        byte_level = self.tokenizer.pre_tokenizer[1]
        # the printable character that stands for each character's UTF-8 bytes
        self.letters = str.maketrans({chr(c): "".join(x for x, _ in byte_level.pre_tokenize_str(chr(c))) for c in range(1, 0x180)})
        self.words = WordCache(self.word, cache_words)
        self.pieces = WordCache(self.piece, cache_words)
        self.raw_words = WordCache(self.raw_word, cache_words)

    def piece(self, piece: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(piece.translate(self.letters))], "<u4").tobytes()

    def word(self, word: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.pieces_of(word)])

    def raw_word(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        return b"".join(self.part(x) for x in slices(text or ""))

    def part(self, text: str) -> bytes:
        if _OTHER.search(text):
            return b"".join(map(self.raw_words.__getitem__, filter(None, _BLANK.split(text))))
        return b"".join(map(self.words.__getitem__, text.lower().split()))


def slices(text: str) -> Iterator[str]:
    """A long text cut at white space into parts of bounded length (a longer word stays whole)."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        if not (m := _BLANK.search(text, at + SLICE_CHARS)):
            break
        yield text[at:m.start()]
        at = m.end()
    yield text[at:]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, specials_as_text: bool = False) -> Encoder:
    """The worker's own encoder; it lives as long as the worker, and so does its cache."""
    key = (path, specials_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(path, specials_as_text)
    return _encoders[key]
