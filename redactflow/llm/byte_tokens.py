"""Token ids of whole texts with a byte-level BPE tokenizer file, many texts at once.

Numpy finds where the tokenizer's own expression cuts a buffer of texts into
pieces (contractions; runs of letters, digits or other characters with the blank
before them; white space).  What class a character has is asked of the tokenizer
itself, once per character.  The pieces are dictionary-encoded, each distinct
piece is merged once by the tokenizer's model and remembered, and the ids of the
texts are gathered from those of the pieces.  A special token's string is that
token and parts the texts before and after it, as in the tokenizer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from redactflow.llm.common import row_steps, text_bytes
from redactflow.llm.tokens import WordCache

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
UNKNOWN = 9
PART_BYTES = 1 << 21
#: FIXED VALUES: letters after an apostrophe that make a piece with it.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")


class ByteEncoder:
    """Encodes with the byte-level tokenizer file at ``path``."""

    def __init__(self, path: str, cache_pieces: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cut = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.specials = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # the character that stands for each byte: itself if it is visible, else one after U+00FF
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(seen)]
        self.letters = {b: b for b in seen} | {b: 0x100 + i for i, b in enumerate(rest)}
        self.classes = np.full(0x110000, UNKNOWN, np.int8)
        self.class_of(np.arange(0x80))
        self.known = WordCache(self.ids_of, cache_pieces)

    def class_of(self, points: np.ndarray) -> np.ndarray:
        """The character classes of code points."""
        out = self.classes[points]
        if (out == UNKNOWN).any():
            for p in np.unique(points[out == UNKNOWN]).tolist():
                one = lambda before: len(self.cut(before + chr(p))) == 1
                self.classes[p] = LETTER if one("a") else DIGIT if one("1") else OTHER if one("-") else SPACE
            out = self.classes[points]
        return out

    def pieces(self, raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Where the pieces of a buffer start; no piece goes over a cut."""
        data = raw.tobytes()
        special = []
        for s in self.specials:
            at = data.find(s)
            while at >= 0:
                k = np.searchsorted(cuts, at, "right")
                if k == len(cuts) or cuts[k] >= at + len(s):  # within one text
                    special.append((at, at + len(s)))
                    at = data.find(s, at + len(s))
                else:
                    at = data.find(s, at + 1)
        edges = np.zeros(len(raw) + 1, bool)
        edges[cuts] = True
        for lo, hi in special:
            edges[[lo, hi]] = True
        head = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each character
        b, edge = raw[head], edges[head]
        kind = self.classes[np.minimum(b, 0x7F)]
        wide = np.flatnonzero(b >= 0x80)
        if len(wide):
            kind[wide] = self.class_of(code_points(raw, head[wide]))
        before = np.append(np.int8(-1), kind[:-1])
        before[edge] = -1
        after = np.append(kind[1:], np.int8(-1))
        after[:-1][edge[1:]] = -1
        blank_before = np.append(False, b[:-1] == 0x20)
        start = (kind != before) & ~((before == SPACE) & blank_before)
        start |= (kind == SPACE) & (after >= 0) & (after != SPACE)
        quote = np.flatnonzero(start & (b == 0x27))
        if len(quote):
            follow = lambda k: np.where(np.append(edge, [True] * 3)[quote + k], 0, np.append(b, [0] * 3)[quote + k])
            b1, b2 = follow(1), follow(2)
            short = np.isin(b1, [ord(x) for x in SHORT_ENDINGS])
            long = np.isin(b1.astype(int) * 256 + b2, [ord(x[0]) * 256 + ord(x[1]) for x in LONG_ENDINGS]) & (b2 > 0)
            hit = quote[short | long]
            start[hit + 1] = False
            end = hit + np.where(long[short | long], 3, 2)
            start[end[end < len(start)]] = True
        out = np.zeros(len(raw) + 1, bool)
        out[head[start]] = True
        for lo, hi in special:
            out[lo + 1:hi] = False
        return np.flatnonzero(out[:-1])

    def ids_of(self, piece: bytes) -> bytes:
        if piece in self.specials:
            return self.specials[piece].to_bytes(4, "little")
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a buffer, and where each text's ids start (and end)."""
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        starts = self.pieces(raw, offsets[offsets < len(raw)])
        ends = np.append(starts, len(raw))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = list(map(self.known.__getitem__, distinct))
        flat = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        piece = coded.indices.to_numpy()
        size = sizes[piece]
        at = np.append(0, np.cumsum(size))
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[piece] - at[:-1], size) + np.arange(at[-1])]
        return ids, at[np.searchsorted(starts, offsets)]

    def encode_column(self, column: pa.Array):
        """(row, ids) of the rows of a text column; of a text longer than a part, several in turn, the first row number alone counting up."""
        raw, offsets = text_bytes(column)
        for i, j in row_steps(offsets, PART_BYTES):
            if j == i + 1 and offsets[j] - offsets[i] > PART_BYTES:
                for lo, hi in long_text_parts(raw[offsets[i]:offsets[j]]):
                    yield i, self.encode(raw[offsets[i] + lo:offsets[i] + hi], np.array([0, hi - lo]))[0]
                continue
            ids, at = self.encode(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            for k in range(j - i):
                yield i + k, ids[at[k]:at[k + 1]]


def code_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the multi-byte characters that start at ``at``."""
    padded = np.append(raw, np.zeros(3, np.uint8))
    a, b, c, d = (padded[at + k].astype(np.int64) for k in range(4))
    b, c, d = b & 0x3F, c & 0x3F, d & 0x3F
    two, three, four = (a & 0x1F) << 6 | b, (a & 0x0F) << 12 | b << 6 | c, (a & 0x07) << 18 | b << 12 | c << 6 | d
    return np.minimum(np.where(a < 0xE0, two, np.where(a < 0xF0, three, four)), 0x10FFFF)


def long_text_parts(raw: np.ndarray, limit: int = PART_BYTES):
    """Cuts of a long text where a piece starts whatever comes around it: at a blank between two ASCII letters."""
    at = 0
    while len(raw) - at > limit:
        look, cut = at + limit, None
        while cut is None and look < len(raw) - 1:
            w = raw[look - 1:look + 4096]
            letter = ((w | 0x20) >= 0x61) & ((w | 0x20) <= 0x7A)
            found = np.flatnonzero((w[1:-1] == 0x20) & letter[:-2] & letter[2:])
            cut = look + int(found[0]) if len(found) else None
            look += 4094
        if cut is None:
            break
        yield at, cut
        at = cut
    yield at, len(raw)


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """The worker's own encoder, with what it remembers."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]
