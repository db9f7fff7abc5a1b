"""Token files of directly addressable codes.

An id is cut into chunks from its low bits up.  All first chunks of a block lie
in the first level, all second chunks in the second, and so on; a continuation
bitmap beside each level says which ids go on in the next, and a rank directory
(ones before every 512 bits) says where: the token at i has its first chunk at i
and the next one at rank(i).  So any token, or any stretch of tokens, is read
without decoding what lies before it.  Chunk widths are chosen for each block
by dynamic programming over the bit lengths of its ids.

A file is a row of blocks, at most ``file_blocks`` of at most ``block_ids``
tokens, so its size is bounded whatever the documents are; a document may span
blocks and files.  A block also holds, for every document with ids in it, the
document's id, number and length, where its ids lie here and how many came before.
All numbers are little-endian; see ``block_bytes`` for the layout.

Documents are written in ascending order of doc_id (nulls first; equal ids by a
hash of the text), dealt out by ranges of that order; an id that many rows share
spreads over ranges.  Null and empty texts hold the end id alone.  Equal rows
stay rows of their own.  An empty table gives no files and no rows.  Columns
besides doc_id and text are not read; doc_id may be of any type that a string can be cast to.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactflow.llm.byte_tokens import byte_encoder
from redactflow.llm.common import stage, table
from redactflow.llm.packing import tokenizer_path
from redactflow.session import shared_dir

END_ID = 0
BLOCK_IDS = 1 << 18
FILE_BLOCKS = 16
#: Chunks of at most so many bits: eight of them fit in one 64-bit word.
MOST_WIDTH = 8
PART_BYTES = 64 << 20
MAGIC = b"DAC1"
HEAD = struct.Struct("<4sIQIII")  # magic, part, ids before in the part, ids, documents, levels
LEVEL = struct.Struct("<II")  # chunk width in bits, chunks
SUPER = 512


def chunk_widths(ids: np.ndarray) -> list[int]:
    """Widths of at most 8 bits that make the block smallest, counting a continuation bit and its rank share for each chunk but the last."""
    bits = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=2)
    longest = max(1, int(np.flatnonzero(bits)[-1]) if len(ids) else 1)
    above = [int(bits[t + 1:].sum()) if t else int(bits.sum()) for t in range(longest)]  # ids that reach bit t
    best = {longest: (0.0, [])}
    for t in range(longest - 1, -1, -1):
        best[t] = min((above[t] * (w + (0 if t + w == longest else 1 + 32 / SUPER)) + best[t + w][0], [w, *best[t + w][1]]) for w in range(1, min(MOST_WIDTH, longest - t) + 1))
    return best[0][1]


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` one after another in ``width`` bits each, with four spare bytes for reads."""
    eights = np.append(values, np.zeros(-len(values) % 8, values.dtype)).astype("<u8").reshape(-1, 8)
    word = eights[:, 0]
    for k in range(1, 8):
        word = word | eights[:, k] << np.uint64(k * width)
    packed = word.view(np.uint8).reshape(-1, 8)[:, :width].ravel()
    return np.append(packed[:-(-len(values) * width // 8)], np.zeros(4, np.uint8))


class Level:
    """Chunks of one width, which of them go on (``more``, 64-bit words), and the ones before every 512 bits."""

    def __init__(self, width: int, n: int, chunks: np.ndarray, more: np.ndarray, ranks: np.ndarray):
        self.width, self.n, self.chunks, self.more, self.ranks = width, n, chunks, more, ranks

    @classmethod
    def of(cls, values: np.ndarray, width: int, last: bool) -> tuple[Level, np.ndarray]:
        on = np.zeros(0, bool) if last else values >> width > 0
        words = np.packbits(np.append(on, np.zeros(-len(on) % SUPER, bool)), bitorder="little").view("<u8")
        ones = np.bitwise_count(words).reshape(-1, SUPER // 64).sum(1, dtype=np.uint32)
        level = cls(width, len(values), pack_bits(values & np.uint32((1 << width) - 1), width), words, np.cumsum(ones, dtype=np.uint32) - ones)
        return level, (values[on] >> width if not last else values[:0])

    def chunk(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.width
        two = np.ndarray(len(self.chunks) - 1, "<u2", self.chunks.data, strides=(1,))  # two bytes from any byte on
        return (two[bit >> 3] >> (bit & 7).astype(np.uint16) & np.uint16((1 << self.width) - 1)).astype(np.uint32)

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.more[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones of the bitmap before each position."""
        out, first, word = self.ranks[at // SUPER].astype(np.int64), at // SUPER * (SUPER // 64), at >> 6
        for k in range(SUPER // 64):
            w = first + k
            inside = np.where(w < word, self.more[np.minimum(w, len(self.more) - 1)], np.uint64(0))
            out += np.bitwise_count(inside).astype(np.int64)
        return out + np.bitwise_count(self.more[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class Codes:
    """The ids of a block, by place."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, widths, rest = [], chunk_widths(ids), ids.astype(np.uint32)
        for k, w in enumerate(widths):
            level, rest = Level.of(rest, w, k + 1 == len(widths))
            levels.append(level)
        return cls(levels)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order."""
        out, live, at, shift = np.zeros(len(places), np.uint32), np.arange(len(places)), np.asarray(places, np.int64), 0
        for k, level in enumerate(self.levels):
            out[live] |= level.chunk(at) << np.uint32(shift)
            shift += level.width
            if k + 1 == len(self.levels) or not len(at):
                break
            on = level.goes_on(at)
            live, at = live[on], level.rank(at[on])
        return out

    def stretch(self, start: int, stop: int) -> np.ndarray:
        """The ids of [start, stop): one rank for each level, whatever lies before."""
        out, live, shift = np.zeros(stop - start, np.uint32), None, 0
        for k, level in enumerate(self.levels):
            at = np.arange(start, stop)
            chunk = level.chunk(at) << np.uint32(shift)
            if live is None:
                out |= chunk
            else:
                out[live] |= chunk
            shift += level.width
            if k + 1 == len(self.levels) or start == stop:
                break
            on = np.flatnonzero(level.goes_on(at))
            live = on if live is None else live[on]
            start = int(level.rank(np.array([start]))[0])
            stop = start + len(on)
        return out


class Block:
    """One block: its documents' directory and its codes."""

    def __init__(self, part: int, first: int, names: list[str | None], numbers: np.ndarray, before: np.ndarray, totals: np.ndarray, starts: np.ndarray, n_ids: int, codes: Codes):
        self.part, self.first, self.names, self.numbers, self.before, self.totals, self.starts, self.n_ids, self.codes = part, first, names, numbers, before, totals, starts, n_ids, codes


def block_bytes(part: int, first: int, pieces: list[tuple[str | None, int, int, int, np.ndarray]]) -> bytes:
    """A block of pieces (doc_id, document's number in the part, its ids before, its ids in all, ids here).

    Header; then of the documents the numbers, ids before and totals (u64), starts
    here (u32), name lengths (i32, -1 for null) and names (UTF-8); then each level:
    width and count (u32), ranks (u32), bitmap (u64), chunks, the sizes of which follow from the count."""
    ids = np.concatenate([p[4] for p in pieces])
    codes = Codes.of(ids)
    sizes = np.array([len(p[4]) for p in pieces])
    names = [None if p[0] is None else p[0].encode() for p in pieces]
    out = [HEAD.pack(MAGIC, part, first, len(ids), len(pieces), len(codes.levels)),
           *(np.array([p[k] for p in pieces], "<u8").tobytes() for k in (1, 2, 3)), (np.cumsum(sizes) - sizes).astype("<u4").tobytes(),
           np.array([-1 if x is None else len(x) for x in names], "<i4").tobytes(), b"".join(x or b"" for x in names)]
    for k, level in enumerate(codes.levels):
        out.append(LEVEL.pack(level.width, level.n))
        if k + 1 < len(codes.levels):
            out += [level.ranks.astype("<u4").tobytes(), level.more.tobytes()]
        out.append(level.chunks.tobytes())
    return b"".join(out)


def read_block(data: memoryview, at: int) -> tuple[Block, int]:
    """The block at ``at`` (its arrays are views of ``data``) and where the next one begins."""
    magic, part, first, n_ids, n_docs, n_levels = HEAD.unpack_from(data, at)
    if magic != MAGIC:
        raise ValueError("not a token file, or a damaged one")
    at += HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    numbers, before, totals, starts, sizes = take("<u8", n_docs), take("<u8", n_docs), take("<u8", n_docs), take("<u4", n_docs), take("<i4", n_docs)
    names = [None if n < 0 else take("u1", int(n)).tobytes().decode() for n in sizes.tolist()]
    levels = []
    for k in range(n_levels):
        width, n = LEVEL.unpack_from(data, at)
        at += LEVEL.size
        supers = -(-n // SUPER) if k + 1 < n_levels else 0
        ranks, more = take("<u4", supers), take("<u8", supers * SUPER // 64)
        levels.append(Level(width, n, take("u1", -(-n * width // 8) + 4), more, ranks))
    return Block(part, first, names, numbers, before, totals, starts, n_ids, Codes(levels)), at + 1  # the sink's separator follows


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, file_blocks: int = FILE_BLOCKS, part_bytes: int = PART_BYTES) -> None:
    """Write the ids of ``docs`` in ascending doc_id order: one or more files for each range of the order.
    The text sink writes a block's bytes as they are, with one separating byte after each."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-size // part_bytes), min(4 * cores, size // (1 << 20)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, end = byte_encoder(tokenizer), TaskContext.get().partitionId(), np.array([end_id], np.uint32)
        first, count, number, pending = 0, 0, 0, []
        for b in batches:
            for name, ids in whole_documents(b.column(0).to_pylist(), encoder.encode_column(b.column(1)), end):
                at = 0
                while at < len(ids):
                    here = ids[at:at + block_ids - count]
                    pending.append((name, number, at, len(ids), here))
                    at, count = at + len(here), count + len(here)
                    if count == block_ids:
                        yield record(block_bytes(part, first, pending))
                        first, count, pending = first + count, 0, []
                number += 1
        if pending:
            yield record(block_bytes(part, first, pending))

    order = [F.col("doc_id"), F.xxhash64("text")]
    spread = docs.select("doc_id", "text").repartitionByRange(parts, *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    (spread.select(F.col("doc_id").cast("string").alias("name"), "text").mapInArrow(blocks, "block binary").select(F.col("block").cast("string"))
     .write.option("maxRecordsPerFile", file_blocks).text(path))


def record(block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])


def whole_documents(names: list, parts: Iterator[tuple[int, np.ndarray]], end: np.ndarray) -> Iterator[tuple[str | None, np.ndarray]]:
    """(name, ids with the end id) of each row, from the parts of its ids."""
    row, held = -1, []
    for k, ids in parts:
        if k != row and held:
            yield names[row], np.concatenate([*held, end])
            held = []
        row = k
        held.append(ids)
    if held:
        yield names[row], np.concatenate([*held, end])


def blocks_of(content: bytes) -> Iterator[Block]:
    """The blocks of one file."""
    data, at = memoryview(content), 0
    while at < len(data):
        block, at = read_block(data, at)
        yield block


def stretches(block: Block, most: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first document, document after the last, their ids): whole documents, about ``most`` ids at a time, read from where they start."""
    ends, i = np.append(block.starts[1:], block.n_ids), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, block.starts[i] + most, "right")))
        yield i, j, block.codes.stretch(int(block.starts[i]), int(ends[j - 1]))
        i = j


PIECE = "part long, number long, doc_id string, first long, total long, before long"


def read_pieces(spark: SparkSession, path: str, value: str = "ids binary", of=None) -> DataFrame:
    """part, number, doc_id (as text), first, total, before, ids of every document's ids in every block under ``path``.
    ``first`` is the place of the document's first id in its part.  With ``of``, the
    last column is ``of(bytes of the ids, total, before)`` of the type ``value`` instead."""
    name = value.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for block in blocks_of(content.as_buffer()):
                    for i, j, ids in stretches(block):
                        data, some = ids.astype("<u4").tobytes(), slice(i, j)
                        cut = 4 * (np.append(block.starts[some], block.starts[i] + len(ids)).astype(np.int64) - int(block.starts[i]))
                        total, before = block.totals[some].astype(np.int64), block.before[some].astype(np.int64)
                        pieces = [data[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                        if of is not None:
                            pieces = list(map(of, pieces, total.tolist(), before.tolist()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(j - i, block.part, np.int64)), pa.array(block.numbers[some].astype(np.int64)), pa.array(block.names[some], pa.string()),
                             pa.array(block.first + block.starts[some].astype(np.int64) - before), pa.array(total), pa.array(before), pa.array(pieces)],
                            ["part", "number", "doc_id", "first", "total", "before", name])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"{PIECE}, {value}")


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """part, place, token of the ``wanted`` (part, place) tokens: places that no file
    has are left out, repeated ones come once.  Only the wanted tokens are decoded."""
    files = spark.read.format("binaryFile").load(path)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                all_blocks = list(blocks_of(content.as_buffer()))
                if not all_blocks:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([all_blocks[0].part], pa.int64()), pa.array([all_blocks[0].first], pa.int64()),
                     pa.array([all_blocks[-1].first + all_blocks[-1].n_ids], pa.int64())], ["path", "part", "lo", "hi"])

    ranges = stage(files.select("path", "content").mapInArrow(spans, "path string, part long, lo long, hi long"), "ranges")
    asked = wanted.select("part", "place").distinct().join(ranges, "part").where("place >= lo and place < hi")
    asked = asked.groupBy("path", F.floor(F.col("place") / BLOCK_IDS).alias("chunk")).agg(F.collect_list("place").alias("places"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, places in zip(b.column(0), b.column(1)):
                want = np.sort(places.values.to_numpy())
                for block in blocks_of(content.as_buffer()):
                    here = want[(want >= block.first) & (want < block.first + block.n_ids)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(here), block.part, np.int64)), pa.array(here), pa.array(block.codes.at(here - block.first).astype(np.int64))], ["part", "place", "token"])

    return files.select("path", "content").join(asked, "path").select("content", "places").mapInArrow(pick, "part long, place long, token long")


def crc_of_joined(crc: int, zeros: int) -> int:
    """What a crc32 adds to that of the bytes it ends up before: the crc moved past ``zeros`` bytes.
    The crc32 of two strings joined is this of the first one's, xor the second one's crc32."""

    def times(a: int, b: int) -> int:  # the product of two polynomials, bits reflected, modulo the crc's own
        out = 0
        while a:
            if a & 0x80000000:
                out ^= b
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
            a = (a << 1) & 0xFFFFFFFF
        return out

    power, shift = 0x00800000, 0x80000000  # x^8, one
    while zeros:
        if zeros & 1:
            shift = times(shift, power)
        power = times(power, power)
        zeros >>= 1
    return times(shift, crc)


def piece_crc(ids: bytes, total: int, before: int) -> int:
    """What a document's ids in one block add to the crc32 of all its ids."""
    crc, rest = zlib.crc32(ids), 4 * (total - before) - len(ids)
    return crc_of_joined(crc, rest) if rest else crc


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """part, number, doc_id (as text), first, n_tokens, ids_crc32 of every document in the files."""
    return read_pieces(spark, path, "crc long", piece_crc).groupBy("part", "number").agg(
        F.first("doc_id").alias("doc_id"), F.first("first").alias("first"), F.first("total").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))


def op12_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark, 'llm')}/dac-{uuid.uuid4().hex}"
    write_files(docs, path, tokenizer_path("byte_bpe_50k.json"))
    found = stage(document_digests(spark, path), "digests")
    # one row for each written part: the ids of all parts before it
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("part").alias("_part"), before.alias("base"))
    kind = dict(docs.dtypes)["doc_id"]
    return found.join(starts, F.col("part") == F.col("_part")).select(
        F.col("doc_id").cast(kind).alias("doc_id"), (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
