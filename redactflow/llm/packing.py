"""Packing of tokenized documents into sequences of a fixed number of tokens.

Every document gets its ids and the end id.  A document longer than a sequence
is first cut into full windows; what remains of it, and every shorter document,
is a piece.  Best-fit decreasing then places the pieces of a bucket, longest
first, in the open sequence with the least room that still holds the piece; a
segment tree over remaining capacities finds that sequence in logarithmic time.

Only piece lengths are shuffled, never ids or texts.  Rows are dealt to buckets
of bounded size by their place in the written piece table, so no document id,
source or length gathers in one task.  Null texts are empty (one piece of the end id);
null, equal and repeated ids are carried through; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.llm.common import stage, table
from redactflow.llm.tokens import encoder

SEQUENCE = 4096
END_ID = 2


def token_pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].array, b["text"]):
                ids = encode(text) + end
                n = len(ids) // 4
                for at in range(0, n, sequence):
                    part = ids[4 * at:4 * (at + sequence)]
                    rows.append((doc_id, at, len(part) // 4, zlib.crc32(part), n))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({c: "int64" for c in out.columns[1:]})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


class RoomTree:
    """A segment tree over 0..sequence that counts the open sequences with each remaining capacity."""

    def __init__(self, sequence: int):
        self.half = 1 << sequence.bit_length()
        self.count = [0] * (2 * self.half)

    def add(self, room: int, change: int) -> None:
        k = room + self.half
        while k:
            self.count[k] += change
            k >>= 1

    def least(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that an open sequence has, or -1."""
        k = need + self.half
        while not self.count[k]:
            while k & 1:  # a right child: nothing more to its right under this parent
                k >>= 1
            if k <= 1:
                return -1
            k += 1
        while k < self.half:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.half


def best_fit(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each piece, placed longest first."""
    order = np.argsort(-lengths, kind="stable")
    tree, open_ones = RoomTree(sequence), defaultdict(list)
    numbers, offsets, new = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in order.tolist():
        need = int(lengths[i])
        room = tree.least(need)
        if room < 0:
            room, number = sequence, new
            new += 1
        else:
            number = open_ones[room].pop()
            tree.add(room, -1)
        numbers[i], offsets[i] = number, sequence - room
        if room > need:
            open_ones[room - need].append(number)
            tree.add(room - need, 1)
    return numbers, offsets


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, bucket_pieces: int = 2048) -> DataFrame:
    """Pieces with sequence_id and offset; ``bucket_pieces`` are packed together on average."""
    pieces = stage(token_pieces(docs, tokenizer, sequence, end_id), "pieces")
    buckets = -(-pieces.count() // bucket_pieces) or 1
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))

    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        numbers, offsets = best_fit(b["length"].to_numpy(), sequence)
        return b.drop(columns="bucket").assign(sequence_id=(int(key[0]) << 32) + numbers, offset=offsets)

    return dealt.groupBy("bucket").applyInPandas(run, ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the executors find the tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
