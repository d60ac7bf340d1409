"""Best-fit decreasing packing of token sequences.

The lengths that pieces can have are bounded by the capacity, so the packing itself needs only the
histogram of lengths. A segment tree over remaining capacities finds the tightest open bin, and all
bins with equal remaining capacity take equal pieces together, which gives the very bins of best-fit
decreasing over single pieces. Each piece then finds its place by its rank among those of its length.

Defined results: a null text is an empty one (its piece holds the end id alone); repeated rows are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, small_batches, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"
#: Entries of each of the two generations of a worker's word cache; the older goes when the younger is full.
CACHE = 100_000
#: Pieces of one length that are ranked together, about, or the square root of their number if that is more.
RANKED = 1_000


class _Uneven(Exception):
    """White space at the edge of a word: the words of the text can't be encoded one by one."""


class TokenBytes(dict):
    """Words, with the space before them, to their ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if not word or word[0].isspace() or word[-1].isspace():
                raise _Uneven
            ids = np.asarray(self.encode(" " + word), "<u4").tobytes()
        if len(word) < 100:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ByteBPE:
    """The ids that the `tokenizers` library gives for a byte-level BPE file, found word by word.

    A space between two characters that aren't white space always begins a pre-token, so words can
    be encoded apart and kept. Texts with other white space at word edges are encoded whole, texts
    with a special token by the library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else re.compile(r"(?!)")
        printable = [b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)]
        visible = {chr(b): b for b in printable}
        visible |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        ranks = {bytes(visible[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.whole = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = TokenBytes(self.whole)

    @cached_property
    def library(self):
        """Loaded for the first text with a special token."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if self.special.search(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise _Uneven
            return np.asarray(self.whole(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))
        except _Uneven:
            return np.asarray(self.whole(text), "<u4").tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def tokenize(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: documents longer than the capacity are cut, the first piece takes the rest of the division."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(path), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n, start = len(ids) // 4, 0
                for piece in range(-(-n // capacity)):
                    length = capacity if piece or not n % capacity else n % capacity
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
                    start += length
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), PIECES)


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf counts the open bins that have it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        node = self.size + remaining
        while node:
            self.count[node] += bins
            node //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity, at least length, of an open bin."""
        node = self.size + length
        if self.count[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node *= 2
                    node += not self.count[node]
                return node - self.size
            node //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces to a bin, first bin, bins, offset in the bin), by length and first rank.

    Of the pieces of a length those of ranks first..first + pieces * bins - 1 go, so many to a bin, to
    bins that are filled up to the offset. Rows grow with the capacity, not with the pieces.
    """
    tree, held, plan, opened = CapacityTree(capacity), {}, [], 0

    def put(remaining: int, first: int, bins: int) -> None:
        if bins and remaining:
            held.setdefault(remaining, []).append((first, bins))
            tree.add(remaining, bins)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens can't go to a bin of {capacity}")
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, each = capacity, capacity // length
                first, bins = opened, -(-left // each)
                opened += bins
            else:
                first, bins = held[remaining].pop()
                tree.add(remaining, -bins)
                each = remaining // length
            for fill in (each, left % each):
                take = min(bins, left // fill) if fill else 0
                if take:
                    plan.append((length, rank, fill, first, take, capacity - remaining))
                    put(remaining - fill * length, first, take)
                    rank, left, first, bins = rank + fill * take, left - fill * take, first + take, bins - take
            put(remaining, first, bins)
    return np.asarray(sorted(plan), np.int64).reshape(-1, 6)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces; it is read twice."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = best_fit_decreasing(histogram, capacity)
    buckets = [-(-n // max(RANKED, isqrt(n))) for n in (histogram.get(length, 1) for length in range(1, capacity + 1))]
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(F.lit(buckets), (F.col("length") - 1).cast("int"))).cast("int"))
    by_length = Window.partitionBy("length").orderBy("bucket")
    before = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", (F.sum("n").over(by_length) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("row", F.row_number().over(within)).join(before, ["length", "bucket"])
    columns = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts = plan[:, 0], plan[:, 1]
        span = np.int64(firsts.max(initial=0) + 1)
        key = lengths * span + firsts
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            row = plan[np.searchsorted(key, length * span + np.minimum(rank, span - 1), "right") - 1]
            place = rank - row[:, 1]
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(row[:, 3] + place // row[:, 2]), pa.array(row[:, 5] + place % row[:, 2] * length)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, (F.col("row") - 1 + F.col("before")).alias("rank")).mapInArrow(tidy(run), PLACED)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens; one row per piece. Batches for Python stay bounded in the session."""
    small_batches(docs.sparkSession)
    return place(materialize(tokenize(docs, path, capacity, end_id), "pieces"), capacity)
