"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The model file gives pieces with log scores; control and unused pieces stay out of the trie. Characters
without a piece cost ten below the least score and become byte pieces. Where no piece has the white
space marker after another character, a text falls into parts (markers, then other characters) whose
best segmentations are independent; the encodings of parts are kept. Of equal scores the longer last
piece wins.

Defined results: a null or empty text has no ids and decodes to an empty text; the space added before
a text is taken off again in decoding; a marker character in a text decodes to a space; repeated rows
are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Encodings of parts that a worker keeps; it starts anew beyond that.
CACHE = 400_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    at = 0
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + n]
        at += n


class Trie:
    """Double-array trie over bytes: from state s, byte c leads to base[s] + c + 1 if that state's check is s."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check, self.value = [0], [-2], [-1]
        ordered = sorted(keys)
        level, free = [(0, 0, len(ordered), 0)], 1  # state, keys from, to, depth
        while level:
            following = []
            for state, low, high, depth in level:
                if low < high and len(ordered[low]) == depth:
                    self.value[state] = keys[ordered[low]]
                    low += 1
                if low == high:
                    continue
                branches, i = [], low
                while i < high:
                    byte, j = ordered[i][depth], i
                    while j < high and ordered[j][depth] == byte:
                        j += 1
                    branches.append((byte, i, j))
                    i = j
                lowest, at, tried = branches[0][0] + 1, max(free, branches[0][0] + 1), 0
                while True:
                    if (more := at - lowest + 514 - len(self.check)) > 0:
                        self.base.extend([0] * more)
                        self.check.extend([-1] * more)
                        self.value.extend([-1] * more)
                    if self.check[at] == -1 and all(self.check[at - lowest + b + 1] == -1 for b, _, _ in branches):
                        break
                    tried += self.check[at] != -1
                    at += 1
                if at > free + 16 and tried >= 0.9 * (at - free):
                    free = at  # nearly full up to here
                base = at - lowest
                self.base[state] = base
                for byte, i, j in branches:
                    self.check[base + byte + 1] = state
                    following.append((base + byte + 1, i, j, depth + 1))
            level = following


class Model:
    """A SentencePiece model used as a unigram model."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        self.prefix, self.squeeze = True, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("models with a character map aren't supported")
                self.prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        usable = {p.encode(): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.trie = Trie(usable)
        self.penalty = min(s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL) - 10.0
        self.apart = not any(MARK in self.pieces[i].lstrip(MARK) for i in usable.values())
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.apart else re.compile(r"(?s).+")
        self.surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.kept: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation."""
        data = text.encode("utf-8", "replace")
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(data)
        best, came, by = [-1e300] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        start = 0
        while start < n:
            first = data[start]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here, state, at, single = best[start], 0, start, False
            while at < n:
                following = base[state] + data[at] + 1
                if check[following] != state:
                    break
                state = following
                at += 1
                piece = value[state]
                if piece >= 0:
                    score = here + scores[piece]
                    if score > best[at]:
                        best[at], came[at], by[at] = score, start, piece
                    single = single or at - start == width
            if not single:
                score = here + self.penalty
                if score > best[start + width]:
                    best[start + width], came[start + width], by[start + width] = score, start, -1
            start += width
        out, at = [], n
        while at:
            if by[at] >= 0:
                out.append(by[at])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(data[came[at] : at]))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at = came[at]
        return out[::-1]

    def _part(self, part: str) -> bytes:
        ids = self.kept.get(part)
        if ids is None:
            ids = np.asarray(self.viterbi(part), "<i4").tobytes()
            if len(self.kept) >= CACHE:
                self.kept.clear()
            if len(part) < 64:
                self.kept[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return np.empty(0, np.int32)
        text = text.replace(" ", MARK)
        return np.frombuffer(b"".join(map(self._part, self.parts.findall(MARK + text if self.prefix else text))), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(path)
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                ids, same = [], []
                for t in batch.column(1):
                    text = t.as_py() or ""
                    ids.append(codec.encode(text))
                    same.append(codec.decode(ids[-1]) == text)
                sizes = np.array([len(i) for i in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)))
                yield pa.record_batch([batch.column(0), pa.array(sizes), lists, pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(path)
        for batch in batches:
            texts = [codec.decode(np.asarray(i.as_py() or [], np.int32)) for i in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
