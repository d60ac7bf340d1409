"""Substring dedup: remove passages whose words occur earlier in the corpus.

A window is a run of `size` consecutive words of one document. Every word under a window that also
starts earlier (smaller doc_id, or same document and earlier start) goes.

Pass 1 builds a count-min sketch. What it counts for a window is the window's minimizer, the half-size
sub-window with the least hash: equal windows have equal minimizers at different places, so the
minimizer's count is never below the window's, and about one place in six is counted. Partition
sketches are sparse; they meet by ranges of cells, and what remains is one bit per cell, "two or
more". It is folded to eight cells for each counted place, 2^29 cells at most, and broadcast: two rows of 64 MB or less.

Pass 2 reads the texts again, keeps only windows that the sketch estimates repeated, drops later ones
of a task at once, and groups the rest exactly by a 96-bit hash of their words, in shards of bounded
size, as many as the windows that the sketch lets through need. A sketch that is too full for its corpus only lets more of them through.

Defined results: a null text has no words; a null doc_id comes before all others; rows that repeat
doc_id and text are one document and get the same result each; of rows with equal doc_id and other
texts, the one with the smaller text hash is earlier; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import WordHashes, mixed, sequences
from .scratch import column, estimated_bytes, give_back, materialize, tidy

#: Cells of each of the sketch's two rows at most, as a power of two, and ranges of cells in which partition sketches meet.
SKETCH_BITS, RANGES = 29, 512
#: Estimated bytes of input whose partition sketches one task merges, about.
MERGED = 32 << 30
#: Bytes of the sketch that the driver counts together.
PIECE = 1 << 16
#: Places or windows that a task holds before it passes them on, and windows that an exact shard gets.
HELD, SHARD = 1_500_000, 1_500_000
_SALT = np.uint64(0x5851F42D4C957F2D)
_ROWS = np.uint64(0xD1B54A32D192ED03), np.uint64(0x94D049BB133111EB)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of every `width` consecutive values."""
    pick, span = (np.minimum, 1) if least else (np.maximum, 1)
    out = values
    while 2 * span <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(values) - width + 1], out[width - span :]) if span < width else out


def minimizers(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The least sub-window hash of each window, and the sub-window hashes at all places that are some window's least."""
    part = size // 2
    inner = sequences(words, part)
    width = size - part + 1
    least = _sliding(inner, width, True)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return least, inner[_sliding(padded, width, False) == inner]


def _cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell in each row. A minimizer is the least of several hashes, so its own high bits would crowd the low cells."""
    return tuple(((hashes * m) >> np.uint64(64 - bits)).astype(np.int64) for m in _ROWS)


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zlib.compress(values.astype(kind).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))


def _merged(batches: Iterator[pa.RecordBatch], size: int) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """Counts up to 2 of a range's cells, the cells of each part, and the sums of the parts' numbers."""
    seen, parts, sums = np.zeros(size, np.uint8), [], [0, 0]
    for batch in batches:
        sums = [a + sum(batch.column(c).to_pylist()) for a, c in zip(sums, ("windows", "places"), strict=True)]
        for cells, twice in zip(batch.column("cells"), batch.column("twice"), strict=True):
            if len(cells.as_py()):
                at = np.cumsum(_unpack(cells.as_py(), "<u4").astype(np.int64))
                more = 1 + np.unpackbits(_unpack(twice.as_py(), "u1"))[: len(at)]
                seen[at] = np.minimum(seen[at] + more, 2)
                parts.append(at)
    return seen, parts, sums


def _folded(marks: np.ndarray, bits: int, wanted: int) -> np.ndarray:
    """Marks of fewer cells: each is set if one of the cells that it stands for is."""
    if wanted >= bits:
        return marks
    if bits - wanted >= 3:
        return np.packbits(marks.reshape(-1, 1 << (bits - wanted - 3)).max(axis=1) > 0)
    return np.packbits(np.unpackbits(marks).reshape(-1, 1 << (bits - wanted)).max(axis=1))


def sketch(texts: DataFrame, size: int, bits: int) -> tuple[list[np.ndarray], int, int]:
    """For each row the bits of cells counted twice or more, the power of two of the cells, and how many windows will pass, about."""
    ranges = min(RANGES, 1 << max(bits - 3, 0))
    cells_per_range = (1 << bits) // ranges
    salts = -(-estimated_bytes(texts) // MERGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, windows, count = WordHashes(), [], 0, 0
        context = TaskContext.get()
        salt = context.partitionId() % salts if context else 0

        def emit() -> pa.RecordBatch:
            nonlocal held, windows, count
            rows = []
            places = np.concatenate([np.empty(0, np.uint64), *held])
            for row, cells in enumerate(_cells(places, bits)):
                cells, n = np.unique(cells, return_counts=True)
                cuts = np.searchsorted(cells, np.arange(ranges + 1) * cells_per_range)
                for r in range(ranges):
                    part = cells[cuts[r] : cuts[r + 1]] - r * cells_per_range
                    if len(part):
                        rows.append((row * ranges + r, salt, _pack(np.diff(part, prepend=0), "<u4"), _pack(np.packbits(n[cuts[r] : cuts[r + 1]] > 1), "u1"), 0, 0))
            if rows:
                rows[0] = (*rows[0][:4], windows, count)
            held, windows, count = [], 0, 0
            columns = zip(*rows, strict=True) if rows else [()] * len(_PARTS)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _PARTS, strict=True)], schema=_PARTS)

        for batch in batches:
            for text in batch.column("text"):
                words = text.as_py().split()
                if len(words) >= size:
                    held.append(minimizers(hashes.of(words), size)[1])
                    windows, count = windows + len(words) - size + 1, count + len(held[-1])
                    if count >= HELD:
                        yield emit()
        yield emit()

    def partial(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, _, sums = _merged(parts, cells_per_range)
        at = np.flatnonzero(seen)
        row = (key[0].as_py(), key[1].as_py(), _pack(np.diff(at, prepend=0), "<u4"), _pack(np.packbits(seen[at] > 1), "u1"), *sums)
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _PARTS, strict=True)], schema=_PARTS)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, sums = _merged(batches, cells_per_range)
        cells, repeated = (sum(int(f(p)) for p in parts) for f in (len, lambda p: (seen[p] > 1).sum()))
        row = (key[0].as_py(), _pack(np.packbits(seen > 1), "u1"), *sums, cells, repeated)
        yield pa.record_batch([pa.array([v]) for v in row], names=["range", "bits", "windows", "places", "cells", "repeated"])

    fields = "range int, salt int, cells binary, twice binary, windows long, places long"
    parts = texts.select("text").mapInArrow(tidy(run), fields)
    if salts > 1:
        parts = parts.groupBy("range", "salt").applyInArrow(partial, fields)
    merged = parts.groupBy("range").applyInArrow(merge, "range long, bits binary, windows long, places long, cells long, repeated long").toArrow()  # of fixed size
    total = {c: sum(merged[c].to_pylist()) for c in ("windows", "places", "cells", "repeated")}
    wanted = min(bits, max(ranges.bit_length() + 2, (8 * total["places"]).bit_length()))
    rows, size_each = [np.zeros((1 << wanted) // 8, np.uint8) for _ in range(2)], (1 << wanted) // ranges // 8
    for r, data in zip(merged["range"].to_pylist(), merged["bits"], strict=True):  # folded range by range: the whole sketch is never unpacked
        low = r % ranges * size_each
        rows[r // ranges][low : low + size_each] = _folded(_unpack(data.as_py(), "u1"), bits, wanted)
    by_chance = float(np.prod([sum(int(np.bitwise_count(m[i : i + PIECE]).sum()) for i in range(0, len(m), PIECE)) / (1 << wanted) for m in rows]))
    share = total["repeated"] / max(total["cells"], 1) + by_chance
    return rows, wanted, int(total["windows"] * min(share, 1.0))


def _earliest(doc: np.ndarray, start: np.ndarray, key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Marks the entries that come first of those with equal key and check; doc is in the documents' order."""
    order = np.lexsort((start, doc, check, key))
    k, c = key[order], check[order]
    first = np.ones(len(order), bool)
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    out = np.empty(len(order), bool)
    out[order] = first
    return out


_PARTS = pa.schema([("range", pa.int32()), ("salt", pa.int32()), ("cells", pa.binary()), ("twice", pa.binary()), ("windows", pa.int64()), ("places", pa.int64())])
_PLACES = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
_LEAST = np.iinfo(np.int64).min


def _framed(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unframed(data: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return parts


def _by_bucket(ids: np.ndarray, texts: np.ndarray, doc: np.ndarray, start: np.ndarray, buckets: int) -> dict[str, list]:
    """One row for each bucket of documents: starts of windows, with their documents. ids and texts are by doc."""
    own, doc = np.unique(doc, return_inverse=True)
    ids, texts = ids[own], texts[own]
    bucket = (mixed(ids.view(np.uint64), texts.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start, doc, bucket[doc]))
    doc, start = doc[order], start[order]
    cuts = np.flatnonzero(np.diff(bucket[doc], prepend=-1, append=-1)) if len(doc) else np.zeros(1, np.int64)
    rows = {"bucket": bucket[doc[cuts[:-1]]].tolist(), "data": []}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
        rows["data"].append(_framed([ids[doc[a:b][first]].tobytes(), texts[doc[a:b][first]].tobytes(), _pack(np.diff(first, append=b - a), "<u4"), _pack(np.diff(start[a:b], prepend=0), "<i4")]))
    return rows


def _collected(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a bucket."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for data in batch.column("data"):
            ids, texts, counts, starts = _unframed(data.as_py())
            counts = _unpack(counts, "<u4")
            for p, v in zip(parts, (np.repeat(np.frombuffer(ids, np.int64), counts), np.repeat(np.frombuffer(texts, np.int64), counts), np.cumsum(_unpack(starts, "<i4").astype(np.int64))), strict=True):
                p.append(v)
    ids, texts, start = map(np.concatenate, parts)
    order = np.lexsort((start, texts, ids))
    ids, texts, start = ids[order], texts[order], start[order].astype("<u4")
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])
    cuts = np.append(np.flatnonzero(new), len(ids))
    of = ids[cuts[:-1]]
    yield pa.record_batch([pa.array(of, pa.int64(), mask=of == _LEAST), pa.array(texts[cuts[:-1]]), pa.array([start[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["doc_id", "text_hash", "places"])


def repeated(docs: DataFrame, size: int = 20, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, text_hash, places: starts (little-endian unsigned 32-bit) of the document's windows that also start earlier."""
    texts = _texts(docs)
    spark = docs.sparkSession
    marks, bits, windows = sketch(texts, size, sketch_bits)
    shards = max(8, -(-windows // SHARD))
    shared = spark.sparkContext.broadcast(marks)
    del marks  # the broadcast has its own copy on disk
    give_back()

    def passing(places: np.ndarray) -> np.ndarray:
        ok = np.ones(len(places), bool)
        for marks, cell in zip(shared.value, _cells(places, bits), strict=True):
            ok &= (marks[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, count = WordHashes(), [], 0

        def emit() -> pa.RecordBatch:
            nonlocal held, count
            held.sort(key=lambda x: x[:2])
            ids, of_text = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
            same = np.ones(len(held), bool)
            same[1:] = (ids[1:] != ids[:-1]) | (of_text[1:] != of_text[:-1])
            held = [x for x, keep in zip(held, same.tolist(), strict=True) if keep]  # a repeated row is the same document
            ids, of_text = ids[same], of_text[same]
            start, key, check = (np.concatenate([np.empty(0, np.uint64), *(x[i] for x in held)]).astype(t) for i, t in ((2, np.uint32), (3, np.uint64), (4, np.uint32)))
            doc = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x[2]) for x in held])
            first = _earliest(doc, start, key, check)
            rows = _by_bucket(ids, of_text, doc[~first], start[~first], shards)
            rows["shard"] = [-1] * len(rows["bucket"])
            doc, start, key, check = doc[first], start[first], key[first], check[first]
            shard = (key % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in range(shards):
                if (at := order[cuts[s] : cuts[s + 1]]).size:
                    own, local = np.unique(doc[at], return_inverse=True)
                    rows["shard"].append(s)
                    rows["bucket"].append(None)
                    rows["data"].append(_framed([_pack(start[at], "<u4"), _pack(local, "<u4"), key[at].tobytes(), check[at].tobytes(), ids[own].tobytes(), of_text[own].tobytes()]))
            held, count = [], 0
            return pa.record_batch([pa.array(rows[f.name], f.type) for f in _PLACES], schema=_PLACES)

        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.as_py().split()
                if len(words) < size:
                    continue
                h = hashes.of(words)
                start = np.flatnonzero(passing(minimizers(h, size)[0]))
                if len(start):
                    held.append((_LEAST if doc_id is None else doc_id, text_hash, start.astype(np.uint32), sequences(h, size)[start], (sequences(h, size, _SALT)[start] >> np.uint64(32)).astype(np.uint32)))
                    count += len(start)
                    if count >= HELD:
                        yield emit()
        yield emit()

    found = materialize(texts.mapInArrow(tidy(run), "shard int, bucket int, data binary"), "windows")

    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(5)]
        for batch in batches:
            for data in batch.column("data"):
                starts, local, keys, checks, ids, of_text = _unframed(data.as_py())
                local = _unpack(local, "<u4")
                values = (_unpack(starts, "<u4"), np.frombuffer(keys, np.uint64), np.frombuffer(checks, np.uint32), np.frombuffer(ids, np.int64)[local], np.frombuffer(of_text, np.int64)[local])
                for p, v in zip(parts, values, strict=True):
                    p.append(v)
        start, hashed, check, ids, of_text = map(np.concatenate, parts)
        order = np.lexsort((of_text, ids))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(ids[order]) != 0) | (np.diff(of_text[order]) != 0)
        doc = np.empty(len(order), np.int64)
        doc[order] = np.cumsum(new) - 1
        own = order[new]
        # rows of one document can be in several tasks if the row is repeated: equal places are one place
        later = ~_earliest(doc, start, hashed, check)
        first = np.lexsort((start, doc, check, hashed))
        lead = np.maximum.accumulate(np.where(later[first], 0, np.arange(len(first))))
        same = (doc[first] == doc[first][lead]) & (start[first] == start[first][lead])
        later[first[same]] = False
        rows = _by_bucket(ids[own], of_text[own], doc[later], start[later], shards)
        yield pa.record_batch([pa.array(rows["bucket"], pa.int32()), pa.array(rows["data"], pa.binary())], names=["bucket", "data"])

    exact = found.where("shard >= 0").select("shard", "data").groupBy("shard").applyInArrow(group, "bucket int, data binary")
    return found.where("shard < 0").select("bucket", "data").unionByName(exact).groupBy("bucket").applyInArrow(_collected, "doc_id long, text_hash long, places binary")


def covered(words: int, places: bytes, size: int) -> np.ndarray:
    """Marks the words under windows that start at the places."""
    edge = np.zeros(words + 1, np.int64)
    at = np.frombuffer(places, "<u4").astype(np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeated(docs: DataFrame, size: int = 20, sketch_bits: int = SKETCH_BITS, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), and the named columns of docs as c0, c1 and so on."""
    places = repeated(docs, size, sketch_bits)
    named = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), *(column(c).alias(f"c{i}") for i, c in enumerate(columns)))
    left = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(f"c{i}" for i in range(len(columns)))).withColumn("text_hash", F.xxhash64("text"))
    right = places.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "places")
    both = left.join(right, left["doc_id"].eqNullSafe(right["id"]) & (left["text_hash"] == right["hash"]), "left")
    extra = [f"c{i}" for i in range(len(columns))]
    schema = named.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept"), *extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                words = text.as_py().split()
                n.append(len(words))
                if places.is_valid:
                    gone = covered(len(words), places.as_py(), size)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *(batch.column(c) for c in extra)], names=schema.names)

    return both.select("doc_id", F.col("text").cast("binary").alias("text"), "places", *extra).mapInArrow(tidy(run), schema)


def dedup_documents(docs: DataFrame, size: int = 20) -> DataFrame:
    """docs with repeated passages removed from text; texts from which nothing goes stay as they are, n_chars follows the text."""
    columns = docs.columns
    done = remove_repeated(docs, size, columns=tuple(columns))
    place = {c: f"c{i}" for i, c in enumerate(columns)}
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col(place["text"]))}
    if "n_chars" in columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col(place["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return done.select(*(new.get(c, F.col(place[c])).alias(c) for c in columns))
