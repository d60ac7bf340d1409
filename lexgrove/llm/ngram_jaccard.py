"""N-gram Jaccard join by vertical partitioning.

All word n-grams have one global order, rare ones first, by a bounded count sketch and then by hash.
Cut into fragments, the order cuts every document's set; pairs of candidates get the overlap of each
fragment counted apart, and the sum over fragments decides the pair exactly.

Copies with equal sets are one class first. Two linked sets share one of their rarest n-grams, so
classes meet in buckets of equal rare n-grams. N-grams that no other set has come first in the order and can't be
in an overlap, so places in the order rule out most of those that only share a template. A bucket's classes are first paired with its hub alone,
the class whose rare n-grams are the most shared, and the hub leaves the bucket; while the links leave many pairs between components, more rounds
follow with other hubs, as long as they take enough of these pairs away. What remains in several components is
paired in a last round, within bands of size. Pairs whose signatures, the parities of their n-grams in 1024 cells,
differ in more bits than linked sets may differ in n-grams are never linked and go before texts are read. So a large group of near copies costs about as many pairs as it has members,
and no link between components is lost.

Defined results: a null or blank text has an empty set and is linked with nothing, itself its
component; a text with fewer words than an n-gram has its whole sequence as one; a null doc_id counts
as smaller than all others and is given back as null; repeated rows are one class; an empty table
gives no rows. Only A-Z are lower-cased; words are runs of characters that aren't ASCII white space.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import WordHashes, mixed, sequences
from .scratch import estimated_bytes, give_back, materialize, stored, tidy

#: Cells of the count sketch at most, as a power of two, and ranges of them: one byte of each cell is broadcast, 16 MB at most, as the driver holds a few copies.
ORDER_BITS, RANGES = 24, 512
#: Estimated bytes of input whose counts one task merges, about.
MERGED = 32 << 30
#: Pairs between components for each row that are left to the last round.
LEFT_PAIRS = 8
#: Bits of a table of ids or n-grams that is broadcast, at most, as a power of two: 8 MB.
ID_BITS = 26
#: Words of 64 bits in a signature.
SIGNATURE = 16
#: Cells that the driver looks at together.
PIECE = 1 << 16
#: n-grams that a task counts before it passes the counts on.
HELD = 1_000_000
FRAGMENTS = 4
NO_ID = np.iinfo(np.int64).min
_FIRST, _SECOND = np.array([0x2545F4914F6CDD1D], np.uint64), np.array([0x9FB21C651E98DF25], np.uint64)


def _hashes(text: bytes, size: int, words: WordHashes) -> np.ndarray:
    """The distinct n-grams of a text."""
    h = words.of(text.lower().split())
    if 0 < len(h) < size:
        return sequences(h, len(h))
    return np.unique(sequences(h, size))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u4").tobytes(), 1)


def _unpacked(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data.as_py()), "<u4")


def frequency_classes(texts: DataFrame, size: int, bits: int = ORDER_BITS) -> tuple[np.ndarray, int]:
    """By cell of the hash the number of binary digits of its count, for as many cells as there are n-grams, 2^bits at most; and their power of two."""
    ranges = min(RANGES, 1 << bits)
    per_range = (1 << bits) // ranges
    salts = -(-estimated_bytes(texts) // MERGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, count = WordHashes(), [], 0
        context = TaskContext.get()
        salt = context.partitionId() % salts if context else 0

        def emit() -> pa.RecordBatch:
            nonlocal held, count
            joined = np.concatenate([np.empty(0, np.uint64), *held])
            held, count = [], 0
            joined >>= np.uint64(64 - bits)
            cells, n = np.unique(joined.view(np.int64), return_counts=True)
            cuts = np.searchsorted(cells, np.arange(ranges + 1) * per_range)
            parts = [(r, slice(a, b)) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            columns = [pa.array([r for r, _ in parts], pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([_packed(np.diff(cells[p] - r * per_range, prepend=0)) for r, p in parts], pa.binary()), pa.array([_packed(n[p]) for _, p in parts], pa.binary())]
            return pa.record_batch(columns, names=["range", "salt", "cells", "counts"])

        for batch in batches:
            for text in batch.column(0):
                held.append(_hashes(text.as_py(), size, words))
                count += len(held[-1])
                if count >= HELD:
                    yield emit()
        if held:
            yield emit()

    def summed(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(per_range, np.float64)
        for batch in batches:
            for cells, counts in zip(batch.column("cells"), batch.column("counts"), strict=True):
                total[np.cumsum(_unpacked(cells).astype(np.int64))] += _unpacked(counts)
        return total

    def partial(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = summed(batches)
        at = np.flatnonzero(total)
        row = (_packed(np.diff(at, prepend=0)), _packed(np.minimum(total[at], 2**32 - 1)))
        yield pa.record_batch([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([v], pa.binary()) for v in row], names=["range", "salt", "cells", "counts"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = summed(batches)
        digits = np.frexp(total)[1].astype(np.uint8)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(digits.tobytes(), 1)], pa.binary()), pa.array([float(total.sum())])], names=["range", "digits", "total"])

    fields = "range int, salt int, cells binary, counts binary"
    parts = texts.select("text").mapInArrow(tidy(run), fields)
    if salts > 1:
        parts = parts.groupBy("range", "salt").applyInArrow(partial, fields)
    classes, grams = np.zeros(1 << bits, np.uint8), 0.0
    merged = parts.groupBy("range").applyInArrow(merge, "range int, digits binary, total double").toArrow()  # of fixed size
    for r, digits, total in zip(merged["range"].to_pylist(), merged["digits"], merged["total"].to_pylist(), strict=True):
        classes[r * per_range : (r + 1) * per_range] = np.frombuffer(zlib.decompress(digits.as_py()), np.uint8)
        grams += total
    wanted = min(bits, max(int(grams).bit_length(), 8))
    return classes if wanted == bits else classes.reshape(1 << wanted, -1).max(axis=1), wanted


class _Order:
    """Places of n-grams in the global order: 6 bits of frequency, then 58 bits of hash; and the cuts between fragments."""

    def __init__(self, classes: np.ndarray, bits: int):
        self.classes, self.bits = classes, bits
        cells = sum(np.bincount(classes[i : i + PIECE], minlength=64) for i in range(0, len(classes), PIECE))  # of all at once it makes 8 bytes a cell
        weight = cells * np.exp2(np.arange(64) - 1.0)  # n-grams by class, about
        reach = np.cumsum(weight) / max(weight.sum(), 1.0)
        self.cuts = []
        for f in range(1, FRAGMENTS):
            c = int(np.searchsorted(reach, f / FRAGMENTS))
            low = reach[c - 1] if c else 0.0
            inside = (f / FRAGMENTS - low) / max(reach[c] - low, 1e-12)
            self.cuts.append((c << 58) + int(min(max(inside, 0.0), 0.999999) * (1 << 58)))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        c = self.classes[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.uint64)
        return np.sort((c << np.uint64(58)) | (hashes & np.uint64((1 << 58) - 1)))

    def fragments(self, places: np.ndarray) -> list[np.ndarray]:
        return np.split(places, np.searchsorted(places, np.array(self.cuts, np.uint64)))


def _print(places: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of the set."""
    return tuple(int(mixed(places, salt, salt[0]).sum(dtype=np.uint64).view(np.int64)) for salt in (_FIRST, _SECOND))


def _signature(places: np.ndarray) -> np.ndarray:
    """For each of the cells of the hash, whether it has an odd number of the n-grams: two of these differ in at most as many bits as the sets in n-grams."""
    odd = np.bincount((places & np.uint64(64 * SIGNATURE - 1)).astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sets(texts: DataFrame, size: int, percent: int, order) -> DataFrame:
    """id, text_hash, n, fp, fp2, prefix: the rarest n-grams, one of which any linked set shares; signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place = WordHashes(), order.value
        for batch in batches:
            n, fp, fp2, prefix, signature = [], [], [], [], []
            for text in batch.column("text"):
                places = place(_hashes(text.as_py(), size, words))
                a, b = _print(places)
                n.append(len(places))
                fp.append(a)
                fp2.append(b)
                prefix.append(places[: len(places) + (-percent * len(places)) // 100 + 1].view(np.int64) if len(places) else places.view(np.int64))
                signature.append(_signature(places))
            columns = [pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(fp2, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(signature, pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column("id"), batch.column("text_hash"), *columns], names=["id", "text_hash", "n", "fp", "fp2", "prefix", "signature"])

    return texts.mapInArrow(tidy(run), "id long, text_hash long, n long, fp long, fp2 long, prefix array<long>, signature array<long>")


def _least(percent: int, n1: Column, n2: Column) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil(percent * (n1 + n2) / (100 + percent) - 1e-9)


def _alike(percent: int, n1: Column, n2: Column, bits: list[tuple[Column, Column]]) -> Column:
    """Sets of these sizes whose signatures, or foldings of them, have these words can be linked."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in bits), F.lit(0)) <= n1 + n2 - 2 * _least(percent, n1, n2)


def _possible(percent: int, n1: Column, n2: Column, at1: Column, at2: Column) -> Column:
    """Sets of these sizes whose first common n-gram has these places can be linked."""
    least = _least(percent, n1, n2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - at1, n2 - at2) >= least)


def _near(bucketed: DataFrame, percent: int) -> DataFrame:
    """The rows of buckets without those whose bucket has no other set of a size that they can be linked with."""
    by_size = Window.partitionBy("gram").orderBy("n", "k")
    most = F.least(100 * F.col("n") / percent, (100 + percent) * (F.col("n") - F.col("at")) / percent - F.col("n")) + 1e-6
    below, above = 100 * F.col("_below") >= percent * F.col("n"), F.col("_above") <= most
    sized = bucketed.withColumns({"_below": F.lag("n").over(by_size), "_above": F.lead("n").over(by_size)})
    return sized.where(F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))).drop("_below", "_above")


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is one of the ids, and few others: the bits of hashed ids are broadcast, so that other rows aren't exchanged."""
    bits = 1 << min(ID_BITS, max((128 * ids.count()).bit_length(), 15))
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    maps = ids.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))
    found = rows.withColumn("_bit", bit).withColumn("_bucket", F.bitmap_bucket_number("_bit")).withColumn("_at", F.bitmap_bit_position("_bit")).join(F.broadcast(maps), "_bucket")
    byte = F.expr("cast(conv(hex(substring(_map, cast(_at div 8 as int) + 1, 1)), 16, 10) as int)")
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0).select(*rows.columns)


def _exploded(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """k, n, at, gram of the shared n-grams of prefixes, and few others: their bits are looked up before rows are made of the others."""
    size = 1 << min(ID_BITS, max((64 * shared.count()).bit_length(), 15))
    place = F.pmod("gram", F.lit(size)) + 1
    maps = shared.select(place.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("map")).toArrow()  # 8 MB at most
    table = np.zeros((size >> 15, 4096), np.uint8)
    for bucket, map_ in zip(maps["bucket"].to_pylist(), maps["map"], strict=True):
        table[bucket - 1] = np.frombuffer(map_.as_py(), np.uint8)
    known = classes.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in batches:
            prefix = batch.column("prefix")
            lengths = prefix.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            grams, row = prefix.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lengths)), lengths)
            bit = grams & (size - 1)
            use = np.flatnonzero((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            at = use - (np.cumsum(lengths) - lengths)[row[use]]
            taken = [batch.column(c).take(pa.array(row[use])) for c in ("id", "fp", "n")]
            yield pa.record_batch([*taken, pa.array(at, pa.int32()), pa.array(grams[use], pa.int64())], names=["id", "fp", "n", "at", "gram"])

    found = classes.select("k.id", "k.fp", "n", "prefix").mapInArrow(tidy(run), "id long, fp long, n long, at int, gram long")
    return found.select(F.struct("id", "fp").alias("k"), "n", "at", "gram")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller class first."""
    first = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return pairs.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("na", "nb").alias("na"), pick("nb", "na").alias("nb")).distinct()


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int, order) -> DataFrame:
    """The pairs whose summed overlap is enough. pairs: a stored table."""
    involved = materialize(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct().select(F.col("k.id").alias("id"), F.col("k.fp").alias("wanted")), "involved")
    rows = _among(texts, involved).join(involved.hint("merge"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place = WordHashes(), order.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for id_, wanted, text in zip(batch.column("id").to_pylist(), batch.column("wanted").to_pylist(), batch.column("text"), strict=True):
                places = place(_hashes(text.as_py(), size, words))
                if _print(places)[0] == wanted:
                    for f, part in enumerate(place.fragments(places)):
                        if len(part):
                            for column, value in zip(out, (id_, wanted, f, part.view(np.int64)), strict=True):
                                column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["id", "fp", "f", "grams"])

    parts = rows.select("id", "wanted", "text").mapInArrow(tidy(run), "id long, fp long, f int, grams array<long>")
    parts = materialize(parts.select(F.struct("id", "fp").alias("k"), "f", "grams"), "fragments")
    each = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("f"))
    left = parts.select(F.col("k").alias("a"), "f", F.col("grams").alias("left"))
    right = parts.select(F.col("k").alias("b"), "f", F.col("grams").alias("right"))
    both = each.join(left.hint("merge"), ["a", "f"]).join(right.hint("merge"), ["b", "f"])
    overlap = both.select("a", "b", "na", "nb", "f", F.size(F.array_intersect("left", "right")).alias("o")).distinct()
    summed = overlap.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return summed.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """k, label: the least node that each node of a link reaches. links: a stored table of a, b."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("k").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("k")).agg(F.min("label").alias("near"))
        lower = materialize(labels.join(near, "k").select("k", "label", F.least("label", "near").alias("lower")), "lower")
        jump = lower.select(F.col("k").alias("lower"), F.col("lower").alias("next"))
        moved = materialize(lower.join(jump.hint("merge"), "lower", "left").select("k", "label", F.least("lower", "next").alias("new")), "moved")
        labels = moved.select("k", F.col("new").alias("label"))
        if not moved.where(F.col("new") != F.col("label")).limit(1).count():
            return labels


def link_documents(docs: DataFrame, size: int = 5, percent: int = 80, order_bits: int = ORDER_BITS) -> DataFrame:
    """id, text_hash, n, k, label: of each row its set's size, its class and the least class of its component; classes are (id, fp), the smallest id of equal sets."""
    spark = docs.sparkSession
    texts = _texts(docs)
    order = spark.sparkContext.broadcast(_Order(*frequency_classes(texts, size, order_bits)))
    give_back()
    sets = materialize(_sets(texts, size, percent, order), "sets")
    classes = sets.where("n > 0").groupBy("fp", "fp2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("signature").alias("signature"))
    classes = materialize(classes.select("fp", "fp2", F.struct("id", "fp").alias("k"), "n", "prefix", "signature"), "classes")

    grams = classes.select(F.explode("prefix").alias("gram"))
    shared = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    bucketed = materialize(_near(_exploded(classes, shared).join(shared.hint("merge"), "gram"), percent), "bucketed")
    weight = materialize(bucketed.groupBy("k").agg((F.sum("m") / F.first("n")).alias("weight")), "weight")
    signatures = materialize(classes.select("k", "signature").join(weight.select("k").hint("merge"), "k"), "signatures")
    weighted = materialize(bucketed.drop("m").join(weight.hint("merge"), "k"), "weighted")

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs whose signatures let them be linked."""
        for side in ("a", "b"):
            pairs = pairs.join(signatures.select(F.col("k").alias(side), F.col("signature").alias(f"s{side}")).hint("merge"), side)
        bits = [(F.col("sa")[i], F.col("sb")[i]) for i in range(SIGNATURE)]
        return pairs.where(_alike(percent, F.col("na"), F.col("nb"), bits)).select("a", "b", "na", "nb")

    in_bucket = Window.partitionBy("gram")

    def with_hubs(rows: DataFrame, by: Column) -> DataFrame:
        """The rows of buckets with the bucket's hub, the greatest by the order."""
        hub = F.max(F.struct(by.alias("by"), "k", "n", "at", "label")).over(in_bucket)
        return materialize(rows.withColumns({"hub": hub, "m": F.count(F.lit(1)).over(in_bucket)}).withColumn("hub", F.col("hub").dropFields("by")), "hubs")

    def pairs_of(hubs: DataFrame) -> DataFrame:
        """Pairs of each bucket's classes with its hub."""
        possible = (F.col("label") != F.col("hub.label")) & _possible(percent, F.col("n"), F.col("hub.n"), F.col("at"), F.col("hub.at"))
        pairs = hubs.where(possible).select(F.col("k").alias("a"), F.col("hub.k").alias("b"), F.col("n").alias("na"), F.col("hub.n").alias("nb"))
        return alike(_ordered(pairs))

    def still_open(hubs: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of buckets whose classes are in several components, without the hubs, whose pairs are done."""
        left = hubs.where((F.col("m") > 2) & (F.col("k") != F.col("hub.k"))).select("k", "n", "at", "gram")
        labelled = left.join(labels.hint("merge"), "k", "left").select("k", "n", "at", "gram", F.coalesce("label", "k").alias("label"))
        several = labelled.withColumns({"low": F.min("label").over(in_bucket), "high": F.max("label").over(in_bucket)}).where("low != high")
        return materialize(several.drop("low", "high"), "open")

    def left_over(rows: DataFrame) -> tuple[float, float]:
        """Rows, and pairs of them between components."""
        of = rows.groupBy("gram", "label").agg(F.count(F.lit(1)).cast("double").alias("m")).groupBy("gram").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same"))
        found = of.agg(F.sum("m").alias("rows"), (F.sum(F.col("m") * F.col("m") - F.col("same")) / 2).alias("pairs")).first()
        return found["rows"] or 0.0, found["pairs"] or 0.0

    hubs = with_hubs(weighted.withColumn("label", F.col("k")), F.col("weight"))
    tried = materialize(pairs_of(hubs), "pairs")
    links, _ = stored(lambda: _linked(tried, texts, size, percent, order), "links")
    labels, _ = stored(lambda: components(links), "labels")
    open_ = still_open(hubs, labels)
    rows, pairs = left_over(open_)
    before, turn = math.inf, 0
    while pairs > LEFT_PAIRS * rows and pairs <= 0.75 * before:
        before, turn = pairs, turn + 1
        hubs = with_hubs(open_, F.xxhash64("k", F.lit(turn)))
        more = materialize(pairs_of(hubs).join(tried.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "pairs")
        links, _ = stored(lambda: links.unionByName(_linked(more, texts, size, percent, order)), "links")  # noqa: B023
        tried = materialize(tried.unionByName(more), "tried")
        labels, _ = stored(lambda: components(links), "labels")
        open_ = still_open(hubs, labels)
        rows, pairs = left_over(open_)

    # sizes of linked sets differ by less than one band; the first of a pair is the smaller, signatures are folded to one word
    folded = signatures.select("k", reduce(Column.bitwiseXOR, [F.col("signature")[i] for i in range(SIGNATURE)]).alias("bits"))
    open_ = materialize(open_.join(folded.hint("merge"), "k"), "open")
    band = F.floor(F.log(F.col("n")) / max(1.0001 * math.log(100 / percent), 1e-3)).cast("int")
    x = open_.select("gram", band.alias("band"), F.col("k").alias("a"), F.col("n").alias("na"), F.col("at").alias("at_a"), F.col("label").alias("la"), F.col("bits").alias("sa"))
    y = open_.select("gram", F.explode(F.array(band - 1, band)).alias("band"), F.col("k").alias("b"), F.col("n").alias("nb"), F.col("at").alias("at_b"), F.col("label").alias("lb"), F.col("bits").alias("sb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    possible = _alike(percent, F.col("na"), F.col("nb"), [(F.col("sa"), F.col("sb"))]) & _possible(percent, F.col("na"), F.col("nb"), F.col("at_a"), F.col("at_b"))
    rest = alike(_ordered(x.join(y.hint("merge"), ["gram", "band"]).where(smaller & (F.col("la") != F.col("lb")) & possible)))
    last = materialize(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if last.limit(1).count():
        links, _ = stored(lambda: links.unionByName(_linked(last, texts, size, percent, order)), "links")
        labels, _ = stored(lambda: components(links), "labels")

    of_set = classes.select("fp", "fp2", "k").join(labels.hint("merge"), "k", "left").select("fp", "fp2", "k", F.coalesce("label", "k").alias("label"))
    return sets.select("id", "text_hash", "n", "fp", "fp2").join(materialize(of_set, "labels").hint("merge"), ["fp", "fp2"], "left").select("id", "text_hash", "n", "k", "label")


def join_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    known = lambda c: F.when(c != NO_ID, c)
    linked = link_documents(docs, size, percent)
    component = F.when(F.col("n") > 0, F.col("label.id")).otherwise(F.col("id"))
    return linked.select(known(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(component).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of linked ones, the one with the smallest doc_id; blank texts all stay."""
    columns = docs.columns
    linked = link_documents(docs, size, percent)
    kept = linked.where((F.col("n") > 0) & (F.col("k") == F.col("label")) & (F.col("id") == F.col("k.id"))).groupBy("k").agg(F.min("id").alias("_id"), F.min("text_hash").alias("_hash")).select("_id", "_hash")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_hash"), F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")).alias("_words"))
    filled = named.where("_words").join(materialize(kept, "kept").hint("merge"), ["_id", "_hash"]).dropDuplicates(["_id", "_hash"])
    return filled.select("_row").unionByName(named.where(~F.col("_words")).select("_row")).select(*(F.col("_row")[c].alias(c) for c in columns))
