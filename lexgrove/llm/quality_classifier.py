"""Quality classifier: naive Bayes support vectors over byte n-grams.

Texts become indicators of hashed byte n-grams (1 to 4 bytes) and of runs of repeated words, scaled by the classes' log-count
ratios and brought to length 1. A linear hinge-loss model is fitted by dual coordinate descent to at
most `max_rows` labelled rows, the ones with the smallest hashes of doc_id, and at most `max_bytes` of
their n-grams, which bounds what the driver holds; a logistic curve through margins of rows left out of the fit turns margins to scores.

Defined results: a null text is an empty one, whose score follows from the intercept alone; labels
with a null doc_id or label are left out, of repeated labels the smallest counts, of texts with one labelled doc_id the one whose n-grams are least in bytes; with labels of one
class only every score is that class, without labels 0.5; repeated rows are scored each; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import WordHashes
from .scratch import column, give_back, materialize, tidy

BITS = 18
LENGTHS = (1, 2, 3, 4)
FOLDS = 5


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Indicators:
    """Sorted numbers of the n-grams that a text has: of its bytes, and of which words repeat the one before."""

    def __init__(self):
        self.seen, self.words = np.zeros(1 << BITS, bool), WordHashes()

    def __call__(self, text: bytes) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        data, seen = np.frombuffer(text, np.uint8).astype(np.uint32), self.seen
        code = np.zeros(len(data), np.uint32)
        for k in range(max(LENGTHS)):
            code = (code[: len(data) - k] << np.uint32(8)) | data[k:] if k else data
            if k + 1 in LENGTHS:
                seen[((code + np.uint32(k * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
        words = self.words.of(text.split())
        same, code = (words[1:] == words[:-1]).astype(np.uint32), np.uint32(1)
        span = max(0, len(same) - max(LENGTHS) + 1)
        for k in range(max(LENGTHS)):  # n-grams over "equal to the word before" and "not equal"
            code = code * np.uint32(2) + same[k : k + span]
        seen[(code + np.uint32(0x3A7F)) & np.uint32((1 << BITS) - 1)] = True
        found = np.flatnonzero(seen).astype(np.uint32)
        seen[found] = False
        return found


@dataclass
class Model:
    """weights already hold the log-count ratios; margin = intercept + sum of weights over found n-grams / norm."""

    weights: np.ndarray
    squares: np.ndarray
    intercept: float
    slope: float
    offset: float
    constant: float | None = None

    def margin(self, found: np.ndarray) -> float:
        norm = float(np.sqrt(self.squares[found].sum(dtype=np.float64)))
        return self.intercept + float(self.weights[found].sum(dtype=np.float64)) / (norm or 1.0)

    def score(self, found: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


def _descend(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the intercept is a feature of value 1. Values are made anew at each visit: all of them would take twice the memory of the rows."""
    norm = np.array([np.sqrt((ratios[r] ** 2).sum()) or 1.0 for r in rows])
    square = np.array([((ratios[r] / n) ** 2).sum() + 1.0 for r, n in zip(rows, norm, strict=True)])
    w, intercept, alpha, order = np.zeros(1 << BITS), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            v = ratios[r] / norm[i]
            gradient = y[i] * (v @ w[r] + intercept) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[r] += step * v
                intercept += step
                alpha[i] = new
                moved = max(moved, abs(step) * square[i])
        if moved < 1e-3:
            break
    return w, intercept


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 12) -> Model:
    """rows: n-grams of each text; labels: 0 or 1."""
    nothing = np.zeros(1 << BITS, np.float32)
    if len(labels) < 4 or len(set(labels.tolist())) < 2:
        return Model(nothing, nothing, 0.0, 1.0, 0.0, float(labels.mean()) if len(labels) else 0.5)
    y = np.where(labels == 1, 1.0, -1.0)

    def solved(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        counts = np.ones((2, 1 << BITS))
        for i in use:
            counts[int(labels[i]), rows[i]] += 1
        ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        share = labels[use].mean()
        each = np.where(labels[use] == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) * cost
        w, b = _descend([rows[i] for i in use], y[use], ratios, each, rounds, 0)
        return ratios, w, b

    every, margins = np.arange(len(y)), np.zeros(len(y))
    for fold in range(2):  # margins of rows that the fit hasn't seen
        ratios, w, b = solved(every[every % 2 != fold])
        for i in every[every % 2 == fold]:
            x = ratios[rows[i]]
            margins[i] = b + float(x @ w[rows[i]]) / (np.sqrt((x * x).sum()) or 1.0)
    slope, offset = _logistic(margins, labels)
    ratios, w, b = solved(every)
    return Model((ratios * w).astype(np.float32), (ratios * ratios).astype(np.float32), b, slope, offset)


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with Platt's smoothed targets, by damped Newton steps."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        theta = theta - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000, max_bytes: int = 256 << 20) -> Model:
    """Fit to at most max_rows labelled rows that aren't held out, and to no more of them than max_bytes of n-grams; of rows with one doc_id, one."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for batch in batches:
            found = [indicators(t.as_py() or b"").tobytes() for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "y", "found"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = texts.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text").mapInArrow(tidy(run), "doc_id long, y int, found binary")  # known has max_rows rows at most
    rows = materialize(found.groupBy("doc_id", "y").agg(F.min("found").alias("found")), "labelled")
    sizes = sorted((r["h"], r["doc_id"], r["n"]) for r in rows.select("doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("found").alias("n")).collect())  # max_rows rows at most
    fits = np.cumsum([n for *_, n in sizes]) <= max_bytes
    use = [i for (_, i, _), ok in zip(sizes, fits, strict=True) if ok]
    own = rows.where(F.col("doc_id").isin(use)).toArrow() if len(use) < len(sizes) else rows.toArrow()
    order = np.argsort(own["doc_id"].to_numpy())
    grams, y = [np.frombuffer(own["found"][int(i)].as_buffer(), np.uint32) for i in order], own["y"].to_numpy()[order].astype(np.int64)  # no copies
    model = fit(grams, y)
    del own, grams
    give_back()
    return model


def score(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """The columns, then score: the probability-like value of label 1, from the text alone. A text among the columns goes to Python once."""
    schema = docs.select(*columns).schema.add("score", "double")
    once = text in columns and schema[text].dataType.typeName() in ("string", "binary")
    at = columns.index(text) if once else len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for batch in batches:
            scores = [model.score(indicators(t.as_py() or b"")) for t in batch.column(at).cast(pa.binary())]
            yield pa.record_batch([*batch.columns[: len(columns)], pa.array(scores, pa.float64())], names=schema.names)

    given = docs.select(*columns) if once else docs.select(*columns, F.col(text).cast("string").cast("binary").alias("_input"))
    return given.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, max_rows=max_rows), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 4000) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    columns = docs.columns
    renamed = docs.select(*(column(c).alias(f"c{i}") for i, c in enumerate(columns)))
    text = next(f"c{i}" for i, c in enumerate(columns) if c.lower() == "text")
    scored = score(renamed, train(docs, labels, max_rows=max_rows), [f"c{i}" for i in range(len(columns))], text)
    return scored.where(F.col("score") >= threshold).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
