"""Model-based scores behind a replaceable interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

Scorer = Callable[[list[tuple[str, str]]], list[float]]


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """0 to 30 by the share of common words: the default, without a model."""
    out = []
    for a, b in pairs:
        x, y = set((a or "").lower().split()), set((b or "").lower().split())
        out.append(round(30 * len(x & y) / len(x | y), 6) if x | y else 0.0)
    return out


def score_pairs(pairs: DataFrame, left: str, right: str, scorer: Scorer = overlap_scorer, batch: int = 64, fallback: float = 0.0, retries: int = 2) -> DataFrame:
    """pairs with score, in batches and in order. A batch that fails is tried again, then pair by pair; a pair that fails gets the fallback."""

    def tried(items: list[tuple[str, str]]) -> list[float]:
        for _ in range(retries):
            try:
                return scorer(items)
            except Exception:  # whatever the model's client raises
                continue
        return [fallback] if len(items) == 1 else [s for i in items for s in tried([i])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            items = list(zip(pdf[left], pdf[right], strict=True))
            yield pdf.assign(score=[s for i in range(0, len(items), batch) for s in tried(items[i : i + batch])])

    return pairs.mapInPandas(run, pairs.withColumn("score", F.lit(0.0)).schema)


Model = Callable[[list[str]], list[dict[str, str] | None]]


def answers(rows: DataFrame, prompt: str, fields: list[str], model: Model, skip: str | None = None, most: int = 12_000, batch: int = 16, retries: int = 2) -> DataFrame:
    """rows with the fields that a model gives for their prompt, cut to so many characters; null where it fails or gives none.

    Rows whose column `skip` isn't blank are passed by with null fields, so that a part that is already enriched costs no call.
    """
    schema = StructType([*rows.schema.fields, *(StructField(f, StringType()) for f in fields)])

    def tried(prompts: list[str]) -> list[dict[str, str] | None]:
        for _ in range(retries):
            try:
                return model(prompts)
            except Exception:  # whatever the model's client raises
                continue
        return [None] if len(prompts) == 1 else [a for p in prompts for a in tried([p])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            open_ = [i for i in range(len(pdf)) if not (skip and isinstance(pdf[skip].iloc[i], str) and pdf[skip].iloc[i].strip())]
            found: list[dict[str, str] | None] = [None] * len(pdf)
            for low in range(0, len(open_), batch):
                part = open_[low : low + batch]
                for i, answer in zip(part, tried([(pdf[prompt].iloc[i] or "")[:most] for i in part]), strict=True):
                    found[i] = answer
            yield pdf.assign(**{f: [(a or {}).get(f) for a in found] for f in fields})

    return rows.mapInPandas(run, schema)


def sections_prompt(sections: DataFrame, each: int = 400, most: int = 12_000) -> DataFrame:
    """doc_id, prompt: the sections of each document in order, each cut to so many characters, up to a length in all."""
    own = F.array_sort(F.collect_list(F.struct("seq", F.substring("content", 1, each).alias("content"))))
    joined = F.array_join(F.transform(own, lambda x: F.concat(F.lit("["), x["seq"].cast("string"), F.lit("] "), F.coalesce(x["content"], F.lit("")))), "\n")
    return sections.groupBy("doc_id").agg(F.substring(joined, 1, most).alias("prompt"))
