"""Fuzzy ratios and tolerant parsing: what Spark has no expression for, in Arrow batches."""

from __future__ import annotations

import ast
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from lexgrove.functions.text import PATTERN_WORDS


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    marks: dict[str, int] = {}
    for i, ch in enumerate(a):
        marks[ch] = marks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & marks.get(ch, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence to the lengths' sum."""
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    if short in long:
        return 100.0
    # a window that begins or ends at a character that the short one has is as good as any
    starts = [i for i in range(1 - len(short), len(long)) if long[max(i, 0)] in short]
    return max((ratio(short, long[max(i, 0) : i + len(short)]) for i in starts), default=0.0)


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def fuzzy_partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StringType())
def normal_form(c: pd.Series) -> pd.Series:
    """Composed characters."""
    return c.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _kind(text: str, least: float) -> str:
    words = (text or "").lower().split()
    for kind, keywords in PATTERN_WORDS:
        if any(ratio(w, k) >= least for w in words for k in keywords):
            return kind
    return "Termine temporale" if "entro il" in (text or "").lower() else "altro"


def fuzzy_pattern_class(c: Column, least: float = 85) -> Column:
    """Kind of requirement by words close to the keywords."""

    @F.pandas_udf(StringType())
    def kinds(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _kind(t, least))

    return kinds(c)


def _attempts(text: str):
    yield text
    if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.S):
        yield m[1]
    for opening, closing in ("{}", "[]"):
        a, b = text.find(opening), text.rfind(closing)
        if 0 <= a < b:
            yield text[a : b + 1]


def parse_answer(text: str | None) -> str:
    """JSON of an answer: as it is, in a fence, between braces, as Python literals, as quoted or listed lines; else an object with the error."""
    for part in _attempts(text or ""):
        for read in (json.loads, ast.literal_eval):
            try:
                return json.dumps(read(part.strip()), ensure_ascii=False)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
    if quoted := re.findall(r'"([^"\n]+)"', text or ""):
        return json.dumps(quoted, ensure_ascii=False)
    if listed := re.findall(r"(?m)^\s*(?:[-*•]|\d+[.)])\s+(.+?)\s*$", text or ""):
        return json.dumps(listed, ensure_ascii=False)
    return json.dumps({"error": "no JSON found", "raw": text or ""}, ensure_ascii=False)


@F.pandas_udf(StringType())
def tolerant_json(c: pd.Series) -> pd.Series:
    return c.map(parse_answer)
