"""Readers: JSON stages, file listings, spreadsheets, texts of files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def requirements(spark: SparkSession, path: str) -> DataFrame:
    """requirement: rows of files {requirements: [{requirement}]}."""
    df = spark.read.schema("requirements array<struct<requirement:string>>").json(path, multiLine=True)
    return df.select(F.explode("requirements.requirement").alias("requirement"))


def catalog(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame:
    """The rows of a catalog file: an array of structs at a path of fields, as "data.scopes"."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline(F.col(rows)))


def stage(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A JSON stage file; rows without a required field are an error."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    for name in required:
        df = df.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"the field {name} is missing"))).otherwise(F.col(name)))
    return df


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, modified, bytes of the files that fit, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def missing(expected: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    """Expected names that aren't among the listed files."""
    return expected.join(listed.select(F.element_at(F.split("path", "/"), -1).alias(name)), name, "left_anti")


def newest(listed: DataFrame, *keys: str) -> DataFrame:
    """The path that was modified last, of each key."""
    return listed.groupBy(*keys).agg(F.max_by("path", "modified").alias("path"))


def first_found(wanted: DataFrame, key: str, *catalogs: tuple[str, DataFrame]) -> DataFrame:
    """wanted with location and the name of the first catalog that has the key. Catalogs: key, location."""
    out, hits = wanted, []
    for i, (name, catalog) in enumerate(catalogs):
        out = out.join(catalog.groupBy(key).agg(F.min("location").alias(f"l{i}")), key, "left")
        hits.append((name, f"l{i}"))
    found = F.coalesce(*(F.col(c) for _, c in hits))
    origin = F.coalesce(*(F.when(F.col(c).isNotNull(), n) for n, c in hits))
    return out.select(*wanted.columns, found.alias("location"), origin.alias("origin"))


def texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path, text, md5 of whole files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.md5("content").alias("md5"))


def sheet_rows(data: bytes) -> list[list[str]]:
    """Rows of the first sheet of a workbook, as wide as its widest."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        name = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = {}
        for cell in ElementTree.fromstring(z.read(name)).iter(f"{_MAIN}c"):
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
            column = 0
            for ch in letters:
                column = column * 26 + ord(ch) - 64
            value = cell.findtext(f"{_MAIN}v")
            text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if cell.get("t") == "inlineStr" else shared[int(value)] if cell.get("t") == "s" and value else value or ""
            rows.setdefault(int(row), {})[column] = text
    width = max((c for r in rows.values() for c in r), default=0)
    return [[rows.get(r, {}).get(c, "") for c in range(1, width + 1)] for r in range(min(rows, default=1), max(rows, default=0) + 1)]


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, row, cells of the first sheets of workbooks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [(p, i, cells) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, cells in enumerate(sheet_rows(c))]
            yield pd.DataFrame(found, columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")
