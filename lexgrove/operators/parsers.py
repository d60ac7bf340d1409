"""Parsers of regulations, gazettes and annexes: windows over ordered lines (doc_id, seq, line)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions.fuzzy import fuzzy_partial_ratio
from lexgrove.functions.text import provision_type
from lexgrove.operators import lines as L

ARTICLE = r"(?i)^\s*(?:articolo|article|artículo|art\.)\s+(\d+)\s*(" + L.EXTENSION + r")?\.?\s*$"
ANNEX = r"(?i)^\s*(?:allegato|annex|anexo)\b"
RECITAL = r"^\s*\((\d+)\)\s+(.*)$"


def regulation(lines: DataFrame) -> DataFrame:
    """doc_id, segment, number, extension, title, content: articles whose numbers continue; others are text of the article before."""
    marked = lines.withColumns({"number": F.regexp_extract("line", ARTICLE, 1).try_cast("bigint"), "extension": F.lower(F.regexp_extract("line", ARTICLE, 2))})
    accepted = L.accepted_articles(marked.where("number is not null").select("doc_id", "seq", "number", "extension")).where("accepted").select("doc_id", "seq", F.lit(True).alias("heads"))
    joined = lines.join(accepted, ["doc_id", "seq"], "left")
    found = L.segments(joined, F.coalesce(F.col("heads"), F.lit(False)))
    return found.where("heading is not null").select("doc_id", "segment", F.regexp_extract("heading", ARTICLE, 1).try_cast("bigint").alias("number"), F.lower(F.regexp_extract("heading", ARTICLE, 2)).alias("extension"), "title", "content")


def gazette(lines: DataFrame) -> DataFrame:
    """doc_id, part, label, content: preamble, recitals, articles and annexes of a legal act, in order."""
    is_article, is_annex, is_recital = F.col("line").rlike(ARTICLE), F.col("line").rlike(ANNEX), F.col("line").rlike(RECITAL)
    order = Window.partitionBy("doc_id").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = lines.withColumn("past", F.max((is_article | is_annex).cast("int")).over(upto))
    kind = F.when(is_annex, "annex").when(is_article, "article").when(is_recital & (F.col("past") == 0), "recital")
    marked = seen.withColumn("kind", kind).withColumn("part", F.sum(F.col("kind").isNotNull().cast("int")).over(upto))
    label = F.when(F.col("kind") == "recital", F.regexp_extract("line", RECITAL, 1)).when(F.col("kind").isNotNull(), F.trim("line"))
    text = F.when(F.col("kind") == "recital", F.regexp_extract("line", RECITAL, 2)).when(F.col("kind").isNull(), F.col("line"))
    grouped = marked.groupBy("doc_id", "part").agg(F.coalesce(F.max("kind"), F.lit("preamble")).alias("kind"), F.max(label).alias("label"), F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("seq", text.alias("t"))))).alias("body"))
    return grouped.select("doc_id", "part", "kind", "label", F.array_join(F.transform("body", lambda x: x["t"]), "\n").alias("content"))


def upper_share(c: Column) -> Column:
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    return F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) / F.greatest(F.length(letters), F.lit(1))


def provisions(lines: DataFrame) -> DataFrame:
    """doc_id, ministry, number, kind, content: numbered provisions of an official bulletin under the ministry that heads them."""
    ministry = F.col("line").rlike(r"(?i)\bministerio|\bconsejo|\bjefatura") & (upper_share(F.col("line")) > 0.7)
    numbered = r"^\s*(\d{3,6})\s+(\S.*)$"
    held = L.with_heading(lines, ministry).withColumnRenamed("heading", "ministry")
    found = L.segments(held.where(~ministry), F.col("line").rlike(numbered)).where("heading is not null")
    first = held.where(F.col("line").rlike(numbered)).select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).cast("bigint").alias("segment"), "ministry")
    text = F.regexp_extract("heading", numbered, 2)
    return found.join(first, ["doc_id", "segment"]).select("doc_id", "ministry", F.regexp_extract("heading", numbered, 1).alias("number"), provision_type(text).alias("kind"), F.concat_ws("\n", text, "title", F.nullif("content", F.lit(""))).alias("content"))


def annex_items(rows: DataFrame) -> DataFrame:
    """doc_id, section, item, cells of table rows (doc_id, seq, section_num, sub_item, text): rows without a number continue the row before."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.withColumns({"section": F.last(F.nullif(F.trim("section_num"), F.lit("")), ignorenulls=True).over(order), "has_id": F.trim(F.coalesce("sub_item", F.lit(""))) != ""})
    grouped = named.withColumn("item", F.sum(F.col("has_id").cast("int")).over(order)).groupBy("doc_id", "item")
    merged = grouped.agg(F.max("section").alias("section"), F.max("sub_item").alias("sub_item"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    return merged.select("doc_id", "section", "sub_item", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


def header_mapping(cells: Column, names: list[str]) -> Column:
    """name to position in a header row, by the first cell that begins with the name."""
    low = F.transform(cells, lambda c: F.lower(F.trim(c)))
    places = [x for n in names for x in (F.lit(n), F.array_position(low, F.get(F.filter(low, _begins(n)), F.lit(0))).cast("int"))]
    return F.map_filter(F.create_map(*places), lambda _, v: v.isNotNull() & (v > 0))


def _begins(name: str):
    return lambda c: c.startswith(name.lower())


def best_pages(requirements: DataFrame, pages: DataFrame, least: float = 50) -> DataFrame:
    """doc_id, requirement, page: the page of the document that fits best, the first of equal ones, "N/A" under the least.

    One page back if that page fits the first 25 characters better. requirements: doc_id, requirement; pages: doc_id, page, text.
    """
    pairs = requirements.distinct().join(pages, "doc_id").select("doc_id", "requirement", "page", fuzzy_partial_ratio("requirement", "text").alias("fit"), fuzzy_partial_ratio(F.substring("requirement", 1, 25), "text").alias("head"))
    group = Window.partitionBy("doc_id", "requirement")
    before = pairs.withColumns({"head_before": F.lag("head").over(group.orderBy("page")), "page_before": F.lag("page").over(group.orderBy("page"))})
    best = before.withColumn("place", F.row_number().over(group.orderBy(F.desc("fit"), "page"))).where("place = 1")
    page = F.when(F.col("fit") < least, "N/A").when(F.col("head_before") > F.col("head"), F.col("page_before").cast("string")).otherwise(F.col("page").cast("string"))
    return best.select("doc_id", "requirement", page.alias("page"))


def derived_files(catalog: DataFrame, deleted: DataFrame) -> DataFrame:
    """Files to delete with documents: their own, and comparisons of two documents that name one of them. catalog: name; deleted: hash."""
    parts = catalog.select("name", F.explode(F.array_distinct(F.split(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", ""), "_vs_"))).alias("hash"))
    return parts.join(deleted.distinct(), "hash", "left_semi").select("name").distinct()


def novelty(old: Column, new: Column, keywords: list[str]) -> Column:
    """0 to 1: keywords that are new or kept, and how much the length differs."""
    low_old, low_new = F.lower(F.coalesce(old, F.lit(""))), F.lower(F.coalesce(new, F.lit("")))
    points = reduce(lambda a, b: a + b, (F.when(low_new.contains(k) & ~low_old.contains(k), 2).when(low_new.contains(k), 1).otherwise(0) for k in keywords), F.lit(0))
    longest = F.greatest(F.length(low_old), F.length(low_new))
    spread = F.coalesce(F.abs(F.length(low_old) - F.length(low_new)) / F.nullif(longest, F.lit(0)), F.lit(0.0))
    return F.least(points / 15, F.lit(1.0)) * 0.7 + spread * 0.3
