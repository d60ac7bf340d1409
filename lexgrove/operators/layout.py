"""Pages of documents as rows: lines, blocks, spans and tables with their places.

The contract for what a scanner gives, whatever library it uses: lines (doc_id, page, seq, line and, where known, y0, page_height),
blocks (doc_id, page, seq, text, x0, y0, page_height, size, font, bold) and table rows (doc_id, page, cells array<string>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns and words that results depend on.
ORDINALS = "PRIMA|SECONDA|TERZA|QUARTA|QUINTA|SESTA|SETTIMA|OTTAVA|NONA|DECIMA|[IVXLC]+"
SECTION_HEADINGS = (r"(?i)^SEZIONE\s+[IVXLC]+", r"(?i)^ALLEGATO\s+[A-Z0-9]", rf"^PARTE\s+(?:{ORDINALS})\s*$", r"(?i)^DISPOSIZIONI\s+PRELIMINARI")
PARAGRAPH_HEADING = r"^[0-9]+(\.[0-9]+)*\.?\s+[^\n]{1,100}"
PAGE_NUMBER = r"^\s*[0-9]{1,5}\s*$"
EU_JOURNAL = r"(?i)Gazzetta\s+ufficiale\s+(?:dell[ae]?\s+)?(?:Unione\s+europea|Comunit[àa]\s+europe[ea])"
EU_DATE, EU_PAGE = r"[0-9]{1,2}\s*\.\s*[0-9]{1,2}\s*\.\s*[0-9]{2,4}", r"[NnLlCc]\s*\.?\s*[0-9]{1,4}\s*/\s*[0-9]{1,4}"
STATE_BULLETIN = r"(?i)B\.?\s*O\.?\s*(?:del)?\s*E\.?\s*[—\-–]\s*n[úÚ]m\.?\s*[0-9]+"
MINISTRY_WORDS = "MINISTERIO|ADMINISTRACI|JEFATURA|PRESIDENCIA|TRIBUNAL|CONSEJO|DIRECCI|SECRETAR|COMUNIDAD|DIPUTACI|AYUNTAMIENTO|UNIVERSIDAD|BANCO DE ESPAÑA|COMISI"
FILLER = r"[.…·•∙ ]{4,}"
NUMBERED_ENTRY = rf"^\s*([0-9]{{1,4}}(?:\.[0-9]{{1,4}})*\.?)\s+(.*?)\s?{FILLER}\s*([0-9]{{1,4}})\b"
TEXT_ENTRY = rf"^\s*(.{{3,120}}?)\s*{FILLER}\s*([0-9]{{1,4}})\s*$"
COLUMN_LETTERS = ("A", "B", "C", "D", "E", "F", "G")
MARGIN = r"(?i)Official\s+Journal|Gazzetta\s+ufficiale|L\s+[0-9]{1,4}\s*/\s*[0-9]{1,4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
LANGUAGES = ("EN", "IT", "FR", "DE", "ES", "PT", "NL")
BODY_SIZE = 11.0

# pages


def page_texts(lines: DataFrame) -> DataFrame:
    """doc_id, page, text: the lines of each page in order."""
    grouped = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("own"))
    return grouped.select("doc_id", "page", F.array_join(F.transform("own", lambda x: x["line"]), "\n").alias("text"))


def page_offsets(pages: DataFrame, mark: int = 2) -> DataFrame:
    """doc_id, page, start, length: where each page begins in the joined text, whose pages are parted by a mark of so many characters."""
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("text")
    return pages.select("doc_id", "page", F.coalesce(F.sum(length + mark).over(before), F.lit(0)).alias("start"), length.alias("length"))


def first_pages(lines: DataFrame, n: int) -> DataFrame:
    """doc_id, text: the first n pages (from 0), joined by newlines; documents without these have an empty text."""
    own = F.array_sort(F.collect_list(F.when(F.col("page") < n, F.struct("page", "seq", "line"))))
    return lines.groupBy("doc_id").agg(own.alias("own")).select("doc_id", F.array_join(F.transform("own", lambda x: x["line"]), "\n").alias("text"))


def reading_order(blocks: DataFrame, step: float = 5.0) -> DataFrame:
    """Blocks with their place (from 0) by page, y in steps, x."""
    order = Window.partitionBy("doc_id").orderBy("page", F.round(F.col("y0") / step) * step, "x0", "seq")
    return blocks.withColumn("place", F.row_number().over(order) - 1)


def sampled_pages(page_count: Column) -> Column:
    """The first 15 pages (from 0); of longer documents also the three in the middle."""
    head = F.sequence(F.lit(0), F.greatest(F.least(page_count, F.lit(15)), F.lit(1)) - 1)
    middle = F.floor(page_count / 2).cast("int")
    return F.when(page_count > 15, F.array_distinct(F.concat(head, F.array(middle - 1, middle, middle + 1)))).otherwise(F.when(page_count > 0, head).otherwise(F.array().cast("array<int>")))


# tables


def _cells(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))))


def filled_cells(cells: Column) -> Column:
    """Null cells become empty ones."""
    return F.transform(cells, lambda c: F.coalesce(c, F.lit("")))


def is_header_row(cells: Column) -> Column:
    """At least four different cells are one of the letters A to G alone."""
    return F.size(F.array_intersect(F.transform(_cells(cells), F.upper), F.array(*map(F.lit, COLUMN_LETTERS)))) >= 4


def is_empty_row(cells: Column) -> Column:
    return F.forall(_cells(cells), lambda c: c == "")


def is_margin_row(cells: Column) -> Column:
    """Little text, hardly anything but a running head, or the mark of a language."""
    text = F.trim(F.array_join(filled_cells(cells), " "))
    head = F.regexp_like(text, F.lit(MARGIN)) & (F.length(text) < 100) & (F.length(F.trim(F.regexp_replace(text, MARGIN, ""))) < 10)
    return (F.length(text) < 5) | head | text.isin(*LANGUAGES)


def table_measures(tables: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, table_ratio, header_pages over the sampled pages. tables: doc_id, page, cells; documents: doc_id, page_count."""
    sampled = documents.select("doc_id", "page_count", F.explode(sampled_pages(F.col("page_count"))).alias("page"))
    found = tables.groupBy("doc_id", "page").agg(F.max(is_header_row(F.col("cells"))).alias("header"))
    measured = sampled.join(found, ["doc_id", "page"], "left").groupBy("doc_id").agg(F.avg(F.col("header").isNotNull().cast("double")).alias("table_ratio"), F.count_if(F.coalesce("header", F.lit(False))).alias("header_pages"))
    return documents.select("doc_id").join(measured, "doc_id", "left").select("doc_id", F.coalesce("table_ratio", F.lit(0.0)).alias("table_ratio"), F.coalesce("header_pages", F.lit(0)).alias("header_pages"))


# repeated lines


def repeated_in_bands(lines: DataFrame, top: float, bottom: float, least: int, least_length: int = 1) -> DataFrame:
    """doc_id, text, n: trimmed lines that stand so often in the top or bottom share of pages (0.1 and 0.1: the outer tenths)."""
    text = F.trim("line")
    outer = (F.col("y0") < F.col("page_height") * top) | (F.col("y0") > F.col("page_height") * (1 - bottom))
    counted = lines.where(outer & (F.length(text) >= least_length)).groupBy("doc_id", text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def without_repeated_in_bands(lines: DataFrame, top: float, bottom: float, least: int, least_length: int = 1) -> DataFrame:
    """Lines except the repeated ones, wherever they stand."""
    repeated = repeated_in_bands(lines, top, bottom, least, least_length).select("doc_id", "text")
    return lines.withColumn("text", F.trim("line")).join(repeated, ["doc_id", "text"], "left_anti").drop("text")


# tests of lines and blocks


def is_section(line: Column) -> Column:
    text = F.trim(line)
    found = F.lit(False)
    for pattern in SECTION_HEADINGS:
        found = found | F.regexp_like(text, F.lit(pattern))
    return found


def is_paragraph(line: Column) -> Column:
    return F.regexp_like(F.trim(line), F.lit(PARAGRAPH_HEADING))


def is_running_head(line: Column) -> Column:
    """Blank lines, page numbers and the heads of the Union's journal."""
    text = F.trim(line)
    dated = lambda p: F.regexp_like(text, F.lit(p))
    alone = (dated("^" + EU_DATE) & (F.length(text) < 20)) | (dated("^" + EU_PAGE) & (F.length(text) < 15))
    return (text == "") | dated(PAGE_NUMBER) | dated(EU_JOURNAL) | (dated(EU_DATE) & dated(EU_PAGE)) | alone | (text == "IT")


def is_bulletin_margin(text: Column, y0: Column, page_height: Column) -> Column:
    """Blocks of the state bulletin that hold no provision: blank, page numbers, heads, and the outer twentieths of the page."""
    return (F.trim(text) == "") | F.regexp_like(text, F.lit(PAGE_NUMBER)) | F.regexp_like(text, F.lit(STATE_BULLETIN)) | (y0 < page_height * 0.05) | (y0 > page_height * 0.95)


def is_ministry(text: Column, bold_share: Column) -> Column:
    """A keyword of an authority, in capitals (over 0.7 of the letters) or bold (over half of the characters)."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    capitals = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    keyword = F.regexp_like(F.upper(text), F.lit(MINISTRY_WORDS))
    return (F.length(letters) > 0) & keyword & ((capitals > 0.7 * F.length(letters)) | F.coalesce(bold_share > 0.5, F.lit(False)))


def is_title(text: Column, size: Column, bold: Column, body_size: Column) -> Column:
    """Blocks under 120 characters that are 1.15 times the body's size or more, bold, or in capitals."""
    t = F.trim(text)
    capitals = (t == F.upper(t)) & (F.length(t) > 3)
    return (t != "") & (F.length(t) < 120) & ((size >= body_size * 1.15) | F.coalesce(bold, F.lit(False)) | capitals)


def title_level(size: Column, body_size: Column) -> Column:
    return F.when(size >= body_size * 1.4, 1).when(size >= body_size * 1.2, 2).otherwise(3)


def block_fonts(spans: DataFrame) -> DataFrame:
    """doc_id, block, font (the most frequent, the first of equals), size (the mean). spans: doc_id, block, font, size."""
    by = spans.groupBy("doc_id", "block", "font").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.count("size").alias("sized"))
    return by.groupBy("doc_id", "block").agg(F.min_by("font", F.struct(-F.col("n"), F.col("font"))).alias("font"), (F.sum("total") / F.sum("sized")).alias("size"))


# indexes


def index_entries(lines: DataFrame, pages: int = 5) -> DataFrame:
    """doc_id, seq, index_page, entry_id, title, page: entries after the first line with the word "indice", on the first pages (from 1).

    An entry is a number, a title, a filler of dots or blanks and a page from 1 to 1499; or a title without a number.
    """
    seen = F.max(F.regexp_like("line", F.lit(r"(?i)\bindice\b"))).over(Window.partitionBy("doc_id").orderBy("page", "seq").rowsBetween(Window.unboundedPreceding, -1))
    after = lines.where(F.col("page") <= pages).withColumn("seen", seen).where("seen")
    numbered = F.regexp_like("line", F.lit(NUMBERED_ENTRY))
    part = lambda pattern, i: F.regexp_extract("line", pattern, i)
    title = F.when(numbered, part(NUMBERED_ENTRY, 2)).otherwise(part(TEXT_ENTRY, 1))
    target = F.when(numbered, part(NUMBERED_ENTRY, 3)).otherwise(part(TEXT_ENTRY, 2)).try_cast("int")
    found = after.select("doc_id", "seq", F.col("page").alias("index_page"), F.when(numbered, part(NUMBERED_ENTRY, 1)).otherwise("").alias("entry_id"), F.rtrim(F.trim(title), F.lit(".")).alias("title"), target.alias("page"))
    return found.where(F.col("page").between(1, 1499) & ((F.col("entry_id") != "") | (F.length("title") > 2)))


def start_pages(lines: DataFrame) -> DataFrame:
    """doc_id, start_page: the first page with a title, chapter and name in three lines, or with preliminary provisions or a part."""
    order = Window.partitionBy("doc_id", "page").orderBy("seq")
    text, second, third = (F.trim(c) for c in (F.col("line"), F.col("second"), F.col("third")))
    like = lambda c, p: F.coalesce(F.regexp_like(c, F.lit(p)), F.lit(False))
    filled = lines.where(F.trim("line") != "").withColumns({"second": F.lead("line").over(order), "third": F.lead("line", 2).over(order)})
    opening = like(text, r"(?i)^TITOLO [IVXLC]+$") & like(second, r"(?i)^Capitolo [0-9]+$") & like(third, r"^[A-ZÀÈÉÙÒÌ][A-ZÀÈÉÙÒÌ0-9 \-',.]{4,}$")
    alone = ~text.contains("...") & (like(text, r"(?i)^DISPOSIZIONI\s+PRELIMINARI\s*$") | like(text, rf"(?i)^PARTE\s+(?:{ORDINALS})\s*(?:[-–]\s*.+)?$"))
    return filled.where(opening | alone).groupBy("doc_id").agg(F.min("page").alias("start_page"))


def page_shift(index: DataFrame, pages: DataFrame, first: int = 10) -> DataFrame:
    """doc_id, shift: how many pages the printed numbers lag behind: the first of the first pages (from 0) that has the first entry's title, and isn't the index."""
    entry = index.groupBy("doc_id").agg(F.min_by(F.struct("title", "page"), "seq").alias("e"))
    low = F.lower("text")
    hits = pages.where(F.col("page") < first).join(entry, "doc_id").where(low.contains(F.lower(F.trim("e.title"))) & ~F.substring(low, 1, 200).contains("indice"))
    shift = hits.withColumn("shift", F.col("page") - (F.col("e.page") - 1)).where("shift > 0").groupBy("doc_id").agg(F.min_by("shift", "page").alias("shift"))
    return index.select("doc_id").distinct().join(shift, "doc_id", "left").select("doc_id", F.coalesce("shift", F.lit(0)).alias("shift"))
