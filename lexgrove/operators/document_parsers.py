"""Parsers of whole documents over rows of lines, spans and blocks, and the router that picks one with its fallbacks.

Each parser marks the rows that are headings; parts are what follows them, by windows in document order. Only the
buffer of the general parser carries state from row to row, and runs as a fold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.operators.layout import filled_cells, is_header_row, is_paragraph, is_section, is_title
from lexgrove.operators.lines import bounded, fold
from lexgrove.operators.matching import in_ranges

# Patterns and limits that results depend on.
CAPITALS = r"^[A-ZÀ-ÖØ-ÝÆŒ0-9 ,'.\-–]{5,}$"
STRUCTURE = r"(?i)^(?:PARTE|SEZIONE|DISPOSIZIONI|ALLEGATO)\b"
CHAPTER, SUBTITLE, NUMBERED = r"^\s*[0-9]+\.\s+[A-Z][^\n]{5,60}$", r"^(?![0-9]+\.\s)[A-Z][\p{L}\p{N}_\s,\-()/']{5,60}$", r"(?s)^([0-9]+)\.\s+(.{60,})"
ACT_TYPE = r"(?i)(REGOLAMENTO\s+\((?:UE|CE|CEE)\)\s+N\.\s*[0-9]+/[0-9]+|DIRETTIVA\s+[0-9]+/[0-9]+/(?:UE|CE|CEE)|DECISIONE\s+[0-9]+/[0-9]+/(?:UE|CE|PESC)|REGOLAMENTO\s+DELEGATO\s+\(UE\)\s+[0-9]+/[0-9]+|REGOLAMENTO\s+DI\s+ESECUZIONE\s+\(UE\)\s+[0-9]+/[0-9]+)"
INSTITUTIONS = ("CONSIGLIO DELL'UNIONE EUROPEA", "PARLAMENTO EUROPEO E DEL CONSIGLIO", "COMMISSIONE EUROPEA", "CONSIGLIO", "PARLAMENTO EUROPEO", "BANCA CENTRALE EUROPEA")
FOOTNOTE_SIZE, LITTLE, SPLIT, SPLIT_MOST = 9.0, 50, 10_000, 12_000
#: For each detected type the parsers to try, in order.
CHAINS = {
    "boe": ("boe", "regolamento", "indice", "contenuto"), "annex_tabular": ("annex_tabular", "regolamento", "indice", "contenuto"), "gazzetta_ue": ("gazzetta_ue", "regolamento", "indice", "contenuto"),
    "banca": ("banca", "regolamento", "indice", "contenuto"), "general": ("general",), "indice": ("indice", "regolamento", "contenuto"), "regolamento": ("regolamento", "indice", "contenuto"),
}


def _upto(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _next(c: str | Column) -> Column:
    return F.lead(c).over(Window.partitionBy("doc_id").orderBy("seq"))


def _before(c: str | Column) -> Column:
    return F.lag(c).over(Window.partitionBy("doc_id").orderBy("seq"))


def _exact(pattern: str) -> str:
    """The pattern with a line feed as the only end of a line, and without the vertical tab as white space."""
    return "(?d)" + pattern.replace(r"\s", r"[\t\n\f\r ]")


def _joined(mark: str, text: str = "line", only: Column | None = None) -> Column:
    own = F.array_sort(F.collect_list(F.struct("seq", text) if only is None else F.when(only, F.struct("seq", text))))
    return F.array_join(F.transform(own, lambda x: x[text]), mark)


def circular(spans: DataFrame, top: float = 0.16, bottom: float = 0.9) -> DataFrame:
    """doc_id, section, section_title, paragraph, heading, content of a bank's circular.

    spans: doc_id, page, seq, line, size, bold, y0, page_height, from the start page on. Small print (size 9 or less) and
    the page's edges go, but for structural headings at the top. A section's title is a following line in capitals. A paragraph's heading is a number
    and title in one line, or bold in two; other bold lines go. Text before the first paragraph of a section is paragraph "0".
    Of sections with one title, and of a section's paragraphs with one heading, the first counts.
    """
    text = F.trim("line")
    inside = F.col("y0").between(F.col("page_height") * top, F.col("page_height") * bottom) | ((F.col("y0") < F.col("page_height") * top) & F.regexp_like(text, F.lit(STRUCTURE)))
    rows = spans.where((text != "") & (F.col("size") > FOOTNOTE_SIZE) & inside).withColumn("line", text)
    bold = F.coalesce("bold", F.lit(False))
    rows = rows.withColumns({"section_start": is_section(F.col("line")), "one_line": is_paragraph(F.col("line")), "bold": bold})
    number = F.col("bold") & F.regexp_like("line", F.lit(r"^[0-9.]+$")) & ~F.col("section_start")
    rows = rows.withColumns({"number": number, "capitals": F.regexp_like("line", F.lit(CAPITALS))})
    two_lines = F.col("number") & F.coalesce(_next(F.col("bold") & ~F.col("section_start") & ~F.col("one_line")), F.lit(False))
    rows = rows.withColumns({"is_name": F.coalesce(_before("section_start"), F.lit(False)) & F.col("capitals") & ~F.col("section_start"), "two_lines": two_lines})
    rows = rows.withColumns({
        "section_title": F.when(F.col("section_start"), F.when(F.coalesce(_next(F.col("capitals") & ~F.col("section_start")), F.lit(False)), _next("line")).otherwise(F.col("line"))),
        "heading": F.when(F.col("one_line") & ~F.col("section_start"), F.concat(F.regexp_extract("line", r"^([0-9]+(?:\.[0-9]+)*\.?)\s+(.+)$", 1), F.regexp_extract("line", r"^([0-9]+(?:\.[0-9]+)*\.?)\s+(.+)$", 2))).when(F.col("two_lines"), F.concat("line", _next("line"))),
    })
    rows = rows.withColumn("section", F.count("section_title").over(_upto("doc_id"))).where("section > 0")
    rows = rows.withColumns({"section_title": F.max("section_title").over(Window.partitionBy("doc_id", "section")), "paragraph": F.count("heading").over(_upto("doc_id", "section"))})
    plain = F.col("heading").isNull() & ~F.col("section_start") & ~F.col("is_name") & ~F.col("bold")
    parts = rows.groupBy("doc_id", "section", "paragraph").agg(F.max("section_title").alias("section_title"), F.max("heading").alias("heading"), F.count_if(plain).alias("texts"), _joined(" ", only=plain).alias("content"))
    parts = parts.where("heading is not null or texts > 0").withColumn("heading", F.coalesce("heading", F.lit("0")))
    first_section = F.min("section").over(Window.partitionBy("doc_id", "section_title"))
    first_heading = F.min("paragraph").over(Window.partitionBy("doc_id", "section", "heading"))
    kept = parts.withColumns({"fs": first_section, "fh": first_heading}).where("fs = section and fh = paragraph")
    return kept.select("doc_id", "section", "section_title", "paragraph", "heading", "content")


def without_index(blocks: DataFrame) -> DataFrame:
    """doc_id, item, chapter, subtitle, number, content of documents with chapters, subtitles and long numbered paragraphs.

    blocks: doc_id, seq, text. Between two numbered paragraphs the first chapter heading counts, further ones are
    text. Text goes to the numbered paragraph above it; under a chapter or subtitle alone it is dropped, as are blank blocks and page numbers.
    """
    rows = blocks.withColumn("text", F.trim("text", F.lit(" \t\r\n"))).where((F.col("text") != "") & ~F.regexp_like("text", F.lit("^[0-9]+$")))
    like = lambda pattern: F.regexp_like("text", F.lit(_exact(pattern)))
    rows = rows.withColumns({"numbered": like(NUMBERED) & ~like(CHAPTER), "could": like(CHAPTER)})
    rows = rows.withColumn("stretch", F.count_if("numbered").over(_upto("doc_id")))
    chapter = F.col("could") & (F.count_if("could").over(_upto("doc_id", "stretch")) == 1)
    rows = rows.withColumns({"chapter_start": chapter, "subtitle_start": like(SUBTITLE) & ~F.col("numbered") & ~F.col("could")})
    rows = rows.withColumn("item", F.count_if(F.col("chapter_start") | F.col("subtitle_start") | F.col("numbered")).over(_upto("doc_id")))
    chapters = F.count_if("chapter_start").over(_upto("doc_id"))
    rows = rows.withColumns({"in_chapter": chapters, "chapter": F.last(F.when(F.col("chapter_start"), F.col("text")), ignorenulls=True).over(_upto("doc_id"))}).where("in_chapter > 0")
    rows = rows.withColumn("subtitle", F.last(F.when(F.col("subtitle_start"), F.col("text")), ignorenulls=True).over(_upto("doc_id", "in_chapter")))
    part = lambda i: F.regexp_extract("text", _exact(NUMBERED), i)
    rows = rows.withColumn("number", F.when(F.col("numbered"), part(1))).withColumn("text", F.when(F.col("numbered"), part(2)).otherwise(F.col("text")))
    kept = rows.groupBy("doc_id", "item").agg(F.max("number").alias("number"), F.first("chapter").alias("chapter"), F.first("subtitle").alias("subtitle"), _joined(" ", "text").alias("content")).where("number is not null")
    return kept.select("doc_id", "item", "chapter", "subtitle", F.concat("number", F.lit(".")).alias("number"), F.trim("content").alias("content"))


def general_parts(blocks: DataFrame, body_size: float = 11.0, low: int = SPLIT, high: int = SPLIT_MOST) -> DataFrame:
    """doc_id, part_id, sibling_of, section, content, page of any document by its titles.

    blocks: doc_id, seq, page, text, size, bold, in reading order. Body text is gathered up to 1.5 times the upper limit, then cut at sentence ends
    between the limits; what is left under 50 characters waits for more, unless the section ends. A part's sibling is the one before in its section.
    """
    marked = blocks.select("doc_id", "seq", "page", F.trim("text").alias("text"), is_title(F.col("text"), F.col("size"), F.col("bold"), F.lit(body_size)).alias("title")).where("text != ''")

    def step(doc: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "part_id", "sibling_of", "section", "content", "page")}
        section, sibling, held, page = "", None, "", 0

        def flush(force: bool) -> None:
            nonlocal sibling, held
            texts = bounded(held.strip(), low, high)
            held = texts.pop() if texts and len(texts[-1]) < LITTLE and not force else ""
            for text in texts:
                number = len(out["part_id"]) + 1
                for c, v in zip(out, (doc["doc_id"][0], number, sibling, section, text, page), strict=True):
                    out[c].append(v)
                sibling = number

        for text, is_heading, at in zip(doc["text"], doc["title"], doc["page"], strict=True):
            if is_heading:
                flush(True)
                section, sibling, held = text, None, ""
                continue
            if not held:
                page = at
            held = f"{held} {text}" if held else text
            if len(held) > 1.5 * high:
                flush(False)
        flush(True)
        return out

    return fold(marked, "doc_id long, part_id int, sibling_of int, section string, content string, page int", step)


def chapters(lines: DataFrame, index: DataFrame, last_pages: DataFrame, tables: DataFrame | None = None, shift: DataFrame | None = None, edge: float = 0.1) -> DataFrame:
    """doc_id, entry, title, content: the text of each entry of an index, from the line with its title to the one with the next title.

    lines: doc_id, page (from 1), seq, line, y0, page_height; index: doc_id, seq, title, page; last_pages: doc_id, last_page; tables: doc_id, page, seq, cells, whose
    rows stand in the text as cells parted by " | "; shift: doc_id, shift, the pages by which printed numbers lag. An entry without a line that
    has its title has all lines of its pages. The outer tenths of pages go.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    moved = index.join(shift, "doc_id", "left").withColumn("page", F.col("page") + F.coalesce("shift", F.lit(0))) if shift is not None else index
    entries = moved.withColumns({"next_page": F.lead("page").over(order), "next_title": F.lead("title").over(order)}).join(last_pages, "doc_id")
    ranges = entries.select("doc_id", F.col("seq").alias("entry"), "title", "next_title", F.col("page").alias("low"), F.greatest("page", F.least(F.coalesce("next_page", "last_page"), F.col("last_page"))).alias("high"))
    body = lines.where(F.col("y0").between(F.col("page_height") * edge, F.col("page_height") * (1 - edge))).select("doc_id", "page", "seq", "line", F.lit(False).alias("cells"))
    if tables is not None:
        body = body.unionByName(tables.select("doc_id", "page", "seq", F.array_join(filled_cells(F.col("cells")), " | ").alias("line"), F.lit(True).alias("cells")))
    placed = in_ranges(body, ranges, "doc_id", "page", "low", "high", 16)
    has = lambda title: F.coalesce(F.lower("line").contains(F.lower(F.trim(title))), F.lit(False)) & ~F.col("cells")
    own = Window.partitionBy("doc_id", "entry")
    begin = F.min(F.when(has(F.col("title")), F.col("seq"))).over(own)
    started = placed.withColumn("begin", begin).where("begin is null or seq >= begin")
    end = F.min(F.when(has(F.col("next_title")) & (F.col("seq") > F.coalesce("begin", F.lit(-1))), F.col("seq"))).over(own)
    kept = started.withColumn("end", end).where("end is null or seq < end")
    return kept.groupBy("doc_id", "entry").agg(F.first("title").alias("title"), _joined("\n").alias("content"))


def act_metadata(first_page: DataFrame) -> DataFrame:
    """doc_id, act_type, act_date, institution from the text of the first page; empty where nothing is found."""
    upper = F.upper("text")
    institution = F.lit("")
    for name in reversed(INSTITUTIONS):
        institution = F.when(upper.contains(name), name).otherwise(institution)
    text = F.coalesce("text", F.lit(""))
    return first_page.select("doc_id", F.regexp_extract(text, ACT_TYPE, 1).alias("act_type"), F.regexp_extract(text, r"(?i)del\s+([0-9]{1,2}\s+\w+\s+[0-9]{4})", 1).alias("act_date"), F.coalesce(institution, F.lit("")).alias("institution"))


def annex_rows(tables: DataFrame) -> DataFrame:
    """doc_id, page, seq, section_num, sub_item, element_name, requirement, condition, description, data_format.

    tables: doc_id, page, seq, cells. The letters A to G in a page's first header row name the columns; the cells from F up to G are
    one description, parted by " | ". Pages without a header row use the header of the last page before that has one.
    """
    spot = lambda letter: F.array_position(F.transform("cells", lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))), letter).cast("int")
    mapping = F.struct(*(spot(x).alias(x) for x in "ABCDEFG"))
    order = Window.partitionBy("doc_id").orderBy("page", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tables.withColumn("header", is_header_row(F.col("cells"))).withColumn("at", F.last(F.when(F.col("header"), mapping), ignorenulls=True).over(order))
    at = F.col("at")
    cell = lambda letter: F.when(at[letter] > 0, F.trim(F.coalesce(F.get("cells", at[letter] - 1), F.lit("")))).otherwise("")
    between = F.filter(F.transform(F.slice("cells", at["F"], at["G"] - at["F"]), lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    description = F.when((at["F"] > 0) & (at["G"] > at["F"] + 1), F.array_join(between, " | ")).otherwise(cell("F"))
    names = zip(("section_num", "sub_item", "element_name", "requirement", "condition"), "ABCDE", strict=True)
    return rows.where("at is not null and not header").select("doc_id", "page", "seq", *(cell(x).alias(n) for n, x in names), description.alias("description"), cell("G").alias("data_format"))


def routed(profiles: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]], chains: dict[str, tuple[str, ...]] = CHAINS) -> DataFrame:
    """parser and the parser's columns: each document's parts by the first parser of its type's chain that gives any.

    profiles: doc_id, detected_type. Each parser gets the doc_ids of the types that may come to it, and gives rows with a doc_id; all give the same columns.
    """
    ranks = profiles.sparkSession.createDataFrame([(t, p, i) for t, chain in chains.items() for i, p in enumerate(p for p in chain if p in parsers)], "detected_type string, parser string, rank int")
    found = None
    for name, parser in parsers.items():
        own = profiles.where(F.col("detected_type").isin([t for t, chain in chains.items() if name in chain])).select("doc_id")
        rows = parser(own).withColumn("parser", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    ranked = found.join(profiles.select("doc_id", "detected_type"), "doc_id").join(F.broadcast(ranks), ["detected_type", "parser"])  # a few rows for each type
    best = ranked.groupBy("doc_id").agg(F.min("rank").alias("best"))
    return ranked.join(best, "doc_id").where("rank = best").select(*found.columns)
