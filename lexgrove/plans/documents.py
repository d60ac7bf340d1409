"""Registered queries of pages, parsers, versions and row shapes, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import text as X
from lexgrove.operators import document_parsers, hierarchy, layout, lines, matching, parsers, scoring, shapes, versioning
from lexgrove.plans.catalog import CLEAN, LINES, Table, query

# Lines of documents on pages of ten lines, each 80 high; a page is 800 high.
PAGED = f"SELECT *, seq // 10 + 1 AS page, (seq % 10) * 80.0 + 20 AS y0, 800.0 AS page_height, length(line) % 7 + 7.5 AS size, length(line) % 5 = 0 AS bold FROM ({LINES})"


def _paged(t: Table, change: Callable[[], Column] | None = None) -> DataFrame:
    found = lines.lines_of(t("documents"))
    if change:
        found = found.withColumn("line", change())
    seq = F.col("seq")
    return found.withColumns({"page": (F.floor(seq / 10) + 1).cast("int"), "y0": (seq % 10) * 80.0 + 20, "page_height": F.lit(800.0), "size": F.length("line") % 7 + 7.5, "bold": F.length("line") % 5 == 0})


def _put(pairs: list[tuple[str, str]]) -> tuple[str, Callable[[], Column]]:
    """Lines of given texts where a condition on seq holds, in SQL and as a column, which is made when a session is there."""

    def column() -> Column:
        out = None
        for c, v in pairs:
            condition, value = F.expr(c), F.expr(v.replace("//", "div"))
            out = F.when(condition, value) if out is None else out.when(condition, value)
        return out.otherwise(F.col("line"))

    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " ELSE line END", column


def _with(put: str) -> str:
    """PAGED over changed lines."""
    return PAGED.replace(f"({LINES})", f"(SELECT doc_id, seq, {put} AS line FROM ({LINES}))")


# pages


@query(f"SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(text) AS INTEGER) AS length FROM (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY seq) AS text FROM ({PAGED}) GROUP BY ALL)")
def page_offsets(t: Table) -> DataFrame:
    return layout.page_offsets(layout.page_texts(_paged(t)))


@query(f"SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY seq) FILTER (page < 3), '')) AS text FROM ({PAGED}) GROUP BY doc_id")
def first_pages(t: Table) -> DataFrame:
    return layout.first_pages(_paged(t), 3).withColumn("text", F.md5("text"))


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, round(l_quantity / 5) * 5, l_discount, l_linenumber) - 1 AS INTEGER) AS place FROM lineitem")
def reading_order(t: Table) -> DataFrame:
    blocks = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_quantity").alias("y0"), F.col("l_discount").alias("x0"))
    return layout.reading_order(blocks).select(F.col("doc_id").alias("l_orderkey"), F.col("seq").alias("l_linenumber"), "place")


@query(
    """WITH d AS (SELECT c_custkey, c_custkey % 40 AS n FROM customer), s AS (SELECT c_custkey, n, unnest(range(0, n)) AS page FROM d), k AS (SELECT * FROM s WHERE page < 15 OR (n > 15 AND page BETWEEN n // 2 - 1 AND n // 2 + 1)),
    f AS (SELECT o_custkey, o_orderkey % 30 AS page, max(o_orderkey % 3 = 0) AS h FROM orders GROUP BY ALL)
    SELECT d.c_custkey AS doc_id, coalesce(avg(CASE WHEN k.page IS NULL THEN NULL WHEN f.page IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.0) AS table_ratio, count(*) FILTER (f.h) AS header_pages FROM d LEFT JOIN k ON k.c_custkey = d.c_custkey LEFT JOIN f ON f.o_custkey = d.c_custkey AND f.page = k.page GROUP BY 1"""
)
def table_measures(t: Table) -> DataFrame:
    k = F.col("o_orderkey") % 3
    cells = F.when(k == 0, F.expr("array('A', ' b', 'C', 'd', null, 'text')")).when(k == 1, F.expr("array('A', 'a', 'B', 'b', 'x')")).otherwise(F.expr("array('q', null)"))
    tables = t("orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 30).cast("int").alias("page"), cells.alias("cells"))
    return layout.table_measures(tables, t("customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 40).cast("int").alias("page_count")))


@query(
    r"""SELECT p_partkey, len(list_distinct(list_filter(list_transform(cells, lambda c: upper(trim(coalesce(c, '')))), lambda c: c IN ('A', 'B', 'C', 'D', 'E', 'F', 'G')))) >= 4 AS header, len(list_filter(cells, lambda c: trim(coalesce(c, '')) <> '')) = 0 AS empty_row,
    length(t) < 5 OR (regexp_matches(t, 'Official\s+Journal|L\s+[0-9]{1,4}\s*/\s*[0-9]{1,4}', 'i') AND length(t) < 100 AND length(trim(regexp_replace(t, 'Official\s+Journal|L\s+[0-9]{1,4}\s*/\s*[0-9]{1,4}', '', 'gi'))) < 10) OR t IN ('EN', 'IT') AS margin
    FROM (SELECT *, trim(array_to_string(list_transform(cells, lambda c: coalesce(c, '')), ' ')) AS t FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ['A', 'B', ' c', 'D', p_name] WHEN 1 THEN [' ', NULL] WHEN 2 THEN ['Official Journal', 'L ' || p_partkey % 900 || '/2'] WHEN 3 THEN ['IT'] WHEN 4 THEN ['Official Journal', p_name] ELSE [p_brand, NULL, p_type] END AS cells FROM part))"""
)
def table_rows(t: Table) -> DataFrame:
    k = F.col("p_partkey") % 6
    cells = (
        F.when(k == 0, F.expr("array('A', 'B', ' c', 'D', p_name)")).when(k == 1, F.expr("array(' ', null)")).when(k == 2, F.expr("array('Official Journal', concat('L ', p_partkey % 900, '/2'))"))
        .when(k == 3, F.expr("array('IT')")).when(k == 4, F.expr("array('Official Journal', p_name)")).otherwise(F.expr("array(p_brand, null, p_type)"))
    )
    rows = t("part").select("p_partkey", cells.alias("cells"))
    c = F.col("cells")
    return rows.select("p_partkey", layout.is_header_row(c).alias("header"), layout.is_empty_row(c).alias("empty_row"), layout.is_margin_row(c).alias("margin"))


RUNNING, _running = _put([("seq % 10 = 0", "'Head of the page'"), ("seq % 10 = 9 AND seq % 20 = 9", "'Foot of the page'")])


@query(f"SELECT doc_id, trim(line) AS text, count(*) AS n FROM ({_with(RUNNING)}) WHERE (y0 < 80 OR y0 > 720) AND length(trim(line)) >= 3 GROUP BY 1, 2 HAVING count(*) >= 2")
def repeated_in_bands(t: Table) -> DataFrame:
    return layout.repeated_in_bands(_paged(t, _running), 0.1, 0.1, 2, 3)


@query(f"WITH l AS ({_with(RUNNING)}), r AS (SELECT doc_id, trim(line) AS text FROM l WHERE y0 < 160 OR y0 > 720 GROUP BY 1, 2 HAVING count(*) >= 2) SELECT doc_id, seq, md5(line) AS line FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND r.text = trim(l.line))")
def without_bands(t: Table) -> DataFrame:
    return layout.without_repeated_in_bands(_paged(t, _running).where("length(trim(line)) >= 1 or true"), 0.2, 0.1, 2, 0).select("doc_id", "seq", F.md5("line").alias("line"))


HEADS, _heads = _put([
    ("seq % 14 = 0", "'SEZIONE IV - x'"), ("seq % 14 = 1", "'ALLEGATO B'"), ("seq % 14 = 2", "'PARTE TERZA'"), ("seq % 14 = 3", "'Disposizioni preliminari'"), ("seq % 14 = 4", "'3.1. Titolo'"), ("seq % 14 = 5", "' 123 '"),
    ("seq % 14 = 6", "'Gazzetta ufficiale dell Unione'"), ("seq % 14 = 7", "'3.12.2020 L 12/4 text'"), ("seq % 14 = 8", "'L 12/45'"), ("seq % 14 = 9", "'IT'"), ("seq % 14 = 10", "'MINISTERIO DE HACIENDA'"), ("seq % 14 = 11", "'El Ministerio de Hacienda'"),
])
DIGITS = r"[0-9]{1,2}\s*\.\s*[0-9]{1,2}\s*\.\s*[0-9]{2,4}"
REFERENCE = r"[NnLlCc]\s*\.?\s*[0-9]{1,4}\s*/\s*[0-9]{1,4}"


@query(
    rf"""SELECT doc_id, seq, regexp_matches(x, '^SEZIONE\s+[IVXLC]+', 'i') OR regexp_matches(x, '^ALLEGATO\s+[A-Z0-9]', 'i') OR regexp_matches(x, '^PARTE\s+({layout.ORDINALS})\s*$') OR regexp_matches(x, '^DISPOSIZIONI\s+PRELIMINARI', 'i') AS section,
    regexp_matches(x, '^[0-9]+(\.[0-9]+)*\.?\s+[^\n]{{1,100}}') AS paragraph,
    x = '' OR regexp_matches(x, '^\s*[0-9]{{1,5}}\s*$') OR regexp_matches(x, 'Gazzetta\s+ufficiale\s+(dell[ae]?\s+)?(Unione\s+europea|Comunit[àa]\s+europe[ea])', 'i') OR (regexp_matches(x, '{DIGITS}') AND regexp_matches(x, '{REFERENCE}')) OR (regexp_matches(x, '^{DIGITS}') AND length(x) < 20) OR (regexp_matches(x, '^{REFERENCE}') AND length(x) < 15) OR x = 'IT' AS running,
    length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) > 0 AND regexp_matches(upper(line), '{layout.MINISTRY_WORDS}') AND (length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) > 0.7 * length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) OR seq % 3 = 0) AS ministry
    FROM (SELECT *, trim(line) AS x FROM ({_with(HEADS)}))"""
)
def line_tests(t: Table) -> DataFrame:
    c = F.col("line")
    bold = F.when(F.col("seq") % 3 == 0, 0.6).otherwise(0.5)
    return _paged(t, _heads).select("doc_id", "seq", layout.is_section(c).alias("section"), layout.is_paragraph(c).alias("paragraph"), layout.is_running_head(c).alias("running"), layout.is_ministry(c, bold).alias("ministry"))


@query(rf"SELECT doc_id, seq, trim(line) = '' OR regexp_matches(line, '^\s*[0-9]{{1,5}}\s*$') OR y0 < 40 OR y0 > 760 AS margin, trim(line) <> '' AND length(trim(line)) < 120 AND (size >= 11 * 1.15 OR bold OR (trim(line) = upper(trim(line)) AND length(trim(line)) > 3)) AS title, CASE WHEN size >= 11 * 1.4 THEN 1 WHEN size >= 11 * 1.2 THEN 2 ELSE 3 END AS level FROM ({PAGED})")
def block_tests(t: Table) -> DataFrame:
    c, body = F.col("line"), F.lit(11.0)
    return _paged(t).select("doc_id", "seq", layout.is_bulletin_margin(c, F.col("y0"), F.col("page_height")).alias("margin"), layout.is_title(c, F.col("size"), F.col("bold"), body).alias("title"), layout.title_level(F.col("size"), body).alias("level"))


@query("SELECT DISTINCT doc_id, block, first_value(font) OVER (PARTITION BY doc_id, block ORDER BY n DESC, font) AS font, round(sum(total) OVER (PARTITION BY doc_id, block) / sum(n) OVER (PARTITION BY doc_id, block), 6) AS size FROM (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS block, l_returnflag AS font, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY ALL)")
def block_fonts(t: Table) -> DataFrame:
    spans = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("block"), F.col("l_returnflag").alias("font"), F.col("l_quantity").alias("size"))
    return layout.block_fonts(spans).withColumn("size", F.round("size", 6))


INDEXED, _indexed = _put([
    ("seq = 1", "'INDICE'"), ("seq % 4 = 0", "concat(seq + 1, '.2 Capo ', seq, ' ......... ', seq % 30 + 1)"), ("seq % 4 = 1", "concat('Premessa ', seq, '. ....... ', seq % 30)"), ("seq % 8 = 2", "concat('ab ....... ', 12)"),
])
ENTRIES = rf"""SELECT doc_id, seq, CAST(page AS INTEGER) AS index_page, CASE WHEN num THEN regexp_extract(line, '{layout.NUMBERED_ENTRY}', 1) ELSE '' END AS entry_id,
    rtrim(trim(CASE WHEN num THEN regexp_extract(line, '{layout.NUMBERED_ENTRY}', 2) ELSE regexp_extract(line, '{layout.TEXT_ENTRY}', 1) END), '.') AS title, TRY_CAST(CASE WHEN num THEN regexp_extract(line, '{layout.NUMBERED_ENTRY}', 3) ELSE regexp_extract(line, '{layout.TEXT_ENTRY}', 2) END AS INTEGER) AS target
    FROM (SELECT *, regexp_matches(line, '{layout.NUMBERED_ENTRY}') AS num, max(regexp_matches(line, '\bindice\b', 'i')) OVER (PARTITION BY doc_id ORDER BY page, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ({_with(INDEXED)}) WHERE page <= 5) WHERE seen"""


@query(f"SELECT doc_id, seq, index_page, entry_id, title, target AS page FROM ({ENTRIES}) WHERE target BETWEEN 1 AND 1499 AND (entry_id <> '' OR length(title) > 2)")
def index_entries(t: Table) -> DataFrame:
    return layout.index_entries(_paged(t, _indexed))


STARTS, _starts = _put([("seq % 30 = 21 AND doc_id % 3 = 0", "'Titolo IV'"), ("seq % 30 = 22 AND doc_id % 3 = 0", "'CAPITOLO 2'"), ("seq % 30 = 23 AND doc_id % 3 = 0", "'AMBITO DI APPLICAZIONE'"), ("seq = 12 AND doc_id % 3 = 1", "'Parte seconda - altro'"), ("seq = 4 AND doc_id % 3 = 1", "'Parte seconda ... 4'")])


@query(
    rf"""WITH l AS (SELECT *, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM ({_with(STARTS)}) WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq))
    SELECT doc_id, CAST(min(page) AS INTEGER) AS start_page FROM l WHERE (regexp_matches(trim(line), '^TITOLO [IVXLC]+$', 'i') AND regexp_matches(trim(b), '^Capitolo [0-9]+$', 'i') AND regexp_matches(trim(c), '^[A-ZÀÈÉÙÒÌ][A-ZÀÈÉÙÒÌ0-9 \-'',.]{{4,}}$'))
    OR (NOT contains(line, '...') AND (regexp_matches(trim(line), '^DISPOSIZIONI\s+PRELIMINARI\s*$', 'i') OR regexp_matches(trim(line), '^PARTE\s+({layout.ORDINALS})\s*([-–]\s*.+)?$', 'i'))) GROUP BY doc_id"""
)
def start_pages(t: Table) -> DataFrame:
    return layout.start_pages(_paged(t, _starts))


@query("SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS shift FROM documents WHERE length(text) >= 0")
def page_shifts(t: Table) -> DataFrame:
    """Titles printed on page 2 that stand doc_id % 4 pages later."""
    docs = t("documents").where("text is not null")
    index = docs.select("doc_id", F.lit(1).alias("seq"), F.concat(F.lit("Title of "), "doc_id", F.lit(" here")).alias("title"), F.lit(2).alias("page"))
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("page"))
    text = F.when(F.col("page") == 0, F.concat(F.lit("INDICE\nTitle of "), "doc_id", F.lit(" here"))).when(F.col("page") == 1 + F.col("doc_id") % 4, F.concat(F.lit("x TITLE OF "), "doc_id", F.lit(" HERE"))).otherwise("none")
    return layout.page_shift(index, pages.withColumn("text", text)).withColumn("shift", F.col("shift").cast("int"))


# parsers

BOOK, _book = _put([("seq % 20 = 3", "concat('3.1 Capo ', seq // 20, ' of it')")])


@query(
    f"""WITH l AS ({_with(BOOK)}), i AS (SELECT doc_id, seq AS entry, page, 'Capo ' || (seq // 20) || ' of it' AS title FROM l WHERE seq % 20 = 3), n AS (SELECT *, lead(page) OVER w AS np, lead(title) OVER w AS nt FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY entry)), z AS (SELECT doc_id, max(page) AS last FROM l GROUP BY 1),
    r AS (SELECT n.*, greatest(page, least(coalesce(np, last), last)) AS high FROM n JOIN z USING (doc_id)),
    b AS (SELECT r.doc_id, r.entry, r.title, r.nt, l.seq, l.line, min(CASE WHEN contains(lower(l.line), lower(r.title)) THEN l.seq END) OVER (PARTITION BY r.doc_id, r.entry) AS b FROM r JOIN l ON l.doc_id = r.doc_id AND l.page BETWEEN r.page AND r.high AND l.y0 BETWEEN 80 AND 720),
    e AS (SELECT *, min(CASE WHEN contains(lower(line), lower(nt)) AND seq > coalesce(b, -1) THEN seq END) OVER (PARTITION BY doc_id, entry) AS e FROM b WHERE b IS NULL OR seq >= b)
    SELECT doc_id, CAST(entry AS INTEGER) AS entry, any_value(title) AS title, md5(string_agg(line, chr(10) ORDER BY seq)) AS content FROM e WHERE e IS NULL OR seq < e GROUP BY 1, 2"""
)
def index_chapters(t: Table) -> DataFrame:
    found = _paged(t, _book)
    index = found.where("seq % 20 = 3").select("doc_id", "seq", F.concat(F.lit("Capo "), F.floor(F.col("seq") / 20), F.lit(" of it")).alias("title"), "page")
    last = found.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    return document_parsers.chapters(found, index, last).withColumn("content", F.md5("content"))


CIRCULAR, _circular = _put([
    ("seq % 24 = 2", "concat('SEZIONE ', CASE WHEN seq % 48 = 2 THEN 'II' ELSE concat('XI ', seq) END)"), ("seq % 24 = 3 AND doc_id % 2 = 0", "concat('NORME COMUNI ', seq // 48)"), ("seq % 24 = 7", "concat(seq // 24, '.1 Ambito')"), ("seq % 24 = 12", "concat(seq // 24, '.2.')"), ("seq % 24 = 13", "'Two lines'"), ("seq % 24 = 17", "'4.4 Same'"),
])
BOLD = "(seq % 24 IN (12, 13, 15) OR length(line) % 5 = 0)"


@query(
    rf"""WITH r AS (SELECT doc_id, seq, trim(line) AS line, regexp_matches(trim(line), '^SEZIONE\s+[IVXLC]+', 'i') OR regexp_matches(trim(line), '^ALLEGATO\s+[A-Z0-9]', 'i') OR regexp_matches(trim(line), '^DISPOSIZIONI\s+PRELIMINARI', 'i') AS s, regexp_matches(trim(line), '^[0-9]+(\.[0-9]+)*\.?\s+[^\n]{{1,100}}') AS p, {BOLD} AS b, regexp_matches(trim(line), '{document_parsers.CAPITALS.replace("'", "''")}') AS c
      FROM ({_with(CIRCULAR)}) WHERE trim(line) <> '' AND (size > 9 OR seq % 24 IN (2, 3, 7, 12, 13, 17)) AND (y0 BETWEEN 800 * 0.16 AND 800 * 0.9 OR (y0 < 800 * 0.16 AND regexp_matches(trim(line), '^(PARTE|SEZIONE|DISPOSIZIONI|ALLEGATO)\b', 'i')))),
    a AS (SELECT *, b AND regexp_matches(line, '^[0-9.]+$') AND NOT s AS num, lead(line) OVER w AS nl, coalesce(lead(b AND NOT s AND NOT p) OVER w, false) AS nb, coalesce(lead(c AND NOT s) OVER w, false) AS nc, coalesce(lag(s) OVER w, false) AND c AND NOT s AS name FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
    h AS (SELECT *, CASE WHEN s THEN CASE WHEN nc THEN nl ELSE line END END AS st, CASE WHEN p AND NOT s THEN regexp_extract(line, '^([0-9]+(\.[0-9]+)*\.?)\s+(.+)$', 1) || regexp_extract(line, '^([0-9]+(\.[0-9]+)*\.?)\s+(.+)$', 3) WHEN num AND nb THEN line || nl END AS heading FROM a),
    g AS (SELECT *, count(st) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS section FROM h),
    k AS (SELECT *, max(st) OVER (PARTITION BY doc_id, section) AS section_title, count(heading) OVER (PARTITION BY doc_id, section ORDER BY seq ROWS UNBOUNDED PRECEDING) AS paragraph, heading IS NULL AND NOT s AND NOT name AND NOT b AS plain FROM g WHERE section > 0),
    q AS (SELECT doc_id, section, paragraph, max(section_title) AS section_title, max(heading) AS heading, count(*) FILTER (plain) AS texts, coalesce(string_agg(line, ' ' ORDER BY seq) FILTER (plain), '') AS content FROM k GROUP BY 1, 2, 3)
    SELECT doc_id, section, section_title, paragraph, heading, md5(content) AS content FROM (SELECT *, min(section) OVER (PARTITION BY doc_id, section_title) AS fs, min(paragraph) OVER (PARTITION BY doc_id, section, heading) AS fp FROM (SELECT doc_id, section, paragraph, section_title, coalesce(heading, '0') AS heading, content FROM q WHERE heading IS NOT NULL OR texts > 0)) WHERE fs = section AND fp = paragraph"""
)
def circular_parts(t: Table) -> DataFrame:
    planted = F.col("seq") % 24
    spans = _paged(t, _circular).withColumns({"bold": planted.isin(12, 13, 15) | F.col("bold"), "size": F.when(planted.isin(2, 3, 7, 12, 13, 17), 12.0).otherwise(F.col("size"))})
    return document_parsers.circular(spans).withColumn("content", F.md5("content"))


LOOSE, _loose = _put([("seq % 9 = 1", "concat('  ', seq, '. Capo Terzo ')"), ("seq % 9 = 4", "concat(seq, '. ', repeat('words of it ', 7))"), ("seq % 9 = 6 AND doc_id % 2 = 0", "'Sottotitolo (altro)'"), ("seq % 9 = 8", "concat(' ', seq)")])


@query(
    rf"""WITH r AS (SELECT *, regexp_matches(x, '{document_parsers.NUMBERED}') AND NOT c AS n FROM (SELECT doc_id, seq, x, regexp_matches(x, '{document_parsers.CHAPTER}') AS c FROM (SELECT doc_id, seq, trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS x FROM ({_with(LOOSE)})) WHERE x <> '' AND NOT regexp_matches(x, '^[0-9]+$'))),
    a AS (SELECT *, sum(n::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stretch FROM r),
    b AS (SELECT *, c AND sum(c::INT) OVER (PARTITION BY doc_id, stretch ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1 AS cs, NOT regexp_matches(x, '^[0-9]+\.\s') AND regexp_matches(x, '^[A-Z][\p{{L}}\p{{N}}_\s,\-()/'']{{5,60}}$') AND NOT n AND NOT c AS ss FROM a),
    d AS (SELECT *, sum((cs OR ss OR n)::INT) OVER w AS item, sum(cs::INT) OVER w AS ic, last_value(CASE WHEN cs THEN x END IGNORE NULLS) OVER w AS chapter FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, last_value(CASE WHEN ss THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id, ic ORDER BY seq ROWS UNBOUNDED PRECEDING) AS subtitle FROM d WHERE ic > 0)
    SELECT doc_id, CAST(item AS BIGINT) AS item, any_value(chapter) AS chapter, arg_min(subtitle, seq) AS subtitle, max(CASE WHEN n THEN regexp_extract(x, '{document_parsers.NUMBERED}', 1) END) || '.' AS number, md5(trim(string_agg(CASE WHEN n THEN regexp_extract(x, '{document_parsers.NUMBERED}', 2) ELSE x END, ' ' ORDER BY seq))) AS content FROM e GROUP BY 1, 2 HAVING max(n::INT) = 1"""
)
def loose_parts(t: Table) -> DataFrame:
    blocks = _paged(t, _loose).select("doc_id", "seq", F.col("line").alias("text"))
    return document_parsers.without_index(blocks).withColumn("content", F.md5("content"))


@query()
def general_parts(t: Table) -> DataFrame:
    blocks = _paged(t).withColumnRenamed("line", "text")
    return document_parsers.general_parts(blocks, 11.0, 1000, 1500)


@query(
    r"""SELECT doc_id, regexp_extract(x, '(REGOLAMENTO\s+\((?:UE|CE|CEE)\)\s+N\.\s*[0-9]+/[0-9]+|DIRETTIVA\s+[0-9]+/[0-9]+/(?:UE|CE|CEE))', 1, 'i') AS act_type, regexp_extract(x, 'del\s+([0-9]{1,2}\s+\w+\s+[0-9]{4})', 1, 'i') AS act_date,
    CASE WHEN contains(upper(x), 'COMMISSIONE EUROPEA') THEN 'COMMISSIONE EUROPEA' WHEN contains(upper(x), 'CONSIGLIO') THEN 'CONSIGLIO' ELSE '' END AS institution
    FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Regolamento (UE) n. ' || doc_id || '/2012 del Consiglio del 4 luglio 2012 ' WHEN 1 THEN 'DIRETTIVA 2014/' || doc_id || '/UE della Commissione europea e del consiglio ' ELSE '' END || coalesce(text, '') AS x FROM documents)"""
)
def act_metadata(t: Table) -> DataFrame:
    k, i = F.col("doc_id") % 3, F.col("doc_id")
    head = F.when(k == 0, F.concat(F.lit("Regolamento (UE) n. "), i, F.lit("/2012 del Consiglio del 4 luglio 2012 "))).when(k == 1, F.concat(F.lit("DIRETTIVA 2014/"), i, F.lit("/UE della Commissione europea e del consiglio "))).otherwise("")
    return document_parsers.act_metadata(t("documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text")))


@query(
    """WITH r AS (SELECT o_custkey AS doc_id, CAST(o_orderkey // 1000 AS INTEGER) AS page, o_orderkey AS seq, o_orderkey % 7 = 0 AS h, o_orderkey % 2 = 0 AS wide, CAST(o_orderkey AS VARCHAR) AS k FROM orders),
    a AS (SELECT *, last_value(CASE WHEN h THEN wide END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, seq ROWS UNBOUNDED PRECEDING) AS w FROM r)
    SELECT doc_id, page, seq, k AS section_num, 'bb' AS sub_item, 'cc' AS element_name, 'dd' AS requirement, 'ee' AS condition, CASE WHEN w THEN 'f1 | f2' ELSE 'f1' END AS description, CASE WHEN w THEN 'gg' ELSE 'f2' END AS data_format FROM a WHERE w IS NOT NULL AND NOT h"""
)
def annex_rows(t: Table) -> DataFrame:
    o = F.col("o_orderkey")
    cells = F.when((o % 7 == 0) & (o % 2 == 0), F.expr("array('A', 'b', 'C', 'D', 'E', 'F', null, ' g ')")).when(o % 7 == 0, F.expr("array('A', 'B', 'C', 'D', 'E', 'F', 'G')")).otherwise(F.expr("array(cast(o_orderkey as string), 'bb ', 'cc', 'dd', 'ee', 'f1', ' f2', 'gg')"))
    tables = t("orders").select(F.col("o_custkey").alias("doc_id"), F.floor(o / 1000).cast("int").alias("page"), o.alias("seq"), cells.alias("cells"))
    return document_parsers.annex_rows(tables)


@query(
    rf"""WITH l AS (SELECT doc_id, seq, CASE WHEN seq % 4 = 0 AND doc_id % 3 <> 1 THEN 'Articolo ' || (seq // 4 + 1) ELSE line END AS line FROM ({LINES}))
    SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'general' WHEN doc_id % 3 <> 1 THEN 'regolamento' ELSE 'contenuto' END AS parser, count(*) AS parts FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN seq WHEN doc_id % 3 <> 1 THEN seq // 4 ELSE 0 END AS part FROM l GROUP BY ALL) GROUP BY 1, 2"""
)
def routed_parts(t: Table) -> DataFrame:
    """Documents of three types; a third of them has no articles, so that the regulation's parser gives way to plain text."""
    heading = F.when((F.col("seq") % 4 == 0) & (F.col("doc_id") % 3 != 1), F.concat(F.lit("Articolo "), F.floor(F.col("seq") / 4) + 1)).otherwise(F.col("line"))
    found = lines.lines_of(t("documents")).withColumn("line", heading)
    k = F.col("doc_id") % 4
    profiles = t("documents").select("doc_id", F.when(k == 3, "general").when(k == 2, "boe").otherwise("regolamento").alias("detected_type"))
    own = lambda ids: found.join(ids, "doc_id", "left_semi")
    each = {
        "general": lambda ids: own(ids).select("doc_id", "seq"), "regolamento": lambda ids: parsers.regulation(own(ids)).select("doc_id", F.col("segment").cast("int").alias("seq")),
        "contenuto": lambda ids: ids.select("doc_id", F.lit(0).alias("seq")), "boe": lambda ids: own(ids).where("false").select("doc_id", "seq"),
    }
    return document_parsers.routed(profiles, each).groupBy("doc_id", "parser").agg(F.count(F.lit(1)).alias("parts"))


@query(
    r"""SELECT doc_id, coalesce(nullif(regexp_extract(x, '\b(?:n\.\s*)?([0-9]{3,4}/[0-9]{4})\b', 1, 'i'), ''), CASE WHEN regexp_extract(stem, '([0-9]{4,5})[RD]([0-9]{3,4})(_|$)', 2, 'i') <> '' THEN regexp_extract(stem, '([0-9]{4,5})[RD]([0-9]{3,4})(_|$)', 1, 'i') || '/' || lpad(regexp_extract(stem, '([0-9]{4,5})[RD]([0-9]{3,4})(_|$)', 2, 'i'), 4, '0') END, 'CODICE_NON_TROVATO') AS code,
    nullif(regexp_extract(x, 'REGOLAMENTO\s*\(UE\)\s*N\.\s*([0-9]+/[0-9]+)', 0, 'i'), '') AS header FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Regolamento (UE) n. 648/2012 e n. 5/1 ' ELSE 'x ' END || substr(coalesce(text, ''), 1, 0) AS x, CASE WHEN doc_id % 3 = 0 THEN '32017R' || (100 + doc_id % 900) || '_it' ELSE 'report' END AS stem FROM documents)"""
)
def document_codes(t: Table) -> DataFrame:
    text = F.when(F.col("doc_id") % 4 == 0, "Regolamento (UE) n. 648/2012 e n. 5/1 ").otherwise("x ")
    stem = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("32017R"), 100 + F.col("doc_id") % 900, F.lit("_it"))).otherwise("report")
    return t("documents").select("doc_id", X.document_code(text, stem).alias("code"), X.regulation_header(text).alias("header"))


# versions

# Three levels made of lines: a line is an article, its sentences are paragraphs; every fifth line is dropped from the new version, every fourth from the old.
OLD_LINE = "CASE WHEN seq % 7 = 3 THEN line || '. and more' ELSE line END"
LEVELS = lambda name, keep, text, placeholder: rf"""{name} AS (SELECT doc_id, seq, 'Art. ' || CASE WHEN seq % 17 = 16 THEN '' ELSE CAST(seq + 1 AS VARCHAR) END AS art_id, {text} AS content, {placeholder} AS ph, lower(regexp_replace(CASE WHEN seq % 17 = 16 THEN 'Art.' ELSE 'Articolo' || (seq + 1) END, '[^A-Za-z0-9]', '', 'g')) AS key FROM ({LINES}) WHERE {keep}),
{name}p AS (SELECT doc_id, seq, CAST(i - 1 AS INTEGER) AS par_seq, CAST(i AS VARCHAR) AS par_key, p[i] AS content FROM (SELECT *, string_split(content, '. ') AS p FROM {name}) x, unnest(range(1, len(p) + 1)) AS u(i))"""  # noqa: E731
VERSIONS = rf"""WITH {LEVELS("n", "seq % 5 <> 1", "line", "seq % 11 = 5")}, {LEVELS("o", "seq % 4 <> 2", OLD_LINE, "seq % 13 = 5")},
ol AS (SELECT doc_id, key, max(seq) AS seq, arg_max(content, seq) AS content, arg_max(ph, seq) AS ph, arg_max(art_id, seq) AS art_id FROM o GROUP BY 1, 2),
a AS (SELECT n.doc_id, n.key, n.seq AS art_seq, n.art_id, ol.seq AS os, CASE WHEN length(n.key) <= 4 THEN 'Scartato' WHEN n.ph THEN 'Eliminato' WHEN ol.seq IS NULL THEN 'Inserito' WHEN {CLEAN("n.content")} = {CLEAN("ol.content")} THEN 'Confermato' WHEN ol.ph THEN 'Inserito' ELSE 'Da Verificare' END AS verdict FROM n LEFT JOIN ol ON ol.doc_id = n.doc_id AND ol.key = n.key),
av AS (SELECT doc_id, art_seq, art_id AS id, CASE WHEN verdict IN ('Confermato', 'Da Verificare') THEN os END AS old_art_seq, verdict FROM a
  UNION ALL SELECT o.doc_id, NULL, ol.art_id, o.seq, 'Rimosso' FROM o JOIN ol USING (doc_id, key) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = o.doc_id AND n.key = o.key)),
p AS (SELECT np.doc_id, np.seq AS art_seq, np.par_seq, np.par_key AS par_id, op.par_seq AS ops, av.verdict AS above, {CLEAN("np.content")} = {CLEAN("op.content")} AS same, np.seq % 11 = 4 AND np.par_seq = 1 AS ph FROM np JOIN av ON av.doc_id = np.doc_id AND av.art_seq = np.seq LEFT JOIN op ON op.doc_id = np.doc_id AND op.seq = av.old_art_seq AND op.par_key = np.par_key),
pv AS (SELECT doc_id, art_seq, par_seq, par_id, ops, above IN ('Eliminato', 'Inserito', 'Scartato') AS down, CASE WHEN above IN ('Eliminato', 'Inserito', 'Scartato') THEN above WHEN above = 'Confermato' THEN CASE WHEN coalesce(same, false) THEN 'Confermato' ELSE 'Errore' END WHEN ph THEN 'Eliminato' WHEN ops IS NOT NULL AND same THEN 'Confermato' WHEN ops IS NOT NULL THEN 'Aggiornato' ELSE 'Inserito' END AS verdict FROM p),
pr AS (SELECT doc_id, art_seq, par_seq, par_id, CASE WHEN NOT down AND verdict IN ('Confermato', 'Aggiornato') THEN ops END AS old_par_seq, verdict, CASE WHEN down THEN 'Ereditato' END AS note FROM pv),
rel AS (SELECT doc_id, old_art_seq, max(art_seq) AS nas, max(verdict = 'Rimosso') AS gone FROM av WHERE old_art_seq IS NOT NULL GROUP BY 1, 2),
rp AS (SELECT op.doc_id, op.par_key AS par_id, op.par_seq, rel.gone FROM op JOIN rel ON rel.doc_id = op.doc_id AND rel.old_art_seq = op.seq WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.doc_id = op.doc_id AND pr.art_seq = rel.nas AND pr.old_par_seq = op.par_seq)),
every AS (SELECT doc_id, 'Capitolo' AS level, art_seq, CAST(NULL AS INTEGER) AS par_seq, id, old_art_seq, CAST(NULL AS INTEGER) AS old_par_seq, verdict, CAST(NULL AS VARCHAR) AS note FROM av
  UNION ALL SELECT doc_id, 'Paragrafo', art_seq, par_seq, par_id, NULL, old_par_seq, verdict, note FROM pr
  UNION ALL SELECT doc_id, 'Paragrafo', NULL, NULL, par_id, NULL, par_seq, 'Rimosso', CASE WHEN gone THEN 'Ereditato' END FROM rp
  UNION ALL SELECT doc_id, 'Paragrafo', seq, par_seq, par_key, NULL, NULL, 'Scartato', NULL FROM np)"""


def _versions(t: Table) -> tuple[DataFrame, DataFrame]:
    def levels(found: DataFrame) -> DataFrame:
        articles = found.select("doc_id", F.lit("article").alias("level"), F.col("seq").alias("art_seq"), F.lit(None).cast("int").alias("par_seq"), F.lit(None).cast("int").alias("sub_seq"), "art_id", F.lit(None).cast("string").alias("par_id"), "content", "is_placeholder")
        p = found.select("*", F.posexplode(F.split("content", r"\. ")).alias("par_seq", "p"))
        ids = ("doc_id", F.col("seq").alias("art_seq"), "par_seq")
        paragraphs = p.select(*ids, F.lit("paragraph").alias("level"), F.lit(None).cast("int").alias("sub_seq"), "art_id", (F.col("par_seq") + 1).cast("string").alias("par_id"), F.col("p").alias("content"), ((F.col("seq") % 11 == 4) & (F.col("par_seq") == 1)).alias("is_placeholder"))
        subs = p.select(*ids, F.lit("sub").alias("level"), F.lit(0).alias("sub_seq"), "art_id", (F.col("par_seq") + 1).cast("string").alias("par_id"), F.col("p").alias("content"), F.lit(False).alias("is_placeholder"))
        return articles.unionByName(paragraphs).unionByName(subs)

    all_ = lines.lines_of(t("documents")).withColumn("art_id", F.when(F.col("seq") % 17 == 16, "Art. ").otherwise(F.concat(F.lit("Art. "), F.col("seq") + 1)))
    new = all_.where("seq % 5 <> 1").withColumn("content", F.col("line")).withColumn("is_placeholder", F.col("seq") % 11 == 5)
    old = all_.where("seq % 4 <> 2").withColumn("content", F.when(F.col("seq") % 7 == 3, F.concat("line", F.lit(". and more"))).otherwise(F.col("line"))).withColumn("is_placeholder", F.col("seq") % 13 == 5)
    return levels(new), levels(old)


@query(VERSIONS + " SELECT * FROM every")
def version_levels(t: Table) -> DataFrame:
    return versioning.compare(*_versions(t)).drop("sub_seq")


@query(VERSIONS + " SELECT level, verdict, count(*) AS n FROM every GROUP BY 1, 2")
def verdict_counts(t: Table) -> DataFrame:
    return versioning.verdict_counts(versioning.compare(*_versions(t)))


@query(
    """WITH p AS (SELECT a.o_custkey AS doc_id, CAST(a.o_orderkey AS INTEGER) AS art_seq, CAST(b.o_orderkey AS INTEGER) AS old_art_seq, 35 - abs(a.o_orderkey % 40 - b.o_orderkey % 40) AS score, a.o_orderkey % 40 = b.o_orderkey % 40 AS same FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1)
    SELECT doc_id, art_seq, old_art_seq, score, CASE WHEN same THEN 'Confermato' ELSE 'Da Verificare II' END AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, art_seq ORDER BY score DESC, old_art_seq) AS r FROM p WHERE score >= 20) WHERE r = 1"""
)
def second_chances(t: Table) -> DataFrame:
    o = t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("k"))
    inserted = o.where("k % 2 = 0").select("doc_id", F.col("k").alias("art_seq"), (F.col("k") % 40).alias("hash"))
    removed = o.where("k % 2 = 1").select("doc_id", F.col("k").alias("old_art_seq"), (F.col("k") % 40).alias("old_hash"))
    return versioning.second_chance(inserted, removed, (35 - F.abs(F.col("hash") - F.col("old_hash"))).cast("long"))


@query(
    """WITH n AS (SELECT o_custkey AS doc_id, o_orderkey // 4 AS par_seq, 'paragraph number ' || (o_orderkey % 25) AS k, o_orderstatus AS c FROM orders WHERE o_orderkey % 2 = 0), o AS (SELECT o_custkey AS doc_id, o_orderkey // 4 AS par_seq, 'paragraph number ' || (o_orderkey % 23) AS k, o_orderstatus AS c FROM orders WHERE o_orderkey % 2 = 1),
    p AS (SELECT n.*, o.par_seq AS os, o.c AS oc, levenshtein(n.k, o.k) AS d, coalesce(levenshtein(n.k, o.k) = 0 OR levenshtein(n.k, o.k) < 0.1 * length(n.k), false) AS fits FROM n LEFT JOIN o USING (doc_id)),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, par_seq ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, d NULLS FIRST, os NULLS FIRST) AS r FROM p)
    SELECT doc_id, CAST(par_seq AS INTEGER) AS par_seq, CAST(CASE WHEN fits THEN os END AS INTEGER) AS old_par_seq, CASE WHEN NOT fits THEN 'Inserito' WHEN d = 0 AND c = oc THEN 'Confermato' ELSE 'Aggiornato' END AS verdict FROM q WHERE r = 1"""
)
def renamed_paragraphs(t: Table) -> DataFrame:
    def side(k: int, n: int) -> DataFrame:
        o = F.col("o_orderkey")
        return t("orders").where(o % 2 == k).select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("art_seq"), F.lit(1).alias("of"), F.floor(o / 4).cast("int").alias("par_seq"), F.concat(F.lit("paragraph number "), o % n).alias("par_key"), F.col("o_orderstatus").alias("clean"))

    return versioning.renamed_paragraphs(side(0, 25), side(1, 23).drop("art_seq")).drop("art_seq")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE WHEN o_orderstatus = 'F' THEN 'Rimosso' WHEN o_orderstatus = 'P' THEN 'Eliminato' ELSE l_returnflag END AS verdict FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def extended_verdicts(t: Table) -> DataFrame:
    s = F.col("o_orderstatus")
    articles = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("old_art_seq"), F.when(s == "F", "Rimosso").when(s == "P", "Eliminato").otherwise("Confermato").alias("verdict"))
    children = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.lit(1).alias("art_seq"), F.col("l_returnflag").alias("verdict"))
    return versioning.extended_to_children(children, articles).drop("art_seq")


# rows of comparisons


def _tree(t: Table) -> DataFrame:
    """Orders as documents: each line an article with one paragraph, whose sub-paragraphs have references by the line's number."""
    match = F.expr("array(named_struct('art_id', concat('Art. ', l_partkey % 9), 'title', l_shipdate_text, 'par_id', cast(l_suppkey % 4 as string), 'content', l_returnflag, 'reason', case when l_partkey % 2 = 0 then 'why' end))")
    none = F.expr("cast(array() as array<struct<art_id:string,title:string,par_id:string,content:string,reason:string>>)")
    rows = t("lineitem").withColumn("l_shipdate_text", F.date_format("l_shipdate", "yyyy-MM-dd")).withColumn("m", F.when(F.col("l_partkey") % 3 == 0, none).otherwise(match))
    refs = F.expr("transform(sequence(1, 3), i -> named_struct('doc_name', concat('d', i), 'doc_code', concat(l_suppkey % 5, '/', i), 'matches', m))")
    rows = rows.withColumn("refs", F.when(F.col("l_linenumber") % 2 == 0, F.slice(refs, 1, 2)).otherwise(F.slice(refs, 1, 0)))
    subs = F.expr("array(named_struct('sub_id', 's0', 'content', l_linestatus, 'requirement', concat('req ', l_linenumber), 'refs', refs), named_struct('sub_id', 's1', 'content', l_returnflag, 'requirement', cast(null as string), 'refs', slice(refs, 1, 1)))")
    paragraphs = F.expr("array(named_struct('par_id', 'p0', 'content', l_returnflag, 'subs', subs))")
    return rows.withColumn("subs", subs).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("art_seq"), F.concat(F.lit("Articolo "), "l_linenumber").alias("art_id"), F.col("l_shipdate_text").alias("title"), F.col("l_linenumber").alias("page"), F.col("l_linestatus").alias("content"), F.when(F.col("l_linenumber") < 6, paragraphs).alias("paragraphs"))


@query(
    """WITH l AS (SELECT *, l_linenumber % 2 = 0 AS e FROM lineitem), s AS (SELECT *, unnest([0, 1]) AS sub_seq FROM l WHERE l_linenumber < 6), r AS (SELECT *, unnest(CASE WHEN NOT e THEN [] WHEN sub_seq = 0 THEN [0, 1] ELSE [0] END) AS ref_seq FROM s)
    SELECT l_orderkey AS doc_id, l_linenumber AS art_seq, 'Articolo' AS kind, CAST(NULL AS VARCHAR) AS par_id, CAST(NULL AS VARCHAR) AS sub_id, CAST(NULL AS INTEGER) AS ref_seq, l_linestatus AS text, CAST(NULL AS VARCHAR) AS ref_code, CAST(NULL AS VARCHAR) AS ref_art, CAST(NULL AS INTEGER) AS coefficient, CAST(NULL AS VARCHAR) AS detail FROM l
    UNION ALL SELECT l_orderkey, l_linenumber, 'Comma', 'p0', NULL, NULL, l_returnflag, NULL, NULL, NULL, NULL FROM l WHERE l_linenumber < 6
    UNION ALL SELECT l_orderkey, l_linenumber, 'Sottocomma', 'p0', 's' || sub_seq, NULL, CASE sub_seq WHEN 0 THEN l_linestatus ELSE l_returnflag END, NULL, NULL, NULL, NULL FROM s WHERE NOT e
    UNION ALL SELECT l_orderkey, l_linenumber, 'Rif. Sottocomma', 'p0', 's' || sub_seq, CAST(ref_seq AS INTEGER), CASE sub_seq WHEN 0 THEN l_linestatus ELSE l_returnflag END, (l_suppkey % 5) || '/' || (ref_seq + 1), CASE WHEN l_partkey % 3 <> 0 THEN 'Art. ' || (l_partkey % 9) END, CASE WHEN l_suppkey % 5 = 2 AND ref_seq = 0 THEN 30 ELSE 1 END,
      CASE WHEN l_suppkey % 5 = 2 AND ref_seq = 0 THEN coalesce(CASE WHEN l_partkey % 3 <> 0 AND l_partkey % 2 = 0 THEN 'why' END, CASE sub_seq WHEN 0 THEN 'req ' || l_linenumber END, '') ELSE '' END FROM r"""
)
def reference_rows(t: Table) -> DataFrame:
    return shapes.reference_rows(_tree(t), "2/1").select("doc_id", "art_seq", "kind", "par_id", "sub_id", "ref_seq", "text", "ref_code", "ref_art", "coefficient", "detail")


@query(
    """SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE l_linenumber % 4 WHEN 0 THEN 'Articolo' WHEN 1 THEN 'Comma' ELSE 'Sottocomma' END AS level, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE 'c' || (l_partkey % 5) END AS paragraph, CASE WHEN l_linenumber % 4 = 2 THEN 's1' END AS sub,
    CASE l_linenumber % 4 WHEN 0 THEN 'content' WHEN 1 THEN l_returnflag ELSE l_linestatus END AS text, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE trim('Articolo: ' || (l_suppkey % 9) || ' Paragrafo: ' || CASE WHEN l_suppkey % 2 = 0 THEN '3' ELSE '' END) END AS "references",
    CASE WHEN l_partkey % 3 = 0 THEN 'second' WHEN l_partkey % 3 = 1 THEN 'first' WHEN l_linenumber % 4 = 0 THEN 'STRINGA VUOTA' ELSE '' END AS description FROM lineitem WHERE l_linenumber % 4 <> 3"""
)
def amendment_rows(t: Table) -> DataFrame:
    e = F.expr
    compared = t("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), e("element_at(array('Articolo', 'Comma', 'Sottocomma', 'Riferimenti'), cast(l_linenumber % 4 + 1 as int))").alias("level"), F.lit("a").alias("article"), F.lit("t").alias("title"), F.lit("content").alias("content"),
        e("concat('c', l_partkey % 5)").alias("par_id"), F.col("l_returnflag").alias("par_content"), F.lit("s1").alias("sub_id"), F.col("l_linestatus").alias("sub_content"), e("cast(l_suppkey % 9 as string)").alias("ref_art"), e("case when l_suppkey % 2 = 0 then '3' end").alias("ref_par"),
        F.lit("m").alias("motive"), e("case when l_partkey % 3 < 2 then 'first' else '' end").alias("first_detail"), e("case when l_partkey % 3 = 0 then 'second' else ' ' end").alias("second_detail"),
    )
    return shapes.amendment_rows(compared).select("doc_id", "seq", "level", "paragraph", "sub", "text", "references", "description")


@query(
    """SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE WHEN k = 0 THEN 'Capitolo' ELSE 'Paragrafo' END AS level, CASE WHEN gone THEN '' ELSE 'n' || l_partkey END AS name, CASE WHEN gone OR k = 0 THEN '' ELSE 'p1' END AS paragraph, CASE WHEN gone THEN '' ELSE x END AS text, CASE WHEN gone THEN 'n' || l_partkey ELSE 'old' END AS related_name, CASE WHEN gone THEN x ELSE 'text' END AS related_text, CASE WHEN gone THEN 'Rimosso' ELSE 'Confermato' END AS verdict
    FROM (SELECT *, l_linenumber % 3 AS k, l_suppkey % 2 = 0 AS gone, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE l_linestatus END AS x FROM lineitem WHERE l_linenumber % 3 < 2)"""
)
def version_rows(t: Table) -> DataFrame:
    e = F.expr
    compared = t("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), e("element_at(array('Articolo', 'Comma', 'Sottocomma'), cast(l_linenumber % 3 + 1 as int))").alias("level"), e("concat('n', l_partkey)").alias("name"), F.col("l_returnflag").alias("content"), F.lit("p1").alias("par_id"),
        F.col("l_linestatus").alias("par_content"), F.lit("old").alias("old_name"), F.lit("text").alias("old_content"), e("case when l_suppkey % 2 = 0 then 'Rimosso' else 'Confermato' end").alias("verdict"), F.lit("").alias("description"),
    )
    return shapes.version_rows(compared).drop("description")


@query("SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS seq, o_orderstatus AS compared_title, CAST(o_orderkey % 31 AS INTEGER) AS coefficient FROM orders")
def title_coefficients(t: Table) -> DataFrame:
    scored = t("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("own"))
    scores = F.transform("own", lambda x: F.struct(x["o_orderstatus"].alias("title"), (x["o_orderkey"] % 31).cast("int").alias("coefficient")))
    return shapes.title_coefficients(scored.select("doc_id", F.lit("a").alias("art_id"), F.lit("t").alias("title"), scores.alias("scores"))).drop("art_id", "title")


@query(
    """WITH p AS (SELECT o_custkey AS doc_id, 'c' || (o_orderkey % 3) AS paragraph, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pair_seq, CAST(o_orderkey % 7 AS INTEGER) AS coefficient FROM orders), k AS (SELECT * FROM p WHERE o_orderkey % 5 <> 0)
    SELECT doc_id, paragraph, pair_seq, coefficient, CASE WHEN row_number() OVER (PARTITION BY doc_id, paragraph ORDER BY coefficient DESC, pair_seq) > 1 THEN 'x' ELSE '' END AS secondary FROM k"""
)
def pair_rows(t: Table) -> DataFrame:
    own = t("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("own"))
    pair = lambda x: F.struct(
        F.concat(F.lit("c"), x["o_orderkey"] % 3).alias("left_id"), F.lit("l").alias("left"), F.lit("r").alias("right_id"), F.when(x["o_orderkey"] % 5 == 0, "Scheda del Documento").otherwise(x["o_orderstatus"]).alias("right"), (x["o_orderkey"] % 7).cast("int").alias("coefficient")
    )
    best = F.array(F.struct(F.lit("b").alias("art_id"), F.lit("title").alias("title"), F.transform("own", pair).alias("pairs")))
    return shapes.pair_rows(own.select("doc_id", F.lit("a").alias("art_id"), F.lit("t").alias("title"), best.alias("best"))).select("doc_id", "paragraph", "pair_seq", "coefficient", "secondary")


@query(
    """SELECT o_orderkey AS pair_id, a.l_linenumber AS left_leaf, b.l_linenumber AS right_leaf FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_orderkey = o_orderkey + 1 WHERE b.l_partkey % 4 <> 0"""
)
def leaf_pairs(t: Table) -> DataFrame:
    matches = t("orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_orderkey").alias("left_art"), (F.col("o_orderkey") + 1).alias("right_art"))
    leaves = t("lineitem").select(F.col("l_orderkey").alias("art"), F.col("l_linenumber").alias("leaf"), F.when(F.col("l_partkey") % 4 == 0, "Storia del documento").otherwise("t").alias("title"), F.col("l_returnflag").alias("content"))
    return shapes.leaf_pairs(matches, leaves, leaves).select("pair_id", "left_leaf", "right_leaf")


@query(
    """WITH r AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN '0' ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS sub_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Art. ' || o_orderkey END AS article FROM orders), g AS (SELECT *, count(*) FILTER (sub_id = '0') OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM r)
    SELECT doc_id, seq, last_value(article IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS carried FROM g"""
)
def carried_articles(t: Table) -> DataFrame:
    o = F.col("o_orderkey")
    rows = t("orders").select(F.col("o_custkey").alias("doc_id"), o.alias("seq"), (o % 5).alias("sub_id"), F.when(o % 3 == 0, F.concat(F.lit("Art. "), o)).alias("article"))
    return shapes.carried_articles(rows).select("doc_id", "seq", "carried")


# values put back


@query("SELECT o_custkey AS doc_id, string_agg(CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END || '/' || o_orderstatus, ',' ORDER BY o_orderkey) AS names FROM orders GROUP BY 1")
def reinserted_values(t: Table) -> DataFrame:
    """Names at a path are taken out with their coordinates, a third of them changed, and put back."""
    own = t("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("own"))
    users = F.transform("own", lambda x: F.struct(F.struct(x["o_orderpriority"].alias("name"), x["o_orderstatus"].alias("role")).alias("profile"), x["o_orderkey"].alias("key")))
    docs = own.select("doc_id", users.alias("users"))
    found = hierarchy.path_values(docs.select("doc_id", "users"), "doc_id", ["users", "profile", "name"])
    keys = docs.select("doc_id", F.posexplode("users").alias("at", "u")).select("doc_id", "at", F.col("u.key").alias("key"))
    changed = found.withColumn("at", F.get("coordinates", F.lit(0))).join(keys, ["doc_id", "at"]).where("key % 3 = 0").select("doc_id", "coordinates", F.upper("value").alias("value"))
    back = shapes.reinserted(docs, changed, "doc_id", ["users", "profile", "name"])
    return back.select("doc_id", F.array_join(F.transform("users", lambda u: F.concat_ws("/", u["profile"]["name"], u["profile"]["role"])), ",").alias("names"))


# filters, ids, unions


@query("SELECT c_custkey, id FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Articolo 1' WHEN 1 THEN '12' ELSE 'a' END AS id, c_custkey % 3 AS g, CASE WHEN c_custkey % 7 = 0 THEN 'Le Definizioni' ELSE c_name END AS title, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '648/2012' ELSE '1/1' END AS code FROM customer) WHERE title NOT LIKE '%efinizioni%' AND id <> '12' AND code IN ('', '648/2012')")
def article_filters(t: Table) -> DataFrame:
    """Definitions, purely numeric ids (twice: always, and in law mode) and articles of other codes go."""
    rows = t("customer").select(
        "c_custkey", F.expr("case c_custkey % 4 when 0 then 'Articolo 1' when 1 then '12' else 'a' end").alias("id"), (F.col("c_custkey") % 3).alias("g"), F.when(F.col("c_custkey") % 7 == 0, "Le Definizioni").otherwise(F.col("c_name")).alias("title"),
        F.expr("case c_custkey % 5 when 0 then null when 1 then '648/2012' else '1/1' end").alias("code"), F.lit("article").alias("level"),
    )
    kept = shapes.relevant_to(shapes.without_definitions(shapes.of_levels(rows, "article")), "code", F.lit("648/2012"))
    return shapes.without_numeric_ids(shapes.law_mode(kept, "g", "id"), "id").select("c_custkey", "id")


@query("SELECT p_partkey AS Tipo, p_name AS Comma, p_type AS Contenuto, p_brand AS Altro, p_size AS \"Rif-Articolo\" FROM part WHERE p_partkey % 3 <> 0")
def uncoded_rows(t: Table) -> DataFrame:
    code = F.expr("case p_partkey % 3 when 0 then '1/1' when 1 then ' NaN' end").alias(shapes.DOCUMENT_CODE)
    table = t("part").select(F.col("p_size").alias("before"), code, F.col("p_partkey").alias("Tipo"), F.col("p_type").alias("Contenuto"), F.col("p_name").alias("Comma"), F.col("p_brand").alias("Altro"), F.col("p_size").alias("Rif-Articolo"))
    return shapes.uncoded_from_kind(table)


@query("SELECT o_custkey AS doc_id, string_agg(r, chr(10) ORDER BY o_orderkey) AS requirements FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_orderpriority ELSE '' END AS r FROM orders) WHERE r <> '' GROUP BY 1 UNION ALL SELECT o_custkey, '' FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 3 = 1) = 0")
def joined_requirements(t: Table) -> DataFrame:
    units = t("orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.expr("case o_orderkey % 3 when 0 then null when 1 then o_orderpriority else ' ' end").alias("requirement"))
    return shapes.joined_requirements(units, ["doc_id"], "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS every_one, true AS some, CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 's' ELSE l_returnflag END WHEN l_linenumber % 3 = 1 THEN l_returnflag ELSE l_linestatus END AS content FROM lineitem")
def reference_presence(t: Table) -> DataFrame:
    e = F.expr
    subs = e("array(named_struct('refs', array('r')), named_struct('refs', case when l_linenumber % 2 = 0 then array('r') else cast(array() as array<string>) end))")
    level = e("element_at(array('sub', 'paragraph', 'article'), cast(l_linenumber % 3 + 1 as int))")
    content = shapes.section_content(level, e("case when l_partkey % 2 = 0 then 's' else ' ' end"), F.col("l_returnflag"), F.col("l_linestatus"))
    return t("lineitem").select("l_orderkey", "l_linenumber", shapes.all_have_references(subs).alias("every_one"), shapes.any_has_references(subs).alias("some"), content.alias("content"))


@query("SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(coalesce((SELECT max(c.o_orderkey % 10) FROM orders c WHERE c.o_custkey = o.o_custkey AND c.o_orderkey % 2 = 1), 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS part_id FROM orders o WHERE o_orderkey % 2 = 0")
def numbered_parts(t: Table) -> DataFrame:
    o = t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"))
    return shapes.numbered_after(o.where("k % 2 = 0"), o.where("k % 2 = 1").select("doc_id", (F.col("k") % 10).alias("part_id")), "k")


@query("SELECT level, count(*) AS n, count(part_id) AS parts, count(seq) AS sections, count(title) AS titles FROM (SELECT 'part' AS level, o_orderkey AS part_id, NULL AS seq, NULL AS title FROM orders UNION ALL SELECT 'section', NULL, c_nationkey, c_name FROM customer UNION ALL SELECT 'document', NULL, NULL, n_name FROM nation) GROUP BY 1")
def all_parts(t: Table) -> DataFrame:
    parts = t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("part_id"))
    sections = t("customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("seq"), F.col("c_name").alias("title"))
    documents = t("nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_name").alias("title"))
    return shapes.all_parts(parts, sections, documents).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count("part_id").alias("parts"), F.count("seq").alias("sections"), F.count("title").alias("titles"))


@query("SELECT o_custkey AS doc_id, count(*) AS sections, string_agg(o_orderstatus, chr(10) ORDER BY o_orderkey) AS content FROM orders GROUP BY 1")
def document_syntheses(t: Table) -> DataFrame:
    return shapes.document_synthesis(t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("content")))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr(text, 1, 100) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def distinct_openings(t: Table) -> DataFrame:
    return shapes.first_by_prefix(t("documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("SELECT o_custkey AS doc_id, CAST(o_orderkey % 2 AS INTEGER) AS art_seq, array_to_string(list_slice(list(o_orderpriority ORDER BY o_orderkey), 1, 3), ' ') AS text FROM orders GROUP BY 1, 2")
def embedding_texts(t: Table) -> DataFrame:
    units = t("orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 2).cast("int").alias("art_seq"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("piece"))
    return shapes.embedding_text(units, 3)


@query("SELECT name, CASE WHEN a % 3 = 0 THEN 'Doc ' || a ELSE substr(md5(CAST(a AS VARCHAR)), 1, 7) END || '_vs_' || CASE WHEN b % 3 = 0 THEN 'Doc ' || b ELSE substr(md5(CAST(b AS VARCHAR)), 1, 7) END AS shown FROM (SELECT DISTINCT o_custkey % 50 AS a, o_orderkey % 50 AS b, md5(CAST(o_custkey % 50 AS VARCHAR)) || '_vs_' || md5(CAST(o_orderkey % 50 AS VARCHAR)) || '.json' AS name FROM orders)")
def shown_names(t: Table) -> DataFrame:
    a, b = (F.md5((F.col(c) % 50).cast("string")) for c in ("o_custkey", "o_orderkey"))
    published = t("orders").select(F.concat(a, F.lit("_vs_"), b, F.lit(".json")).alias("name")).distinct()
    known = t("orders").select((F.col("o_orderkey") % 50).alias("k")).unionByName(t("orders").select((F.col("o_custkey") % 50).alias("k"))).distinct().where("k % 3 = 0")
    return shapes.display_names(published, known.select(F.md5(F.col("k").cast("string")).alias("hash"), F.concat(F.lit("Doc "), "k").alias("display")))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'EXT_1_2' WHEN 1 THEN 'a_b_' || c_custkey ELSE 'file' END AS shown, CASE WHEN c_custkey % 2 = 0 THEN '3 de mayo de 2021,4 Enero 2020' ELSE '' END AS dates, CASE c_custkey % 4 WHEN 0 THEN 'Sopprime' WHEN 1 THEN 'Sostituisce' WHEN 2 THEN 'Inserisce' END AS motive, 'ab' || chr(10) AS clean, c_custkey % 5 <> 1 AS expired FROM customer")
def names_and_dates(t: Table) -> DataFrame:
    e, k = F.expr, F.col("c_custkey")
    file = F.when(k % 3 == 0, F.lit("dir\\sub/ext_1_2_long name.pdf")).when(k % 3 == 1, F.concat(F.lit("/x/a:b?"), k, F.lit(".v.pdf"))).otherwise("__.pdf")
    file = F.when(k % 3 == 0, "dir\\sub/EXT_1_2_long.pdf").when(k % 3 == 1, F.concat(F.lit("/x/a:b?"), k, F.lit(".pdf"))).otherwise("__.pdf")
    text = F.when(k % 2 == 0, "el 3 de mayo de 2021 y 4 Enero 2020, 5 may 2020").otherwise("5 de 2021")
    extract = e("element_at(array('è SOPPRESSO e sostituito', 'il comma è modificato', 'è aggiunto', 'resta'), cast(c_custkey % 4 + 1 as int))")
    updated = F.when(k % 5 == 0, "bad").when(k % 5 == 1, "2024-01-01 09:59:30").otherwise("2024-01-01 09:00:00")
    return t("customer").select(
        "c_custkey", X.display_name(file).alias("shown"), F.array_join(X.spanish_dates(text), ",").alias("dates"), X.motive(extract).alias("motive"), X.printable(F.lit("a\x00​b\n")).alias("clean"),
        X.expired(updated, F.lit("2024-01-01 10:00:00"), 60).alias("expired"),
    )


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE len(embedding) END AS dims FROM embeddings WHERE vec_id % 2 >= 0")
def vectors_or_computed(t: Table) -> DataFrame:
    stored = F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).otherwise(F.array().cast("array<float>"))
    return t("embeddings").select("vec_id", F.size(shapes.vector_or(F.array(F.lit(1.0).cast("float")), stored)).cast("long").alias("dims"))


# trees with references, targets, vectors, jobs


def _pages(t: Table) -> DataFrame:
    """Line items as articles: pages and hashes are there or not by the line's number."""
    e = F.expr
    refs = e("case when l_linenumber % 2 = 0 then array(named_struct('art', 'a1', 'par', l_returnflag, 'doc', 'd1'), named_struct('art', 'a2', 'par', cast(null as string), 'doc', 'd2')) else cast(array() as array<struct<art:string,par:string,doc:string>>) end")
    rows = t("lineitem").withColumn("refs", refs)
    subs = e("array(named_struct('sub_id', 's0', 'page', case when l_linenumber % 3 = 0 then cast(7 as int) end, 'content', l_linestatus, 'hash', '', 'refs', refs))")
    paragraphs = e("array(named_struct('par_id', 'p0', 'page', case when l_linenumber % 4 = 1 then cast(5 as int) end, 'content', case when l_linenumber % 2 = 0 then ' ' else l_returnflag end, 'hash', case when l_linenumber % 5 = 0 then 'stored' end, 'subs', subs), named_struct('par_id', 'p1', 'page', cast(null as int), 'content', 'own', 'hash', cast(null as string), 'subs', slice(subs, 1, 0)))")
    rows = rows.withColumn("subs", subs).withColumn("paragraphs", paragraphs)
    key = e("l_orderkey * 1000000 + l_partkey * 100 + l_suppkey % 100").alias("doc_id")
    return rows.select(key, F.col("l_linenumber").alias("art_seq"), F.concat(F.lit("art. "), "l_linenumber").alias("art_id"), F.lit(2).alias("page"), e("case when l_linenumber % 3 = 1 then '' else l_linestatus end").alias("content"), F.lit(None).cast("string").alias("hash"), "paragraphs")


KEYED = "SELECT *, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey % 100 AS doc_id FROM lineitem"


@query(
    f"""WITH l AS (SELECT *, coalesce(CASE WHEN l_linenumber % 4 = 1 THEN 5 END, 2) AS pp FROM ({KEYED})), s AS (SELECT *, coalesce(CASE WHEN l_linenumber % 3 = 0 THEN 7 END, pp) AS sp FROM l)
    SELECT doc_id, l_linenumber AS art_seq, 'Articolo' AS level, CAST(NULL AS INTEGER) AS par_seq, CAST(NULL AS INTEGER) AS ref_seq, 2 AS page, sha256(lower(CASE WHEN l_linenumber % 3 = 1 THEN '' ELSE l_linestatus END)) AS hash, CAST(NULL AS VARCHAR) AS ref_par FROM l
    UNION ALL SELECT doc_id, l_linenumber, 'Comma', 0, NULL, pp, CASE WHEN l_linenumber % 5 = 0 THEN 'stored' ELSE sha256(lower(CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END)) END, NULL FROM l UNION ALL SELECT doc_id, l_linenumber, 'Comma', 1, NULL, 2, sha256('own'), NULL FROM l
    UNION ALL SELECT doc_id, l_linenumber, 'Sottocomma', 0, NULL, sp, sha256(lower(l_linestatus)), NULL FROM s
    UNION ALL SELECT doc_id, l_linenumber, 'Riferimenti', 0, CAST(k AS INTEGER), sp, NULL, CASE k WHEN 0 THEN l_returnflag END FROM s, (SELECT unnest([0, 1]) AS k) WHERE l_linenumber % 2 = 0"""
)
def flatten_references(t: Table) -> DataFrame:
    return hierarchy.flatten_with_references(_pages(t)).select("doc_id", "art_seq", "level", "par_seq", "ref_seq", "page", "hash", "ref_par")


@query(
    f"""SELECT doc_id, l_linenumber AS art_seq, CASE WHEN l_linenumber % 3 = 1 THEN chr(10) || p || chr(10) || 'own' ELSE l_linestatus END AS content, p AS first_paragraph FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN chr(10) || l_linestatus ELSE l_returnflag END AS p FROM ({KEYED}))"""
)
def rebuilt_when_blank(t: Table) -> DataFrame:
    rebuilt = hierarchy.with_contents_from_below(_pages(t))
    return rebuilt.select("doc_id", "art_seq", "content", F.get("paragraphs", F.lit(0))["content"].alias("first_paragraph"))


@query(f"SELECT doc_id || '_' || l_linenumber || '_' || k AS chunk_id, doc_id, 'Articolo' || l_linenumber AS art_id, CASE WHEN k = 1 THEN 'own' WHEN l_linenumber % 2 = 0 THEN ' ' ELSE l_returnflag END AS content FROM ({KEYED}), (SELECT unnest([0, 1]) AS k)")
def paragraph_chunks(t: Table) -> DataFrame:
    return hierarchy.paragraph_chunks(hierarchy.consolidated(_pages(t).withColumn("title", F.lit(""))))


@query("SELECT doc_id, par_seq, sub_seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(par_seq, 99), coalesce(sub_seq, 99)) - 1 AS INTEGER) AS place FROM (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber < 7 THEN l_linenumber // 3 END AS par_seq, CASE WHEN l_linenumber < 7 AND l_linenumber % 3 > 0 THEN l_linenumber % 3 END AS sub_seq FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))")
def post_orders(t: Table) -> DataFrame:
    k = F.col("l_linenumber")
    flat = t("lineitem").select("l_orderkey", k).distinct().select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("art_seq"), F.when(k < 7, F.floor(k / 3).cast("int")).alias("par_seq"), F.when((k < 7) & (k % 3 > 0), k % 3).alias("sub_seq"))
    return hierarchy.post_order(flat).drop("art_seq")


@query(
    """WITH r AS (SELECT o_orderkey AS seq, o_custkey % 10 AS doc_id, CAST(o_orderkey % 7 AS VARCHAR) AS a, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 3 AS VARCHAR) ELSE '' END AS p, o_orderstatus AS s FROM orders),
    f AS (SELECT doc_id, a, p, min(seq) AS seq FROM r GROUP BY 1, 2, 3)
    SELECT c_custkey AS ref_id, f.seq AS row_id, CASE WHEN f.p = '' THEN 'article ' || f.seq WHEN f.seq % 5 = 0 THEN 'article ' || f.seq ELSE 'paragraph ' || f.seq END AS target FROM (SELECT c_custkey, c_custkey % 10 AS doc_id, CAST(c_custkey % 9 AS VARCHAR) AS a, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 4 AS VARCHAR) ELSE '' END AS p FROM customer) c LEFT JOIN f ON f.doc_id = c.doc_id AND f.a = c.a AND f.p = c.p"""
)
def amendment_targets(t: Table) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    paragraph = o % 2 == 0
    rows = t("orders").select(
        o.alias("seq"), o.alias("row_id"), (F.col("o_custkey") % 10).alias("doc_id"), F.when(paragraph, "paragraph").otherwise("article").alias("level"), (o % 7).alias("n_art"), F.when(paragraph, (o % 3).cast("string")).alias("n_par"),
        F.when(paragraph & (o % 5 != 0), F.concat(F.lit("paragraph "), o)).alias("par_content"), F.concat(F.lit("article "), o).alias("art_content"), F.lit("any").alias("content"),
    )
    refs = t("customer").select(c.alias("ref_id"), (c % 10).alias("doc_id"), (c % 9).alias("n_art"), F.when(c % 2 == 0, (c % 4).cast("string")).alias("n_par"))
    return matching.amendment_targets(refs, rows).select("ref_id", "row_id", "target")


@query(
    """WITH v AS (SELECT vec_id, vec_id % 10 AS g, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.g, a.vec_id AS left_id, b.vec_id AS right_id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9) AS c FROM v a JOIN v b ON a.g = b.g AND a.vec_id % 3 = 0 AND b.vec_id % 3 = 1)
    SELECT left_id, right_id, round(c, 9) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY c DESC, right_id) AS r FROM p) WHERE r = 1 AND c >= 0.1"""
)
def best_vectors(t: Table) -> DataFrame:
    """Vectors whose id leaves 0 against those that leave 1, in ten groups; all of both are compared within a group."""
    side = lambda k, name: t("embeddings").where(F.col("vec_id") % 3 == k).select((F.col("vec_id") % 10).alias("g"), F.col("vec_id").alias(name), F.col("embedding").alias("vector"))
    return matching.best_vectors(side(0, "left_id"), side(1, "right_id"), "g", 0.1).select("left_id", "right_id", F.round("cosine", 9).alias("cosine"))


@query(
    """WITH a AS (SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'))
    SELECT 'Articolo' AS level, 'Art. ' || c_custkey AS art_id, CAST(NULL AS VARCHAR) AS par_id, c_name AS content FROM a UNION ALL SELECT 'Comma', 'Art. ' || c_custkey, 'p' || k, 'c' || k FROM a, (SELECT unnest([1, 2]) AS k)"""
)
def not_implemented_rows(t: Table) -> DataFrame:
    paragraphs = F.expr("array(named_struct('par_id', 'p1', 'content', 'c1'), named_struct('par_id', 'p2', 'content', 'c2'))")
    articles = t("customer").select(F.concat(F.lit("Art. "), "c_custkey").alias("art_id"), F.lit("t").alias("title"), F.col("c_name").alias("content"), paragraphs.alias("paragraphs"))
    results = t("orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("Articolo "), "o_custkey").alias("name"))
    number = lambda c: X.first_integer(F.col(c), -1)
    return matching.not_implemented_rows(articles, results, number("art_id"), number("name")).drop("title")


@query("SELECT o_custkey AS doc_id, CASE WHEN o_custkey % 2 = 0 THEN 'Fonte normativa ufficiale spagnola.' ELSE 'Fonte non determinata automaticamente.' END AS described, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def described_sources(t: Table) -> DataFrame:
    """The description of a source, and the first key of a map turned round whose values are all equal."""
    own = t("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    pairs = F.map_from_entries(F.transform("keys", lambda k: F.struct(k.cast("string").alias("k"), F.lit("same").alias("v"))))
    name = F.when(F.col("doc_id") % 2 == 0, "BOE 12").otherwise("other")
    return own.select("doc_id", X.legal_source_description(name).alias("described"), F.element_at(X.reversed_map(pairs), "same").cast("bigint").alias("first_key"))


@query("SELECT user_id AS job_id, event_id FROM (SELECT *, max(ts) OVER () AS latest FROM events) WHERE NOT (event_id % 4 IN (0, 1) AND epoch(latest) - epoch(ts) > 864000)")
def kept_jobs(t: Table) -> DataFrame:
    """Jobs that ended more than ten days before the last event are gone."""
    from lexgrove.streaming import inbox

    events = t("events")
    k = F.col("event_id") % 4
    states = events.select(F.col("user_id").alias("job_id"), "event_id", F.when(k == 0, "Completed").when(k == 1, "Failed").otherwise("Running").alias("status"), F.col("ts").alias("updated_at"))
    latest = events.agg(F.max("ts")).first()[0]
    return inbox.kept_jobs(states, F.lit(latest), 864_000).select("job_id", "event_id")


@query(f"SELECT doc_id, md5(substr(string_agg('[' || seq || '] ' || substr(line, 1, 40), chr(10) ORDER BY seq), 1, 500)) AS prompt FROM ({LINES}) GROUP BY 1")
def section_prompts(t: Table) -> DataFrame:
    found = lines.lines_of(t("documents")).select("doc_id", "seq", F.col("line").alias("content"))
    return scoring.sections_prompt(found, 40, 500).withColumn("prompt", F.md5("prompt"))
