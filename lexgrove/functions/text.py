"""Text, date, vector and hash functions, all built from Spark's own expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases, keywords and patterns that results depend on.
METADATA_PHRASES = ("informazioni sul documento", "informazioni del documento", "scheda del documento", "storia del documento", "qualità del documento", "qualita del documento")
PROVISIONS = (
    "REAL DECRETO-LEY", "REAL DECRETO LEGISLATIVO", "REAL DECRETO", "DECRETO-LEY", "DECRETO LEGISLATIVO", "DECRETO", "LEY ORGÁNICA", "LEY", "ORDEN",
    "RESOLUCIÓN", "RESOLUCION", "CORRECCIÓN DE ERRORES", "CORRECCION DE ERRORES", "CIRCULAR", "ACUERDO", "ANUNCIO", "EDICTO", "SENTENCIA", "AUTO",
    "CONVENIO", "INSTRUCCIÓN", "INSTRUCCION", "REGLAMENTO", "DIRECTIVA",
)
LEGAL_SOURCES = (
    ("gazzetta", "Gazzetta ufficiale"), ("celex", "Gazzetta ufficiale"), ("banca", "Banca d'Italia"), ("boe", "Boletin Oficial del Estado"),
    ("eba", "European Banking Authority"), ("uif", "UIF"),
)
NO_SOURCE = "Fonte non classificata"
SOURCE_DESCRIPTIONS = {
    "Gazzetta ufficiale": "Fonte normativa ufficiale UE/IT.", "Banca d'Italia": "Pubblicazione/atto di vigilanza Banca d'Italia.", "Boletin Oficial del Estado": "Fonte normativa ufficiale spagnola.",
    "European Banking Authority": "Linea guida/regolamentazione EBA.", "UIF": "Indicazioni/atti Unita di Informazione Finanziaria.", NO_SOURCE: "Fonte non determinata automaticamente.",
}
PATTERN_WORDS = (
    ("Obbligo", ("deve", "devono", "obbligo", "ispezione", "vigilanza")), ("Divieto", ("vietato", "divieto", "non può", "precluso")),
    ("Condizione", ("qualora", "nel caso", "condizione", "controllo")), ("Termine temporale", ("termine", "decorrere")),
)
FIRST_DATES = (r"\b\d{2}/\d{2}/\d{4}\b", r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b")
SPANISH_DATE = r"(?i)[0-9]{1,2}\s+(?:de\s+)?(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\s+(?:de\s+)?[0-9]{4}"
DOCUMENT_CODE = r"(?i)\b(?:n\.\s*)?([0-9]{3,4}/[0-9]{4})\b"
STEM_CODE = r"(?i)([0-9]{4,5})[RD]([0-9]{3,4})(?:_|$)"
NO_CODE = "CODICE_NON_TROVATO"
REGULATION_HEADER = r"(?i)REGOLAMENTO\s*\(UE\)\s*N\.\s*([0-9]+/[0-9]+)"
MOTIVES = (("Sopprime", "soppress|soppression|eliminat"), ("Sostituisce", "sostitui|modific|aggiorna"), ("Inserisce", "inserisc|inserit|aggiung|aggiunt"))
MONTHS = "gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre"
ALL_DATES = (r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b", rf"(?i)\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{2,4}}\b")


def blank_as_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def alnum_key(c: Column) -> Column:
    """Marks, line breaks, tags and everything but ASCII letters and digits go; lower case. Null becomes empty."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"▼\w+\d+", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.translate(text, "\n\t", ""), "<[^>]*>", ""), "[^A-Za-z0-9]", ""))


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def canonical_words(c: Column) -> Column:
    """Soft hyphens go, words hyphenated over a line break are joined, white space collapses; lower case."""
    joined = F.regexp_replace(F.translate(c, "­", ""), "[-‐‑‒–—]\\s*\n\\s*", "")
    return F.lower(F.trim(F.regexp_replace(joined, r"\s+", " ")))


def squeezed(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(" "), F.lit("")))


def first_integer(c: Column, default: int | None = None) -> Column:
    """The first run of digits, or the default."""
    found = F.regexp_extract(c, r"\d+", 0).try_cast("bigint")
    return found if default is None else F.coalesce(found, F.lit(default))


def word_balance(c: Column, allowed: list[str], avoided: list[str]) -> Column:
    """Whether the avoided words occur more often than the allowed ones."""
    count = lambda words: reduce(lambda a, b: a + b, ((F.length(c) - F.length(F.replace(c, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0))
    return count(avoided) - count(allowed) > 0


def first_words(c: Column, n: int) -> Column:
    """The first n words, joined by one space."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), 1, n), " ")


def shortened(c: Column, n: int) -> Column:
    """At most n characters, the last three dots if some were cut."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 3), F.lit("...")))


def page_reference(page: Column) -> Column:
    text = F.trim(F.coalesce(page.cast("string"), F.lit("")))
    return F.when(text == "", "").otherwise(F.concat(F.lit("Pg. "), text))


def name_key(c: Column) -> Column:
    """Only a-z and 0-9 of the lower-cased name."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def file_name(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def plain_line(c: Column) -> Column:
    """Without "page n", trimmed, lower case: the form in which repeated lines are compared."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?i)\bpage\s*\d+\b", "")))


def without_words(c: Column, words: list[str]) -> Column:
    """Whole words of the list go, white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?iU)\b(" + "|".join(words) + r")\b", ""), r"\s+", " "))


def legal_source(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return reduce(lambda rest, rule: F.when(low.contains(rule[0]), rule[1]).otherwise(rest), reversed(LEGAL_SOURCES), F.lit(NO_SOURCE))


def legal_source_description(name: Column) -> Column:
    """What the source of a document's name is."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in SOURCE_DESCRIPTIONS.items() for x in pair)), legal_source(name))


def reversed_map(pairs: Column) -> Column:
    """A map from values to keys; of equal values the first key counts."""
    first = F.aggregate(F.map_entries(pairs), F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["value"]), m).otherwise(F.map_concat(m, F.create_map(e["value"], e["key"]))))
    return first


def provision_type(c: Column) -> Column:
    """The first of the keywords, longest forms first, that begins the text."""
    upper = F.upper(c)
    return reduce(lambda rest, word: F.when(upper.startswith(word), word).otherwise(rest), reversed(PROVISIONS), F.lit(""))


def dotted_number(c: Column) -> Column:
    return c.rlike(r"^\d+(\.\d+)*\.?$")


def pattern_class(c: Column) -> Column:
    """Kind of requirement by whole keywords, in the order of the kinds; then the phrase of a time limit."""
    low = F.lower(c)
    rest = F.when(low.contains("entro il"), "Termine temporale").otherwise("altro")
    for kind, words in reversed(PATTERN_WORDS):
        rest = F.when(low.rlike(r"(?U)(?<!\w)(" + "|".join(words) + r")(?!\w)"), kind).otherwise(rest)
    return rest


def complexity(c: Column) -> Column:
    """Capitalised words and long numbers to each sentence mark."""
    marks = F.length(c) - F.length(F.translate(c, ".\n", ""))
    return F.regexp_count(c, F.lit(r"\b[A-Z]{2,}\b|\d{4,}")) / F.greatest(marks, F.lit(1))


def article_id(c: Column) -> Column:
    """Spaces go, short forms of "Articolo" are written out."""
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), r"(?i)\bart(?:icolo)?\.?(?=\d)", "Articolo")


def is_metadata(*parts: Column) -> Column:
    """Whether the joined parts hold a phrase of a document's own description."""
    low = F.lower(F.concat_ws(" ", *parts))
    return reduce(lambda a, b: a | b, (low.contains(p) for p in METADATA_PHRASES))


def scorable(content: Column, id_: Column, least: int = 10) -> Column:
    """Units with the synthetic id "0" always, others from a length on."""
    return F.coalesce((F.trim(id_.cast("string")) == "0") | (F.length(F.trim(content)) >= least), F.lit(False))


def empty_cell(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin("", "nan", "none")


def first_date(c: Column) -> Column:
    """The first match of the first pattern that has one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in FIRST_DATES), F.lit(""))


def all_dates(c: Column) -> Column:
    """All dates by pattern, in order of appearance, each once."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in ALL_DATES)))


def spanish_dates(c: Column) -> Column:
    """Dates such as "3 de mayo de 2021"."""
    return F.regexp_extract_all(c, F.lit(SPANISH_DATE), F.lit(0))


def now_text() -> Column:
    """The time of the query in UTC, as ISO text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def expired(updated: Column, now: Column, seconds: float) -> Column:
    """Whether the time since the update exceeds the limit; unreadable times have expired."""
    t = lambda c: F.unix_micros(F.try_to_timestamp(c.cast("string")))
    return F.coalesce((t(now) - t(updated)) / 1e6 > seconds, F.lit(True))


def seconds_between(start: Column, end: Column) -> Column:
    """0 where one is missing or can't be read."""
    t = lambda c: F.unix_micros(F.try_to_timestamp(c.cast("string")))
    return F.coalesce((t(end) - t(start)) / 1e6, F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Over the common length; 0 if a vector is missing or empty."""
    n = F.least(F.coalesce(F.size(a), F.lit(0)), F.coalesce(F.size(b), F.lit(0)))
    pairs = lambda x, y: F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(n > 0, pairs(a, b) / (F.sqrt(pairs(a, a)) * F.sqrt(pairs(b, b)) + 1e-9)).otherwise(F.lit(0.0))


def node_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}::"), F.substring(F.sha2(F.coalesce(key, F.lit("")), 256), 1, 24))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def sortable_number(c: Column) -> Column:
    """A number, or null for what can't be read; sort with nulls last."""
    return F.replace(c.cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def vector_text(c: Column, head: int = 64) -> Column:
    """The first components, rounded, and how many there are."""
    shown = F.array_join(F.transform(F.slice(c, 1, head), lambda x: F.round(x.cast("double"), 6).cast("string")), ", ")
    return F.concat(F.lit("["), shown, F.when(F.size(c) > head, F.concat(F.lit(", ... +"), (F.size(c) - head).cast("string"), F.lit(" dims"))).otherwise(""), F.lit("]"))


def reach_band(coefficient: Column) -> Column:
    """Bands of a correlation: literal, strong, misleading, weak; none for 0 or nothing."""
    return F.when(F.coalesce(coefficient, F.lit(0)) == 0, "").when(coefficient == 30, "literal").when(coefficient >= 15, "strong").when(coefficient <= 1, "misleading").otherwise("weak")


def unordered_pair(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "_vs_")


def response_pairs(c: Column) -> Column:
    """(requirement, core text) pairs of a labelled answer."""
    part = lambda label: F.regexp_extract_all(c, F.lit(rf"(?im)^\s*{label}\s*:\s*(.+)$"), F.lit(1))
    return F.arrays_zip(part("requirement").alias("requirement"), part("core text").alias("core_text"))


def document_code(text: Column, stem: Column) -> Column:
    """A code such as 648/2012 from the text, else year and number from the file's stem (32017R352: 32017/0352), else a word for none."""
    digits = F.regexp_extract(stem, STEM_CODE, 2)
    of_stem = F.when(digits != "", F.concat(F.regexp_extract(stem, STEM_CODE, 1), F.lit("/"), F.lpad(digits, 4, "0")))
    return F.coalesce(F.nullif(F.regexp_extract(text, DOCUMENT_CODE, 1), F.lit("")), of_stem, F.lit(NO_CODE))


def regulation_header(text: Column) -> Column:
    """The first header of a regulation with its number, or null."""
    return F.nullif(F.regexp_extract(text, REGULATION_HEADER, 0), F.lit(""))


def amendment_section(text: Column) -> Column:
    """What follows the first regulation header, up to an article that changes a regulation of another number; null without a header."""
    number = F.nullif(F.regexp_extract(text, REGULATION_HEADER, 1), F.lit(""))
    after = F.substring(text, F.instr(text, F.regexp_extract(text, REGULATION_HEADER, 0)) + F.length(F.regexp_extract(text, REGULATION_HEADER, 0)), F.length(text))
    footer = F.concat(F.lit(r"(?ims)^Articolo\s+[0-9]+\s*\r?\n\s*Modifiche\s+del\s+Regolamento\s*\(UE\)\s*N\.?\s*(?!"), number, F.lit(r"[^0-9])[0-9]+/[0-9]+.*"))
    return F.when(number.isNotNull(), F.trim(F.regexp_replace(F.concat(after, F.lit("\n")), footer, F.lit("")), F.lit(" \t\r\n")))


def motive(text: Column) -> Column:
    """What an amendment does, by the first of the kinds whose keywords occur; null for none."""
    low = F.lower(text)
    return reduce(lambda rest, kind: F.when(low.rlike(kind[1]), kind[0]).otherwise(rest), reversed(MOTIVES), F.lit(None).cast("string"))


def safe_stem(c: Column) -> Column:
    """A file's stem without characters that names can't have; "file" if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit("_")), F.lit("")), F.lit("file"))


def display_name(file: Column) -> Column:
    """The safe stem of a file; of names that begin with EXT or INT the first seven characters."""
    stem = F.regexp_replace(F.element_at(F.split(F.replace(file, F.lit("\\"), F.lit("/")), "/"), -1), r"(?<=.)\.[^.]*$", "")
    safe = safe_stem(stem)
    return F.when(F.upper(stem).startswith("EXT") | F.upper(stem).startswith("INT"), F.substring(safe, 1, 7)).otherwise(safe)


def printable(c: Column) -> Column:
    """Without control characters other than line ends and tabs."""
    return F.regexp_replace(c, r"[\p{C}&&[^\n\t]]", "")
