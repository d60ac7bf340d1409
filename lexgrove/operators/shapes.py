"""Rows that comparisons and reports consist of, and what selects and arranges them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lexgrove.functions.text import blank_as_null, empty_cell, is_metadata

# Names of columns in result tables.
DOCUMENT_CODE, KIND = "Codice Documento", "Tipo"
REPORT_COLUMNS = {
    "Pagina": "Pagina", "Titolo Articolo": "Titolo Articolo", "Articolo": "Articolo", "Identificativo Comma": "Comma", "Identificativo Sottocomma": "Paragrafo",
    "Contenuto Articolo": "Contenuto Articolo", "Contenuto Comma": "Contenuto Comma", "Contenuto Sottocomma": "Contenuto Sottocomma", "Pattern Type": "Pattern Type",
    "Riferimento del Sottocomma - Nome Documento": "Rif. Documento", "Riferimento del Sottocomma - Codice Documento": "Rif. Codice",
    "Riferimento del Sottocomma - Tipo match trovato": "Rif. Tipo Match", "Riferimento del Sottocomma - Identificativo Articolo": "Rif.Articolo",
    "Riferimento del Sottocomma - Titolo Articolo": "Rif. Titolo Articolo", "Riferimento del Sottocomma - Identificativo Comma": "Rif. Comma",
    "Riferimento del Sottocomma - Contenuto": "Rif. Contenuto", "Riferimento del Sottocomma - Motivazione": "Dettaglio",
    "Riferimento del Sottocomma - Relazione Contenuto": "Rif. Relazione", "Tipo": "Tipo", "Requirement": "Requirement",
}

# filters


def without_definitions(articles: DataFrame, title: str = "title") -> DataFrame:
    """Articles whose title doesn't speak of definitions; those without a title stay."""
    return articles.where(~F.coalesce(F.lower(title).contains("definizioni"), F.lit(False)))


def law_mode(rows: DataFrame, key: str, id_: str, mark: str = "articolo") -> DataFrame:
    """Where an id of the document has the mark, rows with purely numeric ids go."""
    flagged = rows.groupBy(key).agg(F.max(F.lower(id_).contains(mark)).alias("law"))
    return rows.join(flagged, key).where(~(F.coalesce("law", F.lit(False)) & F.coalesce(F.col(id_).rlike("^[0-9]+$"), F.lit(False)))).select(*rows.columns)


def without_numeric_ids(rows: DataFrame, id_: str) -> DataFrame:
    return rows.where(~F.coalesce(F.col(id_).rlike("^[0-9]+$"), F.lit(False)))


def of_levels(rows: DataFrame, *levels: str) -> DataFrame:
    return rows.where(F.col("level").isin(*levels))


def relevant_to(articles: DataFrame, article_code: str, code: Column) -> DataFrame:
    """Articles without a document code of their own, or with this one."""
    own = F.coalesce(F.col(article_code), F.lit(""))
    return articles.where((own == "") | (own == code))


def uncoded_from_kind(table: DataFrame) -> DataFrame:
    """Rows with an empty document code (if that column exists), columns from the kind on, the content in its place."""
    if DOCUMENT_CODE in table.columns:
        table = table.where(empty_cell(F.col(f"`{DOCUMENT_CODE}`")))
    if KIND not in table.columns:
        raise ValueError(f"the table has no column {KIND}")
    return table.select(*(f"`{c}`" for c in reordered(table.columns[table.columns.index(KIND) :])))


def reordered(columns: list[str]) -> list[str]:
    """The content after the paragraph's column; the rest in the given order."""
    if "Contenuto" not in columns or "Comma" not in columns:
        return list(columns)
    rest = [c for c in columns if c != "Contenuto"]
    at = rest.index("Comma") + 1
    return [*rest[:at], "Contenuto", *rest[at:]]


def report(table: DataFrame) -> DataFrame:
    """The report's columns under their short names; an error names those that are missing."""
    if missing := [c for c in REPORT_COLUMNS if c not in table.columns]:
        raise KeyError(f"columns missing from the table: {missing}")
    return table.select(*(F.col(f"`{c}`").alias(name) for c, name in REPORT_COLUMNS.items()))


def ids_as_text(articles: DataFrame) -> DataFrame:
    """Ids of all levels as strings."""
    subs = lambda p: F.transform(p["subs"], lambda s: s.withField("sub_id", s["sub_id"].cast("string")))
    below = F.transform("paragraphs", lambda p: p.withField("par_id", p["par_id"].cast("string")).withField("subs", subs(p)))
    return articles.withColumns({"art_id": F.col("art_id").cast("string"), "paragraphs": below})


def all_have_references(subs: Column) -> Column:
    return (F.size(subs) > 0) & F.forall(subs, lambda s: F.size(s["refs"]) > 0)


def any_has_references(subs: Column) -> Column:
    return F.exists(subs, lambda s: F.size(s["refs"]) > 0)


def at_place(rows: DataFrame, coordinates: str, *places: int) -> DataFrame:
    """Rows whose coordinates begin so."""
    fits = F.lit(True)
    for i, place in enumerate(places):
        fits = fits & (F.get(F.col(coordinates), F.lit(i)) == place)
    return rows.where(F.coalesce(fits, F.lit(False)))


def joined_requirements(units: DataFrame, key: list[str], order: str) -> DataFrame:
    """The requirements of each key's units by newlines, in order; null and blank ones are left out."""
    own = F.array_sort(F.collect_list(F.when(blank_as_null(F.col("requirement")).isNotNull(), F.struct(order, "requirement"))))
    return units.groupBy(*key).agg(F.array_join(F.transform(own, lambda x: x["requirement"]), "\n").alias("requirements"))


def section_content(level: Column, sub: Column, paragraph: Column, article: Column) -> Column:
    """The content at the unit's level, or the first one above it that isn't blank."""
    s, p, a = map(blank_as_null, (sub, paragraph, article))
    return F.coalesce(F.when(level == "sub", F.coalesce(s, p, a)).when(level == "paragraph", F.coalesce(p, a)).otherwise(a), F.lit(""))


# rows of comparisons


def reference_rows(articles: DataFrame, code: str) -> DataFrame:
    """Rows of an implementation comparison: articles, paragraphs, sub-paragraphs without references, and one row for each reference.

    articles: doc_id, art_seq, art_id, title, page, content, paragraphs array<struct<par_id,content,subs array<struct<sub_id,content,
    requirement,refs array<struct<doc_name,doc_code,matches array<struct<art_id,title,par_id,content,reason>>>>>>>>. The first match counts;
    the coefficient is 30 where the reference names the code, with the reason as detail, else 1.
    """
    a = articles.select("doc_id", "art_seq", "art_id", "title", "page", "content", F.posexplode_outer("paragraphs").alias("par_seq", "p"))
    null = lambda kind="string": F.lit(None).cast(kind)

    def row(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        names = ("par_seq", "par_id", "sub_seq", "sub_id", "ref_seq", "text", "requirement", "ref_doc", "ref_code", "ref_art", "ref_title", "ref_par", "ref_content", "coefficient", "detail")
        typed = {c: "int" for c in ("par_seq", "sub_seq", "ref_seq", "coefficient")}
        return df.select("doc_id", "art_seq", F.lit(kind).alias("kind"), "art_id", "title", "page", *(columns.get(c, null(typed.get(c, "string"))).alias(c) for c in names))

    par = {"par_seq": F.col("par_seq"), "par_id": F.col("p.par_id")}
    s = a.where("p is not null").select("*", F.posexplode("p.subs").alias("sub_seq", "s"))
    sub = par | {"sub_seq": F.col("sub_seq"), "sub_id": F.col("s.sub_id"), "text": F.col("s.content"), "requirement": F.col("s.requirement")}
    r = s.select("*", F.posexplode("s.refs").alias("ref_seq", "r")).withColumn("m", F.get("r.matches", F.lit(0)))
    named = F.coalesce(F.col("r.doc_code") == code, F.lit(False))
    ref = sub | {
        "ref_seq": F.col("ref_seq"), "ref_doc": F.col("r.doc_name"), "ref_code": F.col("r.doc_code"), "ref_art": F.col("m.art_id"), "ref_title": F.col("m.title"), "ref_par": F.col("m.par_id"),
        "ref_content": F.col("m.content"), "coefficient": F.when(named, 30).otherwise(1), "detail": F.when(named, F.coalesce("m.reason", "s.requirement", F.lit(""))).otherwise(""),
    }
    rows = (
        row(articles, "Articolo", text=F.col("content")), row(a.where("p is not null"), "Comma", **par, text=F.col("p.content")),
        row(s.where(F.size("s.refs") == 0), "Sottocomma", **sub), row(r, "Rif. Sottocomma", **ref),
    )
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def amendment_rows(compared: DataFrame) -> DataFrame:
    """Rows of an amendment comparison with the columns of their level.

    compared: doc_id, seq, level, article, title, content, par_id, par_content, sub_id, sub_content, ref_art, ref_par, motive, first_detail, second_detail. The second
    pass's detail counts, else the first's; an article without one says so.
    """
    level = F.col("level")
    article = level == "Articolo"
    named = F.trim(F.concat(F.lit("Articolo: "), F.coalesce("ref_art", F.lit("")), F.lit(" Paragrafo: "), F.coalesce("ref_par", F.lit(""))))
    detail = F.coalesce(blank_as_null(F.col("second_detail")), blank_as_null(F.col("first_detail")))
    return compared.where(level.isin("Articolo", "Comma", "Sottocomma")).select(
        "doc_id", "seq", "level", "article", "title", F.when(article, "").otherwise(F.coalesce("par_id", F.lit(""))).alias("paragraph"), F.when(level == "Sottocomma", F.col("sub_id")).alias("sub"),
        F.when(article, F.col("content")).when(level == "Comma", F.col("par_content")).otherwise(F.col("sub_content")).alias("text"), F.when(article, "").otherwise(named).alias("references"),
        F.coalesce("motive", F.lit("")).alias("motive"), F.coalesce(detail, F.when(article, "STRINGA VUOTA").otherwise("")).alias("description"),
    )


def version_rows(compared: DataFrame) -> DataFrame:
    """Rows of a version comparison: articles and paragraphs only; removed ones have their text on the related side alone.

    compared: doc_id, seq, level, name, content, par_id, par_content, old_name, old_content, verdict, description.
    """
    article = F.col("level").isin("Articolo", "Capitolo")
    gone = F.col("verdict") == "Rimosso"
    text = F.when(article, F.col("content")).otherwise(F.col("par_content"))
    return compared.where(F.col("level").isin("Articolo", "Capitolo", "Comma", "Paragrafo")).select(
        "doc_id", "seq", F.when(article, "Capitolo").otherwise("Paragrafo").alias("level"), F.when(gone, "").otherwise(F.col("name")).alias("name"),
        F.when(gone | article, "").otherwise(F.coalesce("par_id", F.lit(""))).alias("paragraph"), F.when(gone, "").otherwise(text).alias("text"),
        F.when(gone, F.col("name")).otherwise(F.col("old_name")).alias("related_name"), F.when(gone, text).otherwise(F.col("old_content")).alias("related_text"), "verdict", "description",
    )


def title_coefficients(articles: DataFrame) -> DataFrame:
    """A row for each compared title. articles: doc_id, art_id, title, scores array<struct<title, coefficient>>."""
    return articles.select("doc_id", "art_id", "title", F.posexplode("scores").alias("seq", "s")).select("doc_id", "art_id", "title", "seq", F.col("s.title").alias("compared_title"), F.col("s.coefficient").alias("coefficient"))


def pair_rows(articles: DataFrame, coefficient: str = "coefficient") -> DataFrame:
    """A row for each pair of paragraphs, without those about the document itself; all but the first best of a paragraph are marked.

    articles: doc_id, art_id, title, best array<struct<art_id, title, pairs array<struct<left_id, left, right_id, right, coefficient>>>>.
    """
    matched = articles.select("doc_id", "art_id", "title", F.posexplode("best").alias("best_seq", "b"))
    pairs = matched.select("*", F.posexplode("b.pairs").alias("pair_seq", "p")).select(
        "doc_id", "art_id", "title", "best_seq", "pair_seq", F.col("p.left_id").alias("paragraph"), F.col("b.art_id").alias("ref_art"), F.col("b.title").alias("ref_title"), F.col("p.right_id").alias("ref_par"),
        F.col("p.left").alias("text"), F.col("p.right").alias("ref_text"), F.col(f"p.{coefficient}").alias("coefficient"),
    )
    kept = pairs.where(~is_metadata(F.col("ref_title"), F.col("ref_par"), F.col("ref_text")))
    place = F.row_number().over(Window.partitionBy("doc_id", "art_id", "paragraph").orderBy(F.desc_nulls_last("coefficient"), "best_seq", "pair_seq"))
    return kept.withColumn("secondary", F.when(place > 1, "x").otherwise(""))


def leaf_pairs(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The leaf units of matched articles, each of one side with each of the other; right ones about the document itself are left out.

    matches: pair_id, left_art, right_art; left and right: art, leaf, title, content. Articles are what bounds the product.
    """
    side = lambda df, name: df.select(F.col("art").alias(f"{name}_art"), F.col("leaf").alias(f"{name}_leaf"), F.col("content").alias(f"{name}_content"))
    kept = right.where(~is_metadata(F.col("title"), F.col("content")))
    return matches.join(side(left, "left"), "left_art").join(side(kept, "right"), "right_art").select("pair_id", "left_art", "right_art", "left_leaf", "right_leaf", "left_content", "right_content")


def carried_articles(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, sub_id, article) with the article last named in the run; a sub id of "0" begins a new run."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = rows.withColumn("run", F.count_if(F.trim(F.col("sub_id").cast("string")) == "0").over(order))
    within = Window.partitionBy("doc_id", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumn("carried", F.last("article", ignorenulls=True).over(within)).drop("run")


# values put back at their coordinates


def reinserted(df: DataFrame, values: DataFrame, key: str, path: list[str]) -> DataFrame:
    """df with the values (key, coordinates, value) in place of those at the path; places that none is given for keep theirs.

    The inverse of hierarchy.path_values: values meet their row once by key, as a map from coordinates, and nested arrays
    are rebuilt in the row itself.
    """
    at = values.where(F.col("coordinates").isNotNull()).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.array_join(F.col("coordinates").cast("array<string>"), ".").alias("k"), "value"))).alias("_values"))
    joined = df.join(at, key, "left")

    def rebuilt(node: Column, kind, steps: list[str], place: Column) -> Column:
        if isinstance(kind, ArrayType):
            return F.transform(node, lambda x, i: rebuilt(x, kind.elementType, steps, F.concat_ws(".", F.nullif(place, F.lit("")), i.cast("string"))))
        if not steps:
            new = F.get(F.transform(F.array(place), lambda k: F.struct(F.map_contains_key("_values", k).alias("has"), F.element_at(F.col("_values"), k).alias("v"))), F.lit(0))
            return F.when(F.col("_values").isNotNull() & new["has"], new["v"].cast(kind)).otherwise(node)
        field: StructType = kind[steps[0]].dataType
        return F.when(node.isNotNull(), node.withField(steps[0], rebuilt(node[steps[0]], field, steps[1:], place)))

    first = path[0]
    return joined.withColumn(first, rebuilt(F.col(first), df.schema[first].dataType, path[1:], F.lit(""))).select(*df.columns)


# ids, unions and small records


def numbered_after(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """New parts with ids that follow the greatest of their document. new and existing: doc_id; existing: part_id."""
    most = existing.groupBy("doc_id").agg(F.max("part_id").alias("most"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    return new.join(most, "doc_id", "left").withColumn("part_id", (F.coalesce("most", F.lit(0)) + place).cast("int")).drop("most")


def all_parts(parts: DataFrame, sections: DataFrame, documents: DataFrame) -> DataFrame:
    """Parts, sections and documents as one table; columns that one lacks are null."""
    marked = [df.withColumn("level", F.lit(name)) for df, name in ((parts, "part"), (sections, "section"), (documents, "document"))]
    return marked[0].unionByName(marked[1], allowMissingColumns=True).unionByName(marked[2], allowMissingColumns=True)


def document_synthesis(sections: DataFrame) -> DataFrame:
    """doc_id, sections, content: the sections' texts in order, one after another."""
    own = F.array_sort(F.collect_list(F.struct("seq", "content")))
    return sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.array_join(F.transform(own, lambda x: x["content"]), "\n").alias("content"))


def first_by_prefix(rows: DataFrame, text: str, order: str, length: int = 100) -> DataFrame:
    """The first row of each text's first characters."""
    place = F.row_number().over(Window.partitionBy(F.substring(text, 1, length)).orderBy(order))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def embedding_text(units: DataFrame, most: int = 200) -> DataFrame:
    """doc_id, art_seq, text: the first pieces of each article's units, by a space. units: doc_id, art_seq, seq, piece."""
    own = F.slice(F.array_sort(F.collect_list(F.struct("seq", "piece"))), 1, most)
    return units.groupBy("doc_id", "art_seq").agg(F.array_join(F.transform(own, lambda x: x["piece"]), " ").alias("text"))


def display_names(published: DataFrame, names: DataFrame) -> DataFrame:
    """name, shown: names "a_vs_b.json" of two hashes with both as their names; a hash without one is cut to seven characters."""
    sides = F.split(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", ""), "_vs_")
    split = published.select("name", F.get(sides, F.lit(0)).alias("a"), F.get(sides, F.lit(1)).alias("b"))
    of = lambda side: names.select(F.col("hash").alias(side), F.col("display").alias(f"{side}_name"))
    both = split.join(of("a"), "a", "left").join(of("b"), "b", "left")
    shown = lambda side: F.coalesce(f"{side}_name", F.substring(side, 1, 7))
    return both.select("name", F.when(F.col("b").isNull(), shown("a")).otherwise(F.concat_ws("_vs_", shown("a"), shown("b"))).alias("shown"))


def vector_or(computed: Column, stored: Column) -> Column:
    """The stored vector unless it is missing or empty."""
    return F.when(F.size(stored) > 0, stored).otherwise(computed)
