"""Nested document trees: building, flattening, paths, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lexgrove.functions.text import article_id

SYNTHETIC = "0"


def tree_of(docs: DataFrame) -> DataFrame:
    """doc_id, art_seq, title, content, paragraphs: a line is an article, its sentences are paragraphs, their clauses sub-paragraphs."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("art_seq", "content"))
    clauses = lambda p: F.transform(F.filter(F.split(p, ", "), lambda x: F.trim(x) != ""), lambda x, i: F.struct((i + 1).cast("string").alias("sub_id"), F.trim(x).alias("content")))
    sentences = F.transform(F.filter(F.split("content", r"\. "), lambda x: F.trim(x) != ""), lambda x, i: F.struct((i + 1).cast("string").alias("par_id"), F.trim(x).alias("content"), clauses(x).alias("subs")))
    return lines.select("doc_id", "art_seq", F.concat(F.lit("Articolo "), (F.col("art_seq") + 1).cast("string")).alias("art_id"), "content", sentences.alias("paragraphs"))


def with_full_depth(articles: DataFrame) -> DataFrame:
    """Every article gets a paragraph and every paragraph a sub-paragraph; added ones have the id "0" and the parent's content."""
    subs = lambda p: F.when(F.size(p["subs"]) > 0, p["subs"]).otherwise(F.array(F.struct(F.lit(SYNTHETIC).alias("sub_id"), p["content"].alias("content"))))
    none = F.array(F.struct(F.lit(SYNTHETIC).alias("par_id"), F.col("content").alias("content"), F.array(F.struct(F.lit(SYNTHETIC).alias("sub_id"), F.col("content").alias("content"))).alias("subs")))
    own = F.transform("paragraphs", lambda p: F.struct(p["par_id"].alias("par_id"), p["content"].alias("content"), subs(p).alias("subs")))
    return articles.withColumn("paragraphs", F.when(F.size("paragraphs") > 0, own).otherwise(none))


def flatten(articles: DataFrame) -> DataFrame:
    """Pre-order rows of a tree: doc_id, level, art_seq, par_seq, sub_seq, id, content, hash. One pass, no shuffle."""
    row = lambda level, par, sub, id_, content: F.struct(F.lit(level).alias("level"), par.cast("int").alias("par_seq"), sub.cast("int").alias("sub_seq"), id_.alias("id"), content.alias("content"))
    none = F.lit(None)
    article = F.array(row("article", none, none, F.col("art_id"), F.col("content")))
    below = F.flatten(F.transform("paragraphs", lambda p, i: F.concat(F.array(row("paragraph", i, none, p["par_id"], p["content"])), F.transform(p["subs"], lambda s, j: row("sub", i, j, s["sub_id"], s["content"])))))
    return articles.select("doc_id", "art_seq", F.explode(F.concat(article, below)).alias("r")).select("doc_id", "art_seq", "r.*").withColumn("hash", F.sha2(F.lower(F.regexp_replace("content", "[^A-Za-z0-9]", "")), 256))


def rebuild_contents(flat: DataFrame) -> DataFrame:
    """doc_id, art_seq, content: an article's content from its sub-paragraphs, each after a newline, in order."""
    subs = flat.where("level = 'sub'").groupBy("doc_id", "art_seq").agg(F.array_sort(F.collect_list(F.struct("par_seq", "sub_seq", "content"))).alias("parts"))
    return subs.select("doc_id", "art_seq", F.concat(F.lit("\n"), F.array_join(F.transform("parts", lambda p: p["content"]), "\n")).alias("content"))


NODE = "struct<level:string,par_seq:int,sub_seq:int,ref_seq:int,id:string,page:int,content:string,hash:string,ref_art:string,ref_par:string,ref_doc:string>"


def _clean_hash(content: Column, stored: Column) -> Column:
    """The stored hash, else that of the content's letters and digits."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.sha2(F.lower(F.regexp_replace(F.coalesce(content, F.lit("")), "[^A-Za-z0-9]", "")), 256))


def _node(level: str, **parts: Column) -> Column:
    names = ("par_seq", "sub_seq", "ref_seq", "id", "page", "content", "hash", "ref_art", "ref_par", "ref_doc")
    return F.struct(F.lit(level).alias("level"), *(parts.get(n, F.lit(None)).alias(n) for n in names)).cast(NODE)


def flatten_with_references(articles: DataFrame) -> DataFrame:
    """Pre-order rows with references and pages: doc_id, art_seq and the fields of a node.

    articles: doc_id, art_seq, art_id, page, content, hash, paragraphs array<struct<par_id, page, content, hash, subs array<struct<sub_id, page,
    content, hash, refs array<struct<art, par, doc>>>>>>. A page that is missing is the one above; a missing hash is made from the content.
    """

    def references(s: Column, i: Column, j: Column, page: Column) -> Column:
        return F.transform(s["refs"], lambda r, k: _node("Riferimenti", par_seq=i, sub_seq=j, ref_seq=k, id=s["sub_id"], page=page, ref_art=r["art"], ref_par=r["par"], ref_doc=r["doc"]))

    def sub(s: Column, i: Column, j: Column, above: Column) -> Column:
        page = F.coalesce(s["page"], above)
        return F.concat(F.array(_node("Sottocomma", par_seq=i, sub_seq=j, id=s["sub_id"], page=page, content=s["content"], hash=_clean_hash(s["content"], s["hash"]))), F.coalesce(references(s, i, j, page), F.array().cast(f"array<{NODE}>")))

    def paragraph(p: Column, i: Column) -> Column:
        page = F.coalesce(p["page"], F.col("page"))
        own = F.array(_node("Comma", par_seq=i, id=p["par_id"], page=page, content=p["content"], hash=_clean_hash(p["content"], p["hash"])))
        return F.concat(own, F.coalesce(F.flatten(F.transform(p["subs"], lambda s, j: sub(s, i, j, page))), F.array().cast(f"array<{NODE}>")))

    own = F.array(_node("Articolo", id=F.col("art_id"), page=F.col("page"), content=F.col("content"), hash=_clean_hash(F.col("content"), F.col("hash"))))
    below = F.coalesce(F.flatten(F.transform("paragraphs", paragraph)), F.array().cast(f"array<{NODE}>"))
    return articles.select("doc_id", "art_seq", F.explode(F.concat(own, below)).alias("n")).select("doc_id", "art_seq", "n.*")


def _or_children(content: Column, children: Column) -> Column:
    """The content unless it is blank, else the children's, each after a newline."""
    joined = F.array_join(F.transform(children, lambda c: F.concat(F.lit("\n"), F.coalesce(c["content"], F.lit("")))), "")
    return F.when(F.trim(F.coalesce(content, F.lit(""))) != "", content).otherwise(F.coalesce(joined, F.lit("")))


def with_contents_from_below(articles: DataFrame) -> DataFrame:
    """Blank contents of paragraphs and articles are rebuilt from their children, bottom up, in the row itself."""
    paragraphs = F.transform("paragraphs", lambda p: p.withField("content", _or_children(p["content"], p["subs"])))
    rebuilt = articles.withColumn("paragraphs", paragraphs)
    return rebuilt.withColumn("content", _or_children(F.col("content"), F.col("paragraphs")))


def post_order(flat: DataFrame) -> DataFrame:
    """Rows of a flat tree with place: children before their parent, articles in their order."""
    inner = F.coalesce("par_seq", F.lit(2**31 - 1))
    return flat.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "art_seq").orderBy(inner, F.coalesce("sub_seq", F.lit(2**31 - 1)))) - 1)


def hierarchy_path(*keys: Column) -> Column:
    """The keys that aren't blank, in order."""
    return F.filter(F.array(*keys), lambda k: k.isNotNull() & (F.trim(k) != ""))


def consolidated(articles: DataFrame) -> DataFrame:
    """Articles without a title take that of their first paragraph if it stands in brackets; ids are written alike."""
    first = F.trim(F.get("paragraphs", F.lit(0))["content"])
    bracketed = F.when(F.regexp_like(first, F.lit(r"(?s)^\(.*\)$")), first)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), bracketed, F.lit(""))
    return articles.withColumns({"title": title, "art_id": article_id(F.col("art_id"))})


def paragraph_chunks(articles: DataFrame) -> DataFrame:
    """chunk_id, doc_id, art_id, content: one chunk for each paragraph, its id made of the places."""
    p = articles.select("doc_id", "art_seq", "art_id", F.posexplode("paragraphs").alias("i", "p"))
    return p.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("art_seq").cast("string"), F.col("i").cast("string")).alias("chunk_id"), "doc_id", "art_id", F.col("p.content").alias("content"))


def leaves(articles: DataFrame) -> DataFrame:
    """The finest unit of each paragraph: its sub-paragraphs, or itself if it has none."""
    p = articles.select("doc_id", "art_seq", F.posexplode("paragraphs").alias("par_seq", "p"))
    return p.select("doc_id", "art_seq", "par_seq", "p", F.posexplode_outer("p.subs").alias("sub_seq", "s")).select("doc_id", "art_seq", "par_seq", "sub_seq", F.coalesce("s.content", "p.content").alias("content"))


def inherited_references(units: DataFrame) -> DataFrame:
    """Later units of a paragraph get the first unit's references after their own. units: doc_id, art_seq, par_seq, sub_seq, refs."""
    order = Window.partitionBy("doc_id", "art_seq", "par_seq").orderBy("sub_seq")
    first = F.first("refs").over(order)
    later = (F.row_number().over(order) > 1) & (F.size(first) > 0)
    return units.withColumn("all_refs", F.when(later, F.concat("refs", first)).otherwise(F.col("refs")))


def path_values(df: DataFrame, key: str, path: list[str]) -> DataFrame:
    """key, coordinates, value: the values at a path through any nesting of arrays and structs, with the positions passed."""
    out, at, places = df.select(key, F.struct(*[c for c in df.columns if c != key]).alias("at")), "at", []
    for step in path:
        out = out.withColumn("at", F.col(f"{at}.{step}"))
        while isinstance(out.schema["at"].dataType, ArrayType):
            place = f"x{len(places)}"
            out = out.select(*[c for c in out.columns if c != "at"], F.posexplode("at").alias(place, "at"))
            places.append(place)
    return out.select(key, F.array(*places).cast("array<int>").alias("coordinates"), F.col("at").alias("value"))


def split_lists(lists: Column) -> tuple[Column, Column]:
    """A list of lists as one flat list and the lengths."""
    return F.flatten(lists), F.transform(lists, F.size)


def join_lists(flat: Column, lengths: Column) -> Column:
    """The inverse; an error if the lengths don't add up."""
    ends = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda a, b: a + b))
    total = F.aggregate(lengths, F.lit(0), lambda a, b: a + b)
    parts = F.zip_with(ends, lengths, lambda e, n: F.slice(flat, e - n + 1, n))
    return F.when(total == F.size(flat), parts).otherwise(F.raise_error(F.lit("lengths don't add up to the list")).cast("array<array<string>>"))


def joined_texts(lists: Column, separator: str) -> Column:
    """Non-blank texts of a list of lists."""
    return F.array_join(F.filter(F.flatten(lists), lambda t: F.trim(t) != ""), separator)


def flat_names(schema: StructType, prefix: str = "", separator: str = "_") -> list[tuple[str, str]]:
    """Path and flat name of each plain field of a nested schema."""
    out = []
    for f in schema.fields:
        path, name = (f"{prefix}.{f.name}" if prefix else f.name), (f"{prefix}.{f.name}" if prefix else f.name).replace(".", separator)
        out += flat_names(f.dataType, path, separator) if isinstance(f.dataType, StructType) else [(path, name)]
    return out


def flat_struct(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested structs as one level of columns."""
    return df.select(*(F.col(path).alias(name) for path, name in flat_names(df.schema, separator=separator)))


def sections(parts: DataFrame) -> DataFrame:
    """doc_id, section, seq, part_ids, content: parts grouped by section title in the order in which titles first appear."""
    grouped = parts.groupBy("doc_id", "section").agg(F.min("part_id").alias("first"), F.array_sort(F.collect_list(F.struct("part_id", "content"))).alias("own"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    return grouped.select("doc_id", "section", seq.alias("seq"), F.transform("own", lambda x: x["part_id"]).alias("part_ids"), F.array_join(F.transform("own", lambda x: x["content"]), "\n").alias("content"))


def sibling_parts(parts: DataFrame) -> DataFrame:
    """The part before in the same section."""
    return parts.withColumn("sibling_of", F.lag("part_id").over(Window.partitionBy("doc_id", "section").orderBy("part_id")))


def composite_id(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts))
