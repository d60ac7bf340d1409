"""Property graph of documents: nodes, edges, enrichment, and checks before writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions.text import all_dates, first_words, legal_source, node_id

VECTOR = 1536


def properties(**columns: Column) -> Column:
    """A map of the non-null properties."""
    pairs = [x for name, c in columns.items() for x in (F.lit(name), c.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def section_id(doc: Column, content: Column) -> Column:
    return F.concat(F.lit("section::"), doc.cast("string"), F.lit(":"), F.substring(F.sha2(F.coalesce(content, F.lit("")), 256), 1, 20))


def unique_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """The first node of each id."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return nodes.withColumn("place", place).where("place = 1").drop("place")


def document_graph(docs: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, labels, properties) and edges (type, source, target).

    docs: doc_id, source; sections: doc_id, seq, parent (null or a seq), content. Equal texts of one
    document are one node, as its id is the hash of the content.
    """
    s = sections.withColumn("id", section_id(F.col("doc_id"), F.col("content")))
    doc = F.concat(F.lit("document::"), F.col("doc_id").cast("string"))
    source = node_id("source", legal_source(F.col("source")))
    parts = [
        docs.select(doc.alias("id"), F.array(F.lit("Document")).alias("labels"), properties(name=F.col("source")).alias("properties"), F.lit(0).alias("seq")),
        docs.select(source.alias("id"), F.array(F.lit("LegalSource")).alias("labels"), properties(name=legal_source(F.col("source"))).alias("properties"), F.lit(0).alias("seq")).dropDuplicates(["id"]),
        s.select("id", F.array(F.lit("Section")).alias("labels"), properties(abstract=first_words(F.col("content"), 200)).alias("properties"), "seq"),
    ]
    nodes = unique_nodes(parts[0].unionByName(parts[1]).unionByName(parts[2]), "seq").drop("seq")
    # one pass gives a section's own edges, from ids that are computed once
    following = F.lead("id").over(Window.partitionBy("doc_id").orderBy("seq"))
    ids = s.select("doc_id", "id", following.alias("next"), section_parent(s).alias("parent_id"))
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), a.alias("source"), b.alias("target"))
    own = F.array(edge("CONTAINS", doc, F.col("id")), F.when(F.col("next").isNotNull(), edge("NEXT", F.col("id"), F.col("next"))), F.when(F.col("parent_id").isNotNull(), edge("PART_OF", F.col("id"), F.col("parent_id"))))
    of_sections = ids.select(F.explode(F.filter(own, lambda x: x.isNotNull())).alias("e")).select("e.*")
    published = docs.select(F.lit("PUBLISHED").alias("type"), source.alias("source"), doc.alias("target"))
    return nodes, published.unionByName(of_sections)


def section_parent(s: DataFrame) -> Column:
    """The id of the row of the same document whose seq is the row's parent."""
    by_seq = F.map_from_entries(F.collect_list(F.struct("seq", "id")).over(Window.partitionBy("doc_id")))
    return F.when(F.col("parent").isNotNull(), F.element_at(by_seq, F.col("parent")))


ABSTRACT_WORDS, DESCRIPTION_WORDS = 200, 500


def abstract(requirement: Column, content: Column, core: Column) -> Column:
    """The requirement, else the first words of the content; then the core text; cut to as many words again."""
    first = F.coalesce(F.nullif(F.trim(requirement), F.lit("")), first_words(F.coalesce(content, F.lit("")), ABSTRACT_WORDS))
    return first_words(F.concat_ws(" ", first, F.nullif(F.trim(core), F.lit(""))), ABSTRACT_WORDS)


def descriptions(sections: DataFrame) -> DataFrame:
    """doc_id, description: the first words of all abstracts in order. sections: doc_id, seq, abstract."""
    own = F.array_sort(F.collect_list(F.struct("seq", "abstract")))
    return sections.groupBy("doc_id").agg(first_words(F.array_join(F.transform(own, lambda x: x["abstract"]), " "), DESCRIPTION_WORDS).alias("description"))


def author_edges(docs: DataFrame) -> DataFrame:
    """type, source, target: documents to each of their authors. docs: doc_id, authors (array)."""
    each = docs.select(F.concat(F.lit("document::"), F.col("doc_id").cast("string")).alias("source"), F.explode("authors").alias("name")).where("trim(name) <> ''")
    return each.select(F.lit("AUTHORED_BY").alias("type"), "source", node_id("author", F.lower(F.trim("name"))).alias("target")).distinct()


#: How many of each kind of enrichment a document adds at most, the type of its edges, and whether they begin at the document.
ENRICHMENTS = {"concept": (8, "HAS_CONCEPT"), "action": (5, "REQUIRES_ACTION")}


def enrichment(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, name) and edges of the concepts and actions that a model found. docs: doc_id, concepts, actions (arrays of names).

    Blank and repeated names are dropped, then the first of each kind count.
    """
    found = None
    for kind, (most, edge) in ENRICHMENTS.items():
        names = F.array_distinct(F.filter(F.transform(F.coalesce(f"{kind}s", F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: n != ""))
        each = docs.select(F.lit(kind).alias("label"), F.lit(edge).alias("type"), F.concat(F.lit("document::"), F.col("doc_id").cast("string")).alias("source"), F.explode(F.slice(names, 1, most)).alias("name"))
        each = each.withColumn("target", node_id(kind, F.lower("name")))
        found = each if found is None else found.unionByName(each)
    nodes = found.groupBy(F.col("target").alias("id"), "label").agg(F.min("name").alias("name"))
    return nodes, found.select("type", "source", "target").distinct()


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and the counts by label and type as JSON."""
    counted = lambda df, c, name: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias(name), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))).alias(f"{name}_by"))
    by_label = counted(nodes.select(F.explode("labels").alias("label")), "label", "labelled")
    return by_label.withColumn("k", F.lit(1)).join(counted(edges, "type", "edges").withColumn("k", F.lit(1)), "k").drop("k")


def date_edges(sections: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """type, source, target: dates found in sections, except those already known. known: doc_id, date."""
    found = sections.select("doc_id", section_id(F.col("doc_id"), F.col("content")).alias("source"), F.explode(all_dates(F.col("content"))).alias("date"))
    if known is not None:
        found = found.join(known, ["doc_id", "date"], "left_anti")
    return found.select(F.lit("HAS_DATE").alias("type"), "source", node_id("date", F.col("date")).alias("target"))


def mention_edges(entities: DataFrame, kind: str, most: int = 8) -> DataFrame:
    """type, source, target: the first entities of each section. entities: id, names (array)."""
    return entities.select(F.col("id").alias("source"), F.explode(F.slice("names", 1, most)).alias("name")).select(F.lit(f"MENTIONS_{kind.upper()}").alias("type"), "source", node_id(kind, F.lower(F.trim("name"))).alias("target"))


def anchored_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def trimmed_vectors(nodes: DataFrame, column: str = "embedding") -> DataFrame:
    return nodes.withColumn(column, F.slice(column, 1, VECTOR))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[int, int]:
    """Nodes by label and anchored edges by type, as Parquet; nothing for an empty payload. Gives the counts of both."""
    if nodes.isEmpty():
        return 0, 0
    nodes.withColumn("label", F.array_join("labels", ":")).write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    anchored_edges(edges, nodes).write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    spark = nodes.sparkSession
    return spark.read.parquet(f"{path}/nodes").count(), spark.read.parquet(f"{path}/edges").count() if not edges.isEmpty() else 0
