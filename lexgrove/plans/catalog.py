"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions import fuzzy
from lexgrove.functions import text as X
from lexgrove.operators import graph, hierarchy, lines, matching, parsers, profile, scoring, shapes, statistics, versioning
from lexgrove.sources import readers
from lexgrove.streaming import inbox

Table = Callable[[str], DataFrame]
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

# Parts that several statements share.
LINES = r"SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d, unnest(range(1, len(l) + 1)) AS u(i)"
CLEAN = lambda c: rf"lower(regexp_replace(regexp_replace(replace(replace(regexp_replace({c}, '▼\w+\d+', '', 'g'), chr(10), ''), chr(9), ''), '<[^>]*>', '', 'g'), '[^A-Za-z0-9]', '', 'g'))"
TREE = rf"""arts AS (SELECT doc_id, seq AS art_seq, 'Articolo ' || (seq + 1) AS id, line AS content FROM ({LINES})),
pars AS (SELECT doc_id, art_seq, CAST(row_number() OVER (PARTITION BY doc_id, art_seq ORDER BY i) - 1 AS INTEGER) AS par_seq, trim(p[i]) AS content, p[i] AS raw FROM (SELECT *, string_split(content, '. ') AS p FROM arts) a, unnest(range(1, len(p) + 1)) AS u(i) WHERE trim(p[i]) <> ''),
subs AS (SELECT doc_id, art_seq, par_seq, CAST(row_number() OVER (PARTITION BY doc_id, art_seq, par_seq ORDER BY i) - 1 AS INTEGER) AS sub_seq, trim(s[i]) AS content FROM (SELECT *, string_split(raw, ', ') AS s FROM pars) a, unnest(range(1, len(s) + 1)) AS u(i) WHERE trim(s[i]) <> '')"""
FLAT = r"""SELECT doc_id, art_seq, 'article' AS level, CAST(NULL AS INTEGER) AS par_seq, CAST(NULL AS INTEGER) AS sub_seq, id, content FROM arts
UNION ALL SELECT doc_id, art_seq, 'paragraph', par_seq, NULL, CAST(par_seq + 1 AS VARCHAR), content FROM pars
UNION ALL SELECT doc_id, art_seq, 'sub', par_seq, sub_seq, CAST(sub_seq + 1 AS VARCHAR), content FROM subs"""
PLAIN = r"lower(trim(regexp_replace(line, '\bpage\s*\d+\b', '', 'gi')))"


def query(sql: str | None = None) -> Callable[[Callable[[Table], DataFrame]], Callable]:
    """Register a function of a table reader under its name."""

    def register(f: Callable[[Table], DataFrame]) -> Callable:
        _queries[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


# scalar functions


@query(
    rf"""SELECT doc_id, sha256({CLEAN("coalesce(text, '')")}) AS clean_hash, CASE WHEN length(trim(coalesce(text, ''))) <= 80 THEN trim(coalesce(text, '')) ELSE substr(trim(coalesce(text, '')), 1, 77) || '...' END AS short,
    CAST(floor(length(text) / 4) AS BIGINT) AS tokens, lower(replace(source, ' ', '')) AS squeezed, CAST(coalesce(TRY_CAST(nullif(regexp_extract(text, '\d+'), '') AS BIGINT), -1) AS BIGINT) AS first_number,
    'doc::' || substr(sha256(source), 1, 24) AS node, replace(source, ' ', '_') AS file FROM documents"""
)
def scalar_text(t: Table) -> DataFrame:
    c = F.col
    return t("documents").select(
        "doc_id", F.sha2(X.alnum_key(c("text")), 256).alias("clean_hash"), X.shortened(c("text"), 80).alias("short"), X.token_estimate(c("text")).alias("tokens"), X.squeezed(c("source")).alias("squeezed"),
        X.first_integer(c("text"), -1).alias("first_number"), X.node_id("doc", c("source")).alias("node"), X.file_name(c("source")).alias("file"),
    )


@query(r"SELECT doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), 1, 10), ' ') AS excerpt FROM documents")
def first_words(t: Table) -> DataFrame:
    return t("documents").select("doc_id", X.first_words(F.col("text"), 10).alias("excerpt"))


@query()
def content_complexity(t: Table) -> DataFrame:
    """Over all texts, with whole words; a null text has a null complexity. DuckDB's word boundaries know ASCII letters only."""
    return t("documents").select("doc_id", X.complexity(F.col("text")).alias("complexity"))


@query(
    r"""SELECT o_orderkey, coalesce(nullif(regexp_extract(d, '\d{2}/\d{2}/\d{4}'), ''), nullif(regexp_extract(d, '\d{4}-\d{2}-\d{2}'), ''), '') AS first_date, epoch(DATE '1998-12-31'::TIMESTAMP) - epoch(o_orderdate) AS seconds
    FROM (SELECT *, 'ref ' || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)"""
)
def dates_and_spans(t: Table) -> DataFrame:
    d = F.concat(F.lit("ref "), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return t("orders").select("o_orderkey", X.first_date(d).alias("first_date"), X.seconds_between(F.col("o_orderdate"), F.lit("1998-12-31 00:00:00")).alias("seconds"))


@query(
    r"""SELECT CASE WHEN lower(source) LIKE '%gazzetta%' OR lower(source) LIKE '%celex%' THEN 'Gazzetta ufficiale' WHEN lower(source) LIKE '%banca%' THEN 'Banca d''Italia' WHEN lower(source) LIKE '%boe%' THEN 'Boletin Oficial del Estado'
    WHEN lower(source) LIKE '%eba%' THEN 'European Banking Authority' WHEN lower(source) LIKE '%uif%' THEN 'UIF' ELSE 'Fonte non classificata' END AS legal_source, count(*) AS n
    FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'BOE ' WHEN 1 THEN 'Celex ' WHEN 2 THEN 'EBA_' ELSE '' END || source AS source FROM documents) GROUP BY 1"""
)
def legal_sources(t: Table) -> DataFrame:
    k = F.col("doc_id") % 5
    name = F.concat(F.when(k == 0, "BOE ").when(k == 1, "Celex ").when(k == 2, "EBA_").otherwise(""), F.col("source"))
    return t("documents").groupBy(X.legal_source(name).alias("legal_source")).agg(F.count(F.lit(1)).alias("n"))


WORDS_OF = "[" + ", ".join(f"'{w}'" for w in X.PROVISIONS) + "]"


@query(f"SELECT p_partkey, coalesce(list_filter({WORDS_OF}, lambda w: starts_with(upper(x), w))[1], '') AS provision FROM (SELECT p_partkey, coalesce(lower({WORDS_OF}[p_partkey % 30 + 1]), 'other') || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_name ELSE p_name END AS x FROM part)")
def provision_types(t: Table) -> DataFrame:
    """Texts that begin with each of the keywords, in lower case, followed by a space or not."""
    word = F.coalesce(F.lower(F.get(F.array(*map(F.lit, X.PROVISIONS)), (F.col("p_partkey") % 30).cast("int"))), F.lit("other"))
    return t("part").select("p_partkey", X.provision_type(F.concat(word, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.col("p_name")))).alias("provision"))


REQUIREMENTS = [w for _, words in X.PATTERN_WORDS for w in words] + ["entro il", "nulla"]


@query(
    "SELECT o_orderkey, CASE " + " ".join("WHEN " + " OR ".join(f"regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}_])({w})($|[^\\p{{L}}\\p{{N}}_])')" for w in words) + f" THEN '{kind}'" for kind, words in X.PATTERN_WORDS)
    + f" WHEN contains(x, 'entro il') THEN 'Termine temporale' ELSE 'altro' END AS kind FROM (SELECT o_orderkey, lower(o_orderpriority || ' ' || w[o_orderkey % {len(REQUIREMENTS)} + 1] || CASE o_orderkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN ', ' ELSE ' ' END || w[o_orderkey // 7 % {len(REQUIREMENTS)} + 1]) AS x FROM (SELECT *, ["
    + ", ".join(f"'{w}'" for w in REQUIREMENTS) + "] AS w FROM orders))"
)
def requirement_kinds(t: Table) -> DataFrame:
    """Two keywords to a sentence, some of them run into the next word, some in capitals."""
    word = lambda i: F.get(F.array(*map(F.lit, REQUIREMENTS)), (i % len(REQUIREMENTS)).cast("int"))
    k = F.col("o_orderkey")
    mark = F.when(k % 3 == 0, "x").when(k % 3 == 1, ", ").otherwise(" ")
    return t("orders").select("o_orderkey", X.pattern_class(F.upper(F.concat("o_orderpriority", F.lit(" "), word(k), mark, word(F.floor(k / 7))))).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN c = 0 THEN '' WHEN c = 30 THEN 'literal' WHEN c >= 15 THEN 'strong' WHEN c <= 1 THEN 'misleading' ELSE 'weak' END AS band FROM (SELECT *, CAST(l_quantity AS BIGINT) % 31 AS c FROM lineitem)")
def reach_bands(t: Table) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", X.reach_band(F.col("l_quantity").cast("bigint") % 31).alias("band"))


@query("SELECT a.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9), 9) AS cosine FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b USING (vec_id)")
def neighbour_cosine(t: Table) -> DataFrame:
    e = t("embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id").select("vec_id", F.round(X.cosine(F.col("a"), F.col("b")), 9).alias("cosine"))


@query("SELECT o_orderkey, array_to_string(list_sort([md5(o_orderstatus), md5(o_orderpriority)]), '_vs_') AS pair FROM orders")
def unordered_pairs(t: Table) -> DataFrame:
    return t("orders").select("o_orderkey", X.unordered_pair(F.md5("o_orderstatus"), F.md5("o_orderpriority")).alias("pair"))


@query("SELECT doc_id, lower(trim(coalesce(text, ''))) LIKE '%informazioni sul documento%' AS metadata, trim(CAST(doc_id % 3 AS VARCHAR)) = '0' OR length(trim(text)) >= 10 AS scorable FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Informazioni sul Documento ' ELSE '' END || text AS text FROM documents)")
def eligibility(t: Table) -> DataFrame:
    text = F.concat(F.when(F.col("doc_id") % 4 == 0, "Informazioni sul Documento ").otherwise(""), F.col("text"))
    return t("documents").select("doc_id", X.is_metadata(text).alias("metadata"), X.scorable(text, F.col("doc_id") % 3).alias("scorable"))


# trees


@query(rf"WITH {TREE} SELECT *, sha256(lower(regexp_replace(content, '[^A-Za-z0-9]', '', 'g'))) AS hash FROM ({FLAT})")
def flatten_tree(t: Table) -> DataFrame:
    return hierarchy.flatten(hierarchy.tree_of(t("documents")))


@query(rf"WITH {TREE} SELECT doc_id, art_seq, chr(10) || string_agg(content, chr(10) ORDER BY par_seq, sub_seq) AS content FROM subs GROUP BY doc_id, art_seq")
def rebuild_contents(t: Table) -> DataFrame:
    return hierarchy.rebuild_contents(hierarchy.flatten(hierarchy.tree_of(t("documents"))))


@query(
    rf"""WITH {TREE} SELECT doc_id, CAST(count(*) FILTER (level = 'article') AS BIGINT) AS articles, CAST(sum(pars) AS BIGINT) AS paragraphs, CAST(sum(s) AS BIGINT) AS subs FROM (
    SELECT 'article' AS level, a.doc_id, greatest((SELECT count(*) FROM pars p WHERE p.doc_id = a.doc_id AND p.art_seq = a.art_seq), 1) AS pars,
    CASE WHEN (SELECT count(*) FROM pars p WHERE p.doc_id = a.doc_id AND p.art_seq = a.art_seq) = 0 THEN 1 ELSE (SELECT sum(greatest(coalesce(n, 0), 1)) FROM pars p LEFT JOIN (SELECT doc_id, art_seq, par_seq, count(*) AS n FROM subs GROUP BY ALL) x USING (doc_id, art_seq, par_seq) WHERE p.doc_id = a.doc_id AND p.art_seq = a.art_seq) END AS s FROM arts a) GROUP BY doc_id"""
)
def full_depth(t: Table) -> DataFrame:
    deep = hierarchy.with_full_depth(hierarchy.tree_of(t("documents")))
    subs = F.aggregate("paragraphs", F.lit(0), lambda n, p: n + F.size(p["subs"]))
    return deep.groupBy("doc_id").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.size("paragraphs").cast("bigint")).alias("paragraphs"), F.sum(subs.cast("bigint")).alias("subs"))


@query(rf"WITH {TREE} SELECT p.doc_id, p.art_seq, p.par_seq, s.sub_seq, coalesce(s.content, p.content) AS content FROM pars p LEFT JOIN subs s USING (doc_id, art_seq, par_seq)")
def leaf_units(t: Table) -> DataFrame:
    return hierarchy.leaves(hierarchy.tree_of(t("documents")))


@query(rf"WITH {TREE} SELECT doc_id, array_to_string([art_seq, par_seq, sub_seq], '.') AS coordinates, content AS value FROM subs")
def path_values(t: Table) -> DataFrame:
    tree = hierarchy.tree_of(t("documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("art_seq", "paragraphs"))).alias("articles"))
    found = hierarchy.path_values(tree, "doc_id", ["articles", "paragraphs", "subs", "content"])
    return found.select("doc_id", F.array_join(F.col("coordinates").cast("array<string>"), ".").alias("coordinates"), "value")


@query("SELECT doc_id, section, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f) AS INTEGER) AS seq, ids AS part_ids, content FROM (SELECT o_custkey AS doc_id, o_orderpriority AS section, min(o_orderkey) AS f, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS ids, string_agg(o_orderstatus, chr(10) ORDER BY o_orderkey) AS content FROM orders GROUP BY ALL)")
def section_groups(t: Table) -> DataFrame:
    parts = t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("section"), F.col("o_orderkey").alias("part_id"), F.col("o_orderstatus").alias("content"))
    return hierarchy.sections(parts).withColumn("part_ids", F.array_join(F.col("part_ids").cast("array<string>"), ","))


@query("SELECT o_custkey AS doc_id, o_orderkey AS part_id, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS sibling_of FROM orders")
def sibling_parts(t: Table) -> DataFrame:
    parts = t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("section"), F.col("o_orderkey").alias("part_id"))
    return hierarchy.sibling_parts(parts).drop("section")


@query("SELECT o_custkey, o_orderkey, array_to_string(CASE WHEN row_number() OVER w > 1 AND len(f) > 0 THEN list_concat(refs, f) ELSE refs END, ',') AS all_refs FROM (SELECT *, first_value(refs) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM (SELECT o_custkey, o_orderkey, CASE WHEN (o_orderkey // 2) % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE [CAST((o_orderkey // 2) AS VARCHAR)] END AS refs FROM orders)) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def inherited_references(t: Table) -> DataFrame:
    refs = F.when(F.floor(F.col("o_orderkey") / 2) % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.floor(F.col("o_orderkey") / 2).cast("string")))
    units = t("orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("art_seq"), F.lit(0).alias("par_seq"), F.col("o_orderkey").alias("sub_seq"), refs.alias("refs"))
    return hierarchy.inherited_references(units).select(F.col("doc_id").alias("o_custkey"), F.col("sub_seq").alias("o_orderkey"), F.array_join("all_refs", ",").alias("all_refs"))


@query("SELECT doc_id, line FROM (SELECT doc_id, line, max(contains(lower(line), 'th')) OVER (PARTITION BY doc_id) AS law FROM (" + LINES + ")) WHERE NOT (law AND regexp_matches(line, '^[0-9]+$'))")
def law_mode(t: Table) -> DataFrame:
    """Where any line has a mark, purely numeric lines go."""
    return shapes.law_mode(lines.lines_of(t("documents")), "doc_id", "line", "th").select("doc_id", "line")


# comparison


@query(
    rf"""WITH l AS ({LINES}), a AS (SELECT doc_id, seq + 1 AS n_art, '' AS n_par, line AS content FROM l UNION ALL SELECT doc_id, seq + 1, CAST(i AS VARCHAR), p[i] FROM (SELECT *, string_split(line, '. ') AS p FROM l), unnest(range(1, len(p) + 1)) AS u(i)),
    r AS (SELECT doc_id, n_chars % 9 + 1 AS n_art, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars % 3 + 1 AS VARCHAR) ELSE '' END AS n_par FROM documents)
    SELECT r.doc_id, r.n_art, nullif(r.n_par, '') AS n_par, a.content AS target, a.content IS NOT NULL AS found FROM r LEFT JOIN a USING (doc_id, n_art, n_par)"""
)
def reference_resolution(t: Table) -> DataFrame:
    """Half of the references name a paragraph of the article, the others the article itself."""
    docs = t("documents")
    own = lines.lines_of(docs).withColumn("n_art", F.col("seq") + 1)
    paragraphs = own.select("doc_id", "n_art", F.posexplode(F.split("line", r"\. ")).alias("i", "content")).select("doc_id", "n_art", (F.col("i") + 1).cast("string").alias("n_par"), "content")
    articles = own.select("doc_id", "n_art", F.lit(None).cast("string").alias("n_par"), F.col("line").alias("content")).unionByName(paragraphs)
    refs = docs.select("doc_id", (F.col("n_chars") % 9 + 1).alias("n_art"), F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") % 3 + 1).cast("string")).alias("n_par"))
    return matching.resolve_references(refs, articles).select("doc_id", "n_art", "n_par", "target", "found")


@query(
    rf"""WITH l AS (SELECT doc_id, seq, CASE WHEN seq % 19 = 18 THEN 'Art' ELSE 'Articolo ' || (seq + 1) END AS id, line FROM ({LINES})), n AS (SELECT *, seq % 11 = 5 AS ph FROM l WHERE seq % 5 <> 1), o AS (SELECT doc_id, seq, id, CASE WHEN seq % 7 = 3 THEN line || ' x' ELSE line END AS line, seq % 13 = 5 AS ph FROM l WHERE seq % 4 <> 2),
    f AS (SELECT doc_id, id, max(seq) AS seq, arg_max(line, seq) AS line, arg_max(ph, seq) AS ph FROM o GROUP BY 1, 2),
    j AS (SELECT n.doc_id, n.seq AS art_seq, n.id AS art_id, f.seq AS os, CASE WHEN n.id = 'Art' THEN 'Scartato' WHEN n.ph THEN 'Eliminato' WHEN f.seq IS NULL THEN 'Inserito' WHEN {CLEAN("n.line")} = {CLEAN("f.line")} THEN 'Confermato' WHEN f.ph THEN 'Inserito' ELSE 'Da Verificare' END AS verdict FROM n LEFT JOIN f USING (doc_id, id))
    SELECT doc_id, art_seq, art_id, CASE WHEN verdict IN ('Confermato', 'Da Verificare') THEN os END AS old_art_seq, verdict FROM j UNION ALL SELECT doc_id, NULL, id, seq, 'Rimosso' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = o.doc_id AND n.id = o.id)"""
)
def version_verdicts(t: Table) -> DataFrame:
    name = F.when(F.col("seq") % 19 == 18, "Art").otherwise(F.concat(F.lit("Articolo "), (F.col("seq") + 1).cast("string")))
    all_ = lines.lines_of(t("documents")).select("doc_id", F.col("seq").alias("art_seq"), name.alias("art_id"), F.col("line").alias("content"))
    new = all_.where(F.col("art_seq") % 5 != 1).withColumn("is_placeholder", F.col("art_seq") % 11 == 5)
    changed = F.when(F.col("art_seq") % 7 == 3, F.concat("content", F.lit(" x"))).otherwise(F.col("content"))
    old = all_.where(F.col("art_seq") % 4 != 2).withColumn("content", changed).withColumn("is_placeholder", F.col("art_seq") % 13 == 5)
    return versioning.article_verdicts(versioning.keyed(new), versioning.keyed(old)).select("doc_id", "art_seq", "art_id", "old_art_seq", "verdict")


@query("SELECT a, b, distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS r FROM (SELECT s_name AS a, c_name AS b, levenshtein(lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')), lower(regexp_replace(replace(c_name, 'Customer', 'Supplier'), '[^A-Za-z0-9]', '', 'g'))) AS distance, length(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE distance = 0 OR distance < 0.1 * n) WHERE r = 1")
def renamed_articles(t: Table) -> DataFrame:
    left = t("supplier").where("s_name is not null").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("a"))
    right = t("customer").where("c_name is not null").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("b"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("id"))
    return matching.renamed(left, right, "nation").select("a", "b", F.col("distance").cast("bigint").alias("distance"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS score, l_quantity < 15 AS weak FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def best_matches(t: Table) -> DataFrame:
    return matching.best_match(t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("score")), "l_orderkey", "score", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC) AS r FROM lineitem) WHERE r = 1")
def argmax_with_ties(t: Table) -> DataFrame:
    return matching.best_matches_with_ties(t("lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_orderkey", "l_discount").select("l_orderkey", "l_linenumber")


@query(
    """SELECT o_custkey, o_orderkey, s AS score, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o THEN -s END NULLS FIRST, o_orderkey) AS r FROM (SELECT *, max(s > 15) OVER w AS o, max(s = 15) OVER w AS e FROM (SELECT o_custkey, o_orderkey, (o_orderkey // 3) % 18 AS s FROM orders) WINDOW w AS (PARTITION BY o_custkey))
    WHERE CASE WHEN o THEN s > 15 WHEN e THEN s = 15 ELSE true END) WHERE r <= CASE WHEN o OR e THEN 3 ELSE 1 END"""
)
def candidate_articles(t: Table) -> DataFrame:
    pairs = t("orders").select("o_custkey", "o_orderkey", (F.floor(F.col("o_orderkey") / 3) % 18).alias("score"))
    return matching.candidate_articles(pairs, "o_custkey", "score", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY TRY_CAST(replace(c, ',', '.') AS DOUBLE) DESC NULLS LAST, o_orderkey) > 1 THEN 'x' ELSE '' END AS secondary FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 7 AS VARCHAR) || ',5' END AS c FROM orders)")
def secondary_matches(t: Table) -> DataFrame:
    c = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit(",5")))
    rows = t("orders").select("o_custkey", "o_orderkey", c.alias("c"))
    return matching.secondary_marks(rows, ["o_custkey"], X.sortable_number(F.col("c")), "o_orderkey").drop("c")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def not_implemented(t: Table) -> DataFrame:
    results = t("orders").where(F.col("o_orderpriority").startswith("1"))
    return matching.not_implemented(t("customer").select("c_custkey", "c_name"), results, X.first_integer(F.col("c_custkey").cast("string"), -1), F.col("o_custkey")).select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem WHERE l_quantity >= 20) WHERE r = 1")
def matches_over_threshold(t: Table) -> DataFrame:
    return matching.over_threshold(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity", "l_linenumber")


@query("SELECT 'dir/EXT_' || c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE md5(c_name) END AS hash FROM customer")
def name_hashes(t: Table) -> DataFrame:
    c = t("customer")
    names = c.select(F.concat(F.lit("dir/EXT_"), "c_name").alias("name"))
    return matching.name_lookup(names, c.where("c_custkey % 3 != 0").select(F.col("c_name").alias("known"), F.md5("c_name").alias("hash"))).select("name", "hash")


@query(
    """WITH i AS (SELECT o_custkey AS doc_id, o_orderkey AS entry, CAST(dayofyear(o_orderdate) AS INTEGER) AS page FROM orders), r AS (SELECT *, coalesce(greatest(lead(page) OVER (PARTITION BY doc_id ORDER BY page, entry) - 1, page), 400) AS end_page FROM i)
    SELECT p.o_orderkey AS point, r.entry FROM orders p JOIN r ON r.doc_id = p.o_custkey AND dayofyear(p.o_orderdate) + 2 BETWEEN r.page AND r.end_page"""
)
def index_page_ranges(t: Table) -> DataFrame:
    o = t("orders")
    index = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("entry"), F.dayofyear("o_orderdate").alias("page"))
    points = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("point"), (F.dayofyear("o_orderdate") + 2).alias("at"))
    return matching.in_ranges(points, matching.page_ranges(index, F.lit(400)), "doc_id", "at", "page", "end_page", 50).select("point", "entry")


@query("SELECT b.l_orderkey AS block FROM lineitem b WHERE l_linenumber = 1 AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = b.l_orderkey AND x.l_linenumber = 2 AND b.l_quantity >= x.l_quantity - 12 AND b.l_quantity + 5 <= x.l_quantity + 17 AND b.l_suppkey >= x.l_suppkey - 42 AND b.l_suppkey + 1 <= x.l_suppkey + 42)")
def blocks_outside_tables(t: Table) -> DataFrame:
    li = t("lineitem")
    blocks = li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("x0"), F.col("l_suppkey").alias("y0"), (F.col("l_quantity") + 5).alias("x1"), (F.col("l_suppkey") + 1).alias("y1"))
    tables = li.where("l_linenumber = 2").select(F.col("l_orderkey").alias("page"), (F.col("l_quantity") - 10).alias("tx0"), (F.col("l_suppkey") - 40).alias("ty0"), (F.col("l_quantity") + 15).alias("tx1"), (F.col("l_suppkey") + 40).alias("ty1"))
    return matching.outside_boxes(blocks, tables).select(F.col("page").alias("block"))


# lines


@query(rf"SELECT doc_id, {PLAIN} AS plain, count(*) AS n FROM ({LINES}) WHERE {PLAIN} <> '' GROUP BY 1, 2 HAVING count(*) >= 3")
def repeated_lines(t: Table) -> DataFrame:
    return lines.repeated_lines(lines.lines_of(t("documents")), ["doc_id"])


@query(rf"WITH p AS (SELECT *, {PLAIN} AS plain FROM ({LINES})) SELECT doc_id, seq, line FROM p WHERE NOT (plain <> '' AND (doc_id, plain) IN (SELECT (doc_id, plain) FROM p WHERE plain <> '' GROUP BY doc_id, plain HAVING count(*) >= 3))")
def lines_without_repeats(t: Table) -> DataFrame:
    return lines.without_repeated(lines.lines_of(t("documents")), ["doc_id"])


@query(rf"SELECT doc_id, seq, last_value(CASE WHEN length(line) < 120 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS heading FROM ({LINES})")
def headings(t: Table) -> DataFrame:
    return lines.with_heading(lines.lines_of(t("documents")), F.length("line") < 120).select("doc_id", "seq", "heading")


@query(
    rf"""WITH h AS (SELECT *, length(line) < 120 AS h FROM ({LINES})), g AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS segment, coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY seq), false) AND NOT h AS t FROM h)
    SELECT doc_id, CAST(segment AS BIGINT) AS segment, max(CASE WHEN h THEN line END) AS heading, max(CASE WHEN t THEN line END) AS title, coalesce(string_agg(CASE WHEN NOT h AND NOT t THEN line END, chr(10) ORDER BY seq), '') AS content FROM g GROUP BY 1, 2"""
)
def heading_segments(t: Table) -> DataFrame:
    return lines.segments(lines.lines_of(t("documents")), F.length("line") < 120)


@query(rf"SELECT doc_id, CAST(g AS BIGINT) AS \"group\", string_agg(line, ' ' ORDER BY seq) AS line FROM (SELECT *, sum((length(line) > 100)::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM ({LINES})) GROUP BY 1, 2".replace("\\", ""))
def continuation_rows(t: Table) -> DataFrame:
    return lines.merged_continuations(lines.lines_of(t("documents")), F.length("line") > 100, "line")


@query("WITH i AS (SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS seq, event_id // 1000 AS number FROM events), n AS (SELECT *, lead(number) OVER (PARTITION BY doc_id ORDER BY seq) AS nx FROM i) SELECT doc_id, seq, u.n AS number, u.n <> n.number AS is_placeholder FROM n, unnest(CASE WHEN nx > number + 1 THEN range(number, nx) ELSE [number] END) AS u(n)")
def number_gaps(t: Table) -> DataFrame:
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    items = t("events").select(F.col("user_id").alias("doc_id"), seq.alias("seq"), F.floor(F.col("event_id") / 1000).alias("number"))
    return lines.number_gaps(items)


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk, substr(text, i * 1000 + 1, 1000) AS content FROM documents, unnest(range(0, CAST(ceil(length(text) / 1000) AS BIGINT))) AS u(i)")
def fixed_chunks(t: Table) -> DataFrame:
    return lines.fixed_chunks(t("documents"), 1000)


@query(
    rf"""WITH m AS (SELECT *, length(line) < 60 AS alone, sum((NOT length(line) < 60)::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM ({LINES})), o AS (SELECT *, alone AND sum(alone::INT) OVER (PARTITION BY doc_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING) % 2 = 1 AS opens FROM m),
    p AS (SELECT *, lead(line) OVER w AS following, coalesce(lag(opens) OVER w, false) AS taken FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT doc_id, seq, CASE WHEN opens AND following IS NOT NULL THEN line || ' ' || following ELSE line END AS line FROM p WHERE NOT taken"""
)
def broken_lines(t: Table) -> DataFrame:
    return lines.joined_broken_lines(lines.lines_of(t("documents")), F.length("line") < 60)


@query()
def sentence_chunks(t: Table) -> DataFrame:
    return lines.sentence_chunks(t("documents"), 1000, 1500)


@query()
def overlapping_chunks(t: Table) -> DataFrame:
    return lines.overlapping_chunks(t("documents"), 6000, 1000)


@query()
def list_items(t: Table) -> DataFrame:
    return lines.list_items(t("documents"))


@query(
    """WITH RECURSIVE i AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS INTEGER) AS seq, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) // 3 + o_orderkey % 2 AS BIGINT) AS number, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 30 + 1 AS BIGINT) ELSE 1 END AS own, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
    f AS (SELECT doc_id, seq, r, own, number, true AS accepted, number AS last, own AS rank FROM i WHERE r = 1
      UNION ALL SELECT doc_id, seq, r, own, number, ok, CASE WHEN ok THEN number ELSE last END, CASE WHEN ok THEN own ELSE rank END FROM (SELECT i.*, f.last, f.rank, f.last = 0 OR CASE WHEN i.number = f.last + 1 THEN i.own = 1 ELSE i.number = f.last AND i.own - f.rank IN (1, 2) OR i.number = f.last + 2 END AS ok FROM f JOIN i ON i.doc_id = f.doc_id AND i.r = f.r + 1))
    SELECT doc_id, seq, number, ["""
    + ", ".join(f"'{e}'" for e in lines.EXTENSIONS) + "][own] AS extension, accepted FROM f"
)
def accepted_articles(t: Table) -> DataFrame:
    from pyspark.sql import Window

    o = F.col("o_orderkey")
    extension = F.when(o % 3 == 0, F.get(F.array(*map(F.lit, lines.EXTENSIONS)), (o % 30).cast("int"))).otherwise("")
    number = (F.floor(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) / 3) + o % 2).cast("long")
    return lines.accepted_articles(t("orders").select(F.col("o_custkey").alias("doc_id"), o.cast("int").alias("seq"), number.alias("number"), extension.alias("extension")))


@query(
    rf"""WITH b AS (SELECT doc_id, seq, line, CASE WHEN length(line) < 120 THEN CASE WHEN length(line) % 7 + 10 >= 15.4 THEN 1 WHEN length(line) % 7 + 10 >= 13.2 THEN 2 ELSE 3 END ELSE 0 END AS level FROM ({LINES})),
    p AS (SELECT *, """ + ", ".join(f"last_value(CASE WHEN level = {k} THEN seq END IGNORE NULLS) OVER w AS s{k}, last_value(CASE WHEN level = {k} THEN line END IGNORE NULLS) OVER w AS t{k}" for k in (1, 2, 3))
    + """ FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, seq, level, concat_ws(' > ', CASE WHEN s1 IS NOT NULL THEN '1 ' || t1 END, CASE WHEN s2 > coalesce(s1, -1) THEN '2 ' || t2 END, CASE WHEN s3 > greatest(coalesce(s1, -1), coalesce(s2, -1)) THEN '3 ' || t3 END) AS path FROM p"""
)
def title_paths(t: Table) -> DataFrame:
    """Each title in a path is shown with its level."""
    size = (F.length("line") % 7 + 10).cast("double")
    found = lines.lines_of(t("documents")).withColumns({"size": size, "is_title": F.length("line") < 120})
    named = found.withColumn("line", F.concat(F.when(size >= 1.4 * 11, "1 ").when(size >= 1.2 * 11, "2 ").otherwise("3 "), "line"))
    return lines.title_paths(named).withColumn("path", F.array_join("path", " > "))


@query(
    """WITH RECURSIVE i AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS INTEGER) AS seq, CAST(floor(o_totalprice / 20) AS BIGINT) AS tokens FROM orders), p AS (SELECT doc_id, seq, CAST(k AS INTEGER) AS part, least(3000, tokens - k * 3000) AS tokens FROM i, unnest(range(0, greatest((tokens + 2999) // 3000, 1))) AS u(k)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, part) AS r FROM p),
    f AS (SELECT *, 0 AS batch, tokens AS used FROM o WHERE r = 1 UNION ALL SELECT o.*, CASE WHEN f.used > 0 AND f.used + o.tokens > 3000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used > 0 AND f.used + o.tokens > 3000 THEN o.tokens ELSE f.used + o.tokens END FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1)
    SELECT doc_id, seq, part, tokens, batch FROM f"""
)
def token_batches(t: Table) -> DataFrame:
    items = t("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("seq"), F.floor(F.col("o_totalprice") / 20).alias("tokens"))
    return lines.token_batches(items, 3000)


# statistics

OPS = "SELECT event_type AS mode, user_id + 1 AS tokens, value AS seconds, event_id, ts FROM events"


def _operations(t: Table) -> DataFrame:
    return t("events").select(F.col("event_type").alias("mode"), (F.col("user_id") + 1).alias("tokens"), F.col("value").alias("seconds"), "event_id", "ts")


@query(f"SELECT mode, round(avg(CASE WHEN n >= 3 AND r > floor(n * 0.1) AND r <= n - floor(n * 0.1) THEN seconds END), 6) AS truncated_mean FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY seconds) AS r, count(*) OVER (PARTITION BY mode) AS n FROM ({OPS}) WHERE seconds IS NOT NULL) GROUP BY mode")
def truncated_means(t: Table) -> DataFrame:
    return statistics.truncated_mean(_operations(t), "mode", "seconds").withColumn("truncated_mean", F.round("truncated_mean", 6))


@query(f"SELECT mode, round(sum(seconds), 4) AS total_seconds, CAST(sum(tokens) AS BIGINT) AS total_tokens, count(*) AS operations FROM ({OPS}) WHERE seconds >= 10 AND tokens > 0 GROUP BY mode")
def mode_totals(t: Table) -> DataFrame:
    return statistics.mode_totals(_operations(t), "mode", "tokens", "seconds").withColumn("total_seconds", F.round("total_seconds", 4))


@query(f"SELECT mode, round(coalesce(avg(CASE WHEN seconds > 5 AND tokens > 0 THEN tokens / seconds END), 63.0), 2) AS tokens_per_second FROM ({OPS}) GROUP BY mode")
def token_rates(t: Table) -> DataFrame:
    return statistics.token_rate(_operations(t), "mode", "tokens", "seconds")


CHAINED = "SELECT event_type || '/' || user_id % 40 AS mode, CASE WHEN user_id % 40 = 3 THEN 0 ELSE user_id + 1 END AS tokens, value AS seconds FROM events"


@query(
    f"""WITH v AS (SELECT *, seconds / tokens AS rate FROM ({CHAINED}) WHERE tokens > 0 AND seconds > 10 AND seconds < 1800 AND seconds / tokens < 1.0),
    g AS (SELECT mode, count(*) AS n, regr_slope(seconds, tokens) * 500 + regr_intercept(seconds, tokens) AS fit, sum(seconds) / sum(tokens) AS ratio FROM v GROUP BY mode),
    p AS (SELECT mode, avg(CASE WHEN r > floor(n * 0.1) AND r <= n - floor(n * 0.1) THEN rate END) AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY rate) AS r, count(*) OVER (PARTITION BY mode) AS n FROM v) GROUP BY mode HAVING any_value(n) >= 3)
    SELECT mode, round(CASE WHEN n >= 10 AND fit IS NOT NULL THEN fit ELSE coalesce(truncated * 500, ratio * 500, 500 / 63.0) END, 6) AS estimate, CASE WHEN n >= 10 AND fit IS NOT NULL THEN 'linear' WHEN truncated IS NOT NULL THEN 'truncated' WHEN ratio IS NOT NULL THEN 'ratio' ELSE 'fallback' END AS source FROM (SELECT DISTINCT mode FROM ({CHAINED})) LEFT JOIN g USING (mode) LEFT JOIN p USING (mode)"""
)
def time_estimates(t: Table) -> DataFrame:
    """Modes of few operations, so that every link of the chain decides some."""
    mode = F.concat("event_type", F.lit("/"), (F.col("user_id") % 40).cast("string"))
    ops = t("events").select(mode.alias("mode"), F.when(F.col("user_id") % 40 == 3, 0).otherwise(F.col("user_id") + 1).alias("tokens"), F.col("value").alias("seconds"))
    return statistics.time_estimates(ops, "mode", "tokens", "seconds", F.lit(500)).withColumn("estimate", F.round("estimate", 6))


@query(f"SELECT mode, event_id FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY ts DESC, event_id DESC) AS r FROM ({OPS})) WHERE r <= 10")
def last_operations(t: Table) -> DataFrame:
    return statistics.last_operations(_operations(t), "mode", ["ts", "event_id"]).select("mode", "event_id")


@query(
    "SELECT o_orderkey, round(CASE WHEN p > 0 THEN p ELSE b * CASE WHEN k > 15000 THEN 1.5 WHEN k > 10000 THEN 1.3 WHEN k < 2000 THEN 1.1 ELSE 1.2 END END + CASE WHEN o_totalprice / greatest(k, 1) > 200 THEN 30 ELSE 0 END, 4) AS estimate, round(greatest(60.0, 1.2 * b), 4) AS comparison FROM (SELECT *, exp(4.6741 - 0.5726 * ln(1 + b) + 0.8864 * ln(1 + o_totalprice / 1e6) + 1.1992 * ln(1 + o_orderkey % 10)) - 1 AS p FROM (SELECT *, o_custkey % 700 AS b, o_orderkey % 20000 AS k FROM orders))"
)
def duration_estimates(t: Table) -> DataFrame:
    b, k = (F.col("o_custkey") % 700).cast("double"), F.col("o_orderkey") % 20000
    modelled = statistics.log_model(b, F.col("o_totalprice") / 1e6, F.col("o_orderkey") % 10)
    return t("orders").select("o_orderkey", F.round(statistics.adjusted(b, modelled, k, F.col("o_totalprice")), 4).alias("estimate"), F.round(statistics.comparison_estimate(b), 4).alias("comparison"))


@query("SELECT lang, CAST(min(n) AS INTEGER) AS least, round(avg(n), 6) AS mean, CAST(max(n) AS INTEGER) AS most FROM (SELECT lang, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n FROM documents) GROUP BY lang")
def word_statistics(t: Table) -> DataFrame:
    return statistics.word_stats(t("documents"), "lang", "text").withColumn("mean", F.round("mean", 6))


@query("SELECT l_orderkey AS doc_id, coalesce(median(CASE WHEN l_linenumber < 5 THEN l_quantity END), 11.0) AS body_size FROM lineitem GROUP BY 1")
def body_sizes(t: Table) -> DataFrame:
    spans = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("size"), F.col("l_returnflag").alias("font"))
    return statistics.body_font(spans).select("doc_id", "body_size")


# graph

SECTIONS = f"SELECT doc_id, seq, line AS content, 'section::' || doc_id || ':' || substr(sha256(line), 1, 20) AS id FROM ({LINES})"
EDGES = f"""SELECT 'PUBLISHED' AS type, 'source::' || substr(sha256('Fonte non classificata'), 1, 24) AS source, 'document::' || doc_id AS target FROM documents
UNION ALL SELECT 'CONTAINS', 'document::' || doc_id, id FROM ({SECTIONS})
UNION ALL SELECT * FROM (SELECT 'NEXT', id, lead(id) OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM ({SECTIONS})) WHERE n IS NOT NULL
UNION ALL SELECT 'PART_OF', c.id, p.id FROM ({SECTIONS}) c JOIN ({SECTIONS}) p ON c.doc_id = p.doc_id AND p.seq = 0 AND c.seq > 0"""


def _graph(t: Table) -> tuple[DataFrame, DataFrame]:
    docs = t("documents")
    sections = lines.lines_of(docs).select("doc_id", "seq", F.when(F.col("seq") > 0, 0).alias("parent"), F.col("line").alias("content"))
    return graph.document_graph(docs.select("doc_id", "source"), sections)


@query(f"SELECT id, label FROM (SELECT DISTINCT id, 'Section' AS label FROM ({SECTIONS}) UNION ALL SELECT 'document::' || doc_id, 'Document' FROM documents UNION ALL SELECT DISTINCT 'source::' || substr(sha256('Fonte non classificata'), 1, 24), 'LegalSource' FROM documents)")
def graph_nodes(t: Table) -> DataFrame:
    return _graph(t)[0].select("id", F.get("labels", F.lit(0)).alias("label"))


@query(EDGES)
def graph_edges(t: Table) -> DataFrame:
    return _graph(t)[1]


@query(f"WITH e AS ({EDGES}) SELECT type, source, target FROM e WHERE type <> 'PUBLISHED'")
def anchored_edges(t: Table) -> DataFrame:
    """All edges, and as many to targets that don't exist; nodes of sources are left out, so that their edges go as well."""
    nodes, edges = _graph(t)
    dangling = edges.withColumn("target", F.concat("target", F.lit("/none")))
    return graph.anchored_edges(edges.unionByName(dangling), nodes.where("labels[0] != 'LegalSource'"))


@query(f"SELECT 'document::' || doc_id AS source, 'author::' || substr(sha256(a), 1, 24) AS target FROM (SELECT DISTINCT doc_id, unnest([lower(source), 'same author']) AS a FROM documents WHERE doc_id IS NOT NULL)")
def author_edges(t: Table) -> DataFrame:
    docs = t("documents").select("doc_id", F.array(F.concat(F.lit(" "), F.upper("source")), F.lit("Same Author"), F.lit(" ")).alias("authors"))
    return graph.author_edges(docs).drop("type")


@query("SELECT type, count(*) AS n FROM (SELECT DISTINCT 'HAS_CONCEPT' AS type, o_custkey AS d, CAST(x AS VARCHAR) AS x FROM (SELECT o_custkey, x, dense_rank() OVER (PARTITION BY o_custkey ORDER BY f) AS r FROM (SELECT *, o_orderkey // 2 % 40 AS x, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey // 2 % 40) AS f FROM orders)) WHERE r <= 8 UNION ALL SELECT DISTINCT 'REQUIRES_ACTION', o_custkey, CAST(o_orderkey AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 5) GROUP BY 1")
def enrichment_edges(t: Table) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    docs = t("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.transform(own, lambda x: F.concat((F.floor(x["o_orderkey"] / 2) % 40).cast("string"), F.lit(" "))).alias("concepts"), F.transform(own, lambda x: x["o_orderkey"].cast("string")).alias("actions"))
    return graph.enrichment(docs)[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


ABSTRACT = r"array_to_string(list_slice(string_split(trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), 1, {n}), ' ')"


@query(rf"WITH a AS (SELECT doc_id, seq, {ABSTRACT.format(n=200).replace('x,', 'y,')} AS a FROM (SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN 'the requirement' ELSE {ABSTRACT.format(n=200).replace('x,', 'line,')} END || CASE WHEN seq % 2 = 0 THEN ' core ' || seq ELSE '' END AS y FROM ({LINES}))) SELECT doc_id, md5({ABSTRACT.format(n=500)}) AS description FROM (SELECT doc_id, string_agg(a, ' ' ORDER BY seq) AS x FROM a GROUP BY 1)")
def document_descriptions(t: Table) -> DataFrame:
    found = lines.lines_of(t("documents"))
    core = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("core "), "seq"))
    sections = found.select("doc_id", "seq", graph.abstract(F.when(F.col("seq") % 3 == 0, "the requirement").otherwise(" "), F.col("line"), core).alias("abstract"))
    return graph.descriptions(sections).withColumn("description", F.md5("description"))


@query(f"SELECT 'Section' AS label, count(DISTINCT id) AS n FROM ({SECTIONS}) UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'LegalSource', 1")
def node_labels(t: Table) -> DataFrame:
    return graph.label_counts(_graph(t)[0])


@query("SELECT 'HAS_DATE' AS type, 'section::' || o_custkey || ':' || substr(sha256(c), 1, 20) AS source, 'date::' || substr(sha256(d), 1, 24) AS target FROM (SELECT o_custkey, 'on ' || strftime(o_orderdate, '%Y-%m-%d') AS c, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) x WHERE NOT (o_custkey % 2 = 0 AND d < '1995-01-01')")
def date_edges(t: Table) -> DataFrame:
    o = t("orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    known = o.where("o_custkey % 2 = 0 AND d < '1995-01-01'").select(F.col("o_custkey").alias("doc_id"), F.col("d").alias("date")).distinct()
    return graph.date_edges(o.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("on "), "d").alias("content")), known)


# profiles, scores, jobs

TEMPLATES = [
    {"id": "upper", "priority": 1, "threshold": 3, "max_score": 6, "user_aliases": ["capitals"], "scoring_rules": [{"feature": "regex_count_in_head", "pattern": "!!", "min_count": 3, "points": 3}, {"feature": "filename_contains", "values": ["src1"], "points": 2}]},
    {"id": "table", "priority": 2, "threshold": 2, "max_score": 4, "user_aliases": ["grid"], "scoring_rules": [{"feature": "regex_in_head", "pattern": r"\w \| \w", "points": 3}, {"feature": "table_page_ratio_gt", "value": 0.5, "points": 1}]},
]


@query(
    r"""SELECT doc_id, a AS upper_score, b AS table_score, CASE WHEN doc_id % 10 = 0 THEN 'table' WHEN x = 0 AND y = 0 THEN 'general' WHEN x >= y THEN 'upper' ELSE 'table' END AS detected_type, CASE WHEN greatest(x, y) > 0 THEN greatest(x, y) ELSE 0.5 END AS confidence FROM
    (SELECT *, CASE WHEN a >= 3 THEN least(1.0, a / 6) ELSE 0.0 END AS x, CASE WHEN b >= 2 THEN least(1.0, b / 4) ELSE 0.0 END AS y FROM (SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '!!')) >= 3 THEN 3 ELSE 0 END + CASE WHEN source LIKE '%src1%' THEN 2 ELSE 0 END AS a, CASE WHEN regexp_matches(text, '\w \| \w') THEN 3 ELSE 0 END + CASE WHEN doc_id % 4 > 2 THEN 1 ELSE 0 END AS b FROM documents))"""
)
def template_choice(t: Table) -> DataFrame:
    profiles = t("documents").select("doc_id", F.col("text").alias("head"), F.col("source").alias("file"), (F.col("doc_id") % 4 / 4).alias("table_ratio"), F.lit(0).alias("header_pages"), F.when(F.col("doc_id") % 10 == 0, "Grid").alias("hint"))
    chosen = profile.choose(profile.scores(profiles, TEMPLATES), TEMPLATES)
    return chosen.select("doc_id", F.col("scores")["upper"].alias("upper_score"), F.col("scores")["table"].alias("table_score"), "detected_type", "confidence")


@query()
def scored_pairs(t: Table) -> DataFrame:
    pairs = t("part").select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    return scoring.score_pairs(pairs, "a", "b").select("p_partkey", "score")


@query("SELECT user_id AS job_id, status, ts AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (status IN ('Completed', 'Failed')) DESC, ts DESC) AS r FROM (SELECT *, CASE event_id % 50 WHEN 0 THEN 'Completed' WHEN 1 THEN 'Failed' WHEN 2 THEN 'Pending' ELSE 'Running' END AS status FROM events)) WHERE r = 1")
def job_states(t: Table) -> DataFrame:
    k = F.col("event_id") % 50
    log = t("events").select(F.col("user_id").alias("job_id"), F.when(k == 0, "Completed").when(k == 1, "Failed").when(k == 2, "Pending").otherwise("Running").alias("status"), F.col("ts").alias("updated_at"), F.lit(None).cast("string").alias("error"))
    return inbox.job_states(log).drop("error")


@query("SELECT user_id AS job_id, count(*) FILTER (event_type = 'click') AS done, count(*) AS total, round(100 * count(*) FILTER (event_type = 'click') / count(*), 2) AS percent FROM events GROUP BY 1")
def chunk_progress(t: Table) -> DataFrame:
    return inbox.progress(t("events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "click", "Completed").otherwise("Running").alias("status")))


@query("SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS \"end\", count(*) AS events FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 86400000000 THEN 0 ELSE 1 END AS n FROM events)) GROUP BY 1, 2")
def activity_sessions(t: Table) -> DataFrame:
    return inbox.sessions(t("events"), "user_id", "ts", 86_400)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def latest_files(t: Table) -> DataFrame:
    listed = t("orders").select("o_custkey", F.col("o_orderkey").alias("path"), F.struct("o_orderdate", "o_orderkey").alias("modified"))
    return readers.newest(listed, "o_custkey").withColumnRenamed("path", "latest")


@query("SELECT name, max(origin) AS origin FROM (SELECT c_name AS name, CAST(NULL AS VARCHAR) AS origin FROM customer UNION ALL SELECT replace(c_name, 'Customer', 'Supplier'), 'x' FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier) GROUP BY 1")
def catalog_union(t: Table) -> DataFrame:
    """Three catalogs that overlap and have not all the same columns."""
    c = t("customer").select(F.col("c_name").alias("name"))
    renamed = t("customer").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name"), F.lit("x").alias("origin"))
    suppliers = t("supplier").select(F.lit("supplier").alias("origin"), F.col("s_name").alias("name"))
    return c.unionByName(renamed, allowMissingColumns=True).unionByName(suppliers).groupBy("name").agg(F.max("origin").alias("origin"))


# parsers


def _articles(t: Table) -> DataFrame:
    """Lines of documents, every fourth of which is the heading of an article."""
    heading = F.concat(F.lit("Articolo "), (F.floor(F.col("seq") / 4) + 1).cast("string"))
    return lines.lines_of(t("documents")).withColumn("line", F.when(F.col("seq") % 4 == 0, heading).otherwise(F.col("line")))


ARTICLES = rf"SELECT doc_id, seq, CASE WHEN seq % 4 = 0 THEN 'Articolo ' || (seq // 4 + 1) ELSE line END AS line FROM ({LINES})"


@query(
    rf"""SELECT doc_id, CAST(seq // 4 + 1 AS BIGINT) AS number, max(CASE WHEN seq % 4 = 1 THEN line END) AS title, coalesce(string_agg(CASE WHEN seq % 4 > 1 THEN line END, chr(10) ORDER BY seq), '') AS content FROM ({ARTICLES}) GROUP BY 1, 2"""
)
def regulation_articles(t: Table) -> DataFrame:
    return parsers.regulation(_articles(t)).select("doc_id", "number", "title", "content")


@query(
    rf"""SELECT doc_id, 'article' AS kind, max(CASE WHEN seq % 4 = 0 THEN trim(line) END) AS label, coalesce(string_agg(CASE WHEN seq % 4 > 0 THEN line END, chr(10) ORDER BY seq), '') AS content FROM ({ARTICLES}) GROUP BY doc_id, seq // 4"""
)
def gazette_parts(t: Table) -> DataFrame:
    return parsers.gazette(_articles(t)).select("doc_id", "kind", "label", "content")


@query("SELECT DISTINCT name FROM (SELECT (o_custkey % 100) || '_vs_' || (o_orderkey % 100) || '.json' AS name, o_custkey % 100 AS a, o_orderkey % 100 AS b FROM orders) WHERE a < 5 OR b < 5")
def derived_files(t: Table) -> DataFrame:
    o = t("orders")
    name = F.concat_ws("_vs_", (F.col("o_custkey") % 100).cast("string"), F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(".json")))
    return parsers.derived_files(o.select(name.alias("name")), o.select((F.col("o_custkey") % 100).cast("string").alias("hash")).where("cast(hash as int) < 5"))


@query("SELECT event_id, CAST(json_keys(props) AS VARCHAR) AS fields FROM events")
def tolerant_answers(t: Table) -> DataFrame:
    parsed = fuzzy.tolerant_json(F.concat(F.lit("Answer:\n"), F.col("props"), F.lit("\nend")))
    fields = F.concat(F.lit("["), F.array_join(F.json_object_keys(parsed), ", "), F.lit("]"))
    return t("events").select("event_id", fields.alias("fields"))


@query()
def fuzzy_names(t: Table) -> DataFrame:
    return t("part").select("p_partkey", fuzzy.fuzzy_ratio("p_name", "p_type").alias("ratio"), fuzzy.fuzzy_partial_ratio("p_brand", "p_name").alias("partial"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lexgrove.plans import documents  # noqa: F401  registers its queries here

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
