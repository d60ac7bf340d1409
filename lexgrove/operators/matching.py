"""Comparison of documents: matches, anti-matches, best of each group.

No operator pairs all rows with all rows: each has an equality key, and order-dependent rules (first
match, last match, ties) are window functions over small keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions.text import alnum_key, cosine, is_metadata, name_key


def last_match(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Left rows with the right row of equal key that comes last; right columns get the prefix old_."""
    last = right.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("old"))
    return left.join(last, key, "left").select(*left.columns, *(F.col(f"old.{c}").alias(f"old_{c}") for c in columns))


def first_match(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Left rows with the right row of equal key that comes first."""
    first = right.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("hit"))
    return left.join(first, key, "left").select(*left.columns, *(F.col(f"hit.{c}").alias(f"hit_{c}") for c in columns))


def renamed(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, a, b, distance: equal cleaned ids first, else ids whose edit distance is under a tenth of their length; the closest of each a, the first of equal ones.

    left: key, a. right: key, b, id, the name to compare with. Ids that are not equal meet at parts: an id with up to k edits is cut into k // 2 + 1 parts, of which one
    has one edit at most, so that part and the same place of the other id, moved by k at most, are equal once a character is left out of each or of one.
    """
    edits = F.expr("greatest(n - 1, 0) div 10")
    wanted = left.select(key, "a", alnum_key(F.col("a")).alias("left_id"))
    held = right.groupBy(key, alnum_key(F.col("id")).alias("right_id")).agg(F.min("b").alias("b"))
    ids = wanted.select(key, "left_id").distinct()
    same = ids.join(held.withColumnRenamed("right_id", "left_id"), [key, "left_id"]).select(key, "left_id", F.lit(0).alias("distance"), "b")

    open_ = ids.join(same, [key, "left_id"], "left_anti").withColumn("n", F.length("left_id")).where("n > 10")
    parts = {"k": edits, "parts": F.expr("greatest(n - 1, 0) div 20 + 1")}
    places = {"start": F.expr("part * n div parts"), "size": F.expr("(part + 1) * n div parts - part * n div parts")}
    cut = lambda df: df.withColumns(parts).withColumn("part", F.explode(F.expr("sequence(0, cast(parts - 1 as int))"))).withColumns(places)
    less = F.expr("explode(array_distinct(concat(array(piece), transform(sequence(1, greatest(length(piece), 1)), i -> concat(substring(piece, 1, i - 1), substring(piece, i + 1))))))")
    met = lambda df, *c: df.select(key, *c, "n", less.alias("rest"), "part").select(key, *c, F.xxhash64(key, "n", "part", "rest").alias("met")).distinct()
    ours = met(cut(open_).withColumn("piece", F.expr("substring(left_id, start + 1, size)")), "left_id")
    lengths = open_.select("n").distinct()  # as many rows as ids have lengths
    near = held.withColumn("m", F.length("right_id")).join(F.broadcast(lengths), F.abs(F.col("m") - F.col("n")) <= edits)
    moved = cut(near).withColumn("at", F.explode(F.expr("if(parts = 1, array(0L), sequence(greatest(start - k, 0L), start + k))")))
    moved = moved.withColumn("long", F.explode(F.expr("if(parts = 1, array(cast(m as bigint)), sequence(size - 1, size + 1))"))).where("at + long <= m")
    theirs = met(moved.withColumn("piece", F.expr("substring(right_id, cast(at as int) + 1, cast(long as int))")), "right_id", "b")
    pairs = ours.join(theirs, [key, "met"]).withColumn("distance", F.levenshtein("left_id", "right_id"))
    close = pairs.where(10 * F.col("distance") < F.length("left_id")).select(key, "left_id", "distance", "b")
    best = same.unionByName(close).groupBy(key, "left_id").agg(F.min(F.struct("distance", "b")).alias("best"))
    found = wanted.join(best, [key, "left_id"]).groupBy("a").agg(F.min(F.struct("best", key)).alias("f"))
    return found.select(f"f.{key}", "a", "f.best.b", "f.best.distance")


def resolve_references(refs: DataFrame, articles: DataFrame) -> DataFrame:
    """Each reference (ref_id, doc_id, n_art, n_par) with the article or paragraph it names; without one, found is false.

    articles: doc_id, n_art, n_par, content, with n_par null for the article itself. Numbers are compared as text.
    """
    text = lambda c: F.trim(F.col(c).cast("string"))
    left = refs.withColumn("art", text("n_art")).withColumn("par", F.coalesce(text("n_par"), F.lit("")))
    right = articles.select("doc_id", text("n_art").alias("art"), F.coalesce(text("n_par"), F.lit("")).alias("par"), F.col("content").alias("target")).groupBy("doc_id", "art", "par").agg(F.min("target").alias("target"))
    return left.join(right, ["doc_id", "art", "par"], "left").select(*refs.columns, "target", F.col("target").isNotNull().alias("found"))


def amendment_targets(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """Each reference (ref_id, doc_id, n_art, n_par) with the first row that it amends: row_id, target.

    rows: doc_id, seq, row_id, level, n_art, n_par, par_content, art_content, content. A reference to a paragraph needs a row with
    an equal one; without a paragraph only the article's own row counts. The target is the first content that isn't blank: paragraph, article, any.
    """
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    keyed = lambda df: df.withColumns({"_art": text("n_art"), "_par": text("n_par")})
    own = keyed(rows).where("_art <> '' and ((level = 'article') = (_par = ''))")
    content = F.coalesce(*(F.when(F.trim(c) != "", F.col(c)) for c in ("par_content", "art_content", "content")))
    first = own.groupBy("doc_id", "_art", "_par").agg(F.min_by(F.struct("row_id", content.alias("target")), "seq").alias("hit"))
    return keyed(refs).join(first, ["doc_id", "_art", "_par"], "left").select(*refs.columns, "hit.row_id", "hit.target")


def best_vectors(left: DataFrame, right: DataFrame, key: str, least: float | None = None) -> DataFrame:
    """Each left row (key, left_id, vector) with the right row of its key that is nearest by cosine: right_id, cosine; from `least` on, if given."""
    pairs = left.select(key, "left_id", F.col("vector").alias("_a")).join(right.select(key, "right_id", F.col("vector").alias("_b")), key)
    scored = pairs.select(key, "left_id", "right_id", cosine(F.col("_a"), F.col("_b")).alias("cosine"))
    best = scored.groupBy(key, "left_id").agg(F.max_by(F.struct("right_id", "cosine"), F.struct("cosine", -F.col("right_id"))).alias("b")).select(key, "left_id", "b.right_id", "b.cosine")
    return best if least is None else best.where(F.col("cosine") >= least)


def not_implemented_rows(articles: DataFrame, results: DataFrame, article_number: Column, result_number: Column) -> DataFrame:
    """Rows of articles in no result and of their paragraphs. articles: art_id, title, content, paragraphs array<struct<par_id, content>>."""
    open_ = not_implemented(articles, results, article_number, result_number)
    own = open_.select(F.lit("Articolo").alias("level"), "art_id", "title", F.lit(None).cast("string").alias("par_id"), "content")
    below = open_.select("art_id", "title", F.explode("paragraphs").alias("p")).select(F.lit("Comma").alias("level"), "art_id", "title", "p.par_id", "p.content")
    return own.unionByName(below)


def scored_pairs(pairs: DataFrame, score: Column, title_a: str, title_b: str) -> DataFrame:
    """Scores of pairs; those with a title about the document itself get 0."""
    return pairs.withColumn("score", F.when(is_metadata(F.col(title_a)) | is_metadata(F.col(title_b)), F.lit(0)).otherwise(score))


def best_match(pairs: DataFrame, key: str, score: str, order: str, weak: float = 15) -> DataFrame:
    """The best pair of each key, the first of equal ones; weak marks a score that is too low to trust."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(score), order))
    return pairs.withColumn("place", place).where("place = 1").drop("place").withColumn("weak", F.col(score) < weak)


def best_matches_with_ties(pairs: DataFrame, key: str, score: str) -> DataFrame:
    return pairs.withColumn("place", F.rank().over(Window.partitionBy(key).orderBy(F.desc(score)))).where("place = 1").drop("place")


def candidate_articles(pairs: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """Scores over 15: the three best; else scores of 15: the first three; else the first pair alone."""
    group = Window.partitionBy(key)
    over, equal = F.max(F.col(score) > 15).over(group), F.max(F.col(score) == 15).over(group)
    kind = F.when(over, F.col(score) > 15).when(equal, F.col(score) == 15).otherwise(F.lit(True))
    eligible = pairs.withColumns({"over": over, "equal": equal, "fits": kind}).where("fits")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("over"), -F.col(score)), order))
    return eligible.withColumn("place", place).where(F.col("place") <= F.when(F.col("over") | F.col("equal"), 3).otherwise(1)).drop("over", "equal", "fits")


def secondary_marks(rows: DataFrame, keys: list[str], coefficient: Column, order: str) -> DataFrame:
    """"x" on all rows of a group but the one with the greatest coefficient, the first of equal ones; unreadable ones count least."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(coefficient), order))
    return rows.withColumn("secondary", F.when(place > 1, "x").otherwise(""))


def not_implemented(articles: DataFrame, results: DataFrame, article_number: Column, result_number: Column) -> DataFrame:
    """Articles whose number is in no result."""
    return articles.withColumn("number", article_number).join(results.select(result_number.alias("number")).distinct(), "number", "left_anti")


def over_threshold(pairs: DataFrame, key: str, score: str, order: str, least: float = 20) -> DataFrame:
    """The best pair of each key among those with a sufficient score."""
    return best_match(pairs.where(F.col(score) >= least), key, score, order).drop("weak")


def contained(outer: DataFrame, inner: DataFrame, gram: int) -> DataFrame:
    """outer, inner: texts with each text that stands within them. outer and inner: one column of that name, distinct texts of `gram` characters at least.

    Where an outer text has the first characters of inner ones, its substrings of their lengths are looked up. Both sides of the joins grow
    with the texts, which estimates from files' sizes don't tell, so none is broadcast.
    """
    lengths = inner.groupBy(F.substring("inner", 1, gram).alias("run")).agg(F.collect_set(F.length("inner")).alias("lengths"))
    runs = F.transform(F.sequence(F.lit(0), F.length("outer") - gram), lambda i: F.substring("outer", i + 1, gram))
    placed = outer.select("outer", F.posexplode(runs).alias("at", "run")).join(lengths.hint("merge"), "run").select("outer", "at", F.explode("lengths").alias("size"))
    pieces = placed.where(F.col("at") + F.col("size") <= F.length("outer")).select("outer", F.expr("substring(outer, at + 1, size)").alias("inner"))
    return pieces.join(inner.hint("merge"), "inner").select("outer", "inner").distinct()


def name_lookup(names: DataFrame, catalog: DataFrame, least: int = 10, gram: int = 8) -> DataFrame:
    """Each name with the hash of the best fitting catalog name: equal, equal file part, equal suffix, equal key, one key within the other.

    names: name. catalog: known, hash. Each rule is an equality join; the rule's order decides, then the catalog's. Keys within others have so many
    characters at least, and are found by their first `gram` and their length. All sides of the joins grow with the names: none is broadcast.
    """
    file = lambda c: F.element_at(F.split(c, "/"), -1)
    suffix = lambda c: F.regexp_replace(file(c), r"^[^_]*_", "")
    plain = lambda c: name_key(F.regexp_replace(file(c), r"\.[A-Za-z0-9]+$", ""))
    keys = lambda df, c: df.select("*", F.posexplode(F.array(*(f(F.col(c)) for f in (lambda c: c, file, suffix, plain)))).alias("rule", "key"))
    wanted = names.select("name").distinct()
    best = keys(catalog, "known").groupBy("rule", "key").agg(F.min(F.struct("known", "hash")).alias("best"))
    equal = keys(wanted, "name").join(best.hint("merge"), ["rule", "key"]).groupBy("name").agg(F.min(F.struct("rule", "best")).alias("hit"))
    open_ = wanted.join(equal.select("name").hint("merge"), "name", "left_anti").withColumn("a", plain(F.col("name"))).where(F.length("a") >= least)
    held = catalog.withColumn("b", plain(F.col("known"))).where(F.length("b") >= least).groupBy("b").agg(F.min(F.struct("known", "hash")).alias("best"))
    ours, theirs = open_.select("a").distinct(), held.select("b")
    inside = contained(theirs.toDF("outer"), ours.toDF("inner"), gram).select(F.col("inner").alias("a"), F.col("outer").alias("b"))
    around = contained(ours.toDF("outer"), theirs.toDF("inner"), gram).select(F.col("outer").alias("a"), F.col("inner").alias("b"))
    within = inside.unionByName(around).join(held.hint("merge"), "b").groupBy("a").agg(F.min("best").alias("best"))
    fitting = open_.join(within.hint("merge"), "a").select("name", F.struct(F.lit(4).alias("rule"), "best").alias("hit"))
    hits = equal.unionByName(fitting).select("name", "hit.best.hash", "hit.rule")
    return names.join(hits.hint("merge"), "name", "left")


def page_ranges(index: DataFrame, last_page: Column) -> DataFrame:
    """Index entries with the page before the next entry's. index: doc_id, entry, page."""
    following = F.lead("page").over(Window.partitionBy("doc_id").orderBy("page", "entry"))
    return index.withColumn("end_page", F.coalesce(F.greatest(following - 1, F.col("page")), last_page))


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points within ranges of the same key. Ranges are cut at multiples of width, so the join has an equality key."""
    cut = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("cell", F.floor(F.col(point) / width)).join(cut, [key, "cell"]).where(F.col(point).between(F.col(low), F.col(high))).drop("cell")


def outside_boxes(blocks: DataFrame, tables: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Blocks that lie in no table's box of their page. blocks: page, x0, y0, x1, y1; tables: page and tx0, ty0, tx1, ty1."""
    inside = (F.col("x0") >= F.col("tx0") - tolerance) & (F.col("y0") >= F.col("ty0") - tolerance) & (F.col("x1") <= F.col("tx1") + tolerance) & (F.col("y1") <= F.col("ty1") + tolerance)
    b, t = blocks.alias("b"), tables.alias("t")
    return b.join(t, (F.col("b.page") == F.col("t.page")) & inside, "left_anti")
