"""Verdicts on two versions of a document: articles, paragraphs and sub-paragraphs.

Rows of both versions: doc_id, level (article, paragraph or sub), art_seq, par_seq, sub_seq, art_id, par_id, content,
is_placeholder. Articles meet by one full outer join on the cleaned id; the last one of an id counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions.text import alnum_key, article_id

CONFIRMED, UPDATED, INSERTED, DELETED, CHECK, DISCARDED, REMOVED = "Confermato", "Aggiornato", "Inserito", "Eliminato", "Da Verificare", "Scartato", "Rimosso"
SECOND = "Da Verificare II"
INHERITED, MISMATCH = "Ereditato", "Errore"


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with key, clean and, if they have paragraphs, par_key."""
    found = rows.withColumns({"key": alnum_key(article_id(F.col("art_id"))), "clean": alnum_key(F.col("content"))})
    return found.withColumn("par_key", alnum_key(F.col("par_id"))) if "par_id" in rows.columns else found


def article_verdicts(new: DataFrame, old: DataFrame) -> DataFrame:
    """doc_id, key, art_seq, art_id, old_art_seq, verdict, score: every article of the new version, and the old ones without a new one.

    new and old: articles with key and clean. score is 1 for confirmed ones, -1 for those to be checked.
    """
    last = old.groupBy("doc_id", "key").agg(F.max_by(F.struct("art_seq", "art_id", "clean", "is_placeholder"), "art_seq").alias("o"), F.array_sort(F.collect_list("art_seq")).alias("all_old"))
    both = new.select("doc_id", "key", F.struct("art_seq", "art_id", "clean", "is_placeholder").alias("n")).join(last, ["doc_id", "key"], "full")
    n, o = F.col("n"), F.col("o")
    verdict = (
        F.when(n.isNull(), REMOVED).when(F.length("key") <= 4, DISCARDED).when(n["is_placeholder"], DELETED).when(o.isNull(), INSERTED)
        .when(n["clean"] == o["clean"], CONFIRMED).when(o["is_placeholder"], INSERTED).otherwise(CHECK)
    )
    related = F.col("verdict").isin(CONFIRMED, CHECK)
    judged = both.withColumn("verdict", verdict)
    kept = judged.where("n is not null").select("doc_id", "key", "n.art_seq", "n.art_id", F.when(related, o["art_seq"]).alias("old_art_seq"), "verdict", F.when(F.col("verdict") == CONFIRMED, 1).when(F.col("verdict") == CHECK, -1).alias("score"))
    gone = judged.where("n is null").select("doc_id", "key", F.explode("all_old").alias("old_art_seq"), F.col("o.art_id").alias("art_id"))
    return kept.unionByName(gone.select("doc_id", "key", F.lit(None).cast("int").alias("art_seq"), "art_id", "old_art_seq", F.lit(REMOVED).alias("verdict"), F.lit(None).cast("int").alias("score")))


def paragraph_verdicts(articles: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """doc_id, art_seq, par_seq, par_id, old_par_seq, verdict, note: the paragraphs of the new version under their article's verdict.

    Articles that are deleted, inserted or discarded hand their verdict down. Under confirmed ones equal content is
    confirmed, other content an error. Under articles to be checked a placeholder is deleted, an equal id with equal
    content confirmed, with other content updated, and no equal id inserted.
    """
    judged = articles.where("art_seq is not null").select("doc_id", "art_seq", F.col("old_art_seq").alias("of"), F.col("verdict").alias("above"))
    last = old.groupBy("doc_id", F.col("art_seq").alias("of"), "par_key").agg(F.max_by(F.struct("par_seq", "clean"), "par_seq").alias("o"))
    rows = new.join(judged, ["doc_id", "art_seq"]).join(last, ["doc_id", "of", "par_key"], "left")
    above, same = F.col("above"), F.coalesce(F.col("clean") == F.col("o.clean"), F.lit(False))
    found = F.col("o").isNotNull()
    down = above.isin(DELETED, INSERTED, DISCARDED)
    verdict = F.when(down, above).when(above == CONFIRMED, F.when(same, CONFIRMED).otherwise(MISMATCH)).when(F.col("is_placeholder"), DELETED).when(found & same, CONFIRMED).when(found, UPDATED).otherwise(INSERTED)
    related = ~down & found & F.col("verdict").isin(CONFIRMED, UPDATED)
    marked = rows.withColumn("verdict", verdict)
    return marked.select("doc_id", "art_seq", "par_seq", "par_id", F.when(related, F.col("o.par_seq")).alias("old_par_seq"), "verdict", F.when(down, INHERITED).alias("note"))


def removed_paragraphs(articles: DataFrame, paragraphs: DataFrame, old: DataFrame) -> DataFrame:
    """doc_id, art_seq (null), par_seq (null), par_id, old_par_seq, verdict, note: old paragraphs of removed articles, and those of related articles that no new one was related to."""
    related = articles.where("old_art_seq is not null").groupBy("doc_id", F.col("old_art_seq").alias("of")).agg(F.max("art_seq").alias("new_art_seq"), F.max(F.col("verdict") == REMOVED).alias("gone"))
    used = paragraphs.where("old_par_seq is not null").select("doc_id", F.col("art_seq").alias("new_art_seq"), F.col("old_par_seq").alias("par_seq")).distinct()
    rows = old.withColumnRenamed("art_seq", "of").join(related, ["doc_id", "of"])
    left = rows.join(used, ["doc_id", "new_art_seq", "par_seq"], "left_anti")
    none = F.lit(None).cast("int")
    return left.select("doc_id", none.alias("art_seq"), none.alias("par_seq"), "par_id", F.col("par_seq").alias("old_par_seq"), F.lit(REMOVED).alias("verdict"), F.when(F.col("gone"), INHERITED).alias("note"))


def compare(new: DataFrame, old: DataFrame) -> DataFrame:
    """doc_id, level, art_seq, par_seq, sub_seq, id, old_art_seq, old_par_seq, verdict, note over all levels.

    Sub-paragraphs are always discarded. Levels are called Capitolo (articles) and Paragrafo (the others), as in the result tables.
    """
    new, old = keyed(new), keyed(old)
    level = lambda df, name: df.where(F.col("level") == name)
    articles = article_verdicts(level(new, "article"), level(old, "article"))
    paragraphs = paragraph_verdicts(articles, level(new, "paragraph"), level(old, "paragraph"))
    gone = removed_paragraphs(articles, paragraphs, level(old, "paragraph"))
    none = F.lit(None).cast("int")
    chapters = articles.select("doc_id", F.lit("Capitolo").alias("level"), "art_seq", none.alias("par_seq"), none.alias("sub_seq"), F.col("art_id").alias("id"), "old_art_seq", none.alias("old_par_seq"), "verdict", F.lit(None).cast("string").alias("note"))
    below = paragraphs.unionByName(gone).select("doc_id", F.lit("Paragrafo").alias("level"), "art_seq", "par_seq", none.alias("sub_seq"), F.col("par_id").alias("id"), none.alias("old_art_seq"), "old_par_seq", "verdict", "note")
    subs = level(new, "sub").select("doc_id", F.lit("Paragrafo").alias("level"), "art_seq", "par_seq", "sub_seq", F.col("par_id").alias("id"), none.alias("old_art_seq"), none.alias("old_par_seq"), F.lit(DISCARDED).alias("verdict"), F.lit(None).cast("string").alias("note"))
    return chapters.unionByName(below).unionByName(subs)


def verdict_counts(compared: DataFrame) -> DataFrame:
    """level, verdict, n."""
    return compared.groupBy("level", "verdict").agg(F.count(F.lit(1)).alias("n"))


def extended_to_children(children: DataFrame, articles: DataFrame, verdicts: tuple[str, ...] = (DELETED, REMOVED)) -> DataFrame:
    """Rows of the prior document with their article's verdict where it is one of these, else their own."""
    above = articles.where(F.col("verdict").isin(*verdicts) & F.col("old_art_seq").isNotNull()).groupBy("doc_id", F.col("old_art_seq").alias("art_seq")).agg(F.min("verdict").alias("above"))
    return children.join(above, ["doc_id", "art_seq"], "left").withColumn("verdict", F.coalesce("above", "verdict")).drop("above")


def second_chance(inserted: DataFrame, removed: DataFrame, score: Column, least: float = 20) -> DataFrame:
    """doc_id, art_seq, old_art_seq, score, verdict: inserted articles with the removed one of their document that fits best, if its score suffices.

    inserted and removed: doc_id, art_seq or old_art_seq, and the columns that score needs; hash and old_hash: equal
    ones confirm, others are to be checked again. Pairs are those of one document, which holds few of either.
    """
    pairs = inserted.join(removed, "doc_id").withColumn("score", score).where(F.col("score") >= least)
    best = pairs.groupBy("doc_id", "art_seq").agg(F.max_by(F.struct("old_art_seq", "score", "hash", "old_hash"), F.struct("score", -F.col("old_art_seq"))).alias("b"))
    return best.select("doc_id", "art_seq", "b.old_art_seq", "b.score", F.when(F.col("b.hash") == F.col("b.old_hash"), CONFIRMED).otherwise(SECOND).alias("verdict"))


def renamed_paragraphs(new: DataFrame, old: DataFrame) -> DataFrame:
    """doc_id, art_seq, par_seq, old_par_seq, verdict: paragraphs of articles with a second chance.

    Equal cleaned ids come first (confirmed or updated by content), then the nearest id at an edit distance under a tenth of its
    length (updated); others are inserted. new: doc_id, art_seq, of (the old article), par_seq, par_key, clean; old: doc_id, of, par_seq, par_key, clean.
    """
    o = old.select("doc_id", "of", F.col("par_seq").alias("old_par_seq"), F.col("par_key").alias("old_key"), F.col("clean").alias("old_clean"))
    pairs = new.join(o, ["doc_id", "of"], "left").withColumn("distance", F.levenshtein("par_key", "old_key"))
    fits = (F.col("distance") == 0) | (F.col("distance") < 0.1 * F.length("par_key"))
    best = Window.partitionBy("doc_id", "art_seq", "par_seq").orderBy((~F.coalesce(fits, F.lit(False))).cast("int"), "distance", "old_par_seq")
    first = pairs.withColumns({"fits": F.coalesce(fits, F.lit(False)), "place": F.row_number().over(best)}).where("place = 1")
    verdict = F.when(~F.col("fits"), INSERTED).when((F.col("distance") == 0) & (F.col("clean") == F.col("old_clean")), CONFIRMED).otherwise(UPDATED)
    return first.select("doc_id", "art_seq", "par_seq", F.when(F.col("fits"), F.col("old_par_seq")).alias("old_par_seq"), verdict.alias("verdict"))
