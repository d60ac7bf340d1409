"""Document profiles: template rules, scores and the choice of a parser."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = dict
Template = dict


def rule_points(rule: Rule) -> Column:
    """Points of one rule over columns head, extended, broader, file, table_ratio, header_pages."""
    feature, pattern = rule["feature"], "(?im)" + rule.get("pattern", "")
    texts = {"regex_in_head": "head", "regex_in_extended": "extended", "regex_in_broader": "broader"}
    if feature in texts:
        met = F.col(texts[feature]).rlike(pattern)
    elif feature == "regex_count_in_head":
        met = F.regexp_count("head", F.lit(pattern)) >= rule.get("min_count", 1)
    elif feature == "filename_contains":
        met = reduce(lambda a, b: a | b, (F.col("file").contains(v) for v in rule.get("values", [])), F.lit(False))
    elif feature == "table_page_ratio_gt":
        met = F.col("table_ratio") > rule.get("value", 0)
    elif feature == "ag_header_count_ge":
        met = F.col("header_pages") >= rule.get("value", 0)
    else:
        return F.lit(0)
    return F.when(met, rule.get("points", 0)).otherwise(0)


def scores(profiles: DataFrame, templates: list[Template]) -> DataFrame:
    """The profiles with a map of template scores. Rules are few, so they are one projection, not a join."""
    totals = [x for t in templates for x in (F.lit(t["id"]), reduce(lambda a, b: a + b, map(rule_points, t["scoring_rules"]), F.lit(0)))]
    return profiles.withColumn("scores", F.create_map(*totals))


def read_templates(spark: SparkSession, path: str) -> list[Template]:
    """The templates of a folder of JSON files, by priority. Templates are a handful of small files that become one projection."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).collect()
    return sorted((json.loads(r["value"]) for r in rows), key=lambda t: t["priority"])


def with_special_cases(chosen: DataFrame, templates: list[Template], bank: str = "banca", rules: str = "regolamento", index: str = "indice") -> DataFrame:
    """detected_type after the special cases, for documents without a hint that fits.

    Adds to choose: a bank's template needs a start page or a score over its threshold; a bank's score over its maximum gives way to
    a regulation that has articles in its body and reaches its threshold; without a template a start page means bank, an article pattern regulation,
    the word of an index and its entries index. chosen: scores, detected_type, hinted, start_page, has_articles, has_article_pattern, has_index_word, has_index_entries.
    """
    of = {t["id"]: t for t in templates}
    score = lambda t: F.coalesce(F.col("scores")[t["id"]], F.lit(0))
    started = F.col("start_page").isNotNull()
    fits = lambda t: (score(t) >= t["threshold"]) & (started | (score(t) > t["threshold"]) if t["id"] == bank else F.lit(True))
    share = lambda t: F.when(fits(t), score(t) / t["max_score"])
    ordered = sorted(templates, key=lambda t: t["priority"])
    best = reduce(lambda a, b: F.greatest(a, b), (F.coalesce(share(t), F.lit(-1.0)) for t in ordered), F.lit(-1.0))
    by_score = F.coalesce(*(F.when((best >= 0) & (share(t) == best), t["id"]) for t in ordered))
    if bank in of and rules in of:
        inflated = (by_score == bank) & F.col("has_articles") & (score(of[bank]) > of[bank]["max_score"]) & (score(of[rules]) >= of[rules]["threshold"])
        by_score = F.when(inflated, rules).otherwise(by_score)
    rest = F.when(started, bank).when(F.col("has_article_pattern"), rules).when(F.col("has_index_word") & F.col("has_index_entries"), index).otherwise("general")
    return chosen.withColumn("detected_type", F.when(F.col("hinted"), F.col("detected_type")).otherwise(F.coalesce(by_score, rest)))


def choose(scored: DataFrame, templates: list[Template], fallback: str = "general") -> DataFrame:
    """detected_type and confidence: an exact hint, a hint within or around an alias, else the best share of the full score at or over the threshold; earlier priority wins ties."""
    ordered = sorted(templates, key=lambda t: t["priority"])
    hint = F.lower(F.trim(F.coalesce("hint", F.lit(""))))
    exact = F.coalesce(*(F.when(hint.isin([a.lower() for a in t["user_aliases"]]), t["id"]) for t in ordered))
    near = F.coalesce(*(F.when((hint != "") & reduce(lambda a, b: a | b, (hint.contains(a.lower()) | F.lit(a.lower()).contains(hint) for a in t["user_aliases"])), t["id"]) for t in ordered))
    share = lambda t: F.when(F.col("scores")[t["id"]] >= t["threshold"], F.least(F.lit(1.0), F.col("scores")[t["id"]] / t["max_score"]))
    best = F.greatest(*(F.coalesce(share(t), F.lit(0.0)) for t in ordered), F.lit(0.0))
    scored_type = F.coalesce(*(F.when((share(t) == best) & (best > 0), t["id"]) for t in ordered))
    return scored.withColumn("detected_type", F.coalesce(exact, near, scored_type, F.lit(fallback))).withColumn("confidence", F.when(best > 0, best).otherwise(0.5))
