"""Processing-time statistics and layout measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fitted log model and the fallback rate.
LOG_MODEL = {"intercept": 4.6741, "server": -0.5726, "size_mb": 0.8864, "chunks": 1.1992}
TOKENS_PER_SECOND = 63.0
#: Ranges of values by which the values of a key get their places.
RANGES = 4096


def valid_operation(tokens: Column, seconds: Column) -> Column:
    """Some tokens, 10 s to 30 min, and less than a second a token."""
    return (tokens > 0) & (seconds > 10) & (seconds < 1800) & (seconds / tokens < 1.0)


def truncated_mean(df: DataFrame, key: str, value: str, share: float = 0.1) -> DataFrame:
    """key, truncated_mean: without int(n * share) values at each end; null under three values.

    Equal values are counted first, by any task. The two cut values are those at which the running counts pass the cut, over
    distinct values; then a plain aggregate sums what lies between, with the right share of the cut values themselves.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    # thousands of ranges of values for a key: their sums give each value its place without one sort of the whole key
    ends = counted.groupBy(key).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("m").alias("n"))
    ranged = counted.join(ends, key).withColumn("range", F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES), F.lit(RANGES - 1))).otherwise(0).cast("int"))
    sums = ranged.groupBy(key, "range").agg(F.sum("m").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(sums.select(key, "range", before.alias("before")), [key, "range"])
    upto = F.col("before") + F.sum("m").over(Window.partitionBy(key, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = F.floor(F.col("n") * share)
    kept = F.greatest(F.least(F.col("upto"), F.col("n") - cut) - F.greatest(F.col("upto") - F.col("m"), cut), F.lit(0))
    weighed = placed.withColumn("upto", upto).withColumn("kept", kept)
    mean = F.when(F.first("n") >= 3, F.sum(F.col("kept") * F.col("v")) / F.sum("kept"))
    return weighed.groupBy(key).agg(mean.alias("truncated_mean"))


def last_operations(df: DataFrame, key: str, order: list[str], n: int = 10) -> DataFrame:
    """The last n rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("place", place).where(F.col("place") <= n).drop("place")


def mode_totals(ops: DataFrame, mode: str, tokens: str, seconds: str) -> DataFrame:
    """Sums and count by mode over operations of 10 s and tokens at least."""
    return ops.where((F.col(seconds) >= 10) & (F.col(tokens) > 0)).groupBy(mode).agg(F.sum(seconds).alias("total_seconds"), F.sum(tokens).alias("total_tokens"), F.count(F.lit(1)).alias("operations"))


def token_rate(ops: DataFrame, mode: str, tokens: str, seconds: str) -> DataFrame:
    """Mean tokens per second by mode over operations of more than 5 s; the fallback where none counts."""
    rate = F.when((F.col(seconds) > 5) & (F.col(tokens) > 0), F.col(tokens) / F.col(seconds))
    return ops.groupBy(mode).agg(F.round(F.coalesce(F.avg(rate), F.lit(TOKENS_PER_SECOND)), 2).alias("tokens_per_second"))


def time_estimates(ops: DataFrame, mode: str, tokens: str, seconds: str, wanted: Column) -> DataFrame:
    """mode, estimate, source for a number of tokens: linear fit from 10 operations on, else truncated rate, else ratio of sums, else the fallback."""
    valid = ops.where(valid_operation(F.col(tokens), F.col(seconds))).withColumn("rate", F.col(seconds) / F.col(tokens))
    fit = valid.groupBy(mode).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(seconds, tokens).alias("slope"), F.regr_intercept(seconds, tokens).alias("intercept"), (F.sum(seconds) / F.sum(tokens)).alias("ratio"))
    both = ops.select(mode).distinct().join(fit, mode, "left").join(truncated_mean(valid, mode, "rate"), mode, "left")
    linear = F.when(F.col("n") >= 10, F.col("slope") * wanted + F.col("intercept"))
    chain = (linear, F.col("truncated_mean") * wanted, F.col("ratio") * wanted, wanted / TOKENS_PER_SECOND)
    names = ("linear", "truncated", "ratio", "fallback")
    return both.select(mode, F.coalesce(*chain).alias("estimate"), F.coalesce(*(F.when(c.isNotNull(), n) for c, n in zip(chain, names, strict=True))).alias("source"))


def log_model(server: Column, size_mb: Column, chunks: Column) -> Column:
    m = LOG_MODEL
    return F.expm1(m["intercept"] + m["server"] * F.log1p(server) + m["size_mb"] * F.log1p(size_mb) + m["chunks"] * F.log1p(chunks))


def adjusted(base: Column, modelled: Column, tokens: Column, size: Column) -> Column:
    """The model's value if positive, else the base by a factor of the tokens; half a minute more for bulky texts."""
    factor = F.when(tokens > 15_000, 1.5).when(tokens > 10_000, 1.3).when(tokens < 2_000, 1.1).otherwise(1.2)
    return F.when(modelled > 0, modelled).otherwise(base * factor) + F.when(size / F.greatest(tokens, F.lit(1)) > 200, 30).otherwise(0)


def comparison_estimate(base: Column) -> Column:
    """A fifth more, a minute at least."""
    return F.greatest(F.lit(60.0), 1.2 * base)


def word_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    n = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    return df.groupBy(key).agg(F.min(n).alias("least"), F.avg(n).alias("mean"), F.max(n).alias("most"))


def body_font(spans: DataFrame, pages: int = 5, default: float = 11.0) -> DataFrame:
    """doc_id, body_size, font: median size and most frequent font over the first pages."""
    first = F.when(F.col("page") < pages, F.col("size"))
    return spans.groupBy("doc_id").agg(F.coalesce(F.median(first), F.lit(default)).alias("body_size"), F.mode("font").alias("font"))
