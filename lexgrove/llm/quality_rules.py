"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured in its own row and the measures are stored once. Failures of each rule are summed by
host. For each rule a beta prior is fitted to all hosts by moments: its mean is the rate of all documents, and the
share of the variance that lies between hosts gives its weight. A host fails a rule if its rate, by the posterior, is above
the rate of all documents by more than a margin: the lower end of a one-sided 95 % interval decides.
The verdicts are joined back to the stored measures; documents of hosts that fail a rule go. The join is a sort-merge
join of two plain exchanges, so that adaptive execution can split the partition of a host that holds much of the corpus.

Defined results: a null text has no words and fails; a null host has no verdict against it and no part in the rates; repeated
rows count each; an empty table gives no rows; a document without a newline is one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words(text: Column) -> Column:
    """The maximal runs of characters that aren't ASCII white space."""
    trimmed = F.trim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def _paired(hashes: str, step: int) -> Column:
    """Hashes of spans twice as long, from those at i and i + step."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.size(hashes) + 1), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def repeated(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]))

    def spread(starts: Column) -> Column:
        steps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def bound(value: Column, f) -> Column:
        return F.get(F.transform(F.array(value), f), F.lit(0))  # value is computed once for all uses in f

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = bound(ordered, lambda o: F.sort_array(F.transform(repeated(o), lambda x: x["i"])))
    return bound(starts, spread)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, host and the measures of each document; windows are compared by a 64-bit hash within one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "")
    df = df.select(
        "doc_id", "host", words(F.col("text")).alias("words"), lines.alias("lines"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    kept = ["doc_id", "host", "word_chars", "n_symbols"]
    df = df.select(
        *kept, F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    kept += ["n_words", "n_lines", "n_dup_lines"]
    for step in (1, 2, 4):
        df = df.select(*kept, _paired("h", step).alias("h"))
    df = df.select(*kept, F.slice("h", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")).alias("h"))
    repeats = F.when(F.size("h") == F.size(F.array_distinct("h")), F.lit(0)).otherwise(_covered(F.col("h")))
    return df.select(*kept, repeats.cast("long").alias("n_repeat_words"))


def rules(min_words: int = 20, repeat_percent: int = 30, symbol_percent: int = 10, line_percent: int = 30, word_length: tuple[float, float] = (2.0, 15.0)) -> dict[str, Column]:
    """Name and failure of each rule; the first two are base rules."""
    c = F.col
    mean = c("word_chars") / F.greatest(c("n_words"), F.lit(1))
    return {
        "short": c("n_words") < min_words,
        "repeats": 100 * c("n_repeat_words") > repeat_percent * c("n_words"),
        "symbols": 100 * c("n_symbols") > symbol_percent * c("n_words"),
        "lines": 100 * c("n_dup_lines") > line_percent * c("n_lines"),
        "word_length": (mean < word_length[0]) | (mean > word_length[1]),
    }


def host_rates(measured: DataFrame, names: list[str], margin: float = 0.25, z: float = 1.645) -> DataFrame:
    """host, docs, failed, rates, low (maps by rule: failures, posterior means, lower ends) and bad (the rules that the host fails).

    measured has a host and a boolean column for each name. With m the rate of all documents and c the
    correlation of two documents of one host (0: hosts don't differ, 1: hosts are all good or all bad), the prior's weight
    is 1 / c - 1 documents. The expected square of (rate - m) is m (1 - m) (c + (1 - c) / docs), which gives c.
    """
    c = F.col
    sums = [F.sum(c(n).cast("long")).alias(n) for n in names]
    hosts = materialize(measured.where(c("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *sums), "hosts")
    total = hosts.agg(F.sum("docs").alias("docs"), F.avg(1 / c("docs")).alias("alone"), *(F.sum(n).alias(n) for n in names)).first()
    means = {n: (total[n] or 0) / total["docs"] if total["docs"] else 0.0 for n in names}
    squares = hosts.agg(*(F.avg((c(n) / c("docs") - m) * (c(n) / c("docs") - m)).alias(n) for n, m in means.items())).first()
    rates, low = {}, {}
    for n, m in means.items():
        spread, alone = m * (1 - m), total["alone"] or 1.0
        shared = min(max(((squares[n] or 0.0) / spread - alone) / (1 - alone), 0.0), 1.0) if spread and alone < 1 else 0.0
        rates[n] = (shared * c(n) + m * (1 - shared)) / (shared * c("docs") + 1 - shared)
        low[n] = rates[n] - z * F.sqrt(rates[n] * (1 - rates[n]) * shared / (shared * c("docs") + 1))
    mapped = lambda values: F.create_map(*(x for n in names for x in (F.lit(n), values[n])))
    bad = F.filter(F.array(*(F.when(low[n] > means[n] + margin, n) for n in names)), lambda x: x.isNotNull())
    return hosts.select("host", "docs", mapped({n: c(n) for n in names}).alias("failed"), mapped(rates).alias("rates"), mapped(low).alias("low"), bad.alias("bad"))


def judge_documents(docs: DataFrame, margin: float = 0.25) -> DataFrame:
    """All measures, base_failed, a column for each rule that is true if it fails, host_failed (the rules that the host fails) and kept: no base rule fails and the host fails none."""
    failures = rules()
    measured = materialize(measure(docs).select("*", *(f.alias(n) for n, f in failures.items())), "measures")
    verdicts = materialize(host_rates(measured, list(failures), margin).select("host", F.col("bad").alias("host_failed")), "verdicts")
    judged = measured.join(verdicts.hint("merge"), "host", "left").withColumn("host_failed", F.coalesce("host_failed", F.array().cast("array<string>")))
    judged = judged.withColumn("base_failed", F.col("short") | F.col("repeats"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("host_failed") == 0))
