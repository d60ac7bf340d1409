"""Secret scans in DataFrame functions only.

Base patterns are assignments of credentials, access keys and long hexadecimal runs. Beyond these,
tokens of 20 characters or more, parted at "=", are tested for randomness in the encoding that
their characters allow; of a token that no encoding allows, the longest parts that one does. Four tests
measure how a token departs from random draws of its alphabet: chi-squared uniformity over the alphabet and
over its classes of characters, a runs test of the classes, and lag-1 serial correlation. Fisher's method
combines them to a score that is even from 0 to 1 for random tokens.

A secret is a token that rejects the hypothesis "made of words". Its p-value is the share of word-like tokens
of its encoding and band of length whose score is as great. One of these is made from the words of each document,
others from a fixed list of words: joined as in names, paths and constants, as long as the band's shortest token.
Within each band a Benjamini-Hochberg cut at level q over the whole corpus bounds the share of word-like tokens among those reported.

All spans are found in the document's own row. The cut needs histograms of scores only
(4 encodings, 7 bands, 400 bins), which is all that reaches the driver.

Defined results: a null text is empty and has no spans; repeated rows are scanned each; an empty
table gives no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import column, materialize

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"
# A run, with the padding that ends it; other "=" part names from values.
TOKEN = r"[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Pattern and alphabet of each encoding, and where its second and third class of characters begin.
ENCODINGS = (
    ("^[0-9a-fA-F]+$", DIGITS + "abcdef", 10, 16),
    ("^[A-Z2-7]+$", UPPER + "234567", 26, 32),
    ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 26, 52),
    ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 26, 52),
)
# Words of names in programs and texts, for word-like tokens that don't depend on the corpus.
WORDS = """get set user account name service request response handler factory manager config value index data list map table column row error
message event state model view control process thread queue stream buffer reader writer parser token path directory number string default update
delete create insert select order group count total average window summer house water people between against another through market history music
report science general company system program question government world school country street century language nature machine travel picture
haus wasser zeit leben arbeit strasse schule buch freund morgen maison temps travail chemin ville jour monde livre casa tiempo trabajo ciudad mundo
libro noche camino acqua tempo lavoro strada notte citta libri""".split()

KINDS = ("assign", "access", "hex", "random")
SPAN = "struct<start:int,order:int,end:int>"
FOUND = "struct<start:int,end:int,token:string>"
#: Least lengths of the bands, bins of scores and the powers of ten that they cover, and tokens of fixed words in each band and each of the six styles.
BANDS = (20, 24, 28, 32, 40, 56, 96)
BINS, DECADES, FIXED = 400, 10, 200


def located(text: Column, pattern: str, group: int = 0, least: int = 1, needs: str | None = None) -> Column:
    """Start, end and text of the leftmost non-overlapping matches whose group has enough characters.

    Matches and the gaps between them come in the same order, so their lengths add up to positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sized = F.zip_with(whole, F.slice(gaps, 1, F.size(whole)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["m"].alias("token"))
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    found = F.aggregate(sized, zero, step, lambda acc: acc["found"])
    if group:
        part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        zipped = F.zip_with(found, part, lambda f, p: F.struct(f.alias("f"), F.length(p).alias("n")))
        found = F.transform(F.filter(zipped, lambda z: z["n"] >= least), lambda z: z["f"])
    elif least > 1:
        found = F.filter(found, lambda f: F.length(f["token"]) >= least)
    return F.when(F.regexp_like(text, F.lit(needs or pattern)), found).otherwise(F.array().cast(f"array<{FOUND}>"))


def _upper(z: Column) -> Column:
    """The upper tail of the normal distribution, by the logistic approximation (error below 2e-4)."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def _both(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper(F.abs(z)))


def _by_encoding(values: list, e: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), e)


def _score(t: Column) -> Column:
    """Fisher's combination of the four tests; t has e, n, counts, classes, runs, lag."""
    n = t["n"].cast("double")
    k = _by_encoding([float(len(a)) for _, a, *_ in ENCODINGS], t["e"])
    add = lambda array, f: F.aggregate(array, F.lit(0.0), lambda total, x: total + f(x))
    chi = add(t["counts"], lambda c: (c * c).cast("double")) * k / n - n
    free = k - 1
    uniform = _upper((F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    shares = [[b / len(a), (c - b) / len(a), 1 - c / len(a)] for _, a, b, c in ENCODINGS]
    expected = _by_encoding([0.0] * len(ENCODINGS), t["e"])
    for j in range(3):
        share = _by_encoding([x[j] for x in shares], t["e"])
        gap = F.get(t["classes"], F.lit(j)) - n * share
        expected = expected + F.when(share > 0, gap * gap / (n * share)).otherwise(0.0)
    three = _by_encoding([x[2] > 0 for x in shares], t["e"])
    mixed = F.when(three, F.exp(-expected / 2)).otherwise(_both(F.sqrt(expected)))
    # of two neighbours the classes differ with probability d; neighbouring pairs depend on each other through their common character
    differ = [1 - sum(p * p for p in x) for x in shares]
    common = [sum(p * (1 - p) ** 2 for p in x) - d * d for x, d in zip(shares, differ, strict=True)]
    d = _by_encoding(differ, t["e"])
    deviation = F.sqrt((n - 1) * d * (1 - d) + 2 * (n - 2) * _by_encoding(common, t["e"]))
    runs = _both((t["runs"] - (n - 1) * d) / deviation)
    serial = _both(t["lag"] / F.sqrt(n - 1) / ((k * k - 1) / 12))
    half = -sum((F.log(F.greatest(p, F.lit(1e-15))) for p in (uniform, mixed, runs, serial)), F.lit(0.0))
    return F.get(F.transform(F.array(half), lambda h: F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)), F.lit(0))  # half is computed once


def _encoding(token: Column) -> Column:
    """The number of the first encoding that allows the token; null if none does."""
    chosen = F.lit(None).cast("int")
    for e, (pattern, *_) in reversed(list(enumerate(ENCODINGS))):
        chosen = F.when(F.regexp_like(token, F.lit(pattern)), F.lit(e)).otherwise(chosen)
    return chosen


def _pieces(found: Column) -> Column:
    """start, end, t and e of each run that an encoding allows; of other runs each maximal part of 20 characters or more in an alphabet."""
    plain = F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.rtrim(f["token"], F.lit("=")).alias("t")))

    def parts(f: Column) -> Column:
        cut = F.concat(*(located(f["t"], pattern[1:-2] + "{20,}+") for pattern, *_ in ENCODINGS))
        placed = lambda p: F.struct(
            (f["start"] + p["start"]).alias("start"),
            F.when(p["end"] == F.length(f["t"]), f["end"]).otherwise(f["start"] + p["end"]).alias("end"),
            p["token"].alias("t"),
        )
        return F.array_distinct(F.transform(cut, placed))

    fits = lambda f: _encoding(f["t"]).isNotNull()
    cut = F.concat(F.filter(plain, fits), F.flatten(F.transform(F.filter(plain, lambda f: ~fits(f)), parts)))
    return F.transform(cut, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["t"].alias("t"), _encoding(f["t"]).alias("e")))


def _instr(alphabet: Column, char: Column) -> Column:
    return F.call_function("instr", alphabet, char)


def _band(n: Column) -> Column:
    return sum((F.when(n >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))


def _cell(score: Column, band: Column, e: Column) -> Column:
    """The cell of the histogram for a score, an encoding and a band."""
    down = F.floor(-F.log10(F.greatest(score, F.lit(1e-300))) * (BINS / DECADES))
    return ((e * len(BANDS) + band) * BINS + F.greatest(F.lit(0), F.least(F.lit(BINS - 1), BINS - 1 - down))).cast("int")


def _tested(typed: Column) -> Column:
    """start, end and cell of each piece. What can be counted by string functions is, as these are far quicker than lambdas over characters."""
    of = lambda values: lambda e: _by_encoding(values, e)
    alphabet = of([a for _, a, *_ in ENCODINGS])
    classes = of(["a" * b + "b" * (c - b) + "c" * (len(a) - c) for _, a, b, c in ENCODINGS])
    middle = of([(len(a) - 1) / 2 for _, a, *_ in ENCODINGS])

    def lowered(f: Column) -> Column:
        return F.struct(*(f[c].alias(c) for c in ("start", "end", "e")), F.when(f["e"] == 0, F.lower(f["t"])).otherwise(f["t"]).alias("t"))

    def prepared(f: Column) -> Column:
        chars = F.split(f["t"], "")
        return F.struct(
            *(f[c].alias(c) for c in ("start", "end", "e")), F.length(f["t"]).alias("n"), F.call_function("translate", f["t"], alphabet(f["e"]), classes(f["e"])).alias("c"),
            F.regexp_extract_all(F.array_join(F.array_sort(chars), ""), F.lit(r"(.)\1*"), F.lit(0)).alias("equal"),
            F.transform(chars, lambda c: _instr(alphabet(f["e"]), c) - 1 - middle(f["e"])).alias("values"),
        )

    def summed(f: Column) -> Column:
        v, c = f["values"], f["c"]
        part = lambda mark: F.length(F.regexp_replace(c, f"[^{mark}]+", ""))
        return F.struct(
            *(f[x].alias(x) for x in ("start", "end", "e", "n")), F.transform(f["equal"], F.length).alias("counts"), F.array(part("a"), part("b"), part("c")).alias("classes"),
            (F.length(F.regexp_replace(c, "a+|b+|c+", "x")) - 1).alias("runs"),
            F.aggregate(F.zip_with(v, F.slice(v, 2, f["n"]), lambda a, b: a * b), F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0))).alias("lag"),
        )

    steps = (lowered, prepared, summed, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), _cell(_score(f), _band(f["n"]), f["e"]).alias("cell")))
    for step in steps:
        typed = F.transform(typed, step)
    return typed


def _word_like(words: Column, style: Column) -> Column:
    """The words as a name with capitals (0), with underscores (1), as a path (2), in capitals (3), with hyphens (4), or numbers alone (5)."""
    numbered = lambda w, i, mark: F.when(F.pmod(F.xxhash64(w, i), F.lit(3)) == 0, F.concat(w, F.lit(mark), F.pmod(F.xxhash64(i, w), F.lit(1000)).cast("string"))).otherwise(w)
    joined = lambda f, mark="": F.array_join(F.transform(words, f), mark)
    return (
        F.when(style == 0, joined(lambda w, i: numbered(F.initcap(w), i, ""))).when(style == 1, joined(lambda w, i: numbered(F.lower(w), i, "_"), "_"))
        .when(style == 2, F.concat(F.lit("/"), joined(lambda w, i: numbered(F.lower(w), i, ""), "/"))).when(style == 3, joined(lambda w, i: F.upper(w)))
        .when(style == 4, joined(lambda w, i: numbered(F.lower(w), i, "-"), "-")).otherwise(joined(lambda w, i: F.pmod(F.xxhash64(w, i), F.lit(10_000)).cast("string")))
    )


def _null_cells(words: Column, style: Column, band: Column) -> Column:
    """The cell of a word-like token, as long as the band's shortest; none where the words don't suffice."""
    least = F.get(F.array(*map(F.lit, BANDS)), band)
    token = F.call_function("substring", _word_like(words, style), F.lit(1), least)
    typed = F.transform(F.array(token), lambda t: F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), t.alias("t"), _encoding(t).alias("e")))
    return F.transform(_tested(F.filter(typed, lambda f: f["e"].isNotNull() & (F.length(f["t"]) == least))), lambda f: f["cell"])


def _own_words(text: Column) -> Column:
    """Up to 32 words, evenly from the whole text."""
    words = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_+/=-])[A-Za-z][a-z]{2,11}(?![A-Za-z0-9_+/=-])"), F.lit(0))
    return F.get(F.transform(F.array(words), lambda w: F.filter(w, lambda x, i: i % F.greatest(F.ceil(F.size(w) / 32), F.lit(1)) == 0)), F.lit(0))


def _counts(cells: DataFrame) -> dict[int, int]:
    """How often each cell occurs; at most 11,200 rows."""
    return {r[0]: r[1] for r in cells.groupBy(cells.columns[0]).count().collect()}


def _cuts(found: dict[int, int], null: dict[int, int], q: float) -> list[int]:
    """For each encoding and band the least bin that is reported: the Benjamini-Hochberg cut of the band's p-values at level q."""
    groups = len(ENCODINGS) * len(BANDS)
    cuts, p_values = [BINS] * groups, {}
    for g in range(groups):
        total, above = sum(null.get(g * BINS + b, 0) for b in range(BINS)), 0
        for b in reversed(range(BINS)):
            above += null.get(g * BINS + b, 0)
            p_values[g, b] = (1 + above) / (1 + total)
    for band in range(len(BANDS)):
        own = sorted((p_values[g, b], g, b, n) for g in range(band, groups, len(BANDS)) for b in range(BINS) if (n := found.get(g * BINS + b)))
        total, rank, threshold = sum(n for *_, n in own), 0, 0.0
        for p, _, _, n in own:
            rank += n
            if p <= q * rank / total:
                threshold = p
        for p, g, b, _ in own:
            if p <= threshold:
                cuts[g] = min(cuts[g], b)
    return cuts


def _ordered(found: Column | str, order: int) -> Column:
    return F.transform(found, lambda f: F.struct(f["start"].alias("start"), F.lit(order).alias("order"), f["end"].alias("end")))


def of_kind(spans: str, kind: str) -> Column:
    """How many of the spans are of the kind."""
    order = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["order"] == order)).cast("long")


def scan(docs: DataFrame, keep: tuple[str, ...] = (), q: float = 0.05) -> DataFrame:
    """doc_id, base and spans: arrays of (start, order, end), by start and order, order being the place in KINDS; and the columns to keep."""
    kept = F.struct(*(column(c).alias(f"c{i}") for i, c in enumerate(keep))) if keep else F.lit(0)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), kept.alias("_kept"))
    text = F.col("_text")
    base = [
        located(text, ASSIGN, group=2, least=6),
        located(text, ACCESS, least=20, needs=r"AKIA[A-Z0-9]{16}"),
        located(text, HEX),
    ]
    dealt = F.pmod(F.xxhash64("_text"), F.lit(5 * len(BANDS))).cast("int").alias("dealt")
    df = df.select("doc_id", "_kept", *(b.alias(k) for k, b in zip(KINDS, base, strict=False)), located(text, TOKEN).alias("found"), _own_words(text).alias("words"), dealt)
    spans = F.concat(*(_ordered(k, o) for o, k in enumerate(KINDS[:3])))
    df = df.select("doc_id", "_kept", F.sort_array(spans).alias("base"), "found", "words", "dealt")
    free = F.filter("found", lambda f: ~F.exists("base", lambda b: (b["start"] < f["end"]) & (f["start"] < b["end"])))
    df = materialize(df.select("doc_id", "_kept", "base", _tested(_pieces(free)).alias("tested"), _null_cells(F.col("words"), F.col("dealt") % 5, F.floor(F.col("dealt") / 5).cast("int")).alias("null")), "secrets")

    picked = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.get(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64("id", i), F.lit(len(WORDS))).cast("int")))
    fixed = docs.sparkSession.range(6 * len(BANDS) * FIXED).select(_null_cells(picked, F.col("id") % 6, F.floor(F.col("id") / 6).cast("int") % len(BANDS)).alias("null"))
    null = _counts(df.select("null").unionByName(fixed).select(F.explode("null").alias("cell")))
    found = _counts(df.select(F.explode("tested").alias("t")).select("t.cell"))
    cuts = F.array(*map(F.lit, _cuts(found, null, q)))
    random = _ordered(F.filter("tested", lambda t: t["cell"] % BINS >= F.get(cuts, F.floor(t["cell"] / BINS).cast("int"))), 3)
    return df.select("doc_id", "base", F.sort_array(F.concat("base", random)).alias("spans"), *(F.col("_kept")[f"c{i}"].alias(f"kept_{c}") for i, c in enumerate(keep)))


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first is named."""
    kinds = F.array(*map(F.lit, KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.get(kinds, s["order"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def redact_documents(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """docs with the secrets in text masked; n_chars follows the text, the other columns stay."""
    columns = docs.columns
    found = scan(docs, keep=tuple(columns), q=q)
    clean = F.size("spans") == 0
    own = {c: column(f"kept_{c}") for c in columns}
    done = found.select("*", F.when(clean, own["text"]).otherwise(redacted(own["text"], F.col("spans"))).alias("_redacted"))
    new = {"text": F.col("_redacted")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(clean, own["n_chars"]).otherwise(F.length("_redacted")).cast(docs.schema["n_chars"].dataType)
    return done.select(*(new.get(c, own[c]).alias(c) for c in columns))
