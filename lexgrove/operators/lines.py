"""Ordered lines of documents: headings, segments, repeated lines, and folds that carry state.

Everything is partitioned by document. Folds whose next state depends on what was accepted before run
per document in Python; the rest are windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexgrove.functions.text import plain_line

# Latin extensions of article numbers in their order.
EXTENSIONS = (
    "", "bis", "ter", "quater", "quinquies", "sexies", "septies", "octies", "novies", "decies",
    "undecies", "duodecies", "terdecies", "quattuordecies", "quindecies", "sexdecies", "septendecies", "octodecies", "novendecies", "vicies",
    "unvicies", "duovicies", "tervicies", "quattuorvicies", "quinvicies", "sexvicies", "septenvicies", "octovicies", "novenvicies", "tricies",
)
#: The extensions as alternatives of a pattern, longer ones first.
EXTENSION = "|".join(sorted(EXTENSIONS[1:], key=lambda e: (-len(e), e)))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, seq, line."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "line"))


def _order(upto: bool = True) -> Window:
    order = Window.partitionBy("doc_id").orderBy("seq")
    return order.rowsBetween(Window.unboundedPreceding, Window.currentRow) if upto else order


def with_heading(lines: DataFrame, is_heading: Column) -> DataFrame:
    """The last heading at or before each line."""
    return lines.withColumn("heading", F.last(F.when(is_heading, F.col("line")), ignorenulls=True).over(_order()))


def segments(lines: DataFrame, is_heading: Column) -> DataFrame:
    """doc_id, segment, title, content: a heading starts a segment, the line after it is its title; 0 is what comes before."""
    marked = lines.withColumn("is_heading", is_heading).withColumn("segment", F.sum(F.col("is_heading").cast("int")).over(_order()))
    marked = marked.withColumn("is_title", F.coalesce(F.lag("is_heading").over(_order(False)), F.lit(False)) & ~F.col("is_heading"))
    body = F.array_sort(F.collect_list(F.when(~F.col("is_heading") & ~F.col("is_title"), F.struct("seq", "line"))))
    grouped = marked.groupBy("doc_id", "segment").agg(F.max(F.when(F.col("is_heading"), F.col("line"))).alias("heading"), F.max(F.when(F.col("is_title"), F.col("line"))).alias("title"), body.alias("body"))
    return grouped.select("doc_id", "segment", "heading", "title", F.array_join(F.transform("body", lambda x: x["line"]), "\n").alias("content"))


def repeated_lines(lines: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Normalised non-blank lines that occur at least so often within the keys."""
    plain = lines.withColumn("plain", plain_line(F.col("line"))).where("plain != ''")
    return plain.groupBy(*keys, "plain").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def without_repeated(lines: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Lines except the repeated ones."""
    repeated = repeated_lines(lines, keys, least).select(*keys, "plain")
    return lines.withColumn("plain", plain_line(F.col("line"))).join(repeated, [*keys, "plain"], "left_anti").drop("plain")


def merged_continuations(rows: DataFrame, has_id: Column, text: str) -> DataFrame:
    """doc_id, group, text: rows without an id are appended to the row before that has one."""
    grouped = rows.withColumn("group", F.sum(has_id.cast("int")).over(_order())).groupBy("doc_id", "group").agg(F.array_sort(F.collect_list(F.struct("seq", text))).alias("parts"))
    return grouped.select("doc_id", "group", F.array_join(F.transform("parts", lambda p: p[text]), " ").alias(text))


def number_gaps(items: DataFrame) -> DataFrame:
    """doc_id, seq, number, is_placeholder: items with rows for the numbers that a jump leaves out."""
    jump = F.lead("number").over(Window.partitionBy("doc_id").orderBy("seq"))
    spread = items.withColumn("next", jump).withColumn("number", F.explode(F.when(F.col("next") > F.col("number") + 1, F.sequence("number", F.col("next") - 1)).otherwise(F.array("number"))).alias("n"))
    first = F.row_number().over(Window.partitionBy("doc_id", "seq").orderBy("number")) == 1
    return spread.select("doc_id", "seq", "number", (~first).alias("is_placeholder"))


def joined_broken_lines(lines: DataFrame, alone: Column) -> DataFrame:
    """A line that is an id alone takes the following line; that line goes."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    run = Window.partitionBy("doc_id", "island").orderBy("seq")
    # in a run of such lines every second one is taken by the one before
    marked = lines.withColumn("alone", alone).withColumn("island", F.sum((~F.col("alone")).cast("int")).over(order))
    opens = marked.withColumn("place", F.sum(F.col("alone").cast("int")).over(run)).withColumn("opens", F.col("alone") & (F.col("place") % 2 == 1))
    paired = opens.withColumns({"following": F.lead("line").over(order), "taken": F.coalesce(F.lag("opens").over(order), F.lit(False))})
    return paired.where("not taken").select("doc_id", "seq", F.when(F.col("opens") & F.col("following").isNotNull(), F.concat_ws(" ", "line", "following")).otherwise(F.col("line")).alias("line"))


Columns = dict[str, list]


def fold(rows: DataFrame, schema: str, step: Callable[[Columns], Columns]) -> DataFrame:
    """Each document's rows in order through a step that sees the document's columns and gives new ones.

    One sort by document and place; partitions are streamed, so many small documents cost no call of
    Spark's each, and only one document is held at a time. Rows with a null doc_id are one document.
    """
    names = rows.columns
    target = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(columns: Columns) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns[f.name], f.type) for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Columns = {}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in names}
            ids, out, start = columns["doc_id"], {}, 0
            for i in range(1, len(ids) + 1):
                if i < len(ids) and ids[i] == ids[start]:
                    continue
                if held and held["doc_id"][0] != ids[start]:
                    _extend(out, step(held))
                    held = {}
                own = {c: v[start:i] for c, v in columns.items()}
                held = {c: held[c] + own[c] for c in names} if held else own
                start = i
            if out:
                yield batch_of(out)
        if held:
            yield batch_of(step(held))

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(run, schema)


def _extend(out: Columns, more: Columns) -> None:
    for c, v in more.items():
        out.setdefault(c, []).extend(v)


def accepted_articles(items: DataFrame) -> DataFrame:
    """doc_id, seq, number, extension, accepted: items (number, extension) that continue the last accepted one.

    The next number only without an extension; the same number with the next or next but one
    extension; the number after the next; and whatever comes first.
    """

    def step(doc: Columns) -> Columns:
        last, rank, out = 0, 1, []
        for number, extension in zip(doc["number"], doc["extension"], strict=True):
            extension = extension or ""
            own = EXTENSIONS.index(extension.lower()) + 1 if extension.lower() in EXTENSIONS else 1
            ok = last == 0 or (own == 1 if number == last + 1 else number == last and own - rank in (1, 2) or number == last + 2)
            if ok:
                last, rank = number, own
            out.append(bool(ok))
        return {c: doc[c] for c in ("doc_id", "seq", "number", "extension")} | {"accepted": out}

    return fold(items, "doc_id long, seq int, number long, extension string, accepted boolean", step)


def next_label(label: str, kind: str) -> str | None:
    """The label that follows in a numbered, lettered or Roman list."""
    if kind == "number":
        return str(int(label) + 1)
    if kind == "letter":
        return chr(ord(label) + 1) if label not in "zZ" else label * 2
    digits = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    values = [digits.get(ch, 0) for ch in label.lower()]
    if not values or 0 in values:
        return None
    value = sum(-v if i + 1 < len(values) and v < values[i + 1] else v for i, v in enumerate(values)) + 1
    out = ""
    for size, mark in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while value >= size:
            out, value = out + mark, value - size
    return out


_ITEM = re.compile(rf"^\s*(?:(\d+)|([ivxlc]+)|([a-z]))\s*({EXTENSION})?\s*[.)]\s+(.*)$", re.S | re.I)


def list_items(docs: DataFrame) -> DataFrame:
    """doc_id, item, label, kind, content, quoted: items of enumerations; text inside « » starts no item."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"].fillna(""), strict=True):
                items, depth, expected = [["0", "", [], False]], 0, {}
                for line in text.split("\n"):
                    m = _ITEM.match(line) if depth <= 0 else None
                    if m:
                        label = next(g for g in m.groups()[:3] if g)
                        kinds = ["number"] if m[1] else [k for k in ("roman", "letter") if (k == "roman" and m[2]) or (k == "letter" and len(label) == 1)]
                        fits = [k for k in kinds if expected.get(k) == label] or [k for k in kinds if label.lower() in ("1", "i" if k == "roman" else "a")]
                        if fits or m[4]:
                            kind = (fits or kinds)[0]
                            expected[kind] = next_label(label, kind)
                            items.append([label + (" " + m[4] if m[4] else ""), kind, [], False])
                        else:
                            m = None
                    items[-1][2].append(m[5] if m else line)
                    items[-1][3] |= "«" in line
                    depth += line.count("«") - line.count("»")
                rows += [(doc_id, i, label, kind, "\n".join(content), quoted) for i, (label, kind, content, quoted) in enumerate(items) if i or any(content)]
            yield pd.DataFrame(rows, columns=["doc_id", "item", "label", "kind", "content", "quoted"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, item int, label string, kind string, content string, quoted boolean")


def title_paths(blocks: DataFrame, body_size: float = 11.0) -> DataFrame:
    """doc_id, seq, level, path: titles by font size (1.4 of the body's: level 1, 1.2: level 2, else 3) and the titles above them."""

    def step(doc: Columns) -> Columns:
        stack, levels, paths = [], [], []
        for text, size, is_title in zip(doc["line"], doc["size"], doc["is_title"], strict=True):
            level = 0
            if is_title:
                level = 1 if size >= 1.4 * body_size else 2 if size >= 1.2 * body_size else 3
                stack = [*[t for t in stack if t[0] < level], (level, text)]
            levels.append(level)
            paths.append([t for _, t in stack])
        return {"doc_id": doc["doc_id"], "seq": doc["seq"], "level": levels, "path": paths}

    return fold(blocks, "doc_id long, seq int, level int, path array<string>", step)


def token_batches(items: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, seq, part, tokens, batch: items (tokens) in order, a batch ends before it would exceed the most; items over the most are split."""
    own = items.select("doc_id", "seq", F.col("tokens").cast("long").alias("tokens"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / most) - 1, F.lit(0)).cast("int")), lambda i: F.struct(i.alias("part"), F.least(F.lit(most), F.col("tokens") - i * most).alias("tokens")))
    parts = own.select("doc_id", "seq", F.explode(pieces).alias("p")).select("doc_id", "seq", "p.part", "p.tokens")

    def step(doc: Columns) -> Columns:
        order = sorted(range(len(doc["seq"])), key=lambda i: (doc["seq"][i], doc["part"][i]))
        columns = {c: [doc[c][i] for i in order] for c in doc}
        batch, used, out = 0, 0, []
        for tokens in columns["tokens"]:
            if used and used + tokens > most:
                batch, used = batch + 1, 0
            used += tokens
            out.append(batch)
        return columns | {"batch": out}

    return fold(parts, "doc_id long, seq int, part int, tokens long, batch int", step)


_END = re.compile(r"[.!?](?=\s)")


def bounded(text: str, low: int, high: int) -> list[str]:
    """The text cut after the first sentence end between low and high, else at high, until no more than low is left."""
    parts = []
    while len(text) > low:
        m = _END.search(text, low, high)
        cut = m.end() if m else min(high, len(text))
        parts.append(text[:cut].strip())
        text = text[cut:].strip()
    return [*parts, text] if text else parts


def sentence_chunks(docs: DataFrame, low: int = 10_000, high: int = 12_000) -> DataFrame:
    """doc_id, chunk, content: long texts cut after the first sentence end between low and high, else at high."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(d, i, p) for d, t in zip(pdf["doc_id"], pdf["text"].fillna(""), strict=True) for i, p in enumerate(bounded(t, low, high))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, content string")


def fixed_chunks(docs: DataFrame, size: int = 40_000) -> DataFrame:
    """doc_id, chunk, content: pieces of a fixed number of characters."""
    text = F.coalesce("text", F.lit(""))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), (F.ceil(F.length(text) / size) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return docs.select("doc_id", text.alias("text"), F.explode(starts).alias("chunk")).select("doc_id", "chunk", F.substring("text", F.col("chunk") * size + 1, F.lit(size)).alias("content"))


def overlapping_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk, content: recursive splitting at paragraphs, lines, words, characters; pieces are merged up to size and share an overlap."""

    def split(text: str, marks: tuple[str, ...]) -> list[str]:
        mark = next((m for m in marks if m in text or not m), "")
        out, held = [], []
        length = lambda: sum(map(len, held)) + len(mark) * max(len(held) - 1, 0)
        for piece in text.split(mark) if mark else list(text):
            if len(piece) > size:
                if held:
                    out.append(mark.join(held))
                    held = []
                out += split(piece, marks[marks.index(mark) + 1 :])
                continue
            if held and length() + len(mark) + len(piece) > size:
                out.append(mark.join(held))
                while held and (length() > overlap or length() + len(mark) + len(piece) > size):
                    held.pop(0)
            held.append(piece)
        return [p for p in ([*out, mark.join(held)] if held else out) if p.strip()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(d, i, p) for d, t in zip(pdf["doc_id"], pdf["text"].fillna(""), strict=True) for i, p in enumerate(split(t, ("\n\n", "\n", " ", "")))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, content string")
