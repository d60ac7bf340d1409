"""Operators that SQL doesn't express, on small inputs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import text as X
from lexgrove.operators import graph, hierarchy, lines, matching, profile, scoring, statistics, versioning
from lexgrove.sources import readers, writers
from lexgrove.streaming import inbox


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, column, **values):
    kinds = {int: "bigint", str: "string", float: "double"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (X.alnum_key, "▼B1 Art. 5<b>x</b>\tÀ\n y", "art5xy"), (X.alnum_key, None, ""), (X.canonical_words, "Hy­phen-\nated   Word", "hyphenated word"), (X.squeezed, "A b C", "abc"),
        (lambda c: X.first_integer(c, -1), "art. 12 bis 7", 12), (lambda c: X.first_integer(c, -1), "none", -1), (lambda c: X.first_words(c, 2), " a  b\nc ", "a b"),
        (lambda c: X.shortened(c, 6), "abcdefgh", "abc..."), (X.plain_line, "  Page 12 Title ", "title"), (X.name_key, "A-b_1.PDF", "ab1pdf"), (X.dotted_number, "1.2.3", True), (X.dotted_number, "1..2", False),
        (X.pattern_class, "Non può farlo", "Divieto"), (X.pattern_class, "entro il 3", "Termine temporale"), (X.pattern_class, "altrove", "altro"), (X.article_id, "art. 5", "Articolo5"),
        (X.provision_type, "Real Decreto-ley 3", "REAL DECRETO-LEY"), (X.legal_source, "CELEX_3", "Gazzetta ufficiale"), (X.empty_cell, " NaN ", True), (X.empty_cell, "0", False),
        (X.first_date, "il 3.4.21 e 01/02/2020", "01/02/2020"), (X.first_date, "nulla", ""), (X.all_dates, "2020-01-02, 3 Marzo 2021, 1/2/20", ["1/2/20", "2020-01-02", "3 Marzo 2021"]),
        (lambda c: X.word_balance(c, ["si"], ["no"]), "no no si", True), (lambda c: X.without_words(c, ["il", "là"]), "il gatto là Il", "gatto"), (X.without_controls, "a\x00b", "ab"),
        (X.complexity, "NATO 2020. x\n", 1.0), (X.sortable_number, "3,5", 3.5), (X.sortable_number, "x", None), (X.page_reference, "7", "Pg. 7"), (X.page_reference, None, ""),
    ],
)
def test_functions(spark, function, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(function(F.col("t"))).first()[0] == expected


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0, 5.0], [1.0, 0.0]), ([], [1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    assert df.select(X.vector_text(F.col("a"), 2)).first()[0] == "[1.0, 0.0, ... +1 dims]"


def test_answers(spark):
    text = "Requirement: do it\nCore text: now\nrequirement: and this\ncore text: later"
    got = spark.createDataFrame([(text,)], "t string").select(F.inline(X.response_pairs(F.col("t"))))
    assert rows(got) == [("do it", "now"), ("and this", "later")]


def test_lists_round_trip(spark):
    df = spark.createDataFrame([([["a", "b"], [], ["c"]],)], "l array<array<string>>")
    flat, lengths = hierarchy.split_lists(F.col("l"))
    both = df.select("l", flat.alias("f"), lengths.alias("n"))
    assert both.select("l", hierarchy.join_lists(F.col("f"), F.col("n")).alias("m")).where("l = m").count() == 1
    assert df.select(hierarchy.joined_texts(F.col("l"), "-")).first()[0] == "a-b-c"
    with pytest.raises(Exception, match="add up"):
        both.select(hierarchy.join_lists(F.col("f"), F.array(F.lit(9)))).collect()


def test_nested_names(spark):
    df = spark.sql("select named_struct('b', 1, 'c', named_struct('d', 2)) as a, 3 as e")
    assert hierarchy.flat_struct(df).columns == ["a_b", "a_c_d", "e"]
    assert rows(hierarchy.path_values(spark.sql("select 1 as id, array(named_struct('n', array('x', 'y')), named_struct('n', array('z'))) as u"), "id", ["u", "n"])) == [(1, [0, 0], "x"), (1, [0, 1], "y"), (1, [1, 0], "z")]


def test_sequence_of_articles(spark):
    data = [(1, 0, 1, None), (1, 1, 2, None), (1, 2, 2, "bis"), (1, 3, 9, None), (1, 4, 4, None), (1, 5, 3, None), (2, 0, 7, None), (2, 1, 8, "ter")]
    got = rows(lines.accepted_articles(spark.createDataFrame(data, "doc_id long, seq int, number long, extension string")), "doc_id", "seq")
    assert [r[4] for r in got] == [True, True, True, False, True, False, True, False]


def test_list_items(spark):
    text = "Intro\n1. uno\n2) due\na) alfa\nb) beta «citato\n1. non qui»\n3. tre\ni. primo\nii. secondo\n9. no"
    got = rows(lines.list_items(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")), "item")
    assert [r[2] for r in got] == ["0", "1", "2", "a", "b", "3", "i", "ii"]
    assert got[4][4] == "beta «citato\n1. non qui»" and got[-1][4] == "secondo\n9. no"


@pytest.mark.parametrize(("label", "kind", "following"), [("9", "number", "10"), ("a", "letter", "b"), ("z", "letter", "zz"), ("viii", "roman", "ix"), ("xxxix", "roman", "xl")])
def test_next_label(label, kind, following):
    assert lines.next_label(label, kind) == following


def test_title_paths_and_batches(spark):
    blocks = [(1, 0, "A", 16.0, True), (1, 1, "text", 11.0, False), (1, 2, "B", 13.5, True), (1, 3, "C", 11.0, True), (1, 4, "D", 13.5, True)]
    got = rows(lines.title_paths(spark.createDataFrame(blocks, "doc_id long, seq int, line string, size double, is_title boolean")), "seq")
    assert [r[3] for r in got] == [["A"], ["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]
    items = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 5, 5, 30, 1])], "doc_id long, seq int, tokens int")
    assert [r[4] for r in rows(lines.token_batches(items, 10), "seq", "part")] == [0, 0, 1, 2, 3, 4, 5]  # 30 is split


def test_broken_lines(spark):
    data = spark.createDataFrame([(1, i, x) for i, x in enumerate(["1.", "Title", "2.", "3.", "Three", "4."])], "doc_id long, seq int, line string")
    assert [r[2] for r in rows(lines.joined_broken_lines(data, F.col("line").rlike(r"^\d+\.$")), "seq")] == ["1. Title", "2. 3.", "Three", "4."]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "Word one. " * 30), (2, None), (3, "x" * 50)], "doc_id long, text string")
    parts = rows(lines.sentence_chunks(docs, 100, 120), "doc_id", "chunk")
    assert all(len(p) <= 120 for _, _, p in parts) and "".join(p for d, _, p in parts if d == 1).count("Word") == 30
    parts = rows(lines.overlapping_chunks(docs, 40, 10), "doc_id", "chunk")
    assert all(len(p) <= 40 for _, _, p in parts)
    assert "".join(p for d, _, p in rows(lines.fixed_chunks(docs, 7), "doc_id", "chunk") if d == 3) == "x" * 50


def test_profiles(spark):
    rules = [
        {"id": "a", "priority": 1, "threshold": 2, "max_score": 4, "user_aliases": ["alpha"], "scoring_rules": [{"feature": "regex_in_head", "pattern": "^art", "points": 2}, {"feature": "ag_header_count_ge", "value": 3, "points": 2}]},
        {"id": "b", "priority": 2, "threshold": 1, "max_score": 2, "user_aliases": ["beta"], "scoring_rules": [{"feature": "regex_in_broader", "pattern": "boe", "points": 1}, {"feature": "other", "points": 9}]},
    ]
    data = [(1, "Art. 1", "BOE", 0, None), (2, "x", "boe", 3, None), (3, "x", "", 0, None), (4, "x", "", 0, "Alpha "), (5, "x", "", 0, "bet")]
    df = spark.createDataFrame(data, "id int, head string, broader string, header_pages int, hint string").withColumns({"extended": F.col("head"), "file": F.lit("f"), "table_ratio": F.lit(0.0)})
    got = rows(profile.choose(profile.scores(df, rules), rules).select("id", "detected_type", "confidence"), "id")
    assert got == [(1, "a", 0.5), (2, "a", 0.5), (3, "general", 0.5), (4, "a", 0.5), (5, "b", 0.5)]


def test_scorer_that_fails(spark):
    def scorer(pairs):
        if any(a == "bad" for a, _ in pairs):
            raise RuntimeError
        return [float(len(a)) for a, _ in pairs]

    df = spark.createDataFrame([("aa", "b"), ("bad", "b"), ("c", "b")], "x string, y string").coalesce(1)
    assert [r.score for r in scoring.score_pairs(df, "x", "y", scorer, fallback=-1.0).collect()] == [2.0, -1.0, 1.0]
    assert scoring.overlap_scorer([("a b", "b c"), ("", ""), (None, "x")]) == [10.0, 0.0, 0.0]


def test_estimates(spark):
    ops = spark.createDataFrame([("few", 100, 20.0), ("few", 100, 30.0), ("none", 0, 1.0)] + [("mid", 1000, 20.0 + i) for i in range(5)], "mode string, tokens long, seconds double")
    got = {r[0]: r[1:] for r in rows(statistics.time_estimates(ops, "mode", "tokens", "seconds", F.lit(100)))}
    assert got["few"] == (25.0, "ratio") and got["none"][1] == "fallback" and got["mid"][1] == "truncated" and abs(got["mid"][0] - 2.2) < 1e-9


def test_version_edges(spark):
    schema = "doc_id long, art_seq int, art_id string, content string, is_placeholder boolean"  # ids under five letters are discarded
    new = spark.createDataFrame([(1, 0, "Art 1", "same", False), (1, 1, "Art", "x", False), (1, 2, "Articolo 2", "changed", False), (1, 3, "Articolo 3", "new", False)], schema)
    old = spark.createDataFrame([(1, 0, "Articolo 2", "first", False), (1, 1, "ARTICOLO 2", "before", False), (1, 2, "Articolo 9", "gone", False)], schema)
    got = {r.art_id: (r.verdict, r.old_art_seq) for r in versioning.article_verdicts(versioning.keyed(new), versioning.keyed(old)).collect()}
    assert got == {"Art 1": ("Inserito", None), "Art": ("Scartato", None), "Articolo 2": ("Da Verificare", 1), "Articolo 3": ("Inserito", None), "Articolo 9": ("Rimosso", 2)}


def test_first_match_and_scores(spark):
    left = spark.createDataFrame([(1, "k"), (2, "z")], "id int, key string")
    right = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early")], "key string, seq int, v string")
    assert rows(matching.first_match(left, right, "key", "seq", ["v"]).select("id", "hit_v"), "id") == [(1, "early"), (2, None)]
    pairs = spark.createDataFrame([("Storia del documento", "x"), ("a", "b")], "a string, b string")
    assert [r.score for r in matching.scored_pairs(pairs, F.lit(7), "a", "b").orderBy("a").collect()] == [0, 7]


def test_graph_is_written(spark, tmp_path):
    docs = spark.createDataFrame([(1, "boe x")], "doc_id long, source string")
    sections = spark.createDataFrame([(1, 0, None, "a"), (1, 1, 0, "b"), (1, 2, 0, "a")], "doc_id long, seq int, parent int, content string")
    nodes, edges = graph.document_graph(docs, sections)
    assert nodes.count() == 4 and edges.groupBy("type").count().where("type = 'PART_OF'").first()["count"] == 2
    graph.write_graph(nodes, edges, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/edges").count() == edges.count()
    entities = spark.createDataFrame([("s", [f"N{i}" for i in range(20)])], "id string, names array<string>")
    assert graph.mention_edges(entities, "person").count() == 8
    assert graph.trimmed_vectors(spark.sql("select sequence(1, 2000) as embedding")).select(F.size("embedding")).first()[0] == 1536


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a<b&c", 1), (None, 2), ("x\x01y", 3)], "t string, n int").coalesce(1)
    assert writers.workbook(df, f"{tmp_path}/w.xlsx") == 3
    assert zipfile.is_zipfile(f"{tmp_path}/w.xlsx")
    got = rows(readers.workbooks(spark, str(tmp_path)).select("row", "cells"), "row")
    assert [r[1] for r in got] == [["t", "n"], ["a<b&c", "1"], ["", "2"], ["xy", "3"]]
    with pytest.raises(ValueError, match="fit"):
        writers.workbook(df, f"{tmp_path}/v.xlsx", most=2)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("uno")
    (tmp_path / "sub" / "b.txt").write_text("due")
    (tmp_path / "r.json").write_text('{"requirements": [{"requirement": "x"}, {"requirement": "y"}]}')
    assert [r[0] for r in rows(readers.texts(spark, str(tmp_path)).select("text"), "text")] == ["due", "uno"]
    assert [r[0] for r in rows(readers.requirements(spark, f"{tmp_path}/r.json"), "requirement")] == ["x", "y"]
    listed = readers.listing(spark, str(tmp_path), "*.txt")
    assert rows(readers.missing(spark.createDataFrame([("a.txt",), ("c.txt",)], "name string"), listed, "name")) == [("c.txt",)]
    assert readers.newest(listed).first()[0].endswith(".txt")
    with pytest.raises(Exception, match="missing"):
        readers.stage(spark, f"{tmp_path}/r.json", "parts array<string>", ["parts"]).collect()
    wanted = spark.createDataFrame([("k",), ("m",)], "key string")
    near, far = (spark.createDataFrame(x, "key string, location string") for x in ([("k", "near")], [("k", "far"), ("m", "far")]))
    assert rows(readers.first_found(wanted, "key", ("local", near), ("remote", far)), "key") == [("k", "near", "local"), ("m", "far", "remote")]
    writers.stage(listed.select("path"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/json").count() == 2


def test_inbox(spark, tmp_path):
    box, out = tmp_path / "in", str(tmp_path / "out")
    box.mkdir()
    (box / "a.txt").write_text("uno")

    def handle(batch, _):
        batch.select("path").write.mode("append").parquet(out)

    for expected in (1, 2):
        inbox.process(inbox.incoming(spark, str(box)), handle, str(tmp_path / "check"), None).awaitTermination(120)
        assert spark.read.parquet(out).count() == expected  # each file once
        (box / "b.txt").write_text("due")


def test_progress_stream(spark, tmp_path):
    spark.sql("select 1L as job_id, timestamp'2024-01-01 00:00:00' as ts, 'Running' as status union all select 1L, timestamp'2024-01-01 00:01:00', 'Completed'").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("job_id long, ts timestamp, status string").parquet(f"{tmp_path}/e")
    q = inbox.live_progress(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("live").first()["events"] == 2
