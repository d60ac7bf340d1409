"""Pages, parsers, versions and row shapes on small cases, beside the queries that SQL checks."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import text as X
from lexgrove.operators import document_parsers, graph, hierarchy, layout, lines, matching, profile, scoring, shapes, versioning
from lexgrove.sources import readers, writers
from lexgrove.streaming import inbox


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def plain_parts(blocks, low, high):
    """Sections and their texts by the rules of the general parser, one block after another."""
    out, section, held = [], "", ""

    def cut(text):
        texts = []
        while len(text) > low:
            m = re.compile(r"[.!?](?=\s)").search(text, low, high)
            at = m.end() if m else min(high, len(text))
            texts.append(text[:at].strip())
            text = text[at:].strip()
        return texts + ([text] if text else [])

    def flush(force):
        nonlocal held
        texts = cut(held.strip())
        held = texts.pop() if texts and not force and len(texts[-1]) < 50 else ""
        out.extend((section, t) for t in texts)

    for text, title in blocks:
        if title:
            flush(True)
            section, held = text, ""
        else:
            held = f"{held} {text}" if held else text
            if len(held) > 1.5 * high:
                flush(False)
    flush(True)
    return out


def test_general_parts(spark):
    rng = random.Random(3)
    data, want = [], {}
    for doc in range(12):
        blocks = []
        for _ in range(rng.randrange(1, 60)):
            title = rng.random() < 0.1
            blocks.append((f"TITLE {rng.randrange(99)}" if title else " ".join("w" * rng.randrange(1, 9) + rng.choice(["", "", "", "."]) for _ in range(rng.randrange(1, 60))).lower(), title))
        want[doc] = plain_parts(blocks, 300, 400)
        data += [(doc, i, 1, t, 10.0, False) for i, (t, _) in enumerate(blocks)]
    df = spark.createDataFrame(data, "doc_id long, seq int, page int, text string, size double, bold boolean")
    got = {}
    for r in document_parsers.general_parts(df, 11.0, 300, 400).orderBy("doc_id", "part_id").collect():
        own = got.setdefault(r["doc_id"], [])
        assert r["part_id"] == len(own) + 1
        assert r["sibling_of"] is None or own[r["sibling_of"] - 1][0] == r["section"]
        own.append((r["section"], r["content"]))
    assert got == {d: w for d, w in want.items() if w}


def test_folds_keep_large_and_null_ids(spark):
    big = 2**53 + 1
    items = spark.createDataFrame([(big, 0, 5), (None, 1, 7), (None, 0, 3), (big, 1, 25)], "doc_id long, seq int, tokens int")
    got = rows(lines.token_batches(items, 10), "doc_id", "seq", "part")
    assert got == [(None, 0, 0, 3, 0), (None, 1, 0, 7, 0), (big, 0, 0, 5, 0), (big, 1, 0, 10, 1), (big, 1, 1, 10, 2), (big, 1, 2, 5, 3)]


def test_every_latin_extension_counts(spark):
    assert len(lines.EXTENSIONS) == 30
    items = spark.createDataFrame([(1, i, 1, e) for i, e in enumerate(lines.EXTENSIONS)] + [(1, 40, 2, "undecies"), (1, 41, 2, "")], "doc_id long, seq int, number long, extension string")
    accepted = [r.accepted for r in lines.accepted_articles(items).orderBy("seq").collect()]
    assert accepted == [True] * 30 + [False, True]
    docs = spark.createDataFrame([(1, "1. a\n1 undecies. b\n2) c")], "doc_id long, text string")
    assert [r.label for r in lines.list_items(docs).orderBy("item").collect()] == ["1", "1 undecies", "2"]


def test_name_within_name(spark):
    names = spark.createDataFrame([("dir/EXT_the long annual report.pdf",), ("short",), ("annual report 2020 final version",)], "name string")
    catalog = spark.createDataFrame([("x/longannualreport.json", "h1"), ("shor", "h2"), ("Annual-Report-2020", "h3")], "known string, hash string")
    assert rows(matching.name_lookup(names, catalog).select("name", "hash", "rule"), "name") == [("annual report 2020 final version", "h3", 4), ("dir/EXT_the long annual report.pdf", "h1", 4), ("short", None, None)]


VALUES = "doc_id int, items array<struct<name string, tags array<struct<t string, n int>>>>, other string"


def test_values_go_back_to_their_places(spark):
    data = [(1, [("a", [("x", 1), ("y", 2)]), ("b", [])], "o"), (2, [("c", None), ("d", [("z", 3)])], None), (3, [], "p"), (4, None, "q")]
    df = spark.createDataFrame(data, VALUES)
    for path in (["items", "name"], ["items", "tags", "t"]):
        found = hierarchy.path_values(df.select("doc_id", "items"), "doc_id", path)
        assert rows(shapes.reinserted(df, found, "doc_id", path), "doc_id") == rows(df, "doc_id")
        upper = shapes.reinserted(df, found.withColumn("value", F.upper("value")), "doc_id", path)
        assert {r.value for r in hierarchy.path_values(upper.select("doc_id", "items"), "doc_id", path).collect()} == {r.value.upper() for r in found.collect()}
    one = spark.createDataFrame([(1, [0, 1], "new"), (1, [9, 9], "nowhere"), (7, [0], "none")], "doc_id int, coordinates array<int>, value string")
    got = {r.doc_id: r["items"] for r in shapes.reinserted(df, one, "doc_id", ["items", "tags", "t"]).collect()}
    assert [t.t for t in got[1][0].tags] == ["x", "new"] and got[4] is None and len(got) == 4


def test_routes_fall_back(spark):
    profiles = spark.createDataFrame([(1, "boe"), (2, "boe"), (3, "general"), (4, "regolamento"), (5, "unknown")], "doc_id long, detected_type string")
    known = {"boe": [1], "regolamento": [1, 2], "contenuto": [1, 2, 4, 5], "general": [3]}
    parsers = {name: (lambda ids, own=own: ids.where(F.col("doc_id").isin(own))) for name, own in known.items()}
    assert rows(document_parsers.routed(profiles, parsers).select("doc_id", "parser"), "doc_id") == [(1, "boe"), (2, "regolamento"), (3, "general"), (4, "contenuto")]


def test_amendment_sections(spark):
    texts = [
        "intro REGOLAMENTO (UE) N. 648/2012 body\nArticolo 3\nModifiche del Regolamento (UE) n. 648/2012\nmore\nArticolo 4\n Modifiche del regolamento (UE) n. 1/2013\nrest",
        "Regolamento (UE) n. 5/2010\nall of it", "no header", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(X.amendment_section(F.col("t"))).collect()]
    assert got == ["body\nArticolo 3\nModifiche del Regolamento (UE) n. 648/2012\nmore", "all of it", None, None]


def test_chapters_with_tables(spark):
    text = [(1, 1, 0, "INDICE"), (1, 2, 1, "Uno"), (1, 2, 2, "first"), (1, 3, 3, "more"), (1, 3, 4, "Due"), (1, 3, 5, "second")]
    body = spark.createDataFrame([(d, p, s, t, 400.0, 800.0) for d, p, s, t in text] + [(1, 2, 9, "foot", 790.0, 800.0)], "doc_id long, page int, seq int, line string, y0 double, page_height double")
    index = spark.createDataFrame([(1, 1, "Uno", 1), (1, 2, "Due", 2)], "doc_id long, seq int, title string, page int")
    last, shift = spark.createDataFrame([(1, 3)], "doc_id long, last_page int"), spark.createDataFrame([(1, 1)], "doc_id long, shift int")
    tables = spark.createDataFrame([(1, 3, 3, ["a", None, "b"])], "doc_id long, page int, seq int, cells array<string>")
    got = [(r.title, r.content) for r in document_parsers.chapters(body, index, last, tables, shift).orderBy("entry").collect()]
    assert got == [("Uno", "Uno\nfirst\na |  | b\nmore"), ("Due", "Due\nsecond")]


TEMPLATES = [
    {"id": "banca", "priority": 4, "threshold": 3, "max_score": 6, "user_aliases": ["banca"], "scoring_rules": []}, {"id": "regolamento", "priority": 5, "threshold": 2, "max_score": 5, "user_aliases": ["legge"], "scoring_rules": []},
]


def test_special_cases_of_templates(spark, tmp_path):
    for t in TEMPLATES:
        (tmp_path / f"{t['id']}.json").write_text(json.dumps(t))
    assert [t["id"] for t in profile.read_templates(spark, str(tmp_path))] == ["banca", "regolamento"]
    schema = "doc_id int, scores map<string,int>, detected_type string, hinted boolean, start_page int, has_articles boolean, has_article_pattern boolean, has_index_word boolean, has_index_entries boolean"
    cases = [
        (1, {"banca": 3, "regolamento": 0}, "x", False, None, False, False, True, True, "indice"), (2, {"banca": 3, "regolamento": 0}, "x", False, 4, False, False, False, False, "banca"), (3, {"banca": 4, "regolamento": 2}, "x", False, None, True, False, False, False, "banca"),
        (4, {"banca": 8, "regolamento": 2}, "x", False, 1, True, False, False, False, "regolamento"), (5, {"banca": 8, "regolamento": 1}, "x", False, 1, True, False, False, False, "banca"), (6, {"banca": 0, "regolamento": 0}, "x", False, 1, True, True, False, False, "banca"),
        (7, {"banca": 0, "regolamento": 0}, "x", False, None, True, True, True, True, "regolamento"), (8, {"banca": 0, "regolamento": 0}, "x", False, None, False, False, True, False, "general"), (9, {"banca": 6, "regolamento": 0}, "legge", True, None, False, False, False, False, "legge"),
    ]
    got = rows(profile.with_special_cases(spark.createDataFrame([c[:-1] for c in cases], schema), TEMPLATES).select("doc_id", "detected_type"), "doc_id")
    assert got == [(c[0], c[-1]) for c in cases]


def test_reports(spark):
    table = spark.createDataFrame([tuple(map(str, range(20)))], list(shapes.REPORT_COLUMNS)).withColumn("more", F.lit(1))
    assert shapes.report(table).columns == list(shapes.REPORT_COLUMNS.values())
    with pytest.raises(KeyError, match="Requirement"):
        shapes.report(table.drop("Requirement"))
    with pytest.raises(ValueError, match="Tipo"):
        shapes.uncoded_from_kind(table.drop("Tipo"))
    assert shapes.reordered(["a", "Contenuto", "Comma", "b", "Rif-Articolo"]) == ["a", "Comma", "Contenuto", "b", "Rif-Articolo"]
    tree = spark.createDataFrame([(1, 2, [(3, [(4, "c")])])], "doc_id int, art_id int, paragraphs array<struct<par_id int, subs array<struct<sub_id int, content string>>>>")
    got = shapes.ids_as_text(tree).first()
    assert (got.art_id, got.paragraphs[0].par_id, got.paragraphs[0].subs[0].sub_id) == ("2", "3", "4")
    places = spark.createDataFrame([([0, 1],), ([0, 2],), ([0],)], "c array<int>")
    assert shapes.at_place(places, "c", 0, 1).count() == 1 and shapes.at_place(places, "c", 0).count() == 3


def test_graph_summaries(spark, tmp_path):
    nodes = spark.createDataFrame([("a", ["X"]), ("b", ["Y"]), ("c", ["X"])], "id string, labels array<string>")
    edges = spark.createDataFrame([("T", "a", "b")], "type string, source string, target string")
    got = graph.graph_summary(nodes, edges).first()
    assert (got.labelled, got.edges, json.loads(got.labelled_by)) == (3, 1, {"X": 2, "Y": 1})
    assert graph.write_graph(nodes, edges, f"{tmp_path}/g") == (3, 1)
    assert graph.write_graph(nodes.limit(0), edges, f"{tmp_path}/none") == (0, 0) and not (tmp_path / "none").exists()


def test_second_versions(spark):
    articles = spark.createDataFrame([(1, 3, "Eliminato"), (1, 4, "Confermato")], "doc_id long, old_art_seq int, verdict string")
    children = spark.createDataFrame([(1, 3, "own"), (1, 4, "own"), (2, 3, "own")], "doc_id long, art_seq int, verdict string")
    assert rows(versioning.extended_to_children(children, articles), "doc_id", "art_seq") == [(1, 3, "Eliminato"), (1, 4, "own"), (2, 3, "own")]


def test_page_rows(spark):
    body = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "bc"), (1, 1, 2, "d"), (2, 3, 0, "e")], "doc_id long, page int, seq int, line string")
    assert rows(layout.page_offsets(layout.page_texts(body)), "doc_id", "page") == [(1, 0, 0, 4), (1, 1, 6, 1), (2, 3, 0, 1)]
    assert rows(layout.first_pages(body, 1), "doc_id") == [(1, "a\nbc"), (2, "")]
    sampled = spark.range(1).select(*(layout.sampled_pages(F.lit(n)).alias(f"n{n}") for n in (0, 1, 15, 16, 40))).first()
    assert (sampled.n0, sampled.n1, len(sampled.n15), sampled.n16, sampled.n40[15:]) == ([], [0], 15, list(range(15)), [19, 20, 21])
    assert spark.range(1).select(X.now_text()).first()[0].endswith("Z")


def test_model_answers(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no answer")
        return [{"abstract": p.upper()} if p else None for p in prompts]

    df = spark.createDataFrame([(1, "a text", None), (2, "bad", None), (3, "done", "already"), (4, None, " "), (5, "x" * 50, None)], "id int, prompt string, abstract_before string").coalesce(1)
    got = {r.id: (r.abstract, r.motive) for r in scoring.answers(df, "prompt", ["abstract", "motive"], model, skip="abstract_before", most=10).collect()}
    assert got == {1: ("A TEXT", None), 2: (None, None), 3: (None, None), 4: (None, None), 5: ("X" * 10, None)}


def test_files_of_results(spark, tmp_path):
    parsed = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", "old")], "doc_id int, part_id int, content string, abstract string")
    enriched = spark.createDataFrame([(1, 1, "new", "m")], "doc_id int, part_id int, abstract string, meaning string")
    assert rows(writers.merged(parsed, enriched, ["doc_id", "part_id"]), "part_id") == [(1, 1, "a", "new", "m"), (1, 2, "b", "old", None)]
    writers.publish(parsed, str(tmp_path / "r"), "plain", "hash1")
    assert spark.read.json(f"{tmp_path}/r/hash1.json").count() == spark.read.json(f"{tmp_path}/r/plain.json").count() == 2
    assert rows(spark.read.parquet(f"{tmp_path}/r/names")) == [("hash1", "plain")]
    (tmp_path / "c.json").write_text('{"data": {"scopes": [{"name": "x", "total": 2, "files": [{"name": "f", "distance": 0.5}]}]}}')
    found = readers.catalog(spark, f"{tmp_path}/c.json", "data struct<scopes: array<struct<name: string, total: int, files: array<struct<name: string, distance: double>>>>>", "data.scopes")
    assert found.select("name", "total", F.col("files")[0]["name"]).collect()[0] == ("x", 2, "f")


def test_files_move_when_done(spark, tmp_path):
    box, done, out = tmp_path / "in", tmp_path / "done", str(tmp_path / "out")
    box.mkdir()

    def handle(batch, _):
        inbox.outcomes(batch, F.col("length") > 3).write.mode("append").parquet(out)

    for i in range(4):
        (box / f"{i}.txt").write_text("x" * (i + 1))
        inbox.process(inbox.incoming(spark, str(box), archive=str(done)), handle, str(tmp_path / "check"), None).awaitTermination(120)
    assert sorted(r.folder for r in spark.read.parquet(out).collect()) == ["done", "failed", "failed", "failed"]
    assert len(list(done.rglob("*.txt"))) >= 1


def test_subtitles_with_accents_and_odd_ends(spark):
    body = "words of it " * 7
    texts = ["1. Capo Primo", f"2. {body}", "more", "Leouieren\u00e7", "lost", f"3. {body}", "Not a subtitle\u2028", "Nor\u000bthis one"]
    blocks = spark.createDataFrame([(d, i, t) for d in (None, 1) for i, t in enumerate(texts)], "doc_id long, seq int, text string")
    kept = document_parsers.without_index(blocks).orderBy("doc_id", "number").collect()
    body = body.strip()
    parts = [(2, "1. Capo Primo", None, "2.", f"{body} more"), (4, "1. Capo Primo", "Leouieren\u00e7", "3.", f"{body} Not a subtitle\u2028 Nor\u000bthis one")]
    assert [tuple(r) for r in kept] == [(d, *p) for d in (None, 1) for p in parts]


def test_renamed_ids_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab1") for _ in range(n)) for n in (0, 3, 10, 11, 17, 20, 21, 30, 31, 34, 41, 52) for _ in range(4)]

    def edited(word: str) -> str:
        for _ in range(rng.randrange(7)):
            i = rng.randrange(len(word) + 1)
            word = word[:i] + rng.choice(("", "a", "b", "1")) + word[i + rng.randrange(2) :]
        return word

    left = spark.createDataFrame([(i % 3, w) for i, w in enumerate(words + words[:20])], "g int, a string")
    right = spark.createDataFrame([(i % 3, f"b{i:04}", edited(w).upper()) for _ in range(4) for i, w in enumerate(words + words[:20])], "g int, b string, id string")
    distance = F.levenshtein("a", F.lower("id"))
    pairs = left.join(right, "g").withColumn("distance", distance).where((F.col("distance") == 0) | (10 * F.col("distance") < F.length("a")))
    expected = {r["a"]: (r["m"]["distance"], r["m"]["b"]) for r in pairs.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m")).collect()}
    got = {r["a"]: (r["distance"], r["b"]) for r in matching.renamed(left, right, "g").collect()}
    assert got == expected and {d for d, _ in got.values()} >= {0, 1, 2, 3}


def test_common_openings_of_names(spark):
    names = spark.range(4000).select(F.format_string("dir/EXT_Customer#%09d", "id").alias("name"))
    catalog = spark.range(1, 4000, 2).select(F.format_string("Customer#%09d", "id").alias("known"), F.col("id").cast("string").alias("hash"))
    looked = matching.name_lookup(names, catalog.union(spark.createDataFrame([("a/omer#00000000", "x")], "known string, hash string")))
    assert looked.where("hash is null").count() == 1995 and looked.where("rule = 2").count() == 2000 and looked.where("hash = 'x'").count() == 5
    # names that share their openings may not meet pair by pair
    assert "contains(" not in looked._jdf.queryExecution().optimizedPlan().toString().lower()


def test_names_are_not_broadcast(spark):
    names = spark.createDataFrame([("dir/EXT_Customer#000000001",), ("b/Customer#0000000023",)], "name string")
    looked = matching.name_lookup(names, spark.createDataFrame([("Customer#000000001", "x"), ("a/omer#000000002", "y")], "known string, hash string"))
    assert {(r["name"][:1], r["hash"], r["rule"]) for r in looked.collect()} == {("d", "x", 2), ("b", "y", 4)}
    # estimates take the smallness of compressed files for that of their names: whatever they say, the driver gets none
    assert "Broadcast" not in looked._jdf.queryExecution().executedPlan().toString()
