"""Parsers and fuzzy functions on small texts."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import fuzzy
from lexgrove.operators import lines, parsers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def docs(spark, *texts):
    return lines.lines_of(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string"))


def test_common_subsequence():
    def plain(a, b):
        return max(len(s) for n in range(len(a) + 1) for s in itertools.combinations(a, n) if all(c in it for it in [iter(b)] for c in s))

    for a, b in [("", "x"), ("deve", "devono"), ("abcbdab", "bdcaba"), ("aaa", "aa")]:
        assert fuzzy.common(a, b) == plain(a, b)
    assert fuzzy.ratio("deve", "dev") == pytest.approx(600 / 7) and fuzzy.partial_ratio("bcd", "xxbcdxx") == 100


def test_fuzzy_columns(spark):
    df = spark.createDataFrame([("devve pagare",), ("entro il 3",), (None,)], "t string")
    assert [r[0] for r in df.select(fuzzy.fuzzy_pattern_class(F.col("t"))).collect()] == ["Obbligo", "Termine temporale", "altro"]
    assert df.select(fuzzy.fuzzy_ratio("t", "t")).first()[0] == 100
    assert spark.createDataFrame([("é",)], "t string").select(F.length(fuzzy.normal_form("t"))).first()[0] == 1


@pytest.mark.parametrize(("text", "expected"), [('{"a": 1}', {"a": 1}), ('x ```json\n[1, 2]\n``` y', [1, 2]), ("so: {'a': None}", {"a": None}), ('say "uno" and "due"', ["uno", "due"]), ("- x\n- y z\n", ["x", "y z"]), ("?", {"error": "no JSON found", "raw": "?"}), (None, {"error": "no JSON found", "raw": ""})])
def test_tolerant_json(spark, text, expected):
    assert json.loads(spark.createDataFrame([(text,)], "t string").select(fuzzy.tolerant_json("t")).first()[0]) == expected


def test_regulation(spark):
    text = "intro\nArticolo 1\nOggetto\nuno\ndue\nArticolo 7\nnon un articolo\nArticolo 2\nAmbito\ntre\nArticolo 2 bis\nAltro\nquattro"
    got = rows(parsers.regulation(docs(spark, text)), "segment")
    assert [r[2:] for r in got] == [(1, "", "Oggetto", "uno\ndue\nArticolo 7\nnon un articolo"), (2, "", "Ambito", "tre"), (2, "bis", "Altro", "quattro")]


def test_gazette(spark):
    got = rows(parsers.gazette(docs(spark, "IL CONSIGLIO\nvisto\n(1) primo\nsegue\n(2) secondo\nArticolo 1\ntesto\n(3) non recital\nALLEGATO I\ntabella")), "part")
    assert [r[2:] for r in got] == [
        ("preamble", None, "IL CONSIGLIO\nvisto"), ("recital", "1", "primo\nsegue"), ("recital", "2", "secondo"), ("article", "Articolo 1", "testo\n(3) non recital"), ("annex", "ALLEGATO I", "tabella"),
    ]


def test_provisions(spark):
    got = rows(parsers.provisions(docs(spark, "MINISTERIO DE HACIENDA\n1234 Real Decreto 5/2020\nsobre algo\nmas\nMINISTERIO DE DEFENSA\n1235 Orden 3\nx")), "number")
    assert got == [(1, "MINISTERIO DE HACIENDA", "1234", "REAL DECRETO", "Real Decreto 5/2020\nsobre algo\nmas"), (1, "MINISTERIO DE DEFENSA", "1235", "ORDEN", "Orden 3\nx")]


def test_annex_items(spark):
    table = [(1, 0, "I", "a", "uno"), (1, 1, "", None, "segue"), (1, 2, None, "b", "due"), (1, 3, "II", "c", "tre")]
    got = rows(parsers.annex_items(spark.createDataFrame(table, "doc_id long, seq int, section_num string, sub_item string, text string")), "sub_item")
    assert got == [(1, "I", "a", "uno segue"), (1, "I", "b", "due"), (1, "II", "c", "tre")]
    header = spark.createDataFrame([(["Sezione", " Requisito ", "x"],)], "c array<string>")
    assert header.select(parsers.header_mapping(F.col("c"), ["requisito", "sezione", "altro"])).first()[0] == {"requisito": 2, "sezione": 1}


def test_best_pages(spark):
    pages = spark.createDataFrame([(1, 1, "Il fornitore comunica ogni variazione"), (1, 2, "La banca conserva i documenti per dieci anni"), (1, 3, "zzz")], "doc_id long, page int, text string")
    wanted = spark.createDataFrame([(1, "banca conserva i documenti"), (1, "1234567890 qqqqqqqqq")], "doc_id long, requirement string")
    assert dict((r[1], r[2]) for r in rows(parsers.best_pages(wanted, pages))) == {"banca conserva i documenti": "2", "1234567890 qqqqqqqqq": "N/A"}


def test_derived_files_and_novelty(spark):
    catalog = spark.createDataFrame([("a.json",), ("a_vs_b.json",), ("b_vs_c.json",), ("c.xlsx",)], "name string")
    assert rows(parsers.derived_files(catalog, spark.createDataFrame([("b",), ("b",)], "hash string")), "name") == [("a_vs_b.json",), ("b_vs_c.json",)]
    df = spark.createDataFrame([("old text", "deve new"), ("", "")], "o string, n string")
    assert [round(r[0], 4) for r in df.select(parsers.novelty(F.col("o"), F.col("n"), ["deve", "new"])).collect()] == [round(4 / 15 * 0.7, 4), 0.0]
