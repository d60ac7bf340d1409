"""The registered queries against their SQL, and their columns."""

import sys
from pathlib import Path

import pytest

from lexgrove.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from test_catalog import DATA, counted, database  # noqa: E402, F401

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, database, name):  # noqa: F811
    assert counted(queries.queries()[name](spark, DATA).toPandas()) == counted(database.sql(queries.oracle_sql()[name]).df())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


COLUMNS = {
    "op2_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op4_approximate_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op5_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op7_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op8_secret_scans": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op9_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op10_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert dict(queries.queries()[name](spark, DATA).dtypes) == COLUMNS[name]
