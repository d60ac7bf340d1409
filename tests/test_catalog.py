"""Every registered query with SQL gives the rows of that SQL."""

import math
import re
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest

from lexgrove.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the tables aren't here")


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    value = value.item() if hasattr(value, "item") else value
    return round(value, 7) if isinstance(value, float) else value


def counted(frame):
    columns = sorted(frame.columns)
    return columns, Counter(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def database():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, database, name):
    assert counted(catalog.queries()[name](spark, DATA).toPandas()) == counted(database.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_complexity_of_all_texts(spark, tmp_path):
    texts = ["NATO 2020. x\n", "ÉTATS ETATÉ UE é UE", "AB\tCD\rEF 12345", "ABc xAB AB_C A1B UE2", "", None, "niño AÑO ES. 2021\n\nfin", "x" * 50]
    given = pd.read_parquet(f"{DATA}/documents.parquet", columns=["doc_id", "text"])
    rows = [*((10**9 + i, t) for i, t in enumerate(texts)), *((int(i), t if isinstance(t, str) else None) for i, t in given.itertuples(index=False))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["content_complexity"](spark, str(tmp_path)).collect()
    plain_form = lambda t: None if t is None else len(re.findall(r"\b[A-Z]{2,}\b|\d{4,}", t)) / max(t.count(".") + t.count("\n"), 1)
    assert Counter(map(tuple, got)) == Counter((i, plain_form(t)) for i, t in rows)
