"""Writers: JSON stages, and workbooks for small results."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexgrove.functions.text import without_controls

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def stage(df: DataFrame, path: str) -> None:
    """Parquet for the next stage and JSON beside it."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").json(f"{path}/json")


def merged(parsed: DataFrame, enriched: DataFrame, key: list[str]) -> DataFrame:
    """A parser's parts with the columns that enrichment added; parts that weren't enriched have null there. Enriched values win."""
    own = [c for c in enriched.columns if c not in key]
    joined = parsed.join(enriched.select(*key, *(F.col(c).alias(f"_{c}") for c in own)), key, "left")
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in own else F.col(c) for c in parsed.columns]
    return joined.select(*kept, *(F.col(f"_{c}").alias(c) for c in own if c not in parsed.columns))


def publish(df: DataFrame, folder: str, name: str, hash_: str) -> None:
    """A result under its hash and under its plain name, as JSON, and a row of the map from one to the other."""
    for at in dict.fromkeys((hash_, name)):
        df.write.mode("overwrite").json(f"{folder}/{at}.json")
    names = df.sparkSession.createDataFrame([(hash_, name)], "hash string, name string")
    names.write.mode("append").parquet(f"{folder}/names")


def printable(df: DataFrame) -> DataFrame:
    """Strings without control characters."""
    return df.select(*(without_controls(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema.fields))


def _column(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook(df: DataFrame, path: str, sheet: str = "Sheet1", most: int = 1_000_000) -> int:
    """Write a result that fits a sheet to a local workbook, row by row; more rows than `most` are an error. Gives the rows written."""
    names = df.columns
    cell = lambda r, c, v: f'<c r="{_column(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    line = lambda r, values: f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(values, 1)) + "</row>"
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<worksheet xmlns="{_NS}"><sheetData>{line(1, names)}'.encode())
            for row in printable(df).toLocalIterator(prefetchPartitions=True):
                n += 1
                if n > most:
                    raise ValueError(f"more than {most} rows don't fit a sheet")
                out.write(line(n + 1, row).encode())
            out.write(b"</sheetData></worksheet>")
    return n
