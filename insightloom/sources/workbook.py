"""Spreadsheet files (xlsx) for surveys and result tables.

A spreadsheet is for people: what is written is bounded, and more rows are an
error that points to the other formats.  Files are read in parallel, each by the
task that Spark gives it to, from whatever store Spark reads.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: Rows of a sheet that are written at most.
MOST_ROWS = 20_000

# Sheet names and columns of a survey.
SURVEY, METADATA = "Survey", "Metadata"
SURVEY_COLUMNS = ("Rule Candidate", "Rule Corrected", "Correct Relation", "Correct Action", "Correct Quantifier")

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and v not in (float("inf"), float("-inf")):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub("", str(v)))}</t></is></c>'


def to_bytes(sheets: dict[str, list[tuple]]) -> bytes:
    """An xlsx file of sheets, each a list of rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{y}">' + "".join(_cell(f"{_letters(x)}{y}", v) for x, v in enumerate(row)) + "</row>" for y, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def from_bytes(raw: bytes):
    """(sheet, row number from 1, cells as text) of an xlsx file."""
    ns = {"m": _MAIN}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_MAIN}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns):
            target = links[sheet.get(f"{{{_REL}}}id")]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for y, row in enumerate(ElementTree.fromstring(z.read(part)).iter(f"{{{_MAIN}}}row"), 1):
                cells: list = []
                for x, c in enumerate(row):
                    at = _column(c.get("r")) if c.get("r") else x
                    cells += [None] * (at + 1 - len(cells))
                    v = c.find("m:v", ns)
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t"))
                    elif v is not None:
                        cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield sheet.get("name"), int(row.get("r") or y), cells


def write_workbook(sheets: dict[str, DataFrame], path: str, most_rows: int = MOST_ROWS) -> None:
    """One xlsx file, a sheet for each table, headed by its column names."""
    spark = next(iter(sheets.values())).sparkSession
    content = {}
    for name, df in sheets.items():
        rows = df.take(most_rows + 1)
        if len(rows) > most_rows:
            raise ValueError(f"sheet {name} has over {most_rows} rows: write it as csv")
        content[name] = [tuple(df.columns), *map(tuple, rows)]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    out.write(bytearray(to_bytes(content)))
    out.close()


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, sheet, row, cells) of xlsx files; cells are texts."""

    def run(batches):
        for b in batches:
            rows = [(p, *x) for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for x in from_bytes(raw) if sheet is None or x[0] == sheet]
            p, s, r, c = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(s, pa.string()), pa.array(r, pa.int32()), pa.array(c, pa.list_(pa.string()))], names=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sheet string, row int, cells array<string>")


def write_survey(rules: DataFrame, path: str, version: str = "v3", additional: str = "") -> None:
    """Rules, in the order of condition, parameter and range, as a survey for
    experts: candidates beside empty columns for corrections, and a sheet that
    names the text format."""
    sentence = tx.rule_text() if version == "v3" else tx.rule_text_old()
    none = F.lit(None).cast("string")
    sheet = rules.orderBy("condition", "parameter", "cond_lo").select(sentence.alias(SURVEY_COLUMNS[0]), *(none.alias(c) for c in SURVEY_COLUMNS[1:]))
    about = rules.sparkSession.range(1).select(F.lit(version).alias("Version"), F.current_timestamp().cast("string").alias("Date"), F.lit(additional).alias("Additional Data"))
    write_workbook({SURVEY: sheet, METADATA: about}, path)


def read_survey(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """Rules of survey files: from ``column``, or corrections where there are
    some, else the candidates.  Either text format is understood."""
    cells = read_workbook(spark, path, SURVEY)
    head = cells.where("row = 1").select("path", F.col("cells").alias("names"))
    rows = cells.where("row > 1").join(head, "path")
    of = lambda name: F.nullif(F.trim(F.get("cells", F.array_position("names", name).cast("int") - 1)), F.lit(""))
    text = of(column) if column else F.coalesce(of(SURVEY_COLUMNS[1]), of(SURVEY_COLUMNS[0]))
    return rows.where(text.isNotNull()).select("path", "row", tx.parse_rule(text).alias("r")).select("path", "row", "r.*")
