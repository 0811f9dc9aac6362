"""Report files from a document's rows: CSV with Spark, PDF and workbook from the rows of one report.

A report is one user's month, so its rows are few; the writers for PDF and workbook take them as a list (``files`` runs them on executors, for all reports at once).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources import objects

Row = tuple[str, list[str]]  # kind, cells
# Fixed values of the report files: page and fonts of a PDF (font, size), sizes of a workbook's bold fonts.
PAGE_HEIGHT, PAGE_WIDTH, MARGIN, LINE_HEIGHT = 842, 595, 50, 15
FONTS = {"title": (2, 16), "section": (2, 12), "row": (1, 10)}
BOLD = {"title": 14, "section": 11, "header": 10}


def write_csv(lines: DataFrame, path: str) -> None:
    """All reports' lines as text files, one folder a job, each in order."""
    ordered = lines.repartition("job_id").sortWithinPartitions("job_id", "line_no")
    ordered.select("job_id", "line").write.mode("overwrite").partitionBy("job_id").text(path)


def rows_of(document: DataFrame, job_id: int) -> list[Row]:
    rows = document.filter(f"job_id = {int(job_id)}").orderBy("section", "row").select("kind", "cells")
    return [(r.kind, list(r.cells)) for r in rows.toLocalIterator()]


def text_line(kind: str, cells: list[str]) -> str:
    return f"{cells[0]}: {cells[1]}" if kind == "meta" else " | ".join(cells)


def pdf(rows: list[Row]) -> bytes:
    """A4 pages of lines in standard fonts, titles larger and bold; characters outside Latin-1 are shown as question marks."""
    per_page = (PAGE_HEIGHT - 2 * MARGIN) // LINE_HEIGHT + 1  # the last line may stand on the margin
    lines = [(*FONTS.get(kind, FONTS["row"]), text_line(kind, cells)) for kind, cells in rows] or [(*FONTS["row"], "")]
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)]
    face = b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>"
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", face % b"Helvetica", face % b"Helvetica-Bold"]
    kids = []
    for page in pages:
        shown = []
        for font, size, line in page:
            text = line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            shown.append(f"/F{font} {size} Tf (".encode() + text + b") Tj T*")
        stream = f"BT {LINE_HEIGHT} TL {MARGIN} {PAGE_HEIGHT - MARGIN} Td\n".encode() + b"\n".join(shown) + b"\nET"
        kids.append(len(objects) + 1)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE_WIDTH} {PAGE_HEIGHT}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {len(objects) + 2} 0 R >>".encode())
        objects.append(f"<< /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream")
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for i, body in enumerate(objects, 1):
        places.append(out.tell())
        out.write(f"{i} 0 obj\n".encode() + body + b"\nendobj\n")
    start = out.tell()
    out.write(f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places))
    out.write(f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())
    return out.getvalue()


def column_name(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def column_widths(rows: list[Row]) -> str:
    """Columns of the sheet, two at least, by the longest text in each; larger letters count for more."""
    width = [0.0] * max([2, *(len(cells) for _, cells in rows)])
    for kind, cells in rows:
        for k, v in enumerate(cells):
            width[k] = max(width[k], len(v) * BOLD.get(kind, 11) / 11)
    return "".join(f'<col min="{k}" max="{k}" width="{min(w + 2, 255):.2f}" bestFit="1" customWidth="1"/>' for k, w in enumerate(width, 1))


def workbook(rows: list[Row]) -> bytes:
    """One sheet of text cells; titles and headers in bold, columns as wide as their longest text."""
    cells = []
    styles = {kind: f' s="{k}"' for k, kind in enumerate(BOLD, 1)}
    for r, (kind, values) in enumerate(rows, 1):
        style = styles.get(kind, "")
        each = "".join(f'<c r="{column_name(k)}{r}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(v)}</t></is></c>' for k, v in enumerate(values) if v)
        cells.append(f'<row r="{r}">{each}</row>')
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{rels}"><sheets><sheet name="Report" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rels}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rels}/styles" Target="styles.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}"><cols>{column_widths(rows)}</cols><sheetData>{"".join(cells)}</sheetData></worksheet>',
    }
    fonts = "".join(f'<font><b/><sz val="{size}"/><name val="Calibri"/></font>' for size in BOLD.values())
    formats = "".join(f'<xf fontId="{k}" applyFont="1"/>' for k in range(1, len(BOLD) + 1))
    files["xl/styles.xml"] = (
        f'<styleSheet xmlns="{space}"><fonts count="{len(BOLD) + 1}"><font><sz val="11"/><name val="Calibri"/></font>{fonts}</fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
        f'<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(BOLD) + 1}"><xf/>{formats}</cellXfs></styleSheet>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
    return out.getvalue()


def csv(rows: list[Row]) -> bytes:
    """Lines of one report: the title as it is, cells quoted where they must be, an empty line after the metadata and after each section."""

    def cell(v: str) -> str:
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v

    return "".join((cells[0] if kind in ("title", "section", "message", "blank") else ",".join(map(cell, cells))) + "\n" for kind, cells in rows).encode()


def sheet_width(document: DataFrame) -> DataFrame:
    """(job_id, width): the most cells that a row of each report has, two at least."""
    return document.groupBy("job_id").agg(F.greatest(F.lit(2), F.max(F.size("cells"))).alias("width"))


RENDERERS = {"CSV": csv, "PDF": pdf, "XLSX": workbook}


def render(document: DataFrame, job_id: int, form: str) -> bytes:
    """The file of one job's report in a format of ``RENDERERS``."""
    if form not in RENDERERS:
        raise ValueError(f"no generator for format {form}")
    return RENDERERS[form](rows_of(document, job_id))


def files(document: DataFrame, wanted: DataFrame) -> DataFrame:
    """(job_id, report_format, content, error) of all ``wanted`` files (job_id, report_format), made where their rows are.

    The rows of a file meet in one task, for a file is one value; reports are of one user's month.
    """

    def one(key: tuple, group: pa.Table) -> pa.Table:
        job, form = (k.as_py() for k in key)
        group = group.sort_by([("section", "ascending"), ("row", "ascending")])
        content, error = None, None
        try:
            if form not in RENDERERS:
                raise ValueError(f"no generator for format {form}")
            content = RENDERERS[form](list(zip(group.column("kind").to_pylist(), group.column("cells").to_pylist(), strict=True)))
        except Exception as e:
            error = str(e)
        return pa.table({"job_id": pa.array([job], pa.int64()), "report_format": pa.array([form], pa.string()), "content": pa.array([content], pa.binary()), "error": pa.array([error], pa.string())})

    rows = document.join(wanted.select("job_id", "report_format"), "job_id")
    return rows.groupBy("job_id", "report_format").applyInArrow(one, "job_id long, report_format string, content binary, error string")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files in a folder and those below it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw_text): each text file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_text"))


def attempted(recognise: Callable[[bytes], str], content: bytes) -> tuple[str | None, str | None]:
    """The text, or what was raised instead."""
    try:
        return recognise(content), None
    except Exception as e:
        return None, str(e)


def recognised(objects: DataFrame, recognise: Callable[[bytes], str]) -> DataFrame:
    """(path, raw_text, error) by a text recogniser; ``bytes.decode`` takes files that are text already. What it raises becomes the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for content in batch.column("content").to_pylist():
                text, error = attempted(recognise, content)
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "raw_text": pa.array(texts, pa.string()), "error": pa.array(errors, pa.string())})

    return objects.select("path", "content").mapInArrow(run, "path string, raw_text string, error string")


def recognised_objects(keys: DataFrame, path: str, recognise: Callable[[bytes], str]) -> DataFrame:
    """(id, there, raw_text, error) of the objects of ``keys`` (id, s3_key): whether there is one, and its text as ``recognised`` has it.

    Executors open the objects that are asked for, one at a time; what else lies in the folder is not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = objects.opened(path)
        for batch in batches:
            there, texts, errors = [], [], []
            for key in batch.column("s3_key").to_pylist():
                content = objects.read(store, root, key)
                text, error = (None, None) if content is None else attempted(recognise, content)
                there.append(content is not None)
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "there": pa.array(there, pa.bool_()), "raw_text": pa.array(texts, pa.string()), "error": pa.array(errors, pa.string())})

    return objects.spread(keys.select("id", "s3_key"), "id").mapInArrow(run, "id long, there boolean, raw_text string, error string")
