"""Text, PDF and DOCX exports of results and final pages, and versioned snapshots."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S


def batch_text(results: DataFrame) -> DataFrame:
    """(job_id, body): every file's text under its name, in file order."""
    r = results.groupBy("job_id", "file_index").agg(F.min("filename").alias("filename"), F.max(F.coalesce("extracted_text", F.lit(""))).alias("text"))
    part = S.template(K.BATCH_FILE, filename=F.coalesce("filename", F.lit("")), text=F.col("text"))
    rows = r.select("job_id", F.struct("file_index", part.alias("part")).alias("x"))
    return rows.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("body"))


def batch_parts(results: DataFrame) -> DataFrame:
    """(job_id, file_index, part): the pieces of ``batch_text`` unjoined, for jobs of any size."""
    r = results.groupBy("job_id", "file_index").agg(F.min("filename").alias("filename"), F.max(F.coalesce("extracted_text", F.lit(""))).alias("text"))
    return r.select("job_id", "file_index", S.template(K.BATCH_FILE, filename=F.coalesce("filename", F.lit("")), text=F.col("text")).alias("part"))


def page_file_name(name: Column, page_no: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("page")), F.lit("_"), page_no.cast("string"), F.lit(".txt"))


def pdf_bytes(pages: list[str], per_page: int = K.PDF_LINES_PER_PAGE) -> bytes:
    """A plain PDF: Courier 10, a new sheet for each page and each ``per_page`` lines."""
    sheets = []
    for p in pages or [""]:
        lines = (p or "").split("\n")
        sheets += [lines[i : i + per_page] for i in range(0, len(lines), per_page)]
    objs = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    kids = []
    for lines in sheets:
        esc = [x.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") for x in lines]
        body = ("BT /F1 10 Tf 28 785 Td 14.2 TL " + " ".join(f"({x}) Tj T*" for x in esc) + " ET").encode("cp1252", "replace")
        objs.append(b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream")
        objs.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objs))
        kids.append(len(objs))
    objs[1] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % k for k in kids) + b"] /Count %d >>" % len(kids)
    out, at = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for i, o in enumerate(objs, 1):
        at.append(out.tell())
        out.write(b"%d 0 obj\n" % i + o + b"\nendobj\n")
    start = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objs) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at))
    out.write(b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objs) + 1, start))
    return out.getvalue()


def docx_bytes(pages: list[str]) -> bytes:
    """A DOCX: one section per page, one paragraph per line, Courier New 10 point."""
    run = '<w:r><w:rPr><w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/><w:sz w:val="20"/></w:rPr><w:t xml:space="preserve">{}</w:t></w:r>'
    body = []
    for i, p in enumerate(pages or [""]):
        ps = [f"<w:p>{run.format(escape(x))}</w:p>" for x in (p or "").split("\n")]
        last = i == len(pages or [""]) - 1
        sect = '<w:sectPr><w:type w:val="nextPage"/></w:sectPr>'
        body.append("".join(ps) + (sect if last else f"<w:p><w:pPr>{sect}</w:pPr></w:p>"))
    doc = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(body)}</w:body></w:document>'
    types = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    rels = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", types)
        z.writestr("_rels/.rels", rels)
        z.writestr("word/document.xml", doc)
    return buf.getvalue()


def render_pages(page_lists: DataFrame, kind: str) -> DataFrame:
    """(job_id, content) of (job_id, pages) rows as ``pdf`` or ``docx`` bytes."""
    make = {"pdf": pdf_bytes, "docx": docx_bytes}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"job_id": pdf["job_id"], "content": [make(list(p) if p is not None else []) for p in pdf["pages"]]})

    return page_lists.select("job_id", "pages").mapInPandas(run, "job_id string, content binary")


def save_snapshot(df: DataFrame, folder: str, version: int) -> str:
    """Writes an immutable version; readers take the highest complete one."""
    path = f"{folder}/v={version:09d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().toString() for s in fs.listStatus(fs_path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath().toString() + "/_SUCCESS"))]
    return spark.read.parquet(max(done))
