"""Readers. Schemas are given, not inferred, unless a reader says otherwise."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill.functions import text as T


def csv(spark: SparkSession, path: str | list[str], schema: str, separator: str = ",", columns: list[str] | None = None) -> DataFrame:
    """Header CSV with quoted cells that may hold line breaks; only the wanted columns are read."""
    df = spark.read.csv(path, schema=schema, header=True, sep=separator, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return df.select(*columns) if columns else df


def bom_csv(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """CSV of texts whose header may begin with a byte order mark and hold outer blanks."""
    df = spark.read.csv(path, header=True, sep=separator, multiLine=True, quote='"', escape='"', inferSchema=False)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def csv_batches(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All CSV files of a pattern, with the file each row is from and its place in the file's order."""
    df = spark.read.csv(pattern, schema=schema, header=True, multiLine=True, quote='"', escape='"')
    return df.withColumn("source_file", F.col("_metadata.file_name")).withColumn("pos", F.monotonically_increasing_id())


def json_array(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """The ordered array ``field`` of one JSON document as rows with ``pos``."""
    df = spark.read.schema(f"{field} array<{element}>").json(path, multiLine=True)
    return df.select(F.posexplode(field).alias("pos", "x")).select("pos", "x.*")


CASES = "array<struct<case_id:bigint,case_title:string,case_topic:string,case_classification:string,points:array<struct<point_id:bigint,point_title:string,point_quote_text:string,point_source:string>>>>"


def service_points(spark: SparkSession, path: str) -> DataFrame:
    """(service, case, point) rows of nested service documents; services and cases without points give none."""
    df = spark.read.schema(f"service_id bigint, service_name string, cases {CASES}").json(path, multiLine=True)
    cases = df.select("service_id", "service_name", F.explode("cases").alias("c"))
    return cases.select("service_id", "service_name", *[f"c.{k}" for k in ("case_id", "case_title", "case_topic", "case_classification")], F.explode("c.points").alias("p")).select("*", "p.*").drop("p")


QA = "array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,is_impossible:boolean,answers:array<struct<text:string,answer_start:bigint>>>>>>>>"


def question_answers(spark: SparkSession, path: str) -> DataFrame:
    """(title, context, id, question, answer): the first answer, empty where there is none."""
    df = spark.read.schema(f"data {QA}").json(path, multiLine=True).select(F.explode("data").alias("d"))
    qas = df.select("d.title", F.explode("d.paragraphs").alias("p")).select("title", "p.context", F.explode("p.qas").alias("q"))
    none = F.coalesce(F.col("q.is_impossible"), F.lit(False)) | (F.coalesce(F.size("q.answers"), F.lit(0)) <= 0)
    return qas.select("title", "context", "q.id", "q.question", F.when(none, "").otherwise(F.col("q.answers")[0]["text"]).alias("answer"), T.category_of(F.col("q.id")).alias("category"))


def event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of a JSON-lines log with their ``line``, and (file, skipped): lines that hold no object.

    The line number orders events that share a seq: it is the row's place in its partition, after the
    partition's number, which grows along a file.
    """
    from clausemill.schemas import EVENT

    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    body = F.trim("value")
    told = lines.withColumn("ok", F.coalesce(body.startswith("{") & (F.get_json_object(body, "$").isNotNull()), F.lit(False)))
    told = told.withColumn("e", F.when(F.col("ok"), F.from_json(body, EVENT)))
    names = [x.split()[0] for x in EVENT.split(", ")]
    fields = [F.get_json_object("value", "$.data").alias("data") if n == "data" else F.col(f"e.{n}").alias(n) for n in names]
    events = told.where("ok").select(*fields, "line")
    return events, told.groupBy("file").agg(F.count_if(~F.col("ok")).alias("skipped"))


def whole_texts(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(path, text): whole files, bad bytes replaced, line ends normalised, stripped; other suffixes raise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = F.when(F.lower("path").endswith(suffix), T.line_ends(F.make_valid_utf8(F.col("content").cast("string"))))
    return files.select("path", F.coalesce(named, F.raise_error(F.concat(F.lit("not a text file: "), F.col("path")))).alias("text"))


def parallel_lines(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """Line-aligned files ``<platform>.<kind>`` as rows (platform, pos, kind columns); unequal lengths raise.

    Lines end at line feeds alone, so other line separators stay inside a line.
    """
    files = spark.read.text([f"{path}/*.{k}" for k in kinds], wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    body = F.regexp_replace("value", r"\n\z", "")
    rows = files.select(F.regexp_extract("file", r"^(.*)\.[^.]+$", 1).alias("platform"), F.regexp_extract("file", r"\.([^.]+)$", 1).alias("kind"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    wide = rows.groupBy("platform", "pos").pivot("kind", kinds).agg(F.first("line"))
    whole = F.lit(True)
    for k in kinds:
        whole = whole & F.col(k).isNotNull()
    checked = F.when(whole, F.col("platform")).otherwise(F.raise_error(F.concat(F.lit("files of unequal length: "), F.col("platform"))))
    return wide.select(checked.alias("platform"), "pos", *kinds)


def json_runs(spark: SparkSession, pattern: str, schema: str, held_out: bool = False) -> DataFrame:
    """One row a run file; runs that held a source out are left out unless asked for."""
    df = spark.read.schema(schema).json(pattern, multiLine=True)
    return df if held_out or "holdout_source" not in df.columns else df.where("holdout_source IS NULL")


def titles(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("pdf", "txt")) -> DataFrame:
    """(title, path): the stem of every file of the suffixes below a folder, the first path of each title."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    stem = F.regexp_extract("path", rf"([^/]+)\.(?i:{'|'.join(suffixes)})$", 1)
    return files.withColumn("title", stem).where("title != ''").groupBy("title").agg(F.min("path").alias("path"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_comments(spark: SparkSession, path: str) -> DataFrame:
    """(path, comment_id, author, comment, referenced_text, error) of all .docx files below a folder.

    A file that cannot be read gives one row with its error. Each file is read whole in one task.
    """

    def run(frames: Iterator) -> Iterator:
        import io
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        def text_of(node) -> str:
            return "".join(x.text or "" for x in node.iter(f"{_W}t"))

        def comments(content: bytes) -> list[tuple]:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if "word/comments.xml" not in z.namelist():
                    return []
                notes, body = (ElementTree.fromstring(z.read(f"word/{n}.xml")) for n in ("comments", "document"))
            open_: set[str] = set()
            spans: dict[str, list[str]] = {}
            for node in body.iter():
                key = node.get(f"{_W}id")
                if node.tag == f"{_W}commentRangeStart":
                    open_.add(key)
                elif node.tag == f"{_W}commentRangeEnd":
                    open_.discard(key)
                elif node.tag == f"{_W}t":
                    for k in open_:
                        spans.setdefault(k, []).append(node.text or "")
            return [(n.get(f"{_W}id"), n.get(f"{_W}author"), text_of(n), "".join(spans.get(n.get(f"{_W}id"), []))) for n in notes.iter(f"{_W}comment")]

        for pdf in frames:
            out = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(file, *c, None) for c in comments(content)]
                except Exception as e:  # the file's error is its row
                    out.append((file, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "comment_id", "author", "comment", "referenced_text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, comment_id string, author string, comment string, referenced_text string, error string")


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of PDF files; needs the library ``pypdf`` on the executors."""
    if importlib.util.find_spec("pypdf") is None:
        raise RuntimeError("reading PDF files needs the library pypdf")

    def run(frames: Iterator) -> Iterator:
        import io

        import pandas as pd
        import pypdf

        for pdf in frames:
            rows = [(f, i, p.extract_text()) for f, c in zip(pdf["path"], pdf["content"], strict=True) for i, p in enumerate(pypdf.PdfReader(io.BytesIO(c)).pages)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


def excel_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet of a workbook as texts, the first row its header; see ``workbook.workbook_sheet``."""
    from clausemill.sources.workbook import workbook_sheet

    return workbook_sheet(spark, path, sheet)


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The vector table: Parquet with an array column; a filter on a partition column is pruned."""
    return spark.read.parquet(path)


def forward_filled(df: DataFrame, columns: list[str], order: str, *keys: str) -> DataFrame:
    """Merged cells of a sheet: null cells take the last value above them."""
    above = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(above) for c in columns})
