"""Readers and writers of files: CSV with a byte-order mark and quoted line ends, JSON bills, text collections.

Bad rows and files are kept as rows with an ``_error``, never dropped; missing columns become null.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All columns as strings, by the file's own header; a byte-order mark is no part of the first name.

    With ``columns`` the result has exactly these, in this order, null where the file lacks one.
    """
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df if columns is None else df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """The columns in order, blank where the table lacks one."""
    out = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Records with their file name; one that can't be read has ``_error`` set to its text and null fields."""
    wanted = T.StructType([*schema.fields, T.StructField("_error", T.StringType())])
    df = spark.read.schema(wanted).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_error").json(path)
    return df.withColumn("file_name", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def strip_keys(df: DataFrame, prefix: str = "_", keep: Sequence[str] = ()) -> DataFrame:
    """Without the columns that begin with ``prefix``."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix) and c not in keep])


def write_dual_json(df: DataFrame, full_path: str, stripped_path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(full_path)
    strip_keys(df).write.mode(mode).json(stripped_path)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook_lines(content: bytes, separator: str = " | ") -> list[str]:
    """The rows of all sheets of a workbook, in the sheets' order: cells that hold something, joined; blank rows left out.

    Texts, shared or in place, numbers, truth values and results of formulas are shown as they are stored.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(_SHEET + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_SHEET + "si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        lines = []
        for name in sheets:
            for row in ElementTree.fromstring(z.read(name)).iter(_SHEET + "row"):
                cells = []
                for c in row.iter(_SHEET + "c"):
                    v = c.find(_SHEET + "v")
                    kind = c.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(_SHEET + "t"))
                    elif v is None or v.text is None:
                        text = ""
                    elif kind == "s":
                        text = shared[int(v.text)]
                    else:
                        text = {"0": "False", "1": "True"}.get(v.text, v.text) if kind == "b" else v.text
                    if text.strip():
                        cells.append(text.strip())
                if cells:
                    lines.append(separator.join(cells))
    return lines


def _workbooks(contents: pd.Series) -> pd.DataFrame:
    out = []
    for x in contents:
        try:
            out.append((None, None) if x is None else ("\n".join(workbook_lines(x)), None))
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as e:
            out.append((None, f"unreadable: {type(e).__name__}"))
    return pd.DataFrame(out, columns=["text", "error"])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, kind, text, _error) of the files of a folder by their suffix: plain texts and the rows of workbooks.

    Other files are listed without a text, files of no bytes not at all; a file that can't be read has an ``_error`` and stops no other.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    kind = F.when(suffix.isin("txt", "md"), "text").when(suffix == "xlsx", "workbook").when(suffix.isin("png", "jpg", "jpeg", "heic"), "image").otherwise("other")
    plain = F.when(kind == "text", F.try_validate_utf8(F.decode("content", "utf-8")))
    rows = files.select(name.alias("source"), kind.alias("kind"), plain.alias("plain"), F.pandas_udf(_workbooks, "struct<text:string,error:string>")(F.when(kind == "workbook", F.col("content"))).alias("book"))
    bad = F.coalesce("book.error", F.when((F.col("kind") == "text") & F.col("plain").isNull(), "unreadable"))
    return rows.select("source", "kind", F.coalesce("plain", "book.text").alias("text"), bad.alias("_error"))


def index_folder(spark: SparkSession, folder: str, target: str, size: int = 500, overlap: int = 50, reset: bool = False) -> DataFrame:
    """Indexes the texts of a folder as chunks in the Parquet table ``target``, partitioned by source; returns what was
    done of each file (source, kind, n_chunks, _error).

    A file that was indexed before replaces its chunks and leaves those of other files alone; with ``reset`` the whole
    table is made anew. Files without a text give no chunks and keep what is there.
    """
    from billspark.operators import search

    files = read_texts(spark, folder)
    chunked = search.chunks(files.where("text is not null"), key="source", size=size, overlap=overlap)
    if reset and path_exists(spark, target):
        p = spark._jvm.org.apache.hadoop.fs.Path(target)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    chunked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(target)
    n = chunked.groupBy("source").agg(F.count("*").alias("n_chunks"))
    return files.join(n, "source", "left").select("source", "kind", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "_error")


def pair_records(records: DataFrame, documents: DataFrame, items: str = "summary_of_services.line_items") -> DataFrame:
    """Records (with file_name) that have line items, each with the document of the same name before its suffix, if any.

    ``documents`` has a column ``source`` of file names; several of one stem give the first by name.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    own = records.where(F.size(F.coalesce(F.col(items), F.array())) > 0).withColumn("_stem", stem(F.col("file_name")))
    found = documents.groupBy(stem(F.col("source")).alias("_stem")).agg(F.min("source").alias("document"))
    return own.join(found, "_stem", "left").drop("_stem")


def first_existing(wanted: DataFrame, catalog: DataFrame, name: str = "name", priority: str = "priority", path: str = "path") -> DataFrame:
    """Each wanted name with the path of the first folder, by priority, that has it; null where none has."""
    best = catalog.groupBy(name).agg(F.min_by(path, F.col(priority)).alias(path))
    return wanted.join(best, name, "left")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the Parquet table at ``path`` doesn't hold yet; returns how many. Safe to repeat.

    Only the key column of the table is read. Rows are computed once, and counted as they are written. A table that
    is there but can't be read is an error, never taken for none.
    """
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    if path_exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    written = Observation()
    fresh.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return written.get["n"]
