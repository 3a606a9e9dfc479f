"""Readers of uploaded files: CSV, sheet folders and JSON records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset.functions.scalars import sheet_label
from gleanset.session import settle
from gleanset.sources.delimited import location, read_files, survey

def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, source: str | None = None) -> DataFrame:
    """All columns as text: rules work on text and types are semantic.

    Every file below ``path`` has its own delimiter, unless one is given, and
    header; columns of different files meet by name. Quoted cells may hold line
    breaks and delimiters, and large files are read by many tasks all the same
    (``sources/delimited.py``). Empty files and blank lines are passed over, cells
    missing at the end of a row are NULL, cells beyond the header are left out.
    ``source`` names a column with the file's path. Without a file that has a
    header there are no columns.
    """
    files = survey(spark, path, delimiter)
    return read_files(spark, files, source) if files else spark.createDataFrame([], T.StructType([]))


def with_row_id(df: DataFrame, name: str = "__row_id") -> DataFrame:
    """Number rows once; the ids are checkpointed so that every later use agrees."""
    return settle(df.withColumn(name, F.monotonically_increasing_id()))


def sheet_of(path: Column) -> Column:
    """The sheet of a part: the NAME of its folder ``sheet=NAME``, else its file name without the ending."""

    def decoded(text: Column) -> Column:
        return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))

    # Paths are encoded once as URIs, and names of folders once more.
    folder = decoded(F.regexp_extract(path, r"/sheet=([^/]+)/[^/]+$", 1))
    name = decoded(F.regexp_extract(path, "[^/]+$", 0))
    return F.when(folder != "", decoded(folder)).otherwise(F.regexp_replace(name, r"\.[A-Za-z]+$", ""))


def read_sheets(spark: SparkSession, path: str, form: str, book: str = "book") -> DataFrame:
    """A folder of parts as one workbook: every row knows its sheet; empty parts vanish.

    Sheets are sub-folders named ``sheet=NAME``, or files, each named as its
    sheet. Cells of CSV sheets may hold line breaks.
    """
    if form == "csv":
        rows = read_csv(spark, path, source="__path")
        if not rows.columns:
            return spark.createDataFrame([], "sheet string, sheet_label string")
    else:
        rows = spark.read.format(form).load(path)
        rows = rows.select(*[c for c in rows.columns if c != "sheet"], F.col("_metadata.file_path").alias("__path"))
    named = rows.withColumn("sheet", sheet_of(F.col("__path"))).drop("__path")
    return named.withColumn("sheet_label", sheet_label(F.lit(book), F.col("sheet")))


def json_forms(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """The files below ``path`` that hold one object per line (True) and the others that are not blank (False).

    A file's first line decides: an object that is complete in it begins a file
    of lines. The driver holds the names of files, as Spark's listing does.
    """
    schema = "path string, by_line boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            paths = batch.column("path")
            for row in range(batch.num_rows):
                file = paths[row].as_py()
                if file in seen:
                    continue
                seen.add(file)
                line = batch.column("value")[row].as_py().strip()
                try:
                    found = line.startswith("{") and isinstance(json.loads(line), dict)
                except ValueError:
                    found = False
                yield pa.RecordBatch.from_pydict({"path": [file], "by_line": [found]})

    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    heads = lines.filter((F.col("start") == 0) & (F.trim(F.replace("value", F.lit("\r"), F.lit(""))) != "")).select("value", "path")
    out: dict[bool, list[str]] = {True: [], False: []}
    for row in heads.mapInArrow(run, schema).toLocalIterator():
        out[row["by_line"]].append(location(row["path"]))
    return out


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An array of objects, or objects with a ``records`` array, as rows.

    A file is one array or one object over any number of lines, or one object
    per line. Files of lines are read in byte ranges by many tasks and each line
    is parsed once; an array or an object over several lines is one text. Text
    that is no such JSON raises: it must not become NULL rows.
    """
    inner = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    outer = T.StructType([*inner.fields, T.StructField("records", T.ArrayType(inner))])
    marked = T.StructType([*outer.fields, T.StructField("__broken", T.StringType())])
    forms = json_forms(spark, path)
    text, name = F.col("value"), F.col("_metadata.file_name")
    wrong = F.raise_error(F.concat(F.lit("no JSON in "), F.col("name")))
    parts = []
    if forms[True]:
        lines = spark.read.text(forms[True]).filter(F.trim(text) != "").select("value", name.alias("name"))
        parsed = lines.withColumn("o", F.from_json(text, marked, {"columnNameOfCorruptRecord": "__broken"}))
        # A value of another type also marks its line; only text that is no JSON at all raises.
        broken = F.col("o.__broken").isNotNull() & F.try_parse_json(text).isNull()
        parts.append(parsed.select(F.when(broken, wrong).otherwise(F.struct(*[F.col(f"o.`{f.name}`") for f in outer.fields])).alias("o")))
    if forms[False]:
        whole = spark.read.text(forms[False], wholetext=True).select("value", name.alias("name"))
        checked = F.when(F.try_parse_json(text).isNull(), wrong)
        objects = F.when(F.ltrim(text).startswith("["), F.from_json(text, T.ArrayType(outer))).otherwise(F.array(F.from_json(text, outer)))
        parts.append(whole.select(F.explode(F.coalesce(checked, objects)).alias("o")))
    if not parts:
        return spark.createDataFrame([], inner)
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    own = F.array(F.struct(*[F.col(f"o.`{f.name}`") for f in inner.fields]))
    return rows.select(F.inline(F.coalesce(F.col("o.records"), own)))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A stored table with the columns it has at run time."""
    table = spark.read.parquet(path)
    return table.select(*[c for c in columns or table.columns if c in table.columns])
