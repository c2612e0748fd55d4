"""Records from files and from columns of XML, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.plans.schema import Record


def detect_format(doc: Column) -> Column:
    """xml, json or null, by the first character that is no white space."""
    first = F.substr(F.ltrim(doc, F.lit(" \t\r\n﻿")), F.lit(1), F.lit(1))
    return F.when(first == "<", "xml").when(first.isin("{", "["), "json")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and document of each file; one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("document"))


def _options(tag: str) -> dict[str, str]:
    return {"rowTag": tag, "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}


def _typed(raw: DataFrame, record: Record) -> DataFrame:
    whole = F.struct(*raw.columns)
    return raw.select(record.typed(whole).alias("record"), record.violations(whole).alias("errors"))


def read_records(spark: SparkSession, path: str, record: Record, tag: str | None = None) -> DataFrame:
    """record and errors of each element of the tag (by default the record's name); a file is split between tasks at its records."""
    return _typed(spark.read.format("xml").options(**_options(tag or record.name)).schema(record.read_schema()).load(path), record)


def stream_records(spark: SparkSession, path: str, record: Record, tag: str | None = None) -> DataFrame:
    """The same for files as they arrive."""
    return _typed(spark.readStream.format("xml").options(**_options(tag or record.name)).schema(record.read_schema()).load(path), record)


def split_records(df: DataFrame, xml: str, record: Record, tag: str | None = None) -> DataFrame:
    """A row for each element of the tag right below the root of each document, with record, errors and position from 0."""
    tag = tag or record.name
    outer = f"STRUCT<`{tag}`: ARRAY<{record.read_schema().simpleString()}>>"
    options = {k: v for k, v in _options(tag).items() if k != "rowTag"}
    rows = df.select("*", F.posexplode(F.from_xml(F.col(xml), outer, options).getField(tag)).alias("position", "__raw"))
    return rows.withColumns({"record": record.typed(F.col("__raw")), "errors": record.violations(F.col("__raw"))}).drop("__raw", xml)


def within_bytes(df: DataFrame, xml: str, limit: int = 16 << 20) -> DataFrame:
    """Documents of at most so many bytes without a document type declaration before the root."""
    declared = F.regexp_like(xml, F.lit(r"(?s)\A\x{FEFF}?(?:\s+|<\?.*?\?>|<!--.*?-->)*<!DOCTYPE"))
    return df.filter((F.octet_length(xml) <= limit) & ~declared)


def write_records(df: DataFrame, path: str, root: str, row: str) -> None:
    """XML files of rows, each file with the root around its rows; tasks write on their own, a row at a time."""
    df.write.format("xml").option("rootTag", root).option("rowTag", row).option("declaration", "").save(path)
