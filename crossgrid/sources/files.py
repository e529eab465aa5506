"""Readers and writers of the panel's raw and finished files."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Parquet, with those of the columns that are there; filters and columns reach the scan."""
    rows = spark.read.parquet(path)
    if where:
        rows = rows.where(where)
    return rows.select(*(c for c in columns if c in rows.columns)) if columns else rows


def guarded_scan(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A large table, never without a filter."""
    if not (symbols or start or end):
        raise ValueError("a large table needs symbols, a start or an end")
    rows = spark.read.parquet(path)
    if symbols:
        rows = rows.where(F.col("symbol").isin(*symbols))
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    return rows.where(F.col("date") <= F.lit(end).cast("date")) if end else rows


def read_modern_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily files with a header: names and values trimmed, - as null."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="-")
    return rows.toDF(*(c.strip() for c in rows.columns))


def numeric(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns as doubles; what isn't a number is null."""
    return rows.withColumns({c: F.col(c).try_cast("double") for c in columns})


def of_series(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows of the trading series to keep (EQ unless others are named), case and blanks aside."""
    return rows.where(F.upper(F.trim("series")).isin(*(k.upper() for k in keep or ("EQ",))))


def read_sectors(spark: SparkSession, path: str) -> DataFrame:
    """symbol (upper case), isin, industry of a sector list with the columns Symbol, ISIN Code and Industry; names and values trimmed."""
    rows = read_modern_csv(spark, path)
    return rows.select(F.upper(F.trim("Symbol")).alias("symbol"), F.trim("ISIN Code").alias("isin"), F.trim("Industry").alias("industry"))


def read_index_members(spark: SparkSession, path: str) -> DataFrame:
    """Distinct symbols of lists in a column ``symbols`` (separated by commas): trimmed, upper case, no blanks beside an ampersand."""
    cells = read_modern_csv(spark, path).where("symbols IS NOT NULL").select(F.explode(F.split("symbols", ",")).alias("s"))
    return cells.select(F.regexp_replace(F.upper(F.trim("s")), " ?& ?", "&").alias("symbol")).where("symbol <> ''").distinct()


def read_zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """Zipped daily files: rows (file, line) of the first member of each, without its header; names of the header in ``fields``."""

    def lines(batches):
        for b in batches:
            out = []
            for name, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    text = z.read(z.namelist()[0]).decode("utf-8", "replace").splitlines()
                fields = [c.strip() for c in text[0].split(",")]
                out += [(name, fields, [c.strip() for c in line.split(",")]) for line in text[1:] if line.strip()]
            import pandas as pd

            yield pd.DataFrame(out, columns=["file", "fields", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "file string, fields array<string>, cells array<string>")


def by_name(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns of zipped files by their header names."""
    cells = F.map_from_arrays("fields", F.slice("cells", 1, F.size("fields")))
    return rows.select("file", *(F.trim(cells[c]).alias(c) for c in columns))


def write(rows: DataFrame, path: str, **options) -> None:
    rows.write.mode("overwrite").options(**options).parquet(path)


def replace_factor(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Overwrites the partitions of those factors that ``rows`` has, and no others."""
    rows.where("value IS NOT NULL").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("factor").parquet(path)


def write_cache(rows: DataFrame, path: str, columns: dict[str, str], sources: list[str]) -> dict:
    """A report table and its manifest: checked schema, status, sources and row count."""
    have = dict(rows.dtypes)
    missing = [c for c in columns if c not in have]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    write(rows.select(*columns), path)
    n = rows.sparkSession.read.parquet(path).count()
    manifest = {"path": path, "rows": n, "status": "ok" if n else "partial" if sources else "no_source", "sources": sources, "columns": columns}
    rows.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".manifest")
    return manifest


def cache_state(spark: SparkSession, path: str, changed: dict[str, float]) -> str:
    """State of a report table against its manifest: not_built, broken (missing table or other columns), no_source, stale (a source, of those whose time of change is given, is younger than the manifest), or ok."""
    try:
        line = spark.read.text(path.rstrip("/") + ".manifest").withColumn("at", F.col("_metadata.file_modification_time").cast("double")).where("value <> ''").first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return "not_built"
        raise
    manifest = json.loads(line.value)
    try:
        have = spark.read.parquet(path).columns
    except AnalysisException:
        return "broken"
    if have != list(manifest["columns"]):
        return "broken"
    if manifest["status"] == "no_source":
        return "no_source"
    return "stale" if any(changed.get(s, 0.0) > line["at"] for s in manifest["sources"]) else "ok"


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a table is there and not empty; reads one row at most."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
