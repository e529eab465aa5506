"""Reports as text: sections as rows, put in order by Spark, one file that is there whole or not at all."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .statelog import Files

#: rows of a report: section (its place), place in the section, line.
ROWS = "section int, place long, line string"


def text(spark: SparkSession, section: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(section, k, line) for k, line in enumerate(lines)], ROWS)


def _cell(c: str, kind: str, digits: int) -> Column:
    """A number with so many digits, thousands set apart; a bar inside a text is escaped, null is blank."""
    col = F.col(f"`{c}`")
    shown = F.format_number(col, digits) if kind in ("double", "float") or kind.startswith("decimal") else F.replace(F.replace(col.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.coalesce(shown, F.lit(""))


def table(section: int, rows: DataFrame, order: list[str], digits: int = 4) -> DataFrame:
    """A table of the rows, in order: numbers to the right. Places are numbered within one task, as a report's table is read by people; give it an aggregate."""
    from pyspark.sql import Window

    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    right = [kinds[c] in ("double", "float", "int", "bigint", "smallint") or kinds[c].startswith("decimal") for c in rows.columns]
    head = text(spark, section, "| " + " | ".join(rows.columns) + " |", "|" + "|".join("---:" if x else "---" for x in right) + "|")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(_cell(c, kinds[c], digits) for c in rows.columns)), F.lit(" |"))
    place = F.row_number().over(Window.orderBy(*order)).cast("long") + 1
    return head.unionByName(rows.select(F.lit(section).alias("section"), place.alias("place"), cells.alias("line")))


def facts(section: int, row: DataFrame, labels: dict[str, str], digits: int = 4) -> DataFrame:
    """A line per column of a one-row table."""
    kinds = dict(row.dtypes)
    items = F.array(*(F.struct(F.lit(k).cast("long").alias("place"), F.concat(F.lit(f"- {label}: **"), _cell(c, kinds[c], digits), F.lit("**")).alias("line")) for k, (c, label) in enumerate(labels.items())))
    return row.select(F.lit(section).alias("section"), F.explode(items).alias("x")).select("section", "x.place", "x.line")


def assembled(*sections: DataFrame) -> DataFrame:
    """line, in order, a blank line between sections."""
    every = reduce(DataFrame.unionByName, sections)
    gaps = every.groupBy("section").agg((F.max("place") + 1).alias("place")).select("section", "place", F.lit("").alias("line"))
    return every.unionByName(gaps).orderBy("section", "place").select("line")


def publish(lines: DataFrame, path: str) -> None:
    """Writes the lines to one file: to a folder of its own first, whose only part then takes the path's place. A reader sees the old report or the new one."""
    spark, files = lines.sparkSession, Files(lines.sparkSession, path)
    aside = f"{path}.{uuid.uuid4().hex}"
    try:
        lines.coalesce(1).write.text(aside)
        (part,) = [n for n in files.sizes(aside) if n.startswith("part-")]
        options = files.gateway.new_array(files.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = files.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.path(f"{aside}/{part}"), files.path(path), options)
    finally:
        files.drop(aside)
