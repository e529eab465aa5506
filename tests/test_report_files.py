"""A report's text, line by line, and its file."""

from crossgrid.sources import reports
from pyspark.sql import functions as F


def lines(spark):
    rows = spark.createDataFrame([("b|x", 2, 1234.5678), ("a", None, None), ("c\nd", -1, 0.00004)], "name string, n int, v double").repartition(3)
    one = rows.agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    return reports.assembled(reports.table(2, rows, ["name"], 3), reports.text(spark, 0, "# Features", "", "Of all names."), reports.facts(1, one, {"n": "Rows", "m": "Mean"}, 2))


EXPECTED = """# Features

Of all names.

- Rows: **3**
- Mean: **617.28**

| name | n | v |
|---|---:|---:|
| a |  |  |
| b\\|x | 2 | 1,234.568 |
| c d | -1 | 0.000 |

"""


def test_text_of_a_report(spark, tmp_path):
    path = tmp_path / "report.md"
    reports.publish(lines(spark), str(path))
    assert path.read_text() == EXPECTED
    reports.publish(reports.assembled(reports.text(spark, 0, "new")), str(path))
    assert path.read_text() == "new\n\n" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["report.md"]


def test_table_without_rows(spark):
    empty = spark.createDataFrame([], "a string, b double")
    assert [r.line for r in reports.assembled(reports.table(0, empty, ["a"])).collect()] == ["| a | b |", "|---|---:|", ""]
