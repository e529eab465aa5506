"""Data sources: which members are opened, what is pushed, and odd archives and databases."""

import sqlite3
import zipfile
from datetime import date

import pytest
from crossgrid.sources import archives
from pyspark.sql import functions as F


@pytest.fixture
def zips(spark, tmp_path):
    archives.register(spark)
    for month in ("JAN", "FEB"):
        with zipfile.ZipFile(tmp_path / f"m{month}.zip", "w") as z:
            for day in (1, 2, 3):
                z.writestr(f"cm{day:02}{month}2011.csv", f"SYMBOL , CLOSE,VOLUME\nA{day}, {day}.5 , {day}0\nB,-, x\n\n")
            z.writestr("folder/", "")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    return f"{tmp_path}/*.zip"


def test_members_by_date(spark, zips):
    rows = spark.read.format("zipped_csv").schema("date date, close double, symbol string, volume long, other string").load(path=zips)
    assert rows.count() == 12
    some = rows.where("date >= '2011-01-02' AND date < '2011-02-02'")
    got = sorted((r.date, r.symbol, r.close, r.volume, r.other) for r in some.collect())
    assert got == [(d, s, c, v, None) for d, s, c, v in ((date(2011, 1, 2), "A2", 2.5, 20), (date(2011, 1, 2), "B", None, None), (date(2011, 1, 3), "A3", 3.5, 30), (date(2011, 1, 3), "B", None, None), (date(2011, 2, 1), "A1", 1.5, 10), (date(2011, 2, 1), "B", None, None))]
    assert some.rdd.getNumPartitions() == 3  # only the asked members are opened
    assert rows.where("date = '2011-01-03'").select("symbol").rdd.getNumPartitions() == 1
    assert rows.where("date > '2012-01-01'").count() == 0


def test_schema_from_the_header(spark, zips):
    rows = spark.read.format("zipped_csv").option("first_only", "true").load(path=zips)
    assert rows.columns == ["date", "SYMBOL", "CLOSE", "VOLUME"] and rows.count() == 4
    with pytest.raises(Exception, match="zip"):
        spark.read.format("zipped_csv").option("strict", "true").load(path=zips).count()


def test_reader_pushes_dates_alone():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = archives.ZippedReader(None, {"path": "x"})
    kept = list(reader.pushFilters([GreaterThan(("date",), date(2011, 1, 1)), EqualTo(("symbol",), "A")]))
    assert reader.wanted == [(">", date(2011, 1, 1))] and kept == [EqualTo(("symbol",), "A")]
    assert archives.date_of("a/eq_20110105_v2.csv") == date(2011, 1, 5) and archives.date_of("cm05JAN2011bhav.csv") == date(2011, 1, 5) and archives.date_of("x99999999.csv") is None


def test_sqlite_by_row_ranges(spark, tmp_path):
    archives.register(spark)
    path = str(tmp_path / "ledger.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE trials (trial_id INTEGER PRIMARY KEY, thesis_id TEXT, t_stat REAL, n INTEGER)")
    db.executemany("INSERT INTO trials VALUES (?, ?, ?, ?)", [(k, f"th_{k % 3}", k / 4, None if k % 10 == 0 else k) for k in range(1, 1001)])
    db.execute("INSERT INTO trials VALUES (5000, x'00', 'odd', 'odd')")
    db.execute("CREATE TABLE empty (a INTEGER)")
    db.commit()
    read = lambda table, **o: spark.read.format("sqlite_rows").options(path=path, table=table, **o).load()
    rows = read("trials", partitions="4", snapshot=str(tmp_path / "snap"))
    assert rows.dtypes == [("trial_id", "bigint"), ("thesis_id", "string"), ("t_stat", "double"), ("n", "bigint")]
    assert rows.count() == 1001 and rows.rdd.getNumPartitions() == 4
    got = rows.where("thesis_id = 'th_1' AND t_stat > 200").agg(F.count("*").alias("c"), F.sum("trial_id").alias("s")).first()
    want = [k for k in range(1, 1001) if k % 3 == 1 and k / 4 > 200]
    assert (got.c, got.s) == (len(want), sum(want))
    assert tuple(rows.where("trial_id = 5000").first()) == (5000, None, None, None)
    assert read("empty").count() == 0
    missing = spark.read.format("sqlite_rows").schema("trial_id long").options(path=str(tmp_path / "none.db"), table="trials").load()
    assert missing.count() == 0
    db.execute("DELETE FROM trials")
    db.commit()
    db.close()
    assert read("trials").count() == 0


def test_sqlite_pushes_comparisons():
    from pyspark.sql.datasource import EqualTo, IsNull, LessThan

    reader = archives.SqliteReader(None, {"path": "x", "table": "t"})
    kept = list(reader.pushFilters([LessThan(("n",), 5), EqualTo(("s",), "a"), IsNull(("n",))]))
    assert reader.where == [("n", "<", 5), ("s", "=", "a")] and kept == [IsNull(("n",))]
