"""Files of two eras: which are opened, how headers and odd cells are read, which of two rows stays."""

import zipfile
from datetime import date

import pytest
from crossgrid.plans import catalog, prices
from crossgrid.sources import eras
from pyspark.sql import functions as F

OLD = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,\n"
NEW = "SYMBOL, SERIES, DATE1, PREV_CLOSE, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, LAST_PRICE, CLOSE_PRICE, AVG_PRICE, TTL_TRD_QNTY, TURNOVER_LACS, NO_OF_TRADES, DELIV_QTY, DELIV_PER\n"


@pytest.fixture
def folder(tmp_path):
    for day in (29, 30):
        with zipfile.ZipFile(tmp_path / f"cm{day}DEC2019bhav.csv.zip", "w") as z:
            z.writestr(f"cm{day}DEC2019bhav.csv", OLD + f"AAA,EQ,1,2,0.5,{day},9,8,10,150,{day}-DEC-2019,3,INE1,\nBBB,BE,1,1,1,1,1,1,1,1,{day}-DEC-2019,1,INE2,\nCCC , EQ ,1,1,1,x,1,1,0,0,{day}-DEC-2019,-,-,\n")
    (tmp_path / "cm31DEC2019bhav.csv.zip").write_bytes(b"broken")
    (tmp_path / "new").mkdir()
    for name, day in (("20191230", "30-Dec-2019"), ("20191231", "31-Dec-2019"), ("20200101", "01-Jan-2020")):
        (tmp_path / f"new/full_{name}.csv").write_text(NEW + f"AAA, EQ, {day}, 8, 1, 2, 0.5, 9, 1.5, -, 10, 1, 3, 4, 40.5\nZZZ, GB, {day}, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1\n, EQ, {day}, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1\n")
    return tmp_path


def test_eras_meet(spark, folder):
    rows = eras.read_eras(spark, f"{folder}/*.zip", f"{folder}/new", date(2019, 12, 31), date(2019, 12, 30))
    got = sorted((str(r.date), r.symbol, r.era, r.close, r.vwap, r.delivery_pct, r.isin) for r in rows.collect())
    assert got == [
        ("2019-12-29", "AAA", 1, 29.0, 15.0, None, "INE1"), ("2019-12-29", "CCC", 1, None, None, None, None), ("2019-12-30", "AAA", 1, 30.0, 15.0, None, "INE1"), ("2019-12-30", "AAA", 2, 1.5, None, 40.5, None), ("2019-12-30", "CCC", 1, None, None, None, None),
        ("2019-12-31", "AAA", 2, 1.5, None, 40.5, None), ("2020-01-01", "AAA", 2, 1.5, None, 40.5, None),
    ]
    clean = prices.clean(rows.where("symbol = 'AAA'").withColumns({"high": F.lit(99.0)}), "era").collect()
    assert sorted((str(r.date), r.era) for r in clean) == [("2019-12-29", 1), ("2019-12-30", 1), ("2019-12-31", 2), ("2020-01-01", 2)]


def test_only_files_of_the_range(spark, folder):
    rows = eras.read_eras(spark, f"{folder}/*.zip", f"{folder}/new", date(2019, 12, 31), date(2019, 12, 30), date(2019, 12, 30), date(2019, 12, 31), ("EQ", "BE"))
    assert sorted({(str(r.date), r.era, r.symbol) for r in rows.collect()}) == [("2019-12-30", 1, "AAA"), ("2019-12-30", 1, "BBB"), ("2019-12-30", 1, "CCC"), ("2019-12-30", 2, "AAA"), ("2019-12-31", 2, "AAA")]
    assert len(eras.read_modern(spark, f"{folder}/new", date(2020, 1, 1)).inputFiles()) == 1
    assert eras.read_modern(spark, f"{folder}/new", date(2021, 1, 1)) is None
    assert eras.read_legacy(spark, f"{folder}/none*.zip").count() == 0


def test_funds_and_rights_are_no_equity(spark):
    rows = spark.createDataFrame([("ABC", "INE1"), ("GOLDBEES", None), ("NIFTY50X", "INE2"), ("ABC-RE1", None), ("X", "INF3"), ("Y", "IN9Z"), ("MIDCAP", None), ("MIDCAPS", None), (None, None)], "symbol string, isin string")
    got = {r.symbol: r.gone for r in rows.withColumn("gone", F.coalesce(catalog.non_equity(F.col("symbol"), F.col("isin")), F.lit(False))).collect()}
    assert got == {"ABC": False, "GOLDBEES": True, "NIFTY50X": True, "ABC-RE1": True, "X": True, "Y": True, "MIDCAP": True, "MIDCAPS": False, None: False}
