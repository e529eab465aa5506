"""Streams against batches over the same rows, over restarts, with rows in disorder and too late."""

import random
from datetime import datetime, timedelta, timezone

from crossgrid.streaming import trailing
from pyspark.sql import Window
from pyspark.sql import functions as F

SCHEMA = "key long, row_id long, ts timestamp, value double"
BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def made(seed, n, first):
    r = random.Random(seed)
    return [(r.randint(0, 4), first + k, BEGIN + timedelta(hours=(first + k) * 0.5 + r.uniform(-3, 3)), None if r.random() < 0.05 else round(r.uniform(-5, 5), 3)) for k in range(n)]


def batch(spark, rows, n, until):
    w = Window.partitionBy("key").orderBy("ts", "row_id").rowsBetween(-(n - 1), 0)
    mean = F.when(F.count("value").over(w) == n, F.avg("value").over(w))
    return {r.row_id: r.t for r in spark.createDataFrame(rows, SCHEMA).withColumn("t", mean).where(F.col("ts") < F.lit(until)).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in ((got[k], want[k]) for k in want))


def write(spark, rows, folder, name):
    """One file, moved in whole."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    (folder / "in").mkdir(exist_ok=True)
    next((folder / f"tmp-{name}").glob("*.parquet")).rename(folder / "in" / f"{name}.parquet")


def test_trailing_rows_over_restarts(spark, tmp_path):
    parts = [made(k, 60, 60 * k) for k in range(4)]
    late = [(1, 900, BEGIN + timedelta(hours=1), 9.0), (2, 901, BEGIN + timedelta(hours=2), 9.0)]
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: trailing.run_available(trailing.trailing_mean(read(), 3, "10 hours"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    write(spark, parts[0], tmp_path, "a")
    write(spark, parts[1], tmp_path, "b")
    out, dropped = run()
    got = {r.row_id: r.trailing for r in out.collect()}
    until = max(x[2] for x in parts[0] + parts[1]) - timedelta(hours=10)
    same(got, batch(spark, parts[0] + parts[1], 3, until))
    assert dropped == 0 and 60 < len(got) < 120
    write(spark, parts[2] + late, tmp_path, "c")  # after a restart: more rows, two of them too late
    write(spark, parts[3], tmp_path, "d")
    out, dropped = run()
    got = {r.row_id: r.trailing for r in out.collect()}
    every = [x for p in parts for x in p]
    same(got, batch(spark, every, 3, max(x[2] for x in every) - timedelta(hours=10)))
    assert dropped == 2 and out.count() == len(got)
    out, dropped = run()
    assert (out.count(), dropped) == (len(got), 0)  # nothing new


def test_bars_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    rows = [(f"s{k % 3}", BEGIN + timedelta(hours=k), float(k * 37 % 101), k) for k in range(24 * 8)]
    schema = "symbol string, ts timestamp, price double, quantity long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    bars, _ = trailing.run_available(trailing.stream_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {(str(r.date), r.symbol): (r.open, r.high, r.low, r.close, r.volume) for r in bars.collect()}
    want = {}
    for symbol, ts, price, quantity in rows:
        want.setdefault((str(ts.date()), symbol), []).append((price, quantity))
    closed = (max(r[1] for r in rows) - timedelta(days=3)).date()
    want = {k: (v[0][0], max(p for p, _ in v), min(p for p, _ in v), v[-1][0], sum(q for _, q in v)) for k, v in want.items() if k[0] <= str(closed)}
    assert got == want and len(got) == 15


def test_a_key_costs_far_less_than_a_row_of_python_objects():
    """The state's function alone, on plain rows: the same values as by hand, and no frame, timestamp or check for null per row."""
    import time

    import numpy as np
    import pandas as pd

    class State:
        exists, watermark, get = False, 0, None

        def update(self, value):
            self.get, self.exists = value, True

        def getCurrentWatermarkMs(self):
            return self.watermark

        def setTimeoutTimestamp(self, at):
            self.timeout = at

    n, m, at = 5, 20_000, 1_700_000_000_000_000
    values = [None if k % 11 == 3 else k * 0.37 for k in range(m)]
    rows = pd.DataFrame({"row_id": range(m), "ts": (at + 1000 * np.arange(m)).astype("datetime64[us]"), "value": np.array(values, "float64")})
    state, out, began = State(), [], time.process_time()
    assert not list(trailing._own_rows(n, ("k",), iter([rows.sample(frac=1, random_state=1)]), state))
    for done in (7, 9, 19_000):
        state.watermark = at // 1000 + done
        out += list(trailing._own_rows(n, ("k",), iter([]), state))
    took, got = time.process_time() - began, pd.concat(out)
    assert got["row_id"].tolist() == list(range(19_000)) and state.timeout == at // 1000 + 19_001
    want = [sum(w) / n if len(w := values[max(k - n + 1, 0) : k + 1]) == n and None not in w else None for k in range(19_000)]
    assert [None if np.isnan(x) else x for x in got["trailing"]] == want
    assert took < 0.3
