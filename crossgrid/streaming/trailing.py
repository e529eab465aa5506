"""Extensions for streams: bars that a watermark closes, and windows over a key's own last rows.

Both give the rows that a batch over the same data gives, for what the watermark has passed; a query that is started again from its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.staging import for_workers


def stream_bars(trades: DataFrame, bucket: str = "1 day", late: str = "2 days") -> DataFrame:
    """trades: ts, symbol, price, quantity. Bars of each bucket once it is ``late`` past; batches give the same rows."""
    w = F.window("ts", bucket)
    bars = trades.withWatermark("ts", late).groupBy(w, "symbol").agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("quantity").alias("volume"))
    return bars.select(F.to_date("window.start").alias("date"), "symbol", "open", "high", "low", "close", "volume")


def _own_rows(n: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a key: its last n - 1 closed values, and rows that the watermark hasn't passed, of which later ones may still come before."""
    last, *held = (list(x) for x in state.get) if state.exists else ([], [], [], [])
    at, row, value = ([np.array(x, dtype)] for x, dtype in zip(held, ("int64", "int64", "float64")))
    for b in batches:
        at.append(b["ts"].to_numpy("datetime64[us]").astype("int64"))
        row.append(b["row_id"].to_numpy())
        value.append(b["value"].to_numpy("float64"))
    at, row, value = map(np.concatenate, (at, row, value))
    order = np.lexsort((row, at))
    at, row, value = at[order], row[order], value[order].tolist()
    m = int(np.searchsorted(at, state.getCurrentWatermarkMs() * 1000))  # so many are closed
    p, all_ = len(last), last + value[:m]
    state.update((all_[max(len(all_) - n + 1, 0) :], at[m:].tolist(), row[m:].tolist(), value[m:]))
    if m < len(at):  # comes again once the watermark has passed the first of them, with new rows or without
        state.setTimeoutTimestamp(max(int(at[m]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    if m:  # a missing value is NaN, and so is its windows' sum
        means = [sum(all_[k - n + 1 : k + 1]) / n if k >= n - 1 else np.nan for k in range(p, p + m)]
        yield pd.DataFrame({"key": key[0], "row_id": row[:m], "ts": at[:m].astype("datetime64[us]"), "trailing": means})


def trailing_mean(rows: DataFrame, n: int, late: str) -> DataFrame:
    """rows: key long, row_id long, ts, value double; a stream. key, row_id, ts and trailing: the mean of the key's last n rows in order of (ts, row_id), null before there are n or where one has none.

    A row comes out once the watermark, ``late`` behind the newest row, has passed it; rows that come later than that are dropped and counted (``dropped_rows``). A key holds n - 1 values and its rows of the last ``late``."""
    for_workers(rows.sparkSession)
    kinds = "key long, row_id long, ts timestamp, trailing double"
    held = "last array<double>, at array<bigint>, row array<bigint>, value array<double>"
    return rows.withWatermark("ts", late).groupBy("key").applyInPandasWithState(partial(_own_rows, n), kinds, held, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(rows: DataFrame, out: str, checkpoint: str) -> tuple[DataFrame, int]:
    """Takes all that the stream's source has now, in as many batches as it needs, appends to a Parquet table and stops; the table, and how many rows came too late."""
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(out), dropped_rows(query.recentProgress)


def dropped_rows(progress: list) -> int:
    return sum(int(s["numRowsDroppedByWatermark"]) for p in progress for s in p["stateOperators"])


def register() -> None:
    import uuid

    from ..plans.queries import query, r
    from ..sources.staging import shared_dir

    def events(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{sf_dir}/events.parquet"
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")  # as a pattern, so that one file will do as well as a folder

    def taken(spark: SparkSession, rows: DataFrame) -> DataFrame:
        at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        return run_available(rows, f"{at}/out", f"{at}/checkpoint")[0]

    passed = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY FROM events)"

    @query("stream_trailing", f"SELECT user_id, event_id, round(CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END, 6) AS trailing FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) QUALIFY ts < {passed}")
    def stream_trailing(spark, sf_dir):
        rows = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
        return taken(spark, trailing_mean(rows, 5, "2 days")).select(F.col("key").alias("user_id"), F.col("row_id").alias("event_id"), r("trailing").alias("trailing"))

    @query("stream_bars", f"SELECT CAST(ts AS DATE) AS date, event_type AS symbol, round(arg_min(value, ts), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, ts), 6) AS close, count(*) AS volume FROM events GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= {passed}")
    def stream_bars_(spark, sf_dir):
        rows = events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(1).cast("long").alias("quantity"))
        bars = taken(spark, stream_bars(rows))
        return bars.select("date", "symbol", *(r(c).alias(c) for c in ("open", "high", "low", "close")), "volume")
