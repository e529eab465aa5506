"""The trial ledger and the holdout's peeks, as logs with atomic commits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.statelog import StateLog
from .formula import canonical, formula_hash, structural_key

PEEKS = 12
TRIALS = "trial_id long, thesis_id string, formula_hash string, canonical string, shape string, split string, rank_ic double, sharpe double, t_stat double, n_days long, counts_as_trial int, reason string"


class Trials:
    """Every scored run: selection runs count as trials, runs that can only reject don't. ``shape`` is the formula without its numbers, by which effective trials are counted."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = StateLog(spark, path, TRIALS)

    def record_all(self, rows: DataFrame) -> int | None:
        """Rows without trial_id, in order of their reason; they get the next numbers, in one commit."""
        ids = F.row_number().over(Window.orderBy("reason", "rank_ic")).cast("long")  # a row per run of one signal
        return self.log.transact(lambda old: rows.withColumn("trial_id", ids + old.count()))

    def record(self, thesis_id: str, formula: str, split: str, rank_ic: float | None, t_stat: float | None, n_days: int, counts: bool = True, reason: str | None = None, sharpe: float | None = None) -> int:
        row = (thesis_id, formula_hash(formula), canonical(formula), structural_key(formula), split, rank_ic, sharpe, t_stat, n_days, int(counts), reason)
        return self.record_all(self.log.spark.createDataFrame([row], TRIALS.partition(", ")[2]))

    def trials(self, thesis_id: str | None = None) -> DataFrame:
        rows = self.log.read().where("counts_as_trial = 1")
        return rows if thesis_id is None else rows.where(F.col("thesis_id") == thesis_id)

    def pressure(self, thesis_id: str, formula: str) -> dict[str, float]:
        """How much a new run of this formula is one of many: trials, effective trials (formulas of one shape are one), both in its thesis and in all, and the variance of the trials' ratios per day."""
        rows, own, shape = self.trials(), F.col("thesis_id") == thesis_id, structural_key(formula)
        ir = F.col("t_stat") / F.sqrt("n_days")
        m = rows.agg(
            F.count("*").alias("all"), F.count_if(own).alias("own"), F.count_distinct("shape").alias("shapes"), F.count_distinct(F.when(own, F.col("shape"))).alias("own_shapes"),
            F.coalesce(F.bool_or(F.col("shape") == shape), F.lit(False)).alias("seen"), F.coalesce(F.bool_or((F.col("shape") == shape) & own), F.lit(False)).alias("own_seen"), F.var_samp(F.when(F.col("n_days") > 0, ir)).alias("variance"),
        ).first()
        every, inside = m.shapes + (not m.seen), m.own_shapes + (not m.own_seen)
        return {"trials": m["all"], "own_trials": m.own, "effective_all": float(every), "effective_own": float(inside), "effective": float(max(every, inside, 1)), "variance": m.variance}


class PeekBudget:
    """Peeks at the holdout: reserving one spends it, for good, whatever comes of it; of callers that ask for the last one at the same time, one gets it."""

    def __init__(self, spark: SparkSession, path: str, most: int = PEEKS):
        self.spark, self.most = spark, most
        self.log = StateLog(spark, path, "peek_id long, card_id string, status string, result string")

    def used(self) -> int:
        return self.log.read().where("status = 'reserved'").count()

    def reserve(self, card_id: str) -> int | None:
        """The peek's number; None where all are spent."""
        got: list[int] = []

        def make(old: DataFrame) -> DataFrame | None:
            n = old.where("status = 'reserved'").count()
            got[:] = [n + 1]
            return None if n >= self.most else self.spark.createDataFrame([(n + 1, card_id, "reserved", None)], self.log.schema)

        return got[0] if self.log.transact(make) else None

    def finish(self, peek_id: int, card_id: str, result: dict) -> None:
        """Writes down what a reserved peek saw; the reservation stays."""
        self.log.append(self.spark.createDataFrame([(peek_id, card_id, "used", json.dumps(result))], self.log.schema))

    def records(self) -> DataFrame:
        """peek_id, card_id, status, result: the newest state of each peek."""
        newest = F.max_by(F.struct("card_id", "status", "result"), F.when(F.col("status") == "used", 1).otherwise(0))
        return self.log.read().groupBy("peek_id").agg(newest.alias("x")).select("peek_id", "x.*")
