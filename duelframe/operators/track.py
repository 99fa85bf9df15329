"""Predictions against results: matching, grading, log rows and running metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import keep_first

DATE_TOLERANCE_DAYS = 1
GRACE_DAYS = 2
RECENT_EVENTS = 5


def prediction_columns(p: Column, name_1: Column, name_2: Column) -> dict[str, Column]:
    """Rounded output of a scored bout: the pick is side 1 when p >= 0.5."""
    def four(x: Column) -> Column:
        return F.rint(x * 10000) / 10000    # ties to even on the scaled value

    p1 = four(p)
    return {"p_1": p1, "p_2": four(1 - p1), "pick": F.when(p >= 0.5, name_1).otherwise(name_2),
            "confidence": four(F.greatest(p, 1 - p))}


def match_predictions(preds: DataFrame, contests: DataFrame, tolerance: int = DATE_TOLERANCE_DAYS) -> DataFrame:
    """Add `contest_id` and `status` to predictions (pred_id, event_date, entity_1_id, entity_2_id).

    A prediction meets the contest of the same *unordered* pair within +-1 day; if one id is
    unknown, the contest of the known one. Contests are first reduced to one row per key and day
    (count, id), so a prediction reads at most three rows and no group is paired with itself.
    """
    a, b = F.col("entity_1_id"), F.col("entity_2_id")
    c = contests.select("contest_id", F.col("event_date").alias("day"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"),
                        (a == b).alias("same"))
    pair_days = c.filter("lo is not null and hi is not null").groupBy("lo", "hi", "day").agg(
        F.count(F.lit(1)).alias("n"), F.min("contest_id").alias("id"))
    single = c.select("contest_id", "day", F.explode(F.array_compact(F.array_distinct(F.array("lo", "hi")))).alias("lo"))
    single_days = single.groupBy("lo", "day").agg(F.count(F.lit(1)).alias("n"), F.min("contest_id").alias("id"))

    both = a.isNotNull() & b.isNotNull() & (a != b)
    window = F.explode(F.transform(F.sequence(F.lit(-tolerance), F.lit(tolerance)), lambda k: F.date_add("event_date", k))).alias("day")
    keyed = preds.select("pred_id", "event_date", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), both.alias("both"))
    probes = keyed.filter("lo is not null").select("pred_id", "lo", "hi", "both", window)
    hits = (probes.filter("both").join(pair_days, ["lo", "hi", "day"]).select("pred_id", "n", "id")
            .unionByName(probes.filter("not both").join(single_days, ["lo", "day"]).select("pred_id", "n", "id")))
    found = hits.groupBy("pred_id").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    n = F.coalesce("n", F.lit(0))
    status = (F.when(F.coalesce(a, b).isNull(), "unmatchable (no ids)").when(n == 1, "matched")
              .when(n > 1, "ambiguous").otherwise("pending"))
    return (preds.join(found, "pred_id", "left").withColumn("status", status)
            .withColumn("contest_id", F.when(F.col("status") == "matched", F.col("id"))).drop("n", "id"))


def is_late(predicted_at: Column, event_date: Column, grace_days: int = GRACE_DAYS) -> Column:
    """Made more than `grace_days` after the event day began."""
    return predicted_at > F.timestamp_add("DAY", F.lit(grace_days), event_date.cast("timestamp"))


def winning_side(winner: Column, id_1: Column, id_2: Column, name_1: Column, name_2: Column) -> Column:
    """Name of the side that won; one id may be unknown, then the known side lost."""
    return (F.when(winner == id_1, name_1).when(winner == id_2, name_2)
            .when(id_1.isNotNull(), name_2).otherwise(name_1))


def latest_predictions(matched: DataFrame, grace_days: int = GRACE_DAYS) -> DataFrame:
    """The latest prediction per contest that is not late."""
    m = matched.filter("status = 'matched'").filter(~F.coalesce(is_late(F.col("predicted_at"), F.col("event_date"), grace_days), F.lit(False)))
    return keep_first(m, ["contest_id"], [F.desc("predicted_at"), F.desc("pred_id")])


def log_rows(matched: DataFrame, contests: DataFrame, tracked_at: str, grace_days: int = GRACE_DAYS) -> DataFrame:
    """One graded row per contest. Draws and no-contests have no `correct`."""
    res = contests.select("contest_id", "result", "winner_id")
    m = latest_predictions(matched, grace_days).join(res, "contest_id")
    actual = F.when(F.col("result") == "win", winning_side(F.col("winner_id"), F.col("entity_1_id"), F.col("entity_2_id"), F.col("name_1"), F.col("name_2"))).otherwise(F.col("result"))
    return m.select("contest_id", "event_date", "event_name", "name_1", "name_2", "pick", actual.alias("actual_winner"),
                    F.when(F.col("result") == "win", actual == F.col("pick")).alias("correct"),
                    F.col("confidence").alias("p_pick"), "model_version", F.lit(tracked_at).alias("tracked_at"), "prediction_file")


def _summary(scope: str) -> list[Column]:
    return [F.lit(scope).alias("scope"), F.col("n").alias("contests"), (F.col("hits") / F.when(F.col("n") > 0, F.col("n"))).alias("accuracy"),
            (F.col("sq") / F.when(F.col("n") > 0, F.col("n"))).alias("brier")]


def running_metrics(log: DataFrame, recent: int = RECENT_EVENTS) -> DataFrame:
    """Accuracy and Brier overall and over the last `recent` event dates, plus excluded rows.

    Rows are reduced to one per date first; the recent dates are a top-k of those."""
    y = F.col("correct").cast("double")
    days = log.groupBy("event_date").agg(F.count("correct").alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("hits"),
                                         F.coalesce(F.sum((F.col("p_pick") - y) * (F.col("p_pick") - y)), F.lit(0.0)).alias("sq"),
                                         F.count_if(F.col("correct").isNull()).alias("excluded"))
    sums = [F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("sq").alias("sq"),
            F.count_if(F.col("n") > 0).alias("events"), F.sum("excluded").alias("excluded")]
    overall = days.agg(*sums).select(*_summary("overall"), "events", "excluded")
    last = days.filter("n > 0").orderBy(F.desc("event_date")).limit(recent).agg(*sums)
    return overall.unionByName(last.select(*_summary(f"last_{recent}"), "events", F.lit(None).cast("bigint").alias("excluded")))


def status_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
