"""Contest-shaped views over the star-schema tables (an order with two suppliers is a contest)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import matchup as M
from ..operators.running import sequence_in_group, spread, task_count
from ..session import cut_lineage

TRAIN_END, VALID_END, MIN_DATE = "2000-01-01", "2001-01-01", "1996-01-01"
SLATE_BLOCK = 20000
#: Bytes of stored lines a task.
LINE_BYTES = 4 << 20


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded for comparison across engines (and no negative zero)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def side(spark: SparkSession, d: str) -> DataFrame:
    """One row per (order, supplier): the measures of one side. `rf` is the largest flag as a rank (1: A, 3: N), since
    Spark sorts its input for the largest string but hashes for numbers."""
    flag = F.col("l_returnflag")
    rank = F.when(flag > "N", 4).when(flag == "N", 3).when(flag > "A", 2).when(flag == "A", 1).when(flag.isNotNull(), 0)
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_linenumber")
    # The rows meet by order before they are summed: sums kept per scan task would grow with what one task reads, and pairs of an order meet here anyway.
    lines = spread(lines.withColumnsRenamed({"l_orderkey": "contest_id", "l_suppkey": "entity_id"}), ["contest_id"], task_count(lines, LINE_BYTES))
    return lines.groupBy("contest_id", "entity_id").agg(
        F.sum("l_quantity").alias("attempted"), F.sum(F.when(flag != "R", F.col("l_quantity")).otherwise(0.0)).alias("landed"),
        F.count_if(F.col("l_linestatus") == "F").alias("td_landed"), F.count(F.lit(1)).alias("td_attempted"),
        F.count_if(flag == "A").alias("kd"), F.count_if(flag == "N").alias("sub_att"),
        F.sum("l_linenumber").alias("ctrl_sec"), F.max(rank).alias("rf"))


def ranked_sides(spark: SparkSession, d: str) -> DataFrame:
    """The two smallest suppliers of each order (`rn` 1, 2); the rank filter prunes before the shuffle."""
    w = W.partitionBy("contest_id").orderBy("entity_id")
    return side(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 2")


def contests(spark: SparkSession, d: str, with_order: bool = True, with_stats: bool = False) -> DataFrame:
    """One row per contest. `bout_order` (1.. within the day) and the sides' stats only on request."""
    fields = F.struct(*(["entity_id", *[F.col(c).cast("double").alias(c) for c in H.OWN_STATS if c != "duration_sec"], "rf"] if with_stats
                        else ["entity_id", "attempted", "rf", "td_attempted"]))
    # The first side takes the second from the next row: the rows lie in that order already, while an aggregate of whole sides would sort and copy them twice.
    in_contest = W.partitionBy("contest_id").orderBy("entity_id")
    pairs = (ranked_sides(spark, d).select("contest_id", "entity_id", "rn", fields.alias("a")).withColumn("b", F.lead("a").over(in_contest))
             .filter("rn = 1 and b is not null").drop("rn", "entity_id"))
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("contest_id"), F.col("o_orderdate").cast("date").alias("event_date"),
        "o_orderstatus", "o_orderpriority")
    key = F.col("contest_id")
    result = (F.when((F.col("o_orderstatus") == "P") & (key % 10 == 0), "nc")
              .when(F.col("a.attempted") == F.col("b.attempted"), "draw").otherwise("win"))
    a_larger = F.col("a.attempted") > F.col("b.attempted")
    flag = F.when(a_larger, F.col("a.rf")).otherwise(F.col("b.rf"))
    c = pairs.join(orders, "contest_id").select(
        "contest_id", "event_date", F.col("a.entity_id").alias("entity_1_id"), F.col("b.entity_id").alias("entity_2_id"),
        result.alias("result"),
        F.when(result == "win", F.when(a_larger, F.col("a.entity_id")).otherwise(F.col("b.entity_id"))).alias("winner_id"),
        F.when(flag == 1, "ko_tko").when(flag == 3, "submission").otherwise("decision").alias("finish_group"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("division"),
        (key % 17 != 0).alias("has_stats"), (F.col("event_date") < F.lit(MIN_DATE).cast("date")).alias("is_prior"),
        F.when(key % 20 == 0, 5).otherwise(3).alias("scheduled_rounds"), (key % 50 == 0).alias("is_title"),
        (60 * (F.col("a.td_attempted") + F.col("b.td_attempted"))).alias("duration_sec"),
        *(["a", "b"] if with_stats else []))
    if with_stats:
        def stats_of(x: str) -> Column:
            return F.when(F.col("has_stats"), F.struct(F.col(f"{x}.entity_id").alias("entity_id"),
                          *[(F.col("duration_sec").cast("double") if m == "duration_sec" else F.col(f"{x}.{m}")).alias(m) for m in H.OWN_STATS]))
        c = c.withColumns({"stats_1": stats_of("a"), "stats_2": stats_of("b")}).drop("a", "b")
    c = c.withColumn("is_target", (F.col("result") == "win") & ~F.col("is_prior"))
    if with_order:
        return sequence_in_group(c, ["event_date"], "contest_id", "bout_order")
    # The order inside a day follows the id, so the id itself gives the same history.
    return c.withColumn("bout_order", F.col("contest_id"))


def slate_columns(c: DataFrame) -> DataFrame:
    """Slates: contests of a day within a block of ids (about eight bouts, never more than the block),
    and the bout number inside the slate."""
    c = c.withColumn("event_id", F.concat_ws("-", F.date_format("event_date", "yyyyMMdd"), F.floor(F.col("contest_id") / SLATE_BLOCK).cast("string")))
    return c.withColumn("bout_no", F.row_number().over(W.partitionBy("event_id").orderBy("contest_id")))


def stats(spark: SparkSession, d: str) -> DataFrame:
    """Two stat rows per contest that has stats."""
    rows = ranked_sides(spark, d)
    whole = W.partitionBy("contest_id")
    return (rows.withColumn("_n", F.count(F.lit(1)).over(whole))
            .withColumn("duration_sec", 60 * F.sum("td_attempted").over(whole))
            .withColumn("opponent_id", F.sum("entity_id").over(whole) - F.col("entity_id"))
            .filter((F.col("_n") == 2) & (F.col("contest_id") % 17 != 0)).drop("_n", "rn"))


def entity(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    stance = F.when(F.col("s_nationkey") % 3 == 0, "Orthodox").when(F.col("s_nationkey") % 3 == 1, "Southpaw")
    return s.select(
        key.alias("entity_id"), F.col("s_name").alias("name"),
        F.when(key % 7 != 0, 60.0 + F.col("s_nationkey")).alias("height_in"),
        F.when(key % 5 != 0, F.col("s_acctbal") / 100).alias("reach_in"), stance.alias("stance"),
        F.date_add(F.lit("1960-01-01").cast("date"), (key % 9000).cast("int")).alias("dob"))


def appearances(spark: SparkSession, d: str, with_stats: bool = False, with_order: bool = False) -> DataFrame:
    c = contests(spark, d, with_order)
    return H.appearances(c, stats(spark, d) if with_stats else None)


def states(spark: SparkSession, d: str, with_rates: bool = False) -> DataFrame:
    c = stored_contests(spark, d, with_stats=with_rates)
    return H.daily_states(H.appearances(c), with_rates)


def stored_contests(spark: SparkSession, d: str, with_order: bool = False, with_stats: bool = True) -> DataFrame:
    """Contests, with both sides' stats attached, written once: history, division days, targets and probes
    all read this table instead of deriving it again."""
    return cut_lineage(contests(spark, d, with_order, with_stats), "contests", compact=True)


def features(spark: SparkSession, d: str, store: bool = False) -> DataFrame:
    """Training features of every target contest, both orientations."""
    c = stored_contests(spark, d)
    a = H.appearances(c)
    return M.training_features(c, H.daily_states(a), H.division_days(a), entity(spark, d), TRAIN_END, VALID_END, store)


def records_before(spark: SparkSession, d: str, which: str = "is_target", stored: DataFrame | None = None) -> DataFrame:
    """Target contests with each side's contests and wins strictly before (n1, w1, n2, w2). `stored`: the contests, if they are stored already."""
    c = stored_contests(spark, d, with_stats=False) if stored is None else stored
    tasks = task_count(c)
    st = H.daily_states(H.appearances(c), with_rates=False).select("entity_id", "event_date", "cum_contests", "cum_wins")
    targets = c.filter(which)
    probes = targets.select(F.explode(F.array("entity_1_id", "entity_2_id")).alias("entity_id"), "event_date")
    pre = cut_lineage(H.asof_strict(st, probes, ["entity_id"]).select("entity_id", "event_date", "cum_contests", "cum_wins"), "records")
    for s in ("1", "2"):
        targets = spread(targets, [f"entity_{s}_id", "event_date"], tasks).join(pre.select(
            F.col("entity_id").alias(f"entity_{s}_id"), "event_date",
            F.coalesce("cum_contests", F.lit(0)).alias(f"n{s}"), F.coalesce("cum_wins", F.lit(0)).alias(f"w{s}")),
            [f"entity_{s}_id", "event_date"])
    return targets


def forecast_rows(spark: SparkSession, d: str) -> DataFrame:
    """Both orientations of every target contest with a forecast p from smoothed win rates and a small
    advantage for the side listed first."""
    r = records_before(spark, d)
    s1, s2 = M.smoothed_win_rate(F.col("w1"), F.col("n1")), M.smoothed_win_rate(F.col("w2"), F.col("n2"))
    def row(o: int, mine: Column, other: Column, who: str) -> Column:
        return F.struct(F.lit(o).alias("orientation"), ((mine + 0.02) / (mine + other + 0.02)).alias("p"),
                        (F.col("winner_id") == F.col(f"entity_{who}_id")).cast("int").alias("target"))
    return r.select("contest_id", "event_date", "division", F.explode(F.array(row(0, s1, s2, "1"), row(1, s2, s1, "2"))).alias("o")
                    ).select("contest_id", "event_date", "division", "o.*")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric contest scores of the forecast, with the split label."""
    s = M.contest_scores(forecast_rows(spark, d)).withColumn("p", F.round("p", 9))
    return s.withColumn("split", M.assign_split(F.col("event_date"), TRAIN_END, VALID_END))


def predictions(spark: SparkSession, d: str, stored: DataFrame | None = None) -> DataFrame:
    """One saved prediction per contest on or after the cut-off: sides in either order, an id missing here
    and there, dates off by up to a day, some made late."""
    r = slate_columns(records_before(spark, d, "not is_prior", stored))
    key, swap = F.col("contest_id"), F.col("contest_id") % 2 == 1
    a, b = M.smoothed_win_rate(F.col("w1"), F.col("n1")), M.smoothed_win_rate(F.col("w2"), F.col("n2"))
    p1 = (a + 0.02) / (a + b + 0.02)
    p = F.round(F.when(swap, 1 - p1).otherwise(p1), 6)
    def id_of(s: str) -> Column:
        return F.when(swap, F.col(f"entity_{'2' if s == '1' else '1'}_id")).otherwise(F.col(f"entity_{s}_id"))
    def name(c: Column) -> Column:
        return F.concat(F.lit("E"), c)
    made = F.date_add("event_date", F.when(key % 41 == 0, 3).otherwise(-(key % 5)).cast("int")).cast("timestamp")
    df = r.select(key.alias("pred_id"), F.date_add("event_date", (key % 3 - 1).cast("int")).alias("event_date"), F.col("event_id").alias("event_name"),
                  F.when(key % 23 != 0, id_of("1")).alias("entity_1_id"), F.when(key % 46 != 0, id_of("2")).alias("entity_2_id"),
                  name(id_of("1")).alias("name_1"), name(id_of("2")).alias("name_2"), p.alias("p"), made.alias("predicted_at"),
                  F.lit("model_1").alias("model_version"), F.concat(F.lit("cards-"), F.year("event_date"), F.lit(".csv")).alias("prediction_file"),
                  F.when(swap, (F.col("n2") == 0)).otherwise(F.col("n1") == 0).cast("int").alias("newcomer_1"),
                  F.when(swap, (F.col("n1") == 0)).otherwise(F.col("n2") == 0).cast("int").alias("newcomer_2"))
    pick = F.when(F.col("p") >= 0.5, F.col("name_1")).otherwise(F.col("name_2"))
    return df.withColumns({"pick": pick, "confidence": F.greatest(F.col("p"), 1 - F.col("p")),
                           "key_factors": F.concat("name_1", F.lit(": Win rate (0.10); Age (0.05) | "), "name_2", F.lit(": none"))})


def graded(spark: SparkSession, d: str) -> DataFrame:
    """One reviewed bout per contest on or after the cut-off."""
    r = slate_columns(records_before(spark, d, "not is_prior"))
    a, b = M.smoothed_win_rate(F.col("w1"), F.col("n1")), M.smoothed_win_rate(F.col("w2"), F.col("n2"))
    p = F.round((a + 0.02) / (a + b + 0.02), 6)
    won_1 = F.col("winner_id") == F.col("entity_1_id")
    df = r.withColumn("p", p).withColumns({
        "p_pick": F.greatest(F.col("p"), 1 - F.col("p")),
        "correct": F.when(F.col("result") == "win", (F.col("p") >= 0.5) == won_1),
        "finish_group": F.when(F.col("contest_id") % 33 == 0, "dq").otherwise(F.col("finish_group")),
        "newcomer": (F.col("n1") == 0) | (F.col("n2") == 0), "late_change": F.col("contest_id") % 9 == 0,
        "late_change_source": F.when(F.col("contest_id") % 9 == 0, "detected"),
        "division": F.when(F.col("contest_id") % 4 == 0, F.concat(F.lit("Women's "), "division")).otherwise(F.col("division")),
        "name_1": F.concat(F.lit("E"), "entity_1_id"), "name_2": F.concat(F.lit("E"), "entity_2_id"), "event_name": F.col("event_id")})
    return df.withColumns({"pick": F.when(F.col("p") >= 0.5, F.col("name_1")).otherwise(F.col("name_2")), "bout_order": F.col("bout_no"),
                           "actual_winner": F.when(F.col("winner_id").isNotNull(), F.concat(F.lit("E"), "winner_id")).otherwise(F.col("result"))})
