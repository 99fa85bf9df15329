"""Probability metrics as aggregations over contest scores (contest_id, event_date, target, p).

All functions take optional grouping keys, so that many (slice, model) pairs are scored by one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import ranked_histogram

BINS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 1.0]
EPS = 1e-6
Z95 = 1.96


def clip_p(p: Column, eps: float = EPS) -> Column:
    return F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps))


def wilson_low_high(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """95 % Wilson score interval, NULL when n = 0."""
    n_ = F.when(n > 0, n).cast("double")
    phat = k / n_
    denom = F.lit(1.0) + F.lit(z * z) / n_
    centre = (phat + F.lit(z * z) / (2 * n_)) / denom
    half = F.lit(z) * F.sqrt(phat * (1 - phat) / n_ + F.lit(z * z) / (4 * n_ * n_)) / denom
    return centre - half, centre + half


def fold_favourite(p: Column, y: Column) -> tuple[Column, Column]:
    """(probability of the favourite, whether the favourite won)."""
    q = clip_p(p)
    return F.greatest(q, F.lit(1.0) - q), F.when(q >= 0.5, y).otherwise(1 - y).cast("double")


def tie_coin(contest_id: Column) -> Column:
    """Deterministic coin for exact ties."""
    return F.crc32(F.encode(contest_id.cast("string"), "UTF-8")) % 2


def bin_index(q: Column, bins: list[float] = BINS) -> Column:
    """Index of the `[a, b)` bin, NULL outside."""
    out = None
    for i, (a, b) in enumerate(zip(bins[:-1], bins[1:])):
        cond = (q >= a) & (q < b)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def _bin_sums(scores: DataFrame, keys: list[str], bins: list[float]) -> DataFrame:
    q, o = fold_favourite(F.col("p"), F.col("target"))
    return (scores.select(*keys, q.alias("q"), o.alias("o")).withColumn("bin", bin_index(F.col("q"), bins))
            .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("sum_q"), F.sum("o").alias("wins")))


def calibration_table(scores: DataFrame, keys: list[str] = [], bins: list[float] = BINS) -> DataFrame:
    """Per bin of the favourite's probability: n, mean prediction, win rate with Wilson interval, gap.
    Empty bins are kept (n = 0)."""
    sums = _bin_sums(scores, keys, bins)
    edges = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(a).alias("bin_low"), F.lit(b).alias("bin_high"))
                      for i, (a, b) in enumerate(zip(bins[:-1], bins[1:]))])
    # One row per key that occurs: the frame of bins is exploded from a literal, the sums are tiny.
    groups = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("_g"))
    frame = groups.select(*keys, F.explode(edges).alias("e")).select(*keys, "e.*")
    t = frame.join(sums, [*keys, "bin"], "left")
    n, wins = F.coalesce("n", F.lit(0)), F.col("wins")
    rate, mean = wins / F.when(n > 0, n), F.col("sum_q") / F.when(n > 0, n)
    low, high = wilson_low_high(wins, n)
    return t.select(*keys, "bin_low", "bin_high", n.alias("n"), mean.alias("mean_predicted"),
                    rate.alias("actual_win_rate"), low.alias("lower_ci"), high.alias("upper_ci"), (rate - mean).alias("gap"))


def calibration_errors(table: DataFrame, keys: list[str] = []) -> DataFrame:
    """ECE = sum n/N |gap|, MCE = max |gap| over non-empty bins."""
    t = table.filter("n > 0")
    return t.groupBy(*keys).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"),
                                F.max(F.abs("gap")).alias("mce"))


def brier_decomposition(scores: DataFrame, keys: list[str] = [], bins: list[float] = BINS) -> DataFrame:
    """Murphy decomposition on binned, favourite-folded forecasts, from per-bin sums only:
    sum n (o_k - obar)^2 = sum o_k wins_k - N obar^2."""
    binned = F.col("bin").isNotNull()
    gap = (F.col("sum_q") - F.col("wins")) / F.col("n")
    g = _bin_sums(scores, keys, bins).groupBy(*keys).agg(
        F.sum(F.when(binned, F.col("n"))).alias("nb"), F.sum(F.when(binned, F.col("n") * gap * gap)).alias("rel"),
        F.sum(F.when(binned, F.col("wins") * F.col("wins") / F.col("n"))).alias("ww"),
        F.sum(F.when(binned, F.col("wins"))).alias("w"), (F.sum("wins") / F.sum("n")).alias("obar"))
    resolution = (F.col("ww") - 2 * F.col("obar") * F.col("w") + F.col("nb") * F.col("obar") * F.col("obar")) / F.col("nb")
    return g.select(*keys, (F.col("rel") / F.col("nb")).alias("reliability"), resolution.alias("resolution"),
                    (F.col("obar") * (1 - F.col("obar"))).alias("uncertainty"))


def score_metrics(scores: DataFrame, keys: list[str] = []) -> DataFrame:
    """n, accuracy (coin on exact ties), Brier and log loss, one pass."""
    p, y = clip_p(F.col("p")), F.col("target").cast("double")
    pick = F.when(p > 0.5, 1).when(p < 0.5, 0).otherwise(tie_coin(F.col("contest_id")))
    loss = -F.when(F.col("target") == 1, F.log(p)).otherwise(F.log(F.lit(1.0) - p))
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_contests"), F.avg((pick == F.col("target")).cast("double")).alias("accuracy"),
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss).alias("log_loss"))


def roc_auc(scores: DataFrame, keys: list[str] = []) -> DataFrame:
    """AUC over both orientations (p, y) and (1-p, 1-y): Mann-Whitney with ties as one half.

    Ranks come from running counts over *distinct* probabilities in 4096 value blocks, so neither
    a heavy probability nor a heavy group is sorted in one task.
    """
    p = F.round(clip_p(F.col("p")), 12)
    two = scores.select(*keys, F.explode(F.array(
        F.struct(p.alias("p"), F.col("target").cast("long").alias("y")),
        F.struct(F.round(F.lit(1.0) - p, 12).alias("p"), (1 - F.col("target")).cast("long").alias("y")))).alias("s")).select(*keys, "s.*")
    hist = ranked_histogram(two, keys, "p", F.floor(F.col("p") * 4096),
                            {"pos": F.sum("y"), "neg": F.sum(1 - F.col("y"))})
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    g = hist.groupBy(*keys).agg(area.alias("_a"), F.max("pos_all").alias("_p"), F.max("neg_all").alias("_n"))
    pairs = F.col("_p").cast("double") * F.col("_n")
    return g.select(*keys, (F.col("_a") / F.when(pairs > 0, pairs)).alias("roc_auc"))


def evaluate(scores: DataFrame, keys: list[str], bins: list[float] = BINS) -> DataFrame:
    """All metrics per key group on one row."""
    out = score_metrics(scores, keys)
    for part in (calibration_errors(calibration_table(scores, keys, bins), keys),
                 brier_decomposition(scores, keys, bins), roc_auc(scores, keys)):
        out = out.join(part, keys, "left")
    return out


def missingness_report(rows: DataFrame, columns: list[str], target: str = "target", min_share: float = 0.01,
                       min_rows: int = 30) -> DataFrame:
    """Share missing and target rate when missing / present, one wide aggregate then unpivot."""
    y = F.col(target).cast("double")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        null = F.col(c).isNull()
        aggs += [F.count_if(null).alias(f"m{i}"), F.avg(F.when(null, y)).alias(f"a{i}"), F.avg(F.when(~null, y)).alias(f"b{i}")]
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("n_missing"),
                                 (F.col(f"m{i}") / F.col("_n")).alias("missing_share"),
                                 F.col(f"a{i}").alias("target_rate_missing"), F.col(f"b{i}").alias("target_rate_present"))
                        for i, c in enumerate(columns)])
    return (rows.agg(*aggs).select(F.explode(entries).alias("e")).select("e.*")
            .filter((F.col("missing_share") >= min_share) & (F.col("n_missing") >= min_rows)).drop("n_missing"))
