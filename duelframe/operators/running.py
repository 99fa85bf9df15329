"""Order-dependent building blocks that stay parallel when one key holds most of the rows.

A plain window puts a whole key into one task. Here a key is cut into blocks along its order;
rows are only ever sorted inside a block, block totals are scanned per key (one row per
block), and the block's offset is added back with an equi join on (key, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

ORDINAL_BLOCK = 1 << 16
#: Bytes of stored input a task of `spread`.
TASK_BYTES = 1 << 20


def before(window):
    """All rows of the window strictly before the current one."""
    return window.rowsBetween(W.unboundedPreceding, -1)


def upto(window):
    """All rows of the window up to and including the current one."""
    return window.rowsBetween(W.unboundedPreceding, 0)


def task_count(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks for a shuffle of `df`, one for each `task_bytes` of the files that it reads; 0 where it reads none."""
    spark, size = df.sparkSession, 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return -(-size // task_bytes)


def spread(df: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """`df` shuffled by the keys. Their number follows the input, so that a task's share does not grow with it; small inputs are left to Spark."""
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def sequence_in_group(df: DataFrame, keys: list[str], ordinal: str, out: str,
                      block: int = ORDINAL_BLOCK) -> DataFrame:
    """1-based position of each row inside its group, by a unique integer `ordinal`.

    Equal to `row_number()` over (keys, ordinal); a group is numbered in blocks of `block`
    consecutive ordinals, so no task holds more than `block` rows of it.
    """
    blocked = df.withColumn("_blk", F.floor(F.col(ordinal) / F.lit(block)))
    sizes = blocked.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    by_key = W.partitionBy(*keys).orderBy("_blk")
    offsets = sizes.select(*keys, "_blk",
                           F.coalesce(F.sum("_n").over(before(by_key)), F.lit(0)).alias("_off"))
    in_block = W.partitionBy(*keys, "_blk").orderBy(ordinal)
    return (blocked.withColumn("_rn", F.row_number().over(in_block))
            .join(offsets, [*keys, "_blk"])
            .withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint"))
            .drop("_blk", "_rn", "_off"))


def ranked_histogram(df: DataFrame, keys: list[str], value: str, bucket: Column,
                     measures: dict[str, Column]) -> DataFrame:
    """One row per (keys, value) with the measures and their exclusive running totals by value.

    `bucket` must be monotone in `value`; it cuts a key's distinct values into blocks. Copies of
    one value collapse in the first aggregation (map-side), so a heavy value is one row.
    Adds `<measure>_below` (total over smaller values) and `<measure>_all` (group total).
    """
    hist = df.groupBy(*keys, value).agg(*[m.alias(n) for n, m in measures.items()]).withColumn("_b", bucket)
    totals = hist.groupBy(*keys, "_b").agg(*[F.sum(n).alias(n) for n in measures])
    by_key = W.partitionBy(*keys).orderBy("_b") if keys else W.partitionBy(F.lit(1)).orderBy("_b")
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    offsets = totals.select(
        *keys, "_b",
        *[F.coalesce(F.sum(n).over(before(by_key)), F.lit(0)).alias(f"_{n}__off") for n in measures],
        *[F.sum(n).over(whole).alias(f"{n}_all") for n in measures])
    in_block = W.partitionBy(*keys, "_b").orderBy(value)
    local = hist.select("*", *[F.coalesce(F.sum(n).over(before(in_block)), F.lit(0)).alias(f"_{n}__in")
                               for n in measures])
    joined = local.join(offsets, [*keys, "_b"])
    return joined.select(
        *keys, value, *measures,
        *[(F.col(f"_{n}__in") + F.col(f"_{n}__off")).alias(f"{n}_below") for n in measures],
        *[f"{n}_all" for n in measures])


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median", bucket_width: float = 1.0,
                 n: str | None = None) -> DataFrame:
    """Exact interpolating median per group (mean of the two middle values for even counts).

    Rank selection over the value histogram: the middle ranks are found from running counts, so a
    group is never collected. NULL values are ignored; `n` names a weight column, if the input is
    already counted.
    """
    present = df.filter(F.col(value).isNotNull())
    weight = F.sum(n) if n else F.count(F.lit(1))
    hist = ranked_histogram(present, keys, value, F.floor(F.col(value) / F.lit(bucket_width)), {"_n": weight})
    lower, upper = F.floor((F.col("_n_all") + 1) / 2), F.floor((F.col("_n_all") + 2) / 2)

    def holds(rank: Column) -> Column:
        return (rank > F.col("_n_below")) & (rank <= F.col("_n_below") + F.col("_n"))

    return hist.groupBy(*keys).agg(
        ((F.max(F.when(holds(lower), F.col(value))) + F.max(F.when(holds(upper), F.col(value)))) / 2).alias(out))
