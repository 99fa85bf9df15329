"""Declared schemas, typed casts with failure counts, and the raw -> typed cleaning rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.parse import finish_group
from . import measures

#: Type of a column by its name; whole numbers otherwise.
_KINDS = {"bool": "(is|has)_.*", "timestamp": ".*_at", "date": "dob|.*_date", "category": "result|finish_group|division|stance", "float": ".*_(in|lb)",
          "string": ".*_id|.*name|location|method"}


def kind_of(column: str) -> str:
    return next((kind for kind, names in _KINDS.items() if re.fullmatch(names, column)), "int")


def _declared(columns: str) -> dict[str, str]:
    """Column -> type; `entity_#_x` stands for both sides."""
    names = [n for c in columns.split() for n in ([c.replace("#", s) for s in "12"] if "#" in c else [c])]
    return {n: kind_of(n) for n in names}


#: Columns of the tables (fixed values: the stored format).
SCHEMA = {
    "events": _declared("event_id event_name event_date location loaded_at"),
    "contests": _declared("contest_id event_id event_date bout_order entity_#_id entity_#_name winner_id result method finish_group end_round end_time_sec scheduled_rounds division is_title is_target has_stats"),
    "stats": _declared(" ".join(["contest_id entity_id opponent_id", *measures.columns()])),
    "entities": _declared("entity_id name nickname height_in weight_lb reach_in stance dob loaded_at"),
}
KEYS = {"events": ["event_id"], "contests": ["contest_id"], "stats": ["contest_id", "entity_id"], "entities": ["entity_id"]}


# ------------------------------------------------------------------ typed casts

def cast_column(raw: Column, kind: str) -> Column:
    """The cast rule of a logical type; anything unparseable becomes NULL."""
    text = F.trim(raw)
    if kind in ("string", "category"):
        return F.nullif(raw, F.lit(""))
    if kind == "int":
        num = text.try_cast("double")
        return F.when(num % 1 == 0, num).try_cast("bigint")
    if kind == "float":
        num = text.try_cast("double")
        return F.when(~F.isnan(num), num)
    if kind == "bool":
        low = F.lower(text)
        return F.when(low.isin("1", "true"), True).when(low.isin("0", "false"), False)
    if kind == "date":
        return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
    if kind == "timestamp":
        return F.try_to_timestamp(text)
    raise ValueError(f"unknown type {kind!r}")


def typed(raw: DataFrame, schema: dict[str, str], keep: list[str] = []) -> DataFrame:
    """Strings -> declared types, in declared column order."""
    return raw.select(*keep, *[cast_column(F.col(c), k).alias(c) for c, k in schema.items()])


def parse_failures(raw: DataFrame, schema: dict[str, str], table: str) -> DataFrame:
    """(table, column, rows): non-blank cells that became NULL; all columns in one aggregate."""
    failed = [F.count_if((F.trim(F.coalesce(F.col(c), F.lit(""))) != "") & cast_column(F.col(c), k).isNull()).alias(c) for c, k in schema.items()]
    counts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in schema])
    return (raw.agg(*failed).select(F.explode(counts).alias("e"))
            .select(F.lit(table).alias("table"), "e.column", "e.rows").filter("rows > 0"))


def export_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Typed -> text in schema order: dates `yyyy-MM-dd`, bools 0/1, ints rounded, timestamps ISO."""
    out = []
    for c, k in schema.items():
        col = F.col(c)
        if k == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif k == "timestamp":
            col = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ssxx")
        elif k == "bool":
            col = col.cast("int").cast("string")
        elif k == "int":
            col = F.bround(col.cast("double"), 0).cast("bigint").cast("string")
        else:
            col = col.cast("string")
        out.append(col.alias(c))
    return df.select(*out)


# ------------------------------------------------------------------ row rules

def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in an explicit order; the rank limit prunes copies before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def cutoff_flags(contests: DataFrame, min_date: str) -> DataFrame:
    """One table with `is_prior`: earlier contests are history only, never targets, never stats."""
    prior = F.col("event_date") < F.lit(min_date).cast("date")
    return contests.withColumns({
        "is_prior": prior, "is_target": ~prior & F.coalesce(F.col("result") == "win", F.lit(False)),
        "has_stats": ~prior & F.coalesce(F.col("has_stats"), F.lit(False))})


def stat_pair_reasons(stats: DataFrame, contests: DataFrame) -> DataFrame:
    """Stat rows with the reason for removal (NULL = kept): orphan, wrong sides, not exactly two.

    Row counts per contest are aggregated first (map-side) and joined back, so a contest id with
    very many rows is not gathered in one window."""
    c = contests.select("contest_id", "entity_1_id", "entity_2_id", F.lit(True).alias("_known"))
    j = stats.join(c, "contest_id", "left")
    mine, other = F.col("entity_id"), F.col("opponent_id")
    fits = ((mine == F.col("entity_1_id")) & (other == F.col("entity_2_id"))) | ((mine == F.col("entity_2_id")) & (other == F.col("entity_1_id")))
    j = j.withColumn("_reason", F.when(F.col("_known").isNull(), "contest dropped (before min_date or invalid)")
                     .when(~F.coalesce(fits, F.lit(False)), "sides not matching the contest"))
    counts = j.filter("_reason is null").groupBy("contest_id").agg(F.count(F.lit(1)).alias("_n"))
    j = j.join(counts, "contest_id", "left")
    reason = F.coalesce("_reason", F.when(F.col("_n") != 2, "contest has 1 or more than 2 stat rows"))
    return j.select(*stats.columns, reason.alias("drop_reason"))


def drop_report(tagged: dict[str, DataFrame]) -> DataFrame:
    """(table, reason, rows) over row sets tagged with `drop_reason`; one aggregate per table."""
    out = None
    for table, df in tagged.items():
        part = df.filter("drop_reason is not null").groupBy("drop_reason").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(table).alias("table"), F.col("drop_reason").alias("reason"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def clean_tables(raw: dict[str, DataFrame], min_date: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Raw string tables (each with `row_no`) -> (typed tables with prior contests flagged, drop report)."""
    raw_contests = raw["contests"].withColumns({
        "finish_group": finish_group(F.nullif(F.col("method"), F.lit(""))), "is_target": F.lit("0"), "has_stats": F.lit("1")})
    tagged = {}
    for t, schema in SCHEMA.items():
        df = typed(raw_contests if t == "contests" else raw[t], schema, ["row_no"])
        undated = F.col("event_date").isNull() if t in ("events", "contests") else F.lit(False)
        df = df.withColumn("_undated", undated)
        first = df.filter("not _undated").groupBy(*KEYS[t]).agg(F.min("row_no").alias("_first"))
        # Aggregate and join back: a key with very many copies is never gathered in one window.
        df = df.join(first, KEYS[t], "left")
        tagged[t] = df.withColumn("drop_reason", F.when(F.col("_undated"), "event_date missing or unparseable")
                                  .when(~F.col("row_no").eqNullSafe(F.col("_first")), "duplicate key")).drop("_undated", "_first")
    kept = {t: df.filter("drop_reason is null").drop("drop_reason", "row_no") for t, df in tagged.items()}

    contests = cutoff_flags(kept["contests"], min_date)
    current = contests.filter(~F.col("is_prior"))
    reasons = stat_pair_reasons(kept["stats"], current)
    stats = reasons.filter("drop_reason is null").drop("drop_reason")
    with_stats = stats.select("contest_id").distinct().withColumn("_s", F.lit(True))
    contests = contests.join(with_stats, "contest_id", "left").withColumn("has_stats", ~F.col("is_prior") & F.coalesce("_s", F.lit(False))).drop("_s")
    used = current.select("event_id").distinct().withColumn("_used", F.lit(True))
    events = kept["events"].join(used, "event_id", "left")
    report = drop_report({
        **tagged, "contests (prior)": contests.withColumn("drop_reason", F.when(F.col("is_prior"), f"before min_date {min_date} (history only)")),
        "stats (pairs)": reasons,
        "events (unused)": events.withColumn("drop_reason", F.when(F.col("_used").isNull(), "no contests on or after min_date"))})
    tables = {"events": events.filter("_used").drop("_used"), "contests": contests, "stats": stats, "entities": kept["entities"]}
    return tables, report.withColumn("table", F.regexp_replace("table", r" \(.*\)$", ""))
