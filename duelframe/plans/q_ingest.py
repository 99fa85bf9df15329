"""Queries: ingest of text sources, quarantine, cleaning rules, merges and data checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import ingest as I
from ..operators import merge as G
from ..operators import quality as Q
from ..operators import store as B
from ..operators.running import sequence_in_group
from ..session import cut_lineage, shared_path
from ..sources import files
from . import source_views as S
from . import views as V
from .oracle import r6 as q6, sql
from .registry import query
from .views import r6

_HEX = "lower(to_hex({}))"


@query("entity_full_outer", sql(f"""SELECT {_HEX.format('s_suppkey')} AS entity_id, s_name_out AS name, nickname, height_in, weight_lb, dob FROM (
  SELECT s_suppkey, CASE WHEN s_suppkey % 11 <> 0 THEN replace(s_name, '#', ' ') ELSE s_name END AS s_name_out,
    CASE WHEN s_suppkey % 11 <> 0 AND s_suppkey % 4 = 0 THEN 'Nick ' || s_nationkey END AS nickname,
    CASE WHEN s_suppkey % 13 <> 0 THEN e.height_in END AS height_in, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey % 150 + 115 END::DOUBLE AS weight_lb,
    CASE WHEN s_suppkey % 13 <> 0 THEN e.dob END AS dob
  FROM supplier JOIN entity e ON e.entity_id = s_suppkey
  WHERE (s_suppkey % 11 <> 0 OR s_suppkey % 13 <> 0) AND NOT (s_suppkey % 13 <> 0 AND s_suppkey % 17 = 0))""", "entity"))
def _(spark, d):
    entities, _, _ = I.build_entities(S.details(spark, d), S.measures(spark, d), S.LOADED_AT)
    return entities.select("entity_id", "name", "nickname", "height_in", "weight_lb", "dob")


_PLACED = f"event_date <= DATE '{S.TODAY}'"


def _placed(spark, d):
    """Placed result rows; results and meetings are printed from contests that are stored once."""
    c = V.stored_contests(spark, d, with_stats=False)
    return I.place_results(S.results(spark, d, c), I.build_events(S.meetings(spark, d, c), S.TODAY, S.LOADED_AT))


@query("event_lookup", sql(f"""SELECT contest_id * 3 AS row_no, CASE WHEN {_PLACED} THEN replace(event_id, '-', 'e') END AS event_id,
  CASE WHEN {_PLACED} THEN event_date END AS event_date FROM slated""", "slated"))
def _(spark, d):
    placed = _placed(spark, d)
    return placed.filter("event not like 'Old%' and (reason is null or reason <> 'duplicate contest id') and row_no % 3 = 0").select("row_no", "event_id", "event_date")


@query("stale_duplicate_drop", sql(f"SELECT count(*) FILTER (contest_id % 97 = 0 AND contest_id % 101 <> 0 AND {_PLACED}) AS stale_rows FROM contest", "contest"))
def _(spark, d):
    placed = _placed(spark, d)
    return placed.agg(F.count_if(F.col("reason") == "stale event name").alias("stale_rows"))


@query("future_filter", sql(f"SELECT count(DISTINCT event_id) AS events, max(event_date) AS last_day FROM slated WHERE {_PLACED}", "slated"))
def _(spark, d):
    return I.build_events(S.meetings(spark, d), S.TODAY, S.LOADED_AT).agg(F.count(F.lit(1)).alias("events"), F.max("event_date").alias("last_day"))


# Both bio files lack an entity whose key is divisible by 11 and 13: such names stay unmatched.
_UNNAMED = "(entity_1_id % 143 = 0 OR (entity_2_id % 143 = 0 AND contest_id % 73 <> 0))"
_CAUSE = f"""CASE WHEN contest_id % 101 = 0 THEN 'no contest id' WHEN NOT {_PLACED} THEN 'event not in' WHEN copy = 2 THEN 'duplicate'
  WHEN contest_id % 83 = 0 THEN 'cannot split' WHEN contest_id % 79 = 0 OR {_UNNAMED} THEN 'name unmatched' WHEN contest_id % 73 = 0 THEN 'both names'
  WHEN contest_id % 71 = 0 THEN 'unknown outcome' WHEN contest_id % 67 = 0 THEN 'parse error' END"""
_COPIES = """copies AS (SELECT *, 0 AS copy FROM slated UNION ALL SELECT *, 1 FROM slated WHERE contest_id % 97 = 0 UNION ALL SELECT *, 2 FROM slated WHERE contest_id % 89 = 0)"""


@query("quarantine", sql(f"""WITH {_COPIES} SELECT cause, count(*) AS n FROM (SELECT {_CAUSE} AS cause, copy, contest_id, event_date FROM copies)
  WHERE cause IS NOT NULL AND NOT (copy = 1 AND contest_id % 101 <> 0 AND {_PLACED}) GROUP BY 1""", "slated"))
def _(spark, d):
    entities, names, _ = I.build_entities(S.details(spark, d), S.measures(spark, d), S.LOADED_AT)
    events = I.build_events(S.meetings(spark, d), S.TODAY, S.LOADED_AT)
    _, _, bad = I.build_contests(S.results(spark, d), events, names, entities)
    cause = F.regexp_extract("reason", "^(no contest id|event not in|duplicate|cannot split|name unmatched|both names|unknown outcome|parse error)", 1)
    return bad.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query("bout_sequence", sql(f"""SELECT {_HEX.format('contest_id')} AS contest_id, row_number() OVER (PARTITION BY event_id ORDER BY contest_id)::INT AS bout_order
  FROM slated WHERE contest_id % 101 <> 0 AND {_PLACED}""", "slated"))
def _(spark, d):
    placed = _placed(spark, d)
    return sequence_in_group(placed.filter("reason is null"), ["event_id"], "row_no", "bout_order").select("contest_id", "bout_order")


@query("unique_key_join", sql("""SELECT event, bout_key, contest_id FROM (SELECT 'Slate ' || event_id AS event, entity_1_id || ' v ' || entity_2_id AS bout_key, lower(to_hex(min(contest_id))) AS contest_id,
  count(DISTINCT contest_id) AS n FROM slated GROUP BY 1, 2) WHERE n = 1""", "slated"))
def _(spark, d):
    c = V.slate_columns(V.contests(spark, d, False))
    r = c.select(F.concat(F.lit("Slate "), "event_id").alias("event"), F.concat("entity_1_id", F.lit(" v "), "entity_2_id").alias("bout"),
                 F.concat(F.lit("/fight-details/"), F.lower(F.hex("contest_id"))).alias("url"))
    return I.bout_keys(r).withColumnRenamed("bout", "bout_key")


_KEPT = f"""kept AS (SELECT * FROM slated WHERE contest_id % 101 <> 0 AND {_PLACED} AND contest_id % 83 <> 0 AND contest_id % 79 <> 0 AND contest_id % 73 <> 0
  AND contest_id % 71 <> 0 AND contest_id % 67 <> 0 AND NOT {_UNNAMED}),
  keyed AS (SELECT k.*, count(*) OVER (PARTITION BY event_id, entity_1_id, entity_2_id) AS same_key FROM slated k
    WHERE contest_id % 101 <> 0 AND contest_id % 83 <> 0 AND contest_id % 79 <> 0 AND contest_id % 73 <> 0),
  rr AS (SELECT l_orderkey, l_suppkey, l_linenumber, sum(l_quantity)::INT AS a, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END)::INT AS l,
    count(*) FILTER (l_returnflag = 'A') AS kd, max(l_linestatus) AS st FROM lineitem GROUP BY 1, 2, 3),
  listed AS (SELECT k.contest_id, s.contest_id AS src, l_suppkey, rr.* EXCLUDE (l_orderkey, l_suppkey) FROM kept k JOIN keyed y ON y.contest_id = k.contest_id AND same_key = 1
    JOIN slated s ON s.event_id = k.event_id AND s.entity_1_id = k.entity_1_id AND s.entity_2_id = k.entity_2_id
      AND s.contest_id % 83 <> 0 AND s.contest_id % 79 <> 0 AND s.contest_id % 73 <> 0
    JOIN rr ON l_orderkey = s.contest_id AND l_suppkey IN (k.entity_1_id, k.entity_2_id)
    QUALIFY row_number() OVER (PARTITION BY k.contest_id, l_suppkey, l_linenumber ORDER BY s.contest_id) = 1)"""


def _built(spark, d):
    tables, rejected = I.build_tables(S.sources(spark, d), S.TODAY, S.LOADED_AT)
    return tables, rejected


@query("round_totals", sql(f"""WITH {_KEPT} SELECT lower(to_hex(contest_id)) AS contest_id, lower(to_hex(l_suppkey)) AS entity_id, sum(l)::DOUBLE AS landed, sum(a)::DOUBLE AS attempted,
  sum(kd)::DOUBLE AS kd, sum(CASE WHEN st <> 'F' THEN l END)::DOUBLE AS td_landed, sum(CASE WHEN src % 4 <> 0 THEN l_linenumber END)::DOUBLE AS ctrl_sec
  FROM listed GROUP BY listed.contest_id, l_suppkey""", "slated"))
def _(spark, d):
    tables, _ = _built(spark, d)
    return tables["stats"].select("contest_id", "entity_id", "landed", "attempted", "kd", "td_landed", "ctrl_sec")


@query("name_within_group_join", sql(f"""WITH {_KEPT} SELECT lower(to_hex(contest_id)) AS contest_id, lower(to_hex(l_suppkey)) AS entity_id, count(*) AS rounds FROM listed GROUP BY ALL""", "slated"))
def _(spark, d):
    from ..functions.names import normalize_name
    src = S.sources(spark, d)
    entities, names, _ = I.build_entities(src["details"], src["measures"], S.LOADED_AT)
    contests, name_map, _ = I.build_contests(src["results"], I.build_events(src["meetings"], S.TODAY, S.LOADED_AT), names, entities)
    rounds = src["rounds"].join(I.bout_keys(src["results"]), ["event", "bout"]).withColumn("norm", normalize_name(F.col("name")))
    return rounds.join(name_map, ["contest_id", "norm"]).groupBy("contest_id", "entity_id").agg(F.countDistinct("round").alias("rounds"))


@query("load_manifest", sql("""SELECT 'source' AS stage, 'details' AS table, count(*) AS rows FROM supplier WHERE s_suppkey % 11 <> 0
  UNION ALL SELECT 'source', 'measures', count(*) FROM supplier WHERE s_suppkey % 13 <> 0
  UNION ALL SELECT 'source', 'meetings', count(DISTINCT event_id) FROM slated
  UNION ALL SELECT 'source', 'results', count(*) + count(*) FILTER (contest_id % 97 = 0) + count(*) FILTER (contest_id % 89 = 0) FROM slated""", "slated"))
def _(spark, d):
    src = S.sources(spark, d)
    return G.manifest({k: src[k] for k in ("details", "measures", "meetings", "results")}, {})


# ------------------------------------------------------------------ typed casts and exports

_ORDER_SCHEMA = {"id": "string", "n": "int", "x": "float", "b": "bool", "d": "date", "t": "timestamp"}


def _order_strings(spark, d):
    key = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(
        key.cast("string").alias("id"),
        F.when(key % 7 == 0, "").when(key % 11 == 0, F.concat("o_custkey", F.lit(".5"))).when(key % 13 == 0, "many").otherwise(F.concat("o_custkey", F.lit(".0"))).alias("n"),
        F.when(key % 17 == 0, "1,5").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).alias("x"),
        F.when(key % 5 == 0, " TRUE ").when(key % 5 == 1, "0").when(key % 5 == 2, "yes").otherwise("1").alias("b"),
        F.when(key % 19 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
        F.when(key % 23 == 0, "soon").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00+00:00"))).alias("t"))


_CASTS = """SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS n,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS x, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS b,
  CASE WHEN o_orderkey % 19 <> 0 THEN o_orderdate::DATE END AS d, CASE WHEN o_orderkey % 23 <> 0 THEN o_orderdate::TIMESTAMP + INTERVAL 10 HOUR END AS t FROM orders"""


@query("typed_cast", _CASTS)
def _(spark, d):
    return C.typed(_order_strings(spark, d), _ORDER_SCHEMA)


@query("parse_failure_counts", """SELECT 'orders' AS table, * FROM (
  SELECT 'n' AS column, count(*) FILTER (o_orderkey % 7 <> 0 AND (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0)) AS rows FROM orders
  UNION ALL SELECT 'x', count(*) FILTER (o_orderkey % 17 = 0) FROM orders UNION ALL SELECT 'b', count(*) FILTER (o_orderkey % 5 = 2) FROM orders
  UNION ALL SELECT 'd', count(*) FILTER (o_orderkey % 19 = 0) FROM orders UNION ALL SELECT 't', count(*) FILTER (o_orderkey % 23 = 0) FROM orders)""")
def _(spark, d):
    return C.parse_failures(_order_strings(spark, d), _ORDER_SCHEMA, "orders")


@query("typed_export", """SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END::VARCHAR AS n,
  CASE o_orderkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN NULL ELSE '1' END AS b, CASE WHEN o_orderkey % 19 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d,
  CASE WHEN o_orderkey % 23 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00+0000' END AS t FROM orders""")
def _(spark, d):
    schema = {k: v for k, v in _ORDER_SCHEMA.items() if k != "x"}
    return C.export_columns(C.typed(_order_strings(spark, d), schema), schema)


@query("sorted_export", """SELECT o_orderkey, o_orderdate, o_custkey, true AS in_order FROM orders""")
def _(spark, d):
    """Orders as a stored table sorted by (day, key), read back with each row compared to the one before it in its file."""
    path, keys = shared_path(spark, "sorted"), ["o_orderdate", "o_orderkey"]
    files.write_sorted(V.table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey"), path, keys)
    stored = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = W.partitionBy("file").orderBy("at")
    key = F.struct(*keys)
    return stored.select("o_orderkey", "o_orderdate", "o_custkey", F.coalesce(F.lag(key).over(before) <= key, F.lit(True)).alias("in_order"))


@query("scan_trimmed_strings", "SELECT c_custkey::VARCHAR AS id, trim(c_name) AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, 'NA' AS na FROM customer")
def _(spark, d):
    path = files.write_strings(V.table(spark, d, "customer").select(
        F.concat(F.lit(" "), "c_custkey").alias("id"), F.concat(F.lit("  "), "c_name", F.lit("  ")).alias(" name "),
        F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("segment"), F.lit("NA").alias("na")), "strings")
    return files.read_strings(spark, path, ["id", "name", "segment", "na"]).drop("row_no")


@query("scan_typed", _CASTS.replace(", CASE WHEN o_orderkey % 23 <> 0 THEN o_orderdate::TIMESTAMP + INTERVAL 10 HOUR END AS t", ""))
def _(spark, d):
    schema = {k: v for k, v in _ORDER_SCHEMA.items() if k != "t"}
    path = files.write_strings(_order_strings(spark, d).drop("t"), "typed")
    return files.read_typed(spark, path, schema)


@query("scan_with_file_name", "SELECT 'region_year=' || year(o_orderdate) AS file, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY 1")
def _(spark, d):
    o = V.table(spark, d, "orders").select(F.year("o_orderdate").alias("region_year"), F.col("o_custkey").cast("string").alias("custkey"))
    path = files.write_strings(o, "by-year", partition="region_year")
    rows = files.read_with_file_name(spark, path, ["custkey"])
    folder = F.regexp_extract("file_path", r"(region_year=\d+)", 1)
    return rows.groupBy(folder.alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("custkey").cast("bigint")).alias("keys"))


# ------------------------------------------------------------------ cleaning rules

@query("cutoff_split", sql("""SELECT is_prior, result, count(*) AS n, count(*) FILTER (is_target) AS targets, count(*) FILTER (has_stats AND NOT is_prior) AS with_stats FROM contest GROUP BY 1, 2""", "contest"))
def _(spark, d):
    c = C.cutoff_flags(V.contests(spark, d, False), V.MIN_DATE)
    return c.groupBy("is_prior", "result").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_target").alias("targets"), F.count_if("has_stats").alias("with_stats"))


@query("target_flag", sql("SELECT count(*) FILTER (is_target) AS is_target, count(*) FILTER (NOT is_prior AND result = 'draw') AS excluded_draw, count(*) FILTER (NOT is_prior AND result = 'nc') AS excluded_nc FROM contest", "contest"))
def _(spark, d):
    c = C.cutoff_flags(V.contests(spark, d, False), V.MIN_DATE).filter("not is_prior")
    return c.agg(F.count_if("is_target").alias("is_target"), F.count_if(F.col("result") == "draw").alias("excluded_draw"), F.count_if(F.col("result") == "nc").alias("excluded_nc"))


def _faulty_stats(spark, d):
    """Stat rows with faults: one row missing, one doubled, or one with a wrong opponent."""
    key = F.col("contest_id")
    s = V.stats(spark, d).withColumn("first", F.col("entity_id") < F.col("opponent_id"))
    s = s.filter(~((key % 19 == 0) & F.col("first")))
    s = s.withColumn("opponent_id", F.when((key % 37 == 0) & F.col("first"), F.lit(-1)).otherwise(F.col("opponent_id")))
    return s.withColumn("copy", F.explode(F.when((key % 31 == 0) & F.col("first"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


_FAULTY = """faulty AS (SELECT s.*, entity_id < opponent_id AS first FROM stats s WHERE NOT (contest_id % 19 = 0 AND entity_id < opponent_id)
  UNION ALL SELECT s.*, true FROM stats s WHERE contest_id % 31 = 0 AND contest_id % 19 <> 0 AND entity_id < opponent_id),
  judged AS (SELECT f.contest_id, f.entity_id, CASE WHEN c.contest_id IS NULL THEN 'contest dropped (before min_date or invalid)'
    WHEN f.contest_id % 37 = 0 AND first THEN 'sides not matching the contest' END AS reason0 FROM faulty f LEFT JOIN contest c ON c.contest_id = f.contest_id AND NOT is_prior),
  final AS (SELECT *, coalesce(reason0, CASE WHEN count(*) FILTER (reason0 IS NULL) OVER (PARTITION BY contest_id) <> 2 THEN 'contest has 1 or more than 2 stat rows' END) AS reason FROM judged)"""


def _reasons(spark, d):
    return C.stat_pair_reasons(_faulty_stats(spark, d), V.contests(spark, d, False).filter("not is_prior"))


@query("pair_integrity", sql(f"WITH {_FAULTY} SELECT contest_id, entity_id, count(*) AS n FROM final WHERE reason = 'sides not matching the contest' GROUP BY 1, 2", "stats", "contest"))
def _(spark, d):
    return _reasons(spark, d).filter("drop_reason = 'sides not matching the contest'").groupBy("contest_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("exact_pair_filter", sql(f"WITH {_FAULTY} SELECT contest_id, count(*) AS n FROM final WHERE reason IS NULL GROUP BY 1", "stats", "contest"))
def _(spark, d):
    return _reasons(spark, d).filter("drop_reason is null").groupBy("contest_id").agg(F.count(F.lit(1)).alias("n"))


@query("drop_report", sql(f"WITH {_FAULTY} SELECT 'stats' AS table, reason, count(*) AS rows FROM final WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT 'contests', 'before min_date', count(*) FROM contest WHERE is_prior", "stats", "contest"))
def _(spark, d):
    prior = V.contests(spark, d, False).withColumn("drop_reason", F.when(F.col("is_prior"), "before min_date"))
    return C.drop_report({"stats": _reasons(spark, d), "contests": prior})


@query("dedupe_keep_first", """SELECT l_orderkey, l_linenumber, min(l_partkey * 1000000 + l_suppkey) AS first_key FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("first_key"))
    return C.keep_first(li, ["l_orderkey", "l_linenumber"], ["first_key"])


@query("orphan_rows", """SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') GROUP BY 1""")
def _(spark, d):
    recent = V.table(spark, d, "orders").filter("o_orderdate >= timestamp '1996-01-01'").select(F.col("o_orderkey").alias("l_orderkey"))
    return Q.orphan_rows(V.table(spark, d, "lineitem"), recent, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("key_set_diff", """SELECT CASE WHEN c IS NULL THEN 'only_supplier' WHEN s IS NULL THEN 'only_customer' ELSE 'both' END AS side, count(*) AS n FROM
  (SELECT DISTINCT c_nationkey * 100 + c_custkey % 100 AS k, 1 AS c FROM customer) FULL JOIN (SELECT DISTINCT s_nationkey * 100 + s_suppkey % 100 AS k, 1 AS s FROM supplier) USING (k) GROUP BY 1""")
def _(spark, d):
    c = V.table(spark, d, "customer").select((F.col("c_nationkey") * 100 + F.col("c_custkey") % 100).alias("k")).distinct()
    s = V.table(spark, d, "supplier").select((F.col("s_nationkey") * 100 + F.col("s_suppkey") % 100).alias("k")).distinct()
    parts = [("only_customer", c.join(s, "k", "left_anti")), ("only_supplier", s.join(c, "k", "left_anti")), ("both", c.join(s, "k", "left_semi"))]
    out = None
    for name, df in parts:
        part = df.groupBy(F.lit(name).alias("side")).agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ merges

_STORED_UNTIL = "1999-01-01"


def _stored_and_new(spark, d):
    c = V.stored_contests(spark, d, with_stats=False).select("contest_id", "event_date", "result", "winner_id")
    stored = c.filter(F.col("event_date") < F.lit(_STORED_UNTIL).cast("date")).withColumn("result", F.lit("old"))
    return stored, c


@query("insert_only_merge", sql(f"SELECT contest_id, event_date, CASE WHEN event_date < DATE '{_STORED_UNTIL}' THEN 'old' ELSE result END AS result, winner_id FROM contest", "contest"))
def _(spark, d):
    stored, new = _stored_and_new(spark, d)
    return G.insert_only(stored, new.unionByName(new), ["contest_id"], ["result"])


@query("results_log_append", sql(f"SELECT count(*) AS log_rows, count(*) FILTER (event_date >= DATE '{_STORED_UNTIL}') AS added, 0::BIGINT AS added_again FROM contest", "contest"))
def _(spark, d):
    stored, new = _stored_and_new(spark, d)
    once = cut_lineage(G.insert_only(stored, new, ["contest_id"], ["result"]), "log")
    again = G.new_rows(once, new, ["contest_id"], ["result"]).select(F.lit(None).cast("string").alias("result"), F.lit(1).alias("again"))
    rows = once.select("result", F.lit(0).alias("again")).unionByName(again)
    return rows.agg(F.count_if(F.col("again") == 0).alias("log_rows"), F.count_if((F.col("again") == 0) & (F.col("result") != "old")).alias("added"), F.sum("again").alias("added_again"))


@query("log_versions", sql(f"""WITH n AS (SELECT count(*) FILTER (event_date < DATE '{_STORED_UNTIL}') AS old, count(*) AS whole FROM contest)
  SELECT step, version, log_rows, added, refused FROM n, LATERAL (VALUES ('first', 1, old, old, false), ('second', 2, whole, whole - old, false), ('again', 2, whole, 0, false),
    ('crash', 2, whole, NULL, true), ('stale reader', 2, whole, NULL, true)) s(step, version, log_rows, added, refused)""", "contest"))
def _(spark, d):
    """A stored log after two appends, the second one again, an append that dies before its commit, and a stage made for the first version."""
    stored, new = _stored_and_new(spark, d)
    path, steps = shared_path(spark, "log"), []

    def state(step: str, added: int | None, refused: bool = False) -> None:
        v = B.info(spark, path)
        steps.append((step, v["version"], sum(f["rows"] for f in v["folders"]), added, refused))

    def dies(*_):
        raise RuntimeError("killed before the commit")
    first = B.append(path, stored, ["contest_id"], ["result"])
    state("first", first["added"])
    for step in ("second", "again"):
        state(step, B.append(path, new.unionByName(stored), ["contest_id"], ["result"])["added"])
    try:
        B.append(path, new.withColumn("contest_id", -F.col("contest_id")), ["contest_id"], ["result"], commit=dies)
    except RuntimeError:
        state("crash", None, True)
    try:
        B.require(spark, path, first)
    except B.VersionError:
        state("stale reader", None, True)
    return spark.createDataFrame(steps, "step string, version int, log_rows long, added long, refused boolean")


@query("file_quarantine", """SELECT 'region_year=' || year(o_orderdate) AS file, count(*) AS rows, NULL AS reason FROM orders GROUP BY 1 UNION ALL SELECT 'region_year=latin', NULL, 'not UTF-8'
  UNION ALL SELECT 'region_year=ragged', count(*), 'too many fields in line 2' FROM region UNION ALL SELECT 'region_year=other', count(*), 'no column custkey' FROM nation""")
def _(spark, d):
    """Rows of each readable file, and the refused files with the reason: another encoding, a ragged line, other columns."""
    o = V.table(spark, d, "orders").select(F.year("o_orderdate").alias("region_year"), F.col("o_custkey").cast("string").alias("custkey"))
    path = files.write_strings(o, "by-year", partition="region_year")
    region, nation = V.table(spark, d, "region").coalesce(1), V.table(spark, d, "nation").coalesce(1)
    region.select(F.concat(F.lit("é"), "r_regionkey").alias("custkey")).write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/region_year=latin")
    region.select(F.concat_ws(",", "r_regionkey", F.lit("more")).alias("custkey")).write.option("header", True).option("quote", "").csv(f"{path}/region_year=ragged")
    nation.select(F.col("n_nationkey").alias("key")).write.option("header", True).csv(f"{path}/region_year=other")
    found = files.file_status(spark, path, ["custkey"]).withColumn("file", F.regexp_extract("file_path", r"(region_year=\w+)", 1))
    return found.groupBy("file").agg(F.sum("rows").alias("rows"), F.max("reason").alias("reason"))


@query("dataset_fingerprint", sql("""SELECT 'shuffled' AS form, count(*) AS rows, true AS same FROM contest UNION ALL SELECT 'one division renamed', count(*), false FROM contest
  UNION ALL SELECT 'first contest twice', count(*) + 1, false FROM contest""", "contest"))
def _(spark, d):
    """Whether the fingerprint of the contests is that of the same rows in other order, with a changed cell, with a repeated row."""
    c = V.contests(spark, d, False)
    first = c.agg(F.min("contest_id").alias("contest_id"))
    renamed = c.join(first.withColumn("is_first", F.lit(True)), "contest_id", "left").withColumn("division", F.when(F.col("is_first"), F.lit("renamed")).otherwise(F.col("division"))).select(*c.columns)
    forms = {"shuffled": c.repartition(5), "one division renamed": renamed, "first contest twice": c.unionByName(c.join(first, "contest_id", "left_semi"))}
    out = None
    for form, rows in forms.items():
        part = G.fingerprint(rows).withColumn("form", F.lit(form))
        out = part if out is None else out.unionByName(part)
    own = G.fingerprint(c).first().asDict()
    same = [F.col(k) == F.lit(v) for k, v in own.items()]
    return out.select("form", "rows", (same[0] & same[1] & same[2]).alias("same"))


@query("staleness_check", sql(f"""SELECT max(event_date) FILTER (is_target) AS newest_date, max(event_date) FILTER (is_target) > DATE '{V.VALID_END}' AS has_newer, 1 AS missing_columns, true AS needed FROM contest""", "contest"))
def _(spark, d):
    return G.staleness(V.contests(spark, d, False), V.VALID_END, ["a", "b"], ["b", "c"])


# ------------------------------------------------------------------ data checks

def _typed_tables(spark, d):
    c = V.slate_columns(V.contests(spark, d, False))
    c = c.withColumn("has_stats", F.col("has_stats") & ~F.col("is_prior"))
    events = c.filter("not is_prior").groupBy("event_id").agg(F.min("event_date").alias("event_date"))
    stats = V.stats(spark, d).join(c.filter("not is_prior").select("contest_id"), "contest_id", "left_semi")
    return {"contests": c, "events": events, "stats": stats, "entities": V.entity(spark, d)}


@query("quality_checks_processed", sql("""WITH cur AS (SELECT * FROM slated WHERE NOT is_prior), sides AS (SELECT entity_1_id AS e, event_date FROM cur UNION ALL SELECT entity_2_id, event_date FROM cur)
  SELECT "check", severity, violations FROM (VALUES
   ('contests without stats', 'warning', (SELECT count(*) FROM cur WHERE NOT has_stats)),
   ('entity in more than one contest on the same date', 'error', (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM sides GROUP BY e, event_date) WHERE n > 1)),
   ('age at contest outside 18-50', 'warning', (SELECT count(*) FROM sides JOIN entity ON entity_id = e WHERE date_diff('day', dob, event_date) / 365.25 NOT BETWEEN 18 AND 50)),
   ('events: duplicate keys', 'error', 0), ('contests: duplicate keys', 'error', 0), ('stats: duplicate keys', 'error', 0), ('entities: duplicate keys', 'error', 0),
   ('events: event_date missing', 'error', 0), ('contests: event_date missing', 'error', 0), ('contests with stats: not exactly 2 stat rows', 'error', 0),
   ('contests: event not in events', 'error', 0), ('contests: event_date differs from events', 'error', 0), ('contests: entity not in entities', 'error', 0),
   ('contests: same entity on both sides', 'error', 0), ('contests: win without valid winner_id', 'error', 0), ('contests: draw/nc with winner_id', 'error', 0),
   ('contests: is_target != (result == win)', 'error', 0), ('contests: finish_group missing', 'warning', 0), ('prior: entity not in entities', 'error', 0),
   ('prior: win without valid winner_id', 'error', 0), ('prior: marked as target', 'error', 0), ('stats: contest not in contests', 'error', 0)) v("check", severity, violations)""", "slated", "entity"))
def _(spark, d):
    return Q.count_checks(Q.processed_checks(_typed_tables(spark, d)))


def _raw_counts(spark, d):
    t = _typed_tables(spark, d)
    t["stats"] = V.stats(spark, d)
    return Q.count_checks(Q.raw_checks(t, S.TODAY)).select("check", "violations")


def _twice(rows: str, keys: str) -> str:
    return f"(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM {rows} GROUP BY {keys}) WHERE n > 1)"


_RAW_SQL = {
    "events: duplicate keys": _twice("ev", "event_id"), "contests: duplicate keys": _twice("slated", "contest_id"), "stats: duplicate keys": _twice("stats", "contest_id, entity_id"),
    "entities: duplicate keys": _twice("entity", "entity_id"),
    **{name: f"(SELECT count(*) FROM j WHERE {condition})" for name, condition in {
        "contests with 0 stat rows": "n = 0", "contests with 1 or more than 2 stat rows": "n = 1 OR n > 2", "contests whose event is not in events": "ev_date IS NULL",
        "contests.event_date != events.event_date": "ev_date IS DISTINCT FROM event_date", "contest entity ids not in entities": "a IS NULL OR b IS NULL",
        "win: winner_id not one of the two entities": "result = 'win' AND (winner_id IS NULL OR winner_id NOT IN (entity_1_id, entity_2_id))",
        "draw/nc with a winner_id": "result <> 'win' AND winner_id IS NOT NULL", "result not in win/draw/nc": "result IS NULL OR result NOT IN ('win', 'draw', 'nc')"}.items()},
    **{name: f"(SELECT count(*) FROM k WHERE {condition})" for name, condition in {
        "stat rows whose entity is not in the contest": "one IS NULL OR entity_id NOT IN (one, two)", "stat rows whose contest is not in contests": "one IS NULL", "landed > attempted": "landed > attempted",
        "td_landed > td_attempted": "td_landed > td_attempted", "ctrl_sec > duration_sec": "ctrl_sec > duration_sec"}.items()},
    "events dated in the future": f"(SELECT count(*) FROM ev WHERE NOT {_PLACED})", "events with no contests": "(SELECT count(*) FROM ev WHERE event_id NOT IN (SELECT event_id FROM slated))"}


@query("quality_checks_raw_all", sql("""WITH ev AS (SELECT event_id, min(event_date) AS event_date FROM slated WHERE NOT is_prior GROUP BY 1),
  j AS (SELECT c.*, coalesce(s.n, 0) AS n, ev.event_date AS ev_date, a.entity_id AS a, b.entity_id AS b FROM slated c LEFT JOIN (SELECT contest_id, count(*) AS n FROM stats GROUP BY 1) s ON s.contest_id = c.contest_id
    LEFT JOIN ev ON ev.event_id = c.event_id LEFT JOIN entity a ON a.entity_id = entity_1_id LEFT JOIN entity b ON b.entity_id = entity_2_id),
  k AS (SELECT s.*, c.entity_1_id AS one, c.entity_2_id AS two FROM stats s LEFT JOIN slated c ON c.contest_id = s.contest_id) """
  + " UNION ALL ".join(f"SELECT '{name}' AS \"check\", {count} AS violations" for name, count in _RAW_SQL.items()), "slated", "stats", "entity"))
def _(spark, d):
    return _raw_counts(spark, d)


@query("quality_checks_raw", sql(f"""SELECT "check", violations FROM (VALUES ('contests with 0 stat rows', (SELECT count(*) FROM contest WHERE NOT has_stats)),
  ('landed > attempted', 0), ('td_landed > td_attempted', 0), ('ctrl_sec > duration_sec', (SELECT count(*) FROM stats WHERE ctrl_sec > duration_sec)),
  ('events dated in the future', (SELECT count(DISTINCT event_id) FROM slated WHERE NOT {_PLACED})),
  ('contests whose event is not in events', (SELECT count(*) FROM contest WHERE is_prior)), ('contest entity ids not in entities', 0)) v("check", violations)""", "slated", "stats"))
def _(spark, d):
    """The seven checks of the SQL; `quality_checks_raw_all` has every one."""
    return _raw_counts(spark, d).filter(F.col("check").isin("contests with 0 stat rows", "landed > attempted", "td_landed > td_attempted", "ctrl_sec > duration_sec",
                                                            "events dated in the future", "contests whose event is not in events", "contest entity ids not in entities"))


@query("null_profile", sql("""SELECT 'entity' AS table, * FROM (SELECT 'entity_id' AS column, 0 AS nulls, count(*) AS rows FROM entity UNION ALL SELECT 'name', 0, count(*) FROM entity
  UNION ALL SELECT 'height_in', count(*) FILTER (height_in IS NULL), count(*) FROM entity UNION ALL SELECT 'reach_in', count(*) FILTER (reach_in IS NULL), count(*) FROM entity
  UNION ALL SELECT 'stance', count(*) FILTER (stance IS NULL), count(*) FROM entity UNION ALL SELECT 'dob', 0, count(*) FROM entity)""", "entity"))
def _(spark, d):
    return Q.null_profile(V.entity(spark, d), "entity")
