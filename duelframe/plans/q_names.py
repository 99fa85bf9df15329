"""Queries: name resolution. Names are part names with their brand: some unique, many shared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import normalize_name
from ..operators import resolve as N
from . import views as V
from .oracle import sql
from .registry import query
from .source_views import DIVISION_TEXT

_INFO_SQL = """info AS (SELECT p_partkey AS entity_id, p_name || ' ' || replace(lower(p_brand), '#', ' ') AS norm, CASE WHEN p_partkey % 9 <> 0 THEN p_size * 5 END::DOUBLE AS weight_lb,
  CASE WHEN p_partkey % 11 <> 0 THEN DATE '1950-01-01' + (p_partkey * 7919 % 20000)::INT END AS dob FROM part)"""
_PROBE_SQL = """probe AS (SELECT o_orderkey AS probe_id, i.norm || CASE WHEN o_orderkey % 29 = 0 THEN ' x' ELSE '' END AS norm, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate::DATE END AS on_date,
  CASE o_orderkey % 10 WHEN 0 THEN 125 WHEN 1 THEN 115 WHEN 2 THEN 205 WHEN 3 THEN 265 WHEN 6 THEN 185 WHEN 7 THEN 135 WHEN 9 THEN 155 END AS lim FROM orders JOIN info i ON i.entity_id = o_custkey)"""
_RESOLVE_SQL = f"""WITH {_INFO_SQL}, {_PROBE_SQL}, cand AS (SELECT p.*, i.entity_id, i.weight_lb, abs(i.weight_lb - p.lim) AS dist, count(*) OVER (PARTITION BY probe_id) AS n_all,
    coalesce(date_diff('day', i.dob, p.on_date) / 365.25 BETWEEN 18 AND 50, true) AS fits FROM probe p JOIN info i USING (norm)),
  fit AS (SELECT probe_id, any_value(lim) AS lim, count(*) AS n, count(weight_lb) AS weighed, min(entity_id) AS only_id, list((dist, entity_id) ORDER BY dist, entity_id) AS l FROM cand WHERE fits GROUP BY 1)
  SELECT p.probe_id, CASE WHEN c.n_all = 1 THEN c.one WHEN f.n = 1 THEN f.only_id WHEN f.n > 1 AND f.lim IS NOT NULL AND f.weighed = f.n AND f.l[1][1] + 15 <= f.l[2][1] THEN f.l[1][2] END AS entity_id, c.n_all
  FROM probe p LEFT JOIN (SELECT probe_id, any_value(n_all) AS n_all, min(entity_id) AS one FROM cand GROUP BY 1) c USING (probe_id) LEFT JOIN fit f USING (probe_id)"""


def _named(spark, d):
    return V.table(spark, d, "part").select(
        F.col("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("name"),
        F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") * 5.0).alias("weight_lb"),
        F.when(F.col("p_partkey") % 11 != 0, F.date_add(F.lit("1950-01-01").cast("date"), (F.col("p_partkey") * 7919 % 20000).cast("int"))).alias("dob"))


def _probes(spark, d):
    key = F.col("o_orderkey")
    names = _named(spark, d).select(F.col("entity_id").alias("o_custkey"), "name")
    return V.table(spark, d, "orders").join(names, "o_custkey").select(
        key.alias("probe_id"), F.concat(F.upper("name"), F.when(key % 29 == 0, " x").otherwise("")).alias("name"),
        F.get(F.array(*[F.lit(x) for x in DIVISION_TEXT]), (key % 10).cast("int")).alias("division"), F.when(key % 13 != 0, F.col("o_orderdate").cast("date")).alias("on_date"))


@query("resolve_names_exact", f"""SELECT probe_id, entity_id, CASE WHEN n_all IS NULL THEN 'unmatched' WHEN n_all = 1 THEN 'exact' WHEN entity_id IS NOT NULL THEN 'exact_disambiguated' ELSE 'ambiguous' END AS method FROM ({_RESOLVE_SQL})""")
def _(spark, d):
    info = _named(spark, d)
    return N.resolve_exact(_probes(spark, d), N.name_index(info), info)


@query("disambiguate_by_distance", f"SELECT entity_id IS NOT NULL AS picked, count(*) AS n, sum(entity_id)::BIGINT AS ids FROM ({_RESOLVE_SQL}) WHERE n_all > 1 GROUP BY 1")
def _(spark, d):
    info = _named(spark, d)
    r = N.resolve_exact(_probes(spark, d), N.name_index(info), info).filter("method in ('exact_disambiguated', 'ambiguous')")
    return r.groupBy(F.col("entity_id").isNotNull().alias("picked")).agg(F.count(F.lit(1)).alias("n"), F.sum("entity_id").alias("ids"))


@query("resolve_names_compact", f"""SELECT probe_id, entity_id, CASE WHEN n_all = 1 OR entity_id IS NOT NULL THEN 'compact' ELSE 'ambiguous' END AS method FROM ({_RESOLVE_SQL}) WHERE n_all IS NOT NULL""")
def _(spark, d):
    info = _named(spark, d)
    squeezed = _probes(spark, d).withColumn("name", F.replace("name", F.lit(" "), F.lit("")))
    return N.resolve_compact(squeezed, N.name_index(info), info)


@query("alias_lookup", """SELECT lower(replace(s_name, '#', ' ')) AS alias_norm, s_suppkey AS alias_id FROM supplier WHERE s_suppkey % 3 <> 0""")
def _(spark, d):
    s = V.table(spark, d, "supplier")
    aliases = s.select(F.upper("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, -1 - F.col("s_suppkey")).otherwise(F.col("s_suppkey")).alias("entity_id"))
    return N.alias_table(aliases, s.select(F.col("s_suppkey").alias("entity_id")))


def _short_index(spark, d):
    """The distinct part names, one entity each."""
    p = V.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id"))
    return p.withColumns({"weight_lb": F.lit(150.0), "dob": F.lit("1990-01-01").cast("date")})


def _misspelt():
    """One letter dropped, doubled or replaced, at a place that follows the key; tokens swapped in some."""
    at = (F.col("p_partkey") % F.length("p_name") + 1).cast("int")
    head, tail = F.substring("p_name", F.lit(1), at - 1), F.substr("p_name", at + 1)
    letter = F.substring("p_name", at, F.lit(1))
    kind = F.floor(F.col("p_partkey") / 16) % 4
    tokens = F.split("p_name", " ")
    return (F.when(kind == 0, F.concat(head, tail)).when(kind == 1, F.concat(head, letter, letter, tail)).when(kind == 2, F.concat(head, F.lit("q"), tail))
            .otherwise(F.concat_ws(" ", F.get(tokens, F.lit(1)), F.get(tokens, F.lit(0)))))


def _norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


_MISSPELT_SQL = """CASE p_partkey // 16 % 4 WHEN 0 THEN substr(p_name, 1, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2)
  WHEN 1 THEN substr(p_name, 1, p_partkey % length(p_name) + 1) || substr(p_name, p_partkey % length(p_name) + 1)
  WHEN 2 THEN substr(p_name, 1, p_partkey % length(p_name)) || 'q' || substr(p_name, p_partkey % length(p_name) + 2)
  ELSE concat_ws(' ', string_split(p_name, ' ')[2], string_split(p_name, ' ')[1]) END"""
_KNOWN_SQL = "known AS (SELECT p_name AS cand, min(p_partkey) AS id FROM part GROUP BY 1)"
# Longest common subsequence by the carries of additions, for names of up to 120 letters; levenshtein never exceeds the edits counted here.
_FUZZY_SQL = """forms AS (SELECT norm, unnest([norm, array_to_string(list_sort(string_split(norm, ' ')), ' ')]) AS a, unnest([0, 1]) AS form FROM asked),
  known_forms AS (SELECT cand, unnest([cand, array_to_string(list_sort(string_split(cand, ' ')), ' ')]) AS b, unnest([0, 1]) AS form FROM known),
  pairs AS (SELECT norm, cand, a, b, (1::HUGEINT << length(b)::INT) - 1 AS bits FROM forms JOIN known_forms USING (form) WHERE levenshtein(a, b) <= 0.13 * (length(a) + length(b)) + 1e-9),
  common AS (SELECT norm, cand, length(a) + length(b) AS letters, length(b) - bit_count(list_reduce(list_prepend(bits, list_transform(string_split(a, ''), lambda c: coalesce(list_sum(list_transform(range(length(b)),
    lambda i: CASE WHEN substr(b, i::INT + 1, 1) = c THEN 1::HUGEINT << i::INT ELSE 0 END)), 0)::HUGEINT)), lambda v, x: ((v + (v & x)) | (v - (v & x))) & bits)) AS n FROM pairs),
  near AS (SELECT norm, cand, max(2::DOUBLE * n / letters) AS score FROM common WHERE letters - 2 * n <= 0.13 * letters + 1e-9 GROUP BY ALL),
  top AS (SELECT norm, cand AS best, score, lead(score) OVER w AS runner_up FROM near WINDOW w AS (PARTITION BY norm ORDER BY score DESC, cand DESC) QUALIFY row_number() OVER w = 1),
  fuzzy AS (SELECT *, score >= 0.92::DOUBLE AND score - coalesce(runner_up, 0) >= 0.05::DOUBLE AS accepted FROM top)"""


@query("fuzzy_top1_margin", f"""WITH {_KNOWN_SQL}, asked AS (SELECT DISTINCT {_norm_sql(_MISSPELT_SQL)} AS norm FROM part WHERE {_norm_sql(_MISSPELT_SQL)} <> ''), {_FUZZY_SQL}
  SELECT norm, best, round(score, 6) AS score, round(runner_up, 6) AS runner_up, accepted FROM fuzzy""")
def _(spark, d):
    probes = V.table(spark, d, "part").select(normalize_name(_misspelt()).alias("norm"))
    top = N.fuzzy_top1_margin(probes, N.name_index(_short_index(spark, d)))
    return top.select("norm", "best", F.round("score", 6).alias("score"), F.round("runner_up", 6).alias("runner_up"), "accepted")


@query("slate_match", f"""WITH {_KNOWN_SQL}, p AS (SELECT p_partkey, p_partkey % 6 AS kind, {_norm_sql(f"CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN 'The ' || p_name WHEN 3 THEN {_MISSPELT_SQL} ELSE 'Debutant ' || p_partkey END")} AS norm FROM part),
  step AS (SELECT p.*, al.id AS alias_id, ex.id AS exact_id, cp.id AS compact_id, cp.n FROM p LEFT JOIN known al ON p.norm = 'the ' || al.cand LEFT JOIN known ex ON ex.cand = p.norm
    LEFT JOIN (SELECT replace(cand, ' ', '') AS c, count(*) AS n, min(id) AS id FROM known GROUP BY 1) cp ON cp.c = replace(p.norm, ' ', '')),
  asked AS (SELECT DISTINCT norm FROM step WHERE kind <> 4 AND alias_id IS NULL AND exact_id IS NULL AND compact_id IS NULL AND norm <> ''), {_FUZZY_SQL}
  SELECT p_partkey AS probe_id, CASE WHEN kind = 4 THEN p_partkey WHEN alias_id IS NOT NULL THEN alias_id WHEN exact_id IS NOT NULL THEN exact_id WHEN n = 1 THEN compact_id WHEN n > 1 THEN NULL ELSE k.id END AS entity_id,
  CASE WHEN kind = 4 THEN 'manual' WHEN alias_id IS NOT NULL THEN 'alias' WHEN exact_id IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'compact' WHEN n > 1 THEN 'ambiguous' WHEN k.id IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS method
  FROM step LEFT JOIN fuzzy f ON f.norm = step.norm AND f.accepted AND alias_id IS NULL AND exact_id IS NULL AND compact_id IS NULL LEFT JOIN known k ON k.cand = f.best""")
def _(spark, d):
    info = _short_index(spark, d)
    kind = F.col("p_partkey") % 6
    name = (F.when(kind == 0, F.upper("p_name")).when(kind == 1, F.replace("p_name", F.lit(" "), F.lit(""))).when(kind == 2, F.concat(F.lit("The "), "p_name"))
            .when(kind == 3, _misspelt()).otherwise(F.concat(F.lit("Debutant "), "p_partkey")))
    probes = V.table(spark, d, "part").select(F.col("p_partkey").alias("probe_id"), name.alias("name"), F.lit("Lightweight").alias("division"), F.lit("2020-01-01").cast("date").alias("on_date"),
                                              F.when(kind == 4, F.col("p_partkey")).alias("given_id"))
    aliases = info.select(F.concat(F.lit("the "), "name").alias("name"), "entity_id")
    return N.match_names(probes, N.name_index(info), info, aliases)
