"""Queries: text parsing over cells printed from the tables. The SQL computes the expected values
directly from the table columns instead of parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import parse as P
from ..sources.pages import event_bouts, listing_events, page_links
from . import views as V
from .oracle import sql
from .registry import query


def _int_text(c):
    return F.col(c).cast("bigint").cast("string")


@query("parse_x_of_y", sql("""SELECT contest_id, entity_id, CASE WHEN contest_id % 13 = 0 OR contest_id % 29 = 0 THEN NULL ELSE landed END AS landed,
  CASE WHEN contest_id % 13 = 0 OR contest_id % 29 = 0 THEN NULL ELSE attempted END AS attempted,
  contest_id % 13 <> 0 AND contest_id % 29 = 0 AS is_malformed FROM side""", "side"))
def _(spark, d):
    text = (F.when(F.col("contest_id") % 13 == 0, "---").when(F.col("contest_id") % 29 == 0, F.concat(_int_text("landed"), F.lit("/"), _int_text("attempted")))
            .otherwise(F.concat(F.lit(" "), _int_text("landed"), F.lit(" of "), _int_text("attempted"))))
    s = V.side(spark, d).select("contest_id", "entity_id", text.alias("cell"))
    a, b = P.x_of_y(F.col("cell"))
    return s.select("contest_id", "entity_id", a.alias("landed"), b.alias("attempted"), P.malformed(F.col("cell"), a).alias("is_malformed"))


@query("parse_mmss", sql("""SELECT contest_id, entity_id, CASE WHEN contest_id % 13 = 0 OR contest_id % 29 = 0 THEN NULL ELSE (ctrl_sec * 7)::DOUBLE END AS ctrl_sec,
  contest_id % 13 <> 0 AND contest_id % 29 = 0 AS is_malformed FROM side""", "side"))
def _(spark, d):
    sec = (F.col("ctrl_sec") * 7).cast("int")
    text = (F.when(F.col("contest_id") % 13 == 0, "--").when(F.col("contest_id") % 29 == 0, F.format_string("%d.%02d", F.floor(sec / 60).cast("int"), sec % 60))
            .otherwise(F.format_string("%d:%02d", F.floor(sec / 60).cast("int"), sec % 60)))
    s = V.side(spark, d).select("contest_id", "entity_id", text.alias("cell"))
    v = P.mmss(F.col("cell"))
    return s.select("contest_id", "entity_id", v.alias("ctrl_sec"), P.malformed(F.col("cell"), v).alias("is_malformed"))


@query("parse_measures", sql("""SELECT p_partkey, (p_partkey % 84)::DOUBLE AS height_in, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size + 0.5 END::DOUBLE AS reach_in,
  p_size::DOUBLE * 5 AS weight_lb, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END::DOUBLE AS whole,
  p_partkey % 5 = 0 AS bad_whole FROM part"""))
def _(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    t = V.table(spark, d, "part").select(
        "p_partkey", F.format_string("%d' %d\"", F.floor(key % 84 / 12).cast("int"), (key % 12).cast("int")).alias("h"),
        F.when(key % 7 == 0, "--").otherwise(F.format_string("%d.5\"", size)).alias("r"), F.format_string("%d lbs.", size * 5).alias("w"),
        F.when(key % 5 == 0, F.format_string("%d.25", size)).otherwise(F.format_string("%d.0", size)).alias("n"))
    whole = P.whole_number(F.col("n"))
    return t.select("p_partkey", P.height_in(F.col("h")).alias("height_in"), P.reach_in(F.col("r")).alias("reach_in"), P.weight_lb(F.col("w")).alias("weight_lb"),
                    whole.alias("whole"), P.malformed(F.col("n"), whole).alias("bad_whole"))


@query("parse_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS d, o_orderkey % 11 = 0 AS is_malformed FROM orders")
def _(spark, d):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = (F.when(key % 11 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 3 == 0, F.date_format(day, "MMMM d, yyyy"))
            .when(key % 3 == 1, F.date_format(day, "MMM d, yyyy")).otherwise(F.regexp_replace(F.date_format(day, "MMM d, yyyy"), "^(...)", "$1.")))
    o = V.table(spark, d, "orders").select("o_orderkey", text.alias("cell"))
    v = P.text_date(F.col("cell"))
    return o.select("o_orderkey", v.alias("d"), P.malformed(F.col("cell"), v).alias("is_malformed"))


@query("extract_url_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN lower(to_hex(o_orderkey)) END AS contest_id FROM orders")
def _(spark, d):
    key = F.col("o_orderkey")
    url = F.when(key % 9 == 0, F.concat(F.lit("http://stats.example/other/"), F.lower(F.hex(key)))).otherwise(
        F.concat(F.lit("http://stats.example/fight-details/"), F.lower(F.hex(key)), F.lit("/")))
    return V.table(spark, d, "orders").select("o_orderkey", P.url_id(url).alias("contest_id"))


_FORMATS = ["3 Rnd (5-5-5)", "5 Rnd (5-5-5-5-5)", "1 Rnd + OT (12-3)", "No Time Limit", "2 Rnd"]


@query("parse_round_lengths", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN NULL ELSE 2 END::INT AS rounds,
  CASE o_orderkey % 5 WHEN 0 THEN '300,300,300' WHEN 1 THEN '300,300,300,300,300' WHEN 2 THEN '720,180' END AS lengths FROM orders""")
def _(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.get(F.array(*[F.lit(x) for x in _FORMATS]), (F.col("o_orderkey") % 5).cast("int")).alias("f"))
    lengths = P.round_lengths(F.col("f"))
    return o.select("o_orderkey", P.scheduled_rounds(F.col("f")).alias("rounds"), F.array_join(F.transform(lengths, lambda x: x.cast("string")), ",").alias("lengths"))


@query("elapsed_duration", """SELECT o_orderkey, (CASE WHEN o_orderkey % 5 IN (3, 4) THEN CASE WHEN r = 1 THEN t END
  WHEN o_orderkey % 5 = 2 THEN CASE WHEN r = 1 THEN t WHEN r = 2 THEN 720 + t END
  WHEN r <= CASE o_orderkey % 5 WHEN 0 THEN 3 ELSE 5 END THEN (r - 1) * 300 + t END)::DOUBLE AS duration_sec
  FROM (SELECT o_orderkey, o_orderkey // 5 % 6 + 1 AS r, o_custkey % 300 AS t FROM orders)""")
def _(spark, d):
    key = F.col("o_orderkey")
    o = V.table(spark, d, "orders").select(
        "o_orderkey", F.get(F.array(*[F.lit(x) for x in _FORMATS]), (key % 5).cast("int")).alias("f"),
        (F.floor(key / 5) % 6 + 1).cast("double").alias("r"), (F.col("o_custkey") % 300).cast("double").alias("t"))
    return o.select("o_orderkey", P.elapsed(F.col("r"), F.col("t"), P.round_lengths(F.col("f"))).alias("duration_sec"))


@query("split_pair", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 8 THEN 'Customer ' || o_custkey END AS a, CASE WHEN o_orderkey % 10 < 8 THEN 'Rival vs. ' || o_orderkey END AS b FROM orders""")
def _(spark, d):
    key = F.col("o_orderkey")
    left, right = F.concat(F.lit("Customer "), F.col("o_custkey")), F.concat(F.lit("Rival vs. "), key)
    bout = F.when(key % 10 == 9, left).when(key % 10 == 8, F.concat(F.lit("  vs. "), right)).when(key % 2 == 0, F.concat(left, F.lit("  vs. "), right)).otherwise(F.concat(left, F.lit(" vs "), right))
    a, b = P.split_pair(bout)
    return V.table(spark, d, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))


@query("normalize_names", """SELECT p_partkey, p_name || ' oneill strasse jr' AS norm, replace(p_name, ' ', '') || 'oneillstrassejr' AS compact FROM part""")
def _(spark, d):
    styled = F.concat(F.lit("  "), F.translate(F.upper("p_name"), "EIO", "ÉÏØ"), F.lit("  O’Neill-Straße, Jr. "))
    p = V.table(spark, d, "part").select("p_partkey", N.normalize_name(styled).alias("norm"))
    return p.select("p_partkey", "norm", N.compact(F.col("norm")).alias("compact"))


_DIVISION_TEXT = ["Arena Flyweight Title Bout", "Arena Women's Strawweight Title Bout", "Light Heavyweight Bout", "Heavyweight Bout", "Catch Weight Bout",
                  "Arena 2 Tournament Title Bout", "super  heavyweight bout", "WOMEN’S BANTAMWEIGHT BOUT", "Openweight Bout", "Lightweight"]


def _division_cell():
    return F.get(F.array(*[F.lit(x) for x in _DIVISION_TEXT]), (F.col("o_orderkey") % 10).cast("int"))


@query("canonical_division", """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'Flyweight' WHEN 1 THEN 'Women''s Strawweight' WHEN 2 THEN 'Light Heavyweight'
  WHEN 3 THEN 'Heavyweight' WHEN 4 THEN 'Catch Weight' WHEN 6 THEN 'Super Heavyweight' WHEN 7 THEN 'Women''s Bantamweight' WHEN 8 THEN 'Open Weight' WHEN 9 THEN 'Lightweight' END AS division,
  o_orderkey % 10 IN (0, 1) AS is_title FROM orders""")
def _(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", P.canonical_division(_division_cell()).alias("division"), P.is_title(_division_cell()).alias("is_title"))


@query("division_limit", """SELECT limit_lb, count(*) AS n FROM (SELECT CASE o_orderkey % 10 WHEN 0 THEN 125 WHEN 1 THEN 115 WHEN 2 THEN 205 WHEN 3 THEN 265
  WHEN 7 THEN 135 WHEN 9 THEN 155 END::INT AS limit_lb FROM orders) GROUP BY 1""")
def _(spark, d):
    return V.table(spark, d, "orders").groupBy(P.division_limit(_division_cell()).alias("limit_lb")).agg(F.count(F.lit(1)).alias("n"))


_METHODS = ["Decision - Unanimous", "KO/TKO", "TKO - Doctor's Stoppage", "Submission", "DQ", "Overturned"]


@query("finish_group", """SELECT l_returnflag, CASE l_linenumber % 7 WHEN 0 THEN 'decision' WHEN 1 THEN 'ko_tko' WHEN 2 THEN 'ko_tko' WHEN 3 THEN 'submission' WHEN 4 THEN 'dq' WHEN 5 THEN 'other' END AS finish_group,
  count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    method = F.get(F.array(*[F.lit(x) for x in _METHODS]), F.col("l_linenumber") % 7)
    return V.table(spark, d, "lineitem").groupBy("l_returnflag", P.finish_group(method).alias("finish_group")).agg(F.count(F.lit(1)).alias("n"))


@query("decode_outcome", sql("""SELECT contest_id, CASE WHEN contest_id % 31 = 0 THEN NULL ELSE result END AS result,
  CASE WHEN contest_id % 31 = 0 THEN NULL ELSE winner_id END AS winner_id FROM contest""", "contest"))
def _(spark, d):
    c = V.contests(spark, d, False)
    text = (F.when(F.col("contest_id") % 31 == 0, "W/W").when(F.col("result") == "draw", "D/D").when(F.col("result") == "nc", "NC/NC")
            .when(F.col("winner_id") == F.col("entity_1_id"), "W/L").otherwise("L/W"))
    result, winner = P.decode_outcome(text, F.col("entity_1_id"), F.col("entity_2_id"))
    return c.select("contest_id", result.alias("result"), winner.alias("winner_id"))


@query("slugify", "SELECT p_partkey, replace(p_name, ' ', '-') || '-brand-' || substr(p_brand, 7) AS slug FROM part")
def _(spark, d):
    return V.table(spark, d, "part").select("p_partkey", P.slugify(F.concat(F.lit("** "), F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit("!"))).alias("slug"))


@query("clean_titles", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Arena ' || c_custkey || ': ' || c_name WHEN 1 THEN 'Arena Fight Night: ' || c_name
  WHEN 2 THEN 'Gala Arena: ' || c_name ELSE c_name || ' on tour' END AS title FROM customer""")
def _(spark, d):
    key, name = F.col("c_custkey"), F.col("c_name")
    text = (F.when(key % 4 == 0, F.concat(F.initcap("c_mktsegment"), F.lit("  Arena "), key, F.lit(": "), name)).when(key % 4 == 1, F.concat(F.lit("Arena Fight Night | "), name))
            .when(key % 4 == 2, F.concat(F.lit("Gala Arena - "), name)).otherwise(F.concat(name, F.lit("  on tour "))))
    return V.table(spark, d, "customer").select("c_custkey", P.clean_title(text, "Arena", "Gala").alias("title"))


@query("nearest_year_date", """SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%m-%d') <> '02-29' THEN o_orderdate::DATE END AS d FROM orders""")
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    anchor = F.date_add(day, (F.col("o_orderkey") % 201 - 100).cast("int"))
    text = F.date_format(day, "EEE, MMM d / h:mm a")
    month = F.month(F.to_date(F.concat(F.regexp_extract(text, r"([A-Z][a-z]{2})\s+(\d{1,2})", 1), F.lit(" 1, 2000")), "MMM d, yyyy"))
    number = F.regexp_extract(text, r"([A-Z][a-z]{2})\s+(\d{1,2})\s*/", 2).cast("int")
    return V.table(spark, d, "orders").select("o_orderkey", P.nearest_year_date(month, number, anchor).alias("d"))


@query("parse_factor_text", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'Age ' || s_nationkey || ' vs 30|Win rate 50% vs 40%' END AS mine,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Reach 70 vs 71' END AS theirs FROM supplier""")
def _(spark, d):
    key = F.col("s_suppkey")
    left = F.when(key % 3 == 0, "none").otherwise(F.concat(F.lit("Age "), F.col("s_nationkey"), F.lit(" vs 30 (0.35); Win rate 50% vs 40% (0.1)")))
    right = F.when(key % 5 == 0, "none").otherwise("Reach 70 vs 71 (0.02)")
    s = V.table(spark, d, "supplier").select("s_suppkey", "s_name", F.concat(F.col("s_name"), F.lit(": "), left, F.lit(" | Other: "), right).alias("t"))
    return s.select("s_suppkey", F.array_join(P.factor_list(F.col("t"), F.col("s_name"), 0), "|").alias("mine"),
                    F.array_join(P.factor_list(F.col("t"), F.lit("Other"), 1), "|").alias("theirs"))


@query("page_link_extract", r"""WITH hits AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*\bhref="([^"#]*)[^"]*"[^>]*>[^<]*</a>', 1)) AS url,
    unnest(regexp_extract_all(html, '<a\b[^>]*\bhref="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS label,
    generate_subscripts(regexp_extract_all(html, '<a\b[^>]*\bhref="([^"#]*)[^"]*"[^>]*>[^<]*</a>', 1), 1) AS pos FROM pages)
  SELECT page_id, url, trim(label) AS label FROM hits WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1""")
def _(spark, d):
    return page_links(V.table(spark, d, "pages")).select("page_id", "url", "label")


# ------------------------------------------------------------------ listing and event pages, with elements nested in elements of the same name

def _pages(spark, d):
    """Slates as HTML: one listing page for each month and block, and one page for each slate."""
    b = V.slate_columns(V.contests(spark, d, False))
    day = F.date_format("event_date", "EEE, MMM d")
    card = F.concat(F.lit('<div class="event-card x"><div class="event-headline"><div><a href="/slate/'), "event_id", F.lit('#top">Slate '), "event_id", F.lit('</a></div><div> &amp; more</div></div>'
                    '<div class="event-date" data-main-card="'), day, F.lit(' / 7:00 PM" data-main-card-timestamp="'), F.unix_seconds(F.col("event_date").cast("timestamp")).cast("string"),
                    F.lit('"><div>soon</div></div><div class="event-location"><div><div>Hall '), (F.dayofmonth("event_date") % 3).cast("string"), F.lit("</div></div>, Town</div></div>"))
    month = F.concat(F.date_format("event_date", "yyyyMM"), F.lit("-"), F.get(F.split("event_id", "-"), F.lit(1)))
    events = b.select("event_id", "event_date").distinct()
    listings = events.groupBy(month.alias("page_id")).agg(F.concat(F.lit("<html><body><div>"), F.array_join(F.array_sort(F.collect_list(card)), ""), F.lit("</div></body></html>")).alias("html"))    # days of a month
    kind = F.when(F.col("is_title"), " Title Bout").otherwise(" Bout")

    def corner(side: str, which: str) -> Column:
        return F.concat(F.lit(f'<div class="corner-{side}"><div class="pic"></div><div><div>E'), f"entity_{which}_id", F.lit("</div></div></div>"))
    bout = F.concat(F.lit('<div class="bout"><div>'), corner("red", "1"), corner("blue", "2"), F.lit('</div><div class="bout-class"><div></div>Lightweight'), kind, F.lit("</div></div>"))
    first = F.col("bout_no") <= 3
    def part(which: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("bout_no", bout.alias("h"))))), lambda x: x["h"]), "")
    pages = b.groupBy(F.col("event_id").alias("page_id")).agg(F.concat(F.lit('<html><div id="prelims-card"><div>'), part(~first), F.lit('</div></div><div id="main-card"><div>'), part(first), F.lit("</div></div></html>")).alias("html"))
    return listings, pages


# A displayed 29 February has no year of its own among the neighbouring ones (`nearest_year_date`), so such cards are left out.
@query("listing_pages", sql("""SELECT strftime(event_date, '%Y%m') || '-' || split_part(event_id, '-', 2) AS page_id, 'https://x.org/slate/' || event_id AS url, 'Slate ' || event_id || ' & more' AS headline, event_date,
  'Hall ' || day(event_date) % 3 || ', Town' AS location FROM slated WHERE NOT (month(event_date) = 2 AND day(event_date) = 29) GROUP BY event_id, event_date""", "slated"))
def _(spark, d):
    return listing_events(_pages(spark, d)[0], base="https://x.org/")


@query("bout_pages", sql("""SELECT event_id AS page_id, bout_no AS bout_order, 'E' || entity_1_id AS name_1, 'E' || entity_2_id AS name_2, 'Lightweight' AS division, is_title,
  CASE WHEN bout_no = 1 OR is_title THEN 5 ELSE 3 END AS scheduled_rounds, CASE WHEN bout_no <= 3 THEN 'main' ELSE 'prelims' END AS segment FROM slated""", "slated"))
def _(spark, d):
    return event_bouts(_pages(spark, d)[1])
