"""Link and listing extraction from a table of HTML pages, with native regular expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.parse import bound, canonical_division, nearest_year_date, with_parsed

_LINK = r'(<a\b[^>]*\bhref="[^"]*"[^>]*>[^<]*</a>)'


def inner_text(html: Column) -> Column:
    """Text of a fragment: tags to spaces, basic entities decoded, spaces collapsed."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, ch in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, label): links in page order, URL fragment stripped, first label per URL and page."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("pos", "a"))
    links = links.select("page_id", "pos", F.regexp_extract("a", r'\bhref="([^"#]*)', 1).alias("url"), F.trim(F.regexp_extract("a", r">([^<]*)</a>$", 1)).alias("label"))
    return links.filter("url <> ''").groupBy("page_id", "url").agg(F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos"))


@dataclass(frozen=True)
class ListingLayout:
    """Class names and attributes of a listing site."""
    card: str = "event-card"
    headline: str = "event-headline"
    date: str = "event-date"
    location: str = "event-location"
    bout: str = "bout"
    corners: tuple[str, str] = ("corner-red", "corner-blue")
    division: str = "bout-class"
    date_kinds: tuple[str, ...] = ("main-card", "prelims-card", "early-card")
    segments: tuple[tuple[str, str], ...] = (("main-card", "main"), ("prelims-card", "prelims"), ("early-prelims", "early_prelims"))


def _blocks(html: Column, cls: str) -> Column:
    """Fragments that start at an element of class `cls` and run to the next one."""
    cut = F.regexp_replace(html, rf'<(?=[a-z0-9]+\b[^>]*\bclass="(?:[^"]*\s)?{cls}(?:\s[^"]*)?")', "\u0001<")
    return F.filter(F.split(cut, "\u0001"), lambda _, i: i > 0)


def _element(html: Column, cls: str) -> Column:
    """The first element of class `cls` with all it contains, '' without any; an element that is never closed runs to the end.

    Tags and texts become an array; from the opening tag on, a fold counts open elements of the same name until none is left."""
    tokens = F.regexp_extract_all(html, F.lit(r"<[^>]*>|[^<]+"), F.lit(0))
    opening = rf'^<[a-z0-9]+\b[^>]*\bclass="(?:[^"]*\s)?{cls}(?:\s[^"]*)?"'

    def fold(rest: Column, name: Column) -> Column:
        opens, closes = F.concat(F.lit("<"), name), F.concat(F.lit("</"), name)

        def change(token: Column) -> Column:
            tag = F.regexp_extract(token, "^(</?[a-z0-9]+)", 1)
            return F.when(token.startswith(opens) & (tag == opens) & ~token.endswith("/>"), 1).when(token.startswith(closes) & (tag == closes), -1).otherwise(0)

        def step(state: Column, by: Column) -> Column:
            return F.when(state["depth"] == 0, state).otherwise(F.struct((state["depth"] + by).alias("depth"), (state["size"] + 1).alias("size")))
        first = F.struct(F.lit(1).alias("depth"), F.lit(1).alias("size"))
        size = F.aggregate(F.transform(F.slice(rest, F.lit(2), F.size(rest)), change), first, step, lambda s: s["size"])
        return F.array_join(F.slice(rest, F.lit(1), size), "")

    def cut(tokens: Column, start: Column) -> Column:
        name = F.regexp_extract(F.get(tokens, start - 1), "^<([a-z0-9]+)", 1)
        found = bound(F.struct(F.slice(tokens, start, F.size(tokens)).alias("rest"), name.alias("name")), lambda x: fold(x["rest"], x["name"]))
        return F.when(start > 0, found).otherwise("")

    def place(tokens: Column) -> Column:
        return F.array_position(F.transform(tokens, lambda t: t.contains(cls) & t.rlike(opening)), True).cast("int")
    return bound(tokens, lambda t: bound(place(t), lambda start: cut(t, start)))


def listing_events(pages: DataFrame, layout: ListingLayout = ListingLayout(), base: str = "") -> DataFrame:
    """Upcoming events of listing pages: (page_id, url, headline, event_date, location), one per URL.

    The displayed date has no year; the year comes from the nearest epoch timestamp."""
    cards = pages.select("page_id", F.posexplode(_blocks(F.col("html"), layout.card)).alias("pos", "card"))
    head, date = _element(F.col("card"), layout.headline), _element(F.col("card"), layout.date)
    link = F.regexp_extract(head, r'\bhref="([^"#]*)', 1)
    url = F.when(link.startswith("/"), F.concat(F.lit(base.rstrip("/")), link)).otherwise(link)
    days = []
    for kind in layout.date_kinds:
        text = F.regexp_extract(date, rf'\bdata-{kind}="([^"]*)"', 1)
        ts = F.trim(F.regexp_extract(date, rf'\bdata-{kind}-timestamp="([^"]*)"', 1))
        anchor = F.timestamp_seconds(F.when(ts.rlike(r"^\d+$"), ts).try_cast("bigint")).cast("date")
        month = F.month(F.try_to_date(F.concat(F.regexp_extract(text, r"([A-Z][a-z]{2})\s+\d{1,2}", 1), F.lit(" 1, 2000")), "MMM d, yyyy"))
        day = F.regexp_extract(text, r"[A-Z][a-z]{2}\s+(\d{1,2})", 1).try_cast("int")
        days.append(nearest_year_date(month, day, anchor))
    place = F.nullif(F.regexp_replace(inner_text(_element(F.col("card"), layout.location)), r"\s+,", ","), F.lit(""))
    rows = cards.select("page_id", "pos", F.nullif(url, F.lit("")).alias("url"), inner_text(head).alias("headline"), F.coalesce(*days).alias("event_date"), place.alias("location"))
    rows = rows.filter("url is not null and event_date is not null")
    return rows.groupBy("page_id", "url").agg(*[F.min_by(c, "pos").alias(c) for c in ("headline", "event_date", "location")])


def event_bouts(pages: DataFrame, layout: ListingLayout = ListingLayout()) -> DataFrame:
    """Bouts of event pages in listed order: names, division, title flag, rounds, segment."""
    marked = F.col("html")
    segment_ids = "|".join(s for s, _ in layout.segments)
    before = F.regexp_replace(marked, rf'<(?=[a-z0-9]+\b[^>]*\bid="(?:{segment_ids})")', "\u0002<")
    parts = pages.select("page_id", F.posexplode(F.split(before, "\u0002")).alias("spos", "part"))
    seg = F.regexp_extract("part", rf'^<[a-z0-9]+\b[^>]*\bid="({segment_ids})"', 1)
    names = F
    rank = F
    for i, (key, label) in enumerate(layout.segments):
        names, rank = names.when(seg == key, label), rank.when(seg == key, i)
    bouts = parts.select("page_id", names.alias("segment"), F.coalesce(rank, F.lit(-1)).alias("srank"), F.posexplode(_blocks(F.col("part"), layout.bout)).alias("pos", "b"))
    a, b = (F.nullif(inner_text(_element(F.col("b"), c)), F.lit("")) for c in layout.corners)
    text = inner_text(_element(F.col("b"), layout.division))
    rows = with_parsed(bouts, {"name_1": a, "name_2": b, "division_text": text}).drop("b").filter("name_1 is not null and name_2 is not null")
    # A page is one slate, numbered inside the page.
    w = W.partitionBy("page_id").orderBy("srank", "pos")
    title = F.lower("division_text").rlike("title|championship")
    rows = rows.withColumn("bout_order", F.row_number().over(w)).withColumn("is_title", title)
    rounds = F.when((F.col("bout_order") == 1) | F.col("is_title"), 5).otherwise(3)
    division = F.coalesce(canonical_division(F.col("division_text")), F.nullif(F.regexp_replace("division_text", " Bout$", ""), F.lit("")))
    return rows.select("page_id", "bout_order", "name_1", "name_2", division.alias("division"), "is_title", rounds.alias("scheduled_rounds"), "segment")
