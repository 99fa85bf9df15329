"""Audit of how filters interact: what each removes in every order they can be applied in.

Per document one bit mask says which filters it fails. Documents are counted by (part, mask), so that a
part has at most 2^5 mask cells however large it is. Each cell then folds across the array of all 120
orders with `transform` and `aggregate`: at every step of every order its documents are kept, removed
here, or removed before, which gives 600 weighted structs a cell; the cells of a part are merged by
elementwise sums.

Repeated texts are found by digest from counts: documents are counted by (digest, flags, id), then by
(digest, flags) with the least id and its count, and only those rows, a few a digest, meet in a window.
No copies are joined with each other, and a text that a third of all rows share is one key of partial sums.

Null texts are empty; a null lang is the part ''; a null id has no labels, and is neither smaller nor larger than
another id; repeated rows count each, and are no copies of each other; of several labels of an id any 1 counts. An
empty table has no part and no rows. Extra columns are left out.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10
_WORD, _ODD = "[^\\x20\\x09-\\x0D]+", "[#$%&*|]"


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text only: few words, few distinct words, many capitals, odd signs."""
    def of(words: Column) -> Column:
        n = F.size(words)
        few = F.when(n < MIN_WORDS, 1).otherwise(0)
        same = F.when(100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n, 2).otherwise(0)
        return few + same
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    return (F.get(F.transform(F.array(words), of), 0) + F.when(100 * upper > MAX_UPPER * F.length(text), 4).otherwise(0)
            + F.when(text.rlike(_ODD), 8).otherwise(0))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest, good, toxic) per document, without the copy bit."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    flags = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    return rows.join(flags, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "part", "mask", "digest", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def mask_cells(rows: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic) with the copy bit: one row for each mask that occurs in a part."""
    keys = ["digest", "mask", "part", "good", "toxic"]
    by_id = rows.groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    with_id = F.col("doc_id").isNotNull()
    by_flags = by_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(with_id, F.col("n")).otherwise(0)).alias("n_id"),
                                        F.min("doc_id").alias("least"), F.min_by(F.when(with_id, F.col("n")), "doc_id").alias("n_least"))
    first = F.min("least").over(W.partitionBy("digest"))
    copies = F.col("n_id") - F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    cells = F.array(F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n")))
    split = by_flags.withColumn("first", first).withColumn("copies", F.when(F.col("n_id") > 0, copies).otherwise(0)).select("part", "good", "toxic", F.explode(cells).alias("c"))
    return split.filter("c.n > 0").groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.when(F.col("good"), F.col("c.n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("c.n")).otherwise(0)).alias("n_toxic"))


def folded(cells: DataFrame) -> DataFrame:
    """Per cell the 600 structs (filter_order, step, filter, counts) of all steps of all orders."""
    n, nothing, mask = F.col("n"), F.lit(0).cast("long"), F.col("mask")
    bits = F.create_map(*[x for k, f in enumerate(FILTERS) for x in (F.lit(f), F.lit(1 << k))])

    def fold(order: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            name = F.substring(order, i, 1)
            bit = F.element_at(bits, name)
            fails = mask.bitwiseAND(bit) != 0
            here = state["alive"] & fails
            counts = [F.when(state["alive"] & ~fails, n), F.when(here, n), F.when(fails & ~state["alive"], n), F.when(mask == bit, n),
                      F.when(here, F.col("n_good")), F.when(here, F.col("n_toxic"))]
            row = F.struct(order.alias("filter_order"), i.alias("step"), name.alias("filter"), *[F.coalesce(c, nothing).alias(k) for k, c in zip(COUNTS, counts)])
            return F.struct((state["alive"] & ~fails).alias("alive"), F.concat(state["rows"], F.array(row)).alias("rows"))
        kind = "array<struct<filter_order: string, step: int, filter: string, " + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>"
        start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("rows"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), start, step, lambda s: s["rows"])
    orders = F.array(*[F.lit(o) for o in ORDERS])
    return cells.select("part", F.flatten(F.transform(orders, fold)).alias("steps"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts per part, order and step, and each filter's removals summed over all orders."""
    steps = folded(mask_cells(marked(docs, labels))).select("part", F.explode("steps").alias("s")).select("part", "s.*")
    sums = steps.groupBy("part", "filter_order", "step", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS])
    total = F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley")
    return sums.select("part", "filter_order", "step", *COUNTS, total)


#: The same rows in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN first < w.doc_id THEN 16 ELSE 0 END) AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(step)),
c AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(g) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(x) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM cell, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM c"""
