"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

A text's 5-word shingles are hashed once. The top bits of a hash choose one of 128 bins, the bin's
smallest hash is its value. An empty bin takes the value of the first non-empty bin of its own random
probe sequence (optimal densification: every empty bin draws on its own, so copies are independent).
The fingerprint packs the low 8 bits of each value as hexadecimal text. Two unrelated values agree in
8 bits with odds of 1/256, which the likeness corrects: (share - 1/256) / (1 - 1/256), not below 0.

Everything runs on built-in expressions. Null texts count as empty; texts without words have the
fingerprint of dashes, 1.0 alike among themselves and 0.0 to any other; texts of fewer than five words
have one shingle; rows without doc_id are left out of the order of documents, have an empty edited
tail and null near_next; rows of equal doc_id all follow the same document and the smallest of their
texts is what others are compared with; an empty table gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from duelframe.session import cut_lineage

from .native_text import let, shingle_hashes

BINS, BITS, WIDTH = 128, 8, 5
_draw = random.Random(13)
#: Start and odd step of each bin's probe sequence; odd steps visit every bin.
_START = [_draw.randrange(BINS) for _ in range(BINS)]
_STEP = [_draw.randrange(1, BINS, 2) for _ in range(BINS)]
EMPTY = "-" * (2 * BINS)


def fingerprint(text: Column) -> Column:
    """Hexadecimal text of 2 * BINS digits."""
    def bin_of(h):
        return F.shiftrightunsigned(h, 64 - BINS.bit_length() + 1).cast("int")

    def least(hashes):          # first hash of each bin in sorted order
        return F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(hashes, F.greatest(i - 1, F.lit(0))))))

    def spread(values):         # value of each bin, null if empty
        return let(F.transform(values, bin_of), lambda bins: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(values, F.array_position(bins, b).cast("int") - 1)))

    start, step = F.array(*map(F.lit, _START)), F.array(*map(F.lit, _STEP))

    def dense(bins):
        def probe(b):
            return F.coalesce(F.get(bins, b), *[F.get(bins, F.pmod(F.get(start, b) + F.get(step, b) * a, F.lit(BINS)).cast("int")) for a in range(BINS)])
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), probe)

    def packed(values):
        return F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.bitwiseAND(255)), 2, "0")), "")

    def of(hashes):
        return F.when(F.size(hashes) == 0, F.lit(EMPTY)).otherwise(packed(let(let(least(hashes), spread), dense)))
    return F.lower(let(F.sort_array(shingle_hashes(F.coalesce(text, F.lit("")), WIDTH)), of))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * 2 + 1, F.lit(2)) == F.substring(b, i * 2 + 1, F.lit(2))))
    chance = 1.0 / (1 << BITS)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((a == EMPTY) | (b == EMPTY), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id, n) of distinct ids in descending order; the first follows the last.

    Ids are dealt by range; a partition is ordered by itself and only its ends meet across partitions.
    """
    dealt = cut_lineage(ids.repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "ids")
    ends = dealt.groupBy("part").agg(F.max("doc_id").alias("top"))
    order = W.orderBy("part")       # one row for each partition
    ends = ends.select("part", F.coalesce(F.lead("top").over(order), F.max("top").over(W.partitionBy())).alias("beyond"))
    inside = dealt.withColumn("next", F.lead("doc_id").over(W.partitionBy("part").orderBy(F.desc("doc_id"))))
    return inside.join(ends, "part").select("doc_id", F.coalesce("next", "beyond").alias("next_id"), "n")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_id) per document; `edited` is the hash of its edited text."""
    # a cast that changes nothing would keep the two joins below from reading one shuffle
    doc_id = F.col("doc_id") if docs.schema["doc_id"].dataType == LongType() else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("copies"))
    ids = cut_lineage(ids, "ids")
    order = cut_lineage(following(ids.select("doc_id", "n")), "order")
    asked = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("asks"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    named = rows.filter("doc_id is not null")       # both joins read one shuffle of the texts
    heads = named.join(asked, "doc_id").select(F.col("asks").alias("doc_id"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"), F.col("doc_id").alias("next_id"))
    if not ids.filter("copies > 1").isEmpty():
        heads = heads.groupBy("doc_id", "next_id").agg(F.min("head").alias("head"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("head"), F.lit(1), third))
    met = (named.join(heads, "doc_id").select("doc_id", "next_id", "text", "head")
           .union(rows.filter("doc_id is null").select("doc_id", F.lit(None).cast("long"), "text", F.lit(""))).select("doc_id", "next_id", "text", edited.alias("edited")))
    return met.select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"))


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints with near_edited and near_next."""
    found = cut_lineage(fingerprints(docs), "fingerprints")
    beside = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fingerprint").alias("other")).withColumnRenamed("doc_id", "next_id")
    return (found.join(beside, "next_id", "left")
            .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("other")).alias("near_next")))
