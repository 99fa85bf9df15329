"""Column expressions on whole texts: words, shingle hashes, per-row bindings. No Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """`use(v)` with v bound to `value`, which is evaluated once a row even inside nested lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def words(text: Column) -> Column:
    """Lower-case words between white space (space, tab, line feed, vertical tab, form feed, carriage return)."""
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
    return F.array_remove(F.when(odd, F.split(F.lower(text), "[\\x20\\t\\n\\x0b\\f\\r]+")).otherwise(F.split(F.lower(text), " ")), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingles(h: Column, width: int) -> Column:
    """64-bit hashes of `width` consecutive word hashes, in order; the whole sequence as one if there are fewer, but not none."""
    long = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
    return F.when(F.size(h) >= width, long).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def shingle_hashes(text: Column, width: int) -> Column:
    """`shingles` of the words of a text."""
    return let(word_hashes(text), lambda h: shingles(h, width))
