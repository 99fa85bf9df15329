"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the character n-grams of all languages: each of its cells is a mask
with one bit per language, and an n-gram sets its language's bit in `HASHES` cells. The AND of an
n-gram's cells returns all languages that (may) contain it. A text's n-grams are looked up, bits are
counted per language, and the counts are corrected for the filter's false positives: with fill f of a
language's bit, a foreign n-gram passes with odds f^HASHES =: q, so the expected own count is
(count - q * n) / (1 - q). The language with the largest corrected count wins; ties go to the first
language by name. The score is its share of all corrected counts.

An n-gram enters a language's filter if at least `least` of the language's sampled documents hold it
and no other language holds it `ratio` times as often per document. The fit reads at most `rows`
documents of each language (a documented bound: those with the smallest hashes).

Null texts and texts without a letter are `und` with score 0; with no n-gram known the score is 0 and
the most frequent learned language is given; documents with null lang or null text teach nothing; with
nothing to learn from everything is `und`; repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .tokens import U, mix

#: Bytes of an n-gram, cells of the filter (a power of two), hash functions, sampled documents of a language.
GRAM, CELLS, HASHES, ROWS = 5, 1 << 21, 3, 1500
LEAST, RATIO = 3, 3.0
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def grams(buf: np.ndarray, size: int = GRAM) -> np.ndarray:
    """64-bit codes of all runs of `size` bytes of the lower-cased bytes; digits, marks and white space are one space."""
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += U(32)
    fold[~tokens.ALNUM] = U(32)
    fold[48:58] = U(32)
    b = fold[buf]
    if len(b) < size:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(b) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = (out << U(8)) | b[k:len(b) - size + 1 + k]
    return out


def _count_grams(batches):
    """Distinct n-grams of each sampled document, counted per language in the task."""
    held: dict[str, list] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lo, hi, buf, starts in tokens.pieces(batch.column("text")):
            ends = np.append(starts[1:], len(buf))
            for k in range(hi - lo):
                held.setdefault(langs[lo + k], []).append(np.unique(grams(buf[starts[k]:ends[k]])))
    for lang, lists in held.items():
        values, n = np.unique(np.concatenate(lists), return_counts=True)
        for a in range(0, len(values), 1 << 16):
            k = len(values[a:a + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(values[a:a + k].view(np.int64)), pa.array(n[a:a + k].astype(np.int64))], names=["lang", "gram", "n"])


def cells_of(codes: np.ndarray, cells: int, hashes: int) -> list[np.ndarray]:
    h = mix(codes + U(1))
    step = (h >> U(32)) | U(1)
    return [((h + U(i) * step) & U(cells - 1)).astype(np.int64) for i in range(hashes)]


def fit(known: DataFrame, rows: int = ROWS, cells: int = CELLS, hashes: int = HASHES, least: int = LEAST, ratio: float = RATIO) -> dict:
    """The filter and each language's false-positive rate, from (text, lang)."""
    known = known.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if len(langs) > 64:
        raise ValueError("a mask holds 64 languages")
    order = F.xxhash64("text", F.lit(5))
    part = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, 1.3 * rows / sizes[x]))) for x in langs]) if langs else F.lit(1.0)
    sample = known.filter(F.abs(order % 1_000_000) < part * 1_000_000).select("text", "lang")
    counted = sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    taken = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = counted.withColumn("rate", F.col("n") / F.coalesce(*[F.when(F.col("lang") == x, F.lit(float(n))) for x, n in taken.items()]) if taken else F.lit(0.0))
    best = rate.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "n", "rate")).alias("of"))
    kept = best.select("gram", "best", F.explode("of").alias("o")).filter((F.col("o.n") >= least) & (F.col("o.rate") * ratio >= F.col("best"))).select("gram", "o.lang")
    masks = np.zeros(cells, dtype=np.uint8 if len(langs) <= 8 else np.uint64)
    for r in kept.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect():
        for at in cells_of(np.array(r["grams"], dtype=np.int64).view(np.uint64), cells, hashes):
            masks[at] |= masks.dtype.type(1 << langs.index(r["lang"]))
    fill = np.array([((masks & masks.dtype.type(1 << i)) != 0).mean() for i in range(len(langs))])
    common = max(langs, key=lambda x: (sizes[x], x)) if langs else UNKNOWN
    return {"langs": langs, "masks": masks, "miss": fill ** hashes, "hashes": hashes, "common": common}


def decide(buf: np.ndarray, model: dict) -> np.ndarray:
    """Corrected count of each language."""
    codes = grams(buf)
    codes = codes[codes != U(0x2020202020)]
    found = None
    for at in cells_of(codes, len(model["masks"]), model["hashes"]):
        found = model["masks"][at] if found is None else found & model["masks"][at]
    n = len(codes)
    counts = np.array([np.count_nonzero(found & found.dtype.type(1 << i)) for i in range(len(model["langs"]))]) if n else np.zeros(len(model["langs"]))
    return np.maximum(counts - model["miss"] * n, 0) / (1 - np.minimum(model["miss"], 0.99))


def _predict(sent):
    def run(batches):
        model = sent.value
        for batch in batches:
            lang, score = [], []
            texts = batch.column("text")
            for lo, hi, buf, starts in tokens.pieces(texts):
                ends = np.append(starts[1:], len(buf))
                for k in range(hi - lo):
                    text = texts[lo + k].as_py()
                    if not text or not _LETTER.search(text) or not model["langs"]:
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    counts = decide(buf[starts[k]:ends[k]], model)
                    best, total = int(counts.argmax()), float(counts.sum())
                    lang.append(model["langs"][best] if total else model["common"])
                    score.append(float(counts[best]) / total if total else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, known: DataFrame, rows: int = ROWS) -> DataFrame:
    """(doc_id, lang_pred, score) per document, learned from `known(text, lang)`."""
    model = fit(known.select("text", "lang"), rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(sent), "doc_id long, lang_pred string, score double")
