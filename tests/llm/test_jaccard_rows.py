"""What the similarity join keeps between its steps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.llm import jaccard_join

from . import brute


@pytest.fixture
def kept(monkeypatch):
    """Rows of each intermediate table, by name."""
    rows, cut = {}, jaccard_join.cut_lineage

    def counted(df, purpose):
        out = cut(df, purpose)
        rows.setdefault(purpose, []).append(out.count())
        return out
    monkeypatch.setattr(jaccard_join, "cut_lineage", counted)
    return rows


def components(spark, docs):
    found = jaccard_join.link_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}


def test_signatures_with_the_same_nodes_are_one_group(spark, kept):
    draw = random.Random(5)
    words = [f"w{draw.random()}" for _ in range(400)]
    docs = {1: " ".join(words), 2: " ".join([*words[:200], "other", *words[201:]]), 3: " ".join(f"v{draw.random()}" for _ in range(400))}
    assert components(spark, docs) == brute.components(docs)
    assert kept["met"] == [2]


def test_large_unlike_sets_are_not_compared(spark, kept):
    draw = random.Random(6)
    common, one, two = ([f"w{draw.random()}" for _ in range(n)] for n in (2000, 1000, 1000))
    docs = {1: " ".join(common + one), 2: " ".join(common + two), 3: " ".join(common + one[:900])}
    assert components(spark, docs) == brute.components(docs)
    assert kept["possible"][0] > kept["pairs"][0] == 1


def test_sketches_of_different_lengths(spark):
    draw = np.random.default_rng(7)
    values = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for a, b in ((values[:520], values[:500]), (values[:2000], values[300:1100]), (values, values[:100]), (values[:900], values[:900])):
        x, y = (jaccard_join.odd_sketch(v, jaccard_join.fine_words(len(v))) for v in (a, b))
        words = min(len(x), len(y))
        want = int(np.bitwise_count((jaccard_join.odd_sketch(a, words) ^ jaccard_join.odd_sketch(b, words)).view(np.uint64)).sum())
        row = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<long>, y array<long>")
        assert row.select(jaccard_join.differing(F.col("x"), F.col("y"))).first()[0] == want <= len(set(a.tolist()) ^ set(b.tolist()))
