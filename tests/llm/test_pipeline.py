"""The corpus pipeline on planted copies, benchmark passages and repeated ids."""

import random

import pytest

import corpus_pipeline
from duelframe.llm import decontaminate, jaccard_join, line_dedup, quality

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(draw, words):
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(3, 8))) for _ in range(words))


@pytest.fixture()
def planted(spark, monkeypatch):
    """Forty own texts; an exact copy, a near copy, a text with a benchmark passage, one id with two texts, nulls and an empty text."""
    draw = random.Random(2)
    texts = {i: prose(draw, 120) for i in range(40)}
    item = prose(draw, 30)
    rows = list(texts.items()) + [(100, texts[0]), (101, texts[1].replace(texts[1].split()[60], "changed")), (102, prose(draw, 60) + " " + item + " " + prose(draw, 60)),
                                  (103, texts[2] + "\n" + prose(draw, 90)), (5, prose(draw, 110)), (104, None), (105, ""), (None, prose(draw, 100))]
    tables = {"documents": spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], KIND), "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
              "labels": spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")}
    monkeypatch.setattr(corpus_pipeline.queries, "table", lambda spark, sf_dir, name: tables[name])
    return tables, texts


def test_run_keeps_one_of_each_group(spark, planted):
    _, texts = planted
    got = [r.doc_id for r in corpus_pipeline.run(spark, "").collect()]
    assert 100 not in got and 101 not in got and 102 not in got          # exact copy, near copy, benchmark passage
    assert sorted(i for i in got if i is not None) == sorted([*texts, 5, 103, 104, 105]) and got.count(None) == 1
    assert all(stage.__doc__ for _, stage in corpus_pipeline.STAGES) and corpus_pipeline.ORACLE_SQL is None


def test_run_on_an_empty_table(spark, planted):
    tables, _ = planted
    tables["documents"] = tables["documents"].limit(0)
    assert corpus_pipeline.run(spark, "").count() == 0


def test_stages_judge_texts_not_ids(spark):
    draw = random.Random(4)
    good, item = prose(draw, 80), prose(draw, 20)
    docs = spark.createDataFrame([(1, good, "en", "s", 1), (1, prose(draw, 40) + " " + item, "en", "s", 1), (2, prose(draw, 70), "en", "s", 1), (2, prose(draw, 70), "en", "s", 1)], KIND)
    clean = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(r.doc_id, r.text == good) for r in clean.filter("doc_id = 1").collect()} == {(1, True)} and clean.count() == 3
    assert jaccard_join.keep_first(docs).count() == 4 and line_dedup.drop_lines(docs, drop_emptied=True).count() == 4


def test_classifier_sample_is_bounded_and_defined(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", "en", "s", 1) for i in range(60)] + [(3, "another text", "en", "s", 1)] * 50, KIND)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(2, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    sample = quality.sampled(docs, labels, 20).collect()
    assert len(sample) == 20 and sum(r.label for r in sample) == 10
    whole = {r.text: r.label for r in quality.sampled(docs, labels).collect()}
    assert len(whole) < 60 and whole.get("text number 2", 1) == 1 and whole == {r.text: r.label for r in quality.sampled(docs.repartition(7), labels.repartition(3)).collect()}
    assert quality.drop_rejected(docs.withColumn("score", docs["doc_id"]), labels).columns == [*docs.columns, "score"]
