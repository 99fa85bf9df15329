"""What the line join keeps between its steps."""

import random

from duelframe.llm import line_dedup

from . import brute


def test_unlike_lines_of_a_group_are_not_compared(spark, monkeypatch):
    rows, cut = {}, line_dedup.cut_lineage

    def counted(df, purpose):
        out = cut(df, purpose)
        rows.setdefault(purpose, []).append(out.count())
        return out
    monkeypatch.setattr(line_dedup, "cut_lineage", counted)
    draw = random.Random(8)
    some = lambda n: [f"w{draw.random()}" for _ in range(n)]
    common, one, two, line = some(24), some(34), some(34), some(40)
    docs = {1: common + one, 2: common + two, 3: line, 4: line[:39]} | {k: (one if k % 2 else two) + some(30) for k in range(5, 13)}      # what few lines have comes first
    docs = {k: " ".join(words) for k, words in docs.items()}
    got = {r.doc_id: r.removed for r in line_dedup.report(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect() if r.n_removed}
    assert got == brute.removed_lines(docs) == {4: [0]}
    assert sum(rows["pairs"]) == 1      # not the first two lines, which share their rarest shingles
