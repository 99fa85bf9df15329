"""Registered queries over the small tables against plain versions and the libraries."""

import pyarrow.parquet as pq
import pytest

from duelframe.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


def test_jaccard_join(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_jaccard_join(spark, SF).collect()}
    assert got == brute.components(docs)


def test_line_dedup(spark, docs):
    part = {d: docs[d] for d in sorted(docs)[:300]}
    df = spark.createDataFrame(list(part.items()), "doc_id long, text string")
    from duelframe.llm import line_dedup
    got = {r.doc_id: r.removed for r in line_dedup.report(df).collect() if r.n_removed}
    assert got == brute.removed_lines(part)
    cleaned = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    assert cleaned == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in got.get(d, [])) for d, t in part.items()}


def test_decontaminate(spark, docs):
    b = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    want = brute.contamination(docs, list(zip(b["item_id"], b["text"])))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op9_decontaminate(spark, SF).collect()}
    assert got == {d: (n, h, len(i), brute.sha(",".join(i)), h > 0) for d, (n, h, i) in want.items()}


def test_sentencepiece(spark, docs):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary())
    got = {r.doc_id: r for r in queries.op4_sentencepiece(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, text in docs.items():
        ids = library.encode(text)
        r = got[d]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.checked) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids)), True)


def test_personal_data(spark, docs):
    got = {r.doc_id: r for r in queries.op6_personal_data(spark, SF).collect()}
    for d, text in docs.items():
        base = brute.base_spans(text)
        r, written = got[d], [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == brute.sha(",".join(written))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))
        assert set(written) <= set(r.spans.split(","))


def test_url_filter(spark):
    t = pq.read_table(f"{SF}/pages.parquet").to_pydict()
    got = {r.page_id: r for r in queries.op8_url_filter(spark, SF).collect()}
    for p, url in zip(t["page_id"], t["url"]):
        host, path, rule, says = brute.verdict(url)
        assert (got[p].host, got[p].path, got[p].rule) == (host, path, rule)
        assert got[p].verdict == says if says else got[p].verdict in ("allow", "block")


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in queries.op7_fingerprints(spark, SF).collect()}
    ids, errors = sorted(docs, reverse=True), []
    for d, nxt in zip(ids, ids[1:] + ids[:1]):
        text = docs[d]
        k = len(text) // 3
        edited = text[:len(text) - k] + docs[nxt][:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(edited))
        a, b, c = brute.shingle_set(text), brute.shingle_set(edited), brute.shingle_set(docs[nxt])
        errors += [abs(r.near_edited - len(a & b) / len(a | b)), abs(r.near_next - len(a & c) / len(a | c))]
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.3
    by_text = {}
    for d, text in docs.items():
        assert by_text.setdefault(text, got[d].fingerprint) == got[d].fingerprint


def test_language(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    lang = dict(zip(t["doc_id"], t["lang"]))
    rows = [r for r in queries.op3_language_masks(spark, SF).collect()]
    held = [r for r in rows if r.held_out]
    assert 100 < len(held) < 300 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_quality(spark):
    t = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    label = dict(zip(t["doc_id"], t["quality"]))
    rows = queries.op10_quality(spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_html(spark):
    t = pq.read_table(f"{SF}/pages.parquet").to_pydict()
    import html
    import re
    for r in queries.op2_html_crf(spark, SF).collect():
        page = t["html"][t["page_id"].index(r.page_id)]
        article = re.search("<article>(.*?)(</article>|<footer)", page, re.S).group(1)
        want = " ".join(html.unescape(re.sub("</?[a-z][^>]*>", " ", article.replace("<b>", "").replace("</b>", ""))).split())
        assert r.text == want and r.n_chars == len(want)
