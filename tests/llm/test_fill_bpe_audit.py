"""Fill-in-middle, word BPE and the filter audit against plain versions and the library."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pyarrow.parquet as pq
import pytest

from duelframe.llm import fill_middle, filter_audit, queries, word_bpe

SF = "/root/testdata/sf0.01"
KIND = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(40_000))
LINES = "".join(f"line {i} with < signs <S and <P\n" for i in range(9_000))
CASES = [(1, "one\ntwo\nthree\n"), (2, None), (3, ""), (4, "no line feed"), (4, "no line feed"), (None, "null\nid\nhere"), (5, "\n\n\n"), (6, LONG), (7, LINES), (8, "has <S> in\nit"),
         (9, "a<\n<P\nS>\n<M\n>"), (10, "x" * 200_000 + "\n" + "y" * 70_000), (11, "end<\nend<S\nend<P"), (1, "other\ntext\nof one\nid")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], KIND).selectExpr("*", "1 AS n", "'x' AS form", "2 AS block", "3 AS words", "4 AS part", "5 AS mask", "6 AS digest", "true AS good")


def filled(doc_id, text):
    """The contract, word for word."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("size", [fill_middle.CHUNK, 7, 1])
def test_fill_middle(spark, size):
    rows = CASES if size > 7 else [c for c in CASES if len(c[1] or "") < 1000]
    got = Counter(map(tuple, fill_middle.digests(docs_of(spark, rows), size=size).collect()))
    want = Counter()
    for d, t in rows:
        n, form, prefix, middle, output = filled(d, t)
        want[(d, n, form, prefix, middle, sha(output), sha(t or ""))] += 1
    assert got == want


def test_fill_middle_outputs(spark):
    outputs = fill_middle.transform(docs_of(spark, CASES), size=50)
    assert Counter(map(tuple, outputs.collect())) == Counter((d, *filled(d, t)) for d, t in CASES)
    assert Counter(map(tuple, fill_middle.restore(outputs).collect())) == Counter((d, t or "") for d, t in CASES)
    assert fill_middle.transform(docs_of(spark, [])).count() == 0 and fill_middle.digests(docs_of(spark, [])).count() == 0
    assert {r.form for r in fill_middle.digests(docs_of(spark, CASES), (7, 0, 50)).collect()} == {"plain"}


def test_fill_middle_restores_by_one_shuffle(spark):
    pieces = fill_middle.sorted_pieces(docs_of(spark, CASES))
    placed = pieces.mapPartitions(fill_middle._digested, preservesPartitioning=True)
    assert placed.partitionBy(pieces.getNumPartitions(), fill_middle._spread) is placed


def test_places_do_not_depend_on_the_pieces():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice("<PSM>\nab") for _ in range(draw.randint(0, 60)))
        n, form, _, _, output = filled(draw.randint(0, 99), text)
        pieces, lo = [], 0
        while lo < len(output):
            hi = lo + draw.randint(1, 5)
            pieces.append(output[lo:hi])
            lo = hi
        assert "".join(x for _, x in sorted(fill_middle.original_places(form, pieces))) == text


WORDS = ["It's <|endoftext|> we'll", "<|startoftext|><|startoftext|>x", "Ünïcödé ǅ İstanbul ΣΑΣ ſt ﬁ", "é J̌ Å ﬁ ①", "日本語 123 ١٢ ½ ²", "a\xa0b c\x1cd\x85e​f", "!!!...'s'S 'RE", "<|x|> <|endoftext|", "🙂🙃 ok", "\u0000\u0001", "ab­c ŉ ǅ", "퟿", "don't I'VE"]


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.vocabulary(queries.WORD_VOCABULARY))


def expected(texts):
    tok = library()
    out = []
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((ids, tok.decode(ids, skip_special_tokens=False)))
    return out


@pytest.mark.parametrize("block", [word_bpe.BLOCK, 40])
def test_word_bpe(spark, block):
    draw = random.Random(5)
    made = ["".join(draw.choice([chr(draw.randint(0x20, 0x24f)), chr(draw.randint(0x20, 0x7e)), " ", "\n", chr(draw.randint(0xa0, 0x2fff))]) for _ in range(60)) for _ in range(300)]
    rows = CASES + [(100 + i, t) for i, t in enumerate(WORDS + made)]
    path = queries.vocabulary(queries.WORD_VOCABULARY)
    want = Counter((d, tuple(ids), decoded) for (d, _), (ids, decoded) in zip(rows, expected([t for _, t in rows])))
    for got in (word_bpe.encode(docs_of(spark, rows), path, block, decoded=True), word_bpe.decode(word_bpe.encode(docs_of(spark, rows), path, block), path)):
        assert Counter((r.doc_id, tuple(r["ids"]), r.decoded) for r in got.collect()) == want


def test_every_plain_character_is_cut_as_in_the_library():
    vocabulary, tok = word_bpe.load(queries.vocabulary(queries.WORD_VOCABULARY)), library()
    for c in (chr(i) for i in range(0x250)):
        for text in (c, f"a{c}b", f"1{c}{c}!", f"'{c}", f" {c} "):
            assert [i for w in vocabulary.words(text) for i in vocabulary.ids(w)] == tok.encode(text, add_special_tokens=False).ids, (hex(ord(c)), text)


def test_word_bpe_query(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_word_bpe(spark, SF).collect()}
    assert got == {d: (len(ids), sha(" ".join(map(str, ids))), sha(decoded)) for d, (ids, decoded) in zip(t["doc_id"], expected(t["text"]))}
    assert word_bpe.encode(docs_of(spark, []), queries.vocabulary(queries.WORD_VOCABULARY)).count() == 0


def audited(docs, labels):
    """All 120 orders applied one after the other to rows (doc_id, text, lang)."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        rows.append((lang or "", {f for f in fails if fails[f]}, d in good if d is not None else False, d in toxic if d is not None else False))
    out = {}
    for part in {r[0] for r in rows}:
        mine, removed_by = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = list(range(len(mine)))
            for step, f in enumerate(order, 1):
                gone = [i for i in alive if f in mine[i][1]]
                failing = sum(f in r[1] for r in mine)
                alive = [i for i in alive if f not in mine[i][1]]
                out[part, order, step] = [len(alive), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(mine[i][2] for i in gone), sum(mine[i][3] for i in gone)]
                removed_by[f] += len(gone)
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_by[order[step - 1]])
    return out


def test_filter_audit(spark):
    draw = random.Random(3)
    texts = [None, "", "#", "ABC def", "a " * 120, " ".join(f"w{i}" for i in range(130)), " ".join(f"W{i}" for i in range(130)) + " X" * 40, "é x\x0by", " ".join(f"w{i}" for i in range(130)) + " 5%"]
    docs = [(draw.choice([None, *range(30)]), draw.choice(texts), draw.choice([None, "", "en", "fr"])) for _ in range(150)]
    labels = [(draw.choice([None, *range(40)]), draw.choice([None, 0, 1]), draw.choice([None, 0, 1])) for _ in range(60)]
    rows = spark.createDataFrame([(d, t, lang, "s", 1) for d, t, lang in docs], KIND).selectExpr("*", "1 AS part", "2 AS mask", "'x' AS digest", "true AS good", "3 AS n", "4 AS _id")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part", "1 AS _id", "false AS good")
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in filter_audit.audit(rows, marks).collect()}
    assert got == audited(docs, labels) and len(got) == 600 * 3
    assert filter_audit.audit(rows.limit(0), marks).count() == 0
    none = filter_audit.audit(rows, marks.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert list(none) == [0, 0]
