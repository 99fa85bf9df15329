"""Nulls, empty and repeated rows, empty tables and extra columns."""

import pytest

from duelframe.llm import decontaminate, fingerprints, html_crf, jaccard_join, langid, line_dedup, personal_data, quality, queries, sentencepiece_bpe, url_filter

LONG = " ".join(f"w{i}" for i in range(40_000))
TEXT = "The quick brown fox jumps over the lazy dog near the river bank today"
ROWS = [(1, TEXT, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (4, TEXT, "en", "s", 5), (4, TEXT, "en", "s", 5), (None, TEXT, None, "s", 1),
        (5, " \n\t ", "en", "s", 1), (6, LONG, "en", "s", 1), (7, "x", None, "s", 1)]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND).selectExpr("*", "1 AS node", "2 AS row", "3 AS score", "4 AS items")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_jaccard_join(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_components(docs).collect()}
    n = len(TEXT.split()) - 4
    assert got == {(1, n, 1), (2, 0, 2), (3, 0, 3), (4, n, 1), (None, n, None), (5, 0, 5), (6, 39_996, 6), (7, 1, 7)}
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "None"]
    assert jaccard_join.link_components(none).count() == 0


def test_signatures_of_similar_sets_meet():
    import numpy as np
    draw = np.random.default_rng(1)
    few, no = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(8):
            a = draw.integers(0, 1 << 63, size, dtype=np.uint64)
            b = a.copy()
            for _ in range(3 * size):       # change elements as long as the sets stay similar
                c = np.append(b[1:], draw.integers(0, 1 << 63, draw.integers(0, 3), dtype=np.uint64))
                same = len(np.intersect1d(a, c))
                if 100 * same < 75 * (len(a) + len(c) - same):
                    break
                b = c
            frequent = np.sort(draw.choice(a, size // 3, replace=False)) if size > 3 else few
            rank, seen = np.arange(len(frequent)), np.full(len(frequent), 9, dtype=np.int64)
            x, y = ({int(s) for sig, _ in jaccard_join.signatures(np.unique(v), frequent, rank, seen, 75) for s in sig} for v in (a, b))
            assert x & y or np.array_equal(np.unique(a), np.unique(b)) and len(no) == 0
            differ = len(np.setxor1d(a, b))
            bits = int(np.bitwise_count((jaccard_join.odd_sketch(np.unique(a)) ^ jaccard_join.odd_sketch(np.unique(b))).view(np.uint64)).sum())
            assert bits <= differ and (differ > 40 or bits >= differ // 2)


def test_sets_similar_to_equal_ones_only_sign_nothing():
    import numpy as np
    no = np.empty(0, dtype=np.int64)
    for size, signs in ((1, False), (2, False), (3, True), (9, True)):
        found = list(jaccard_join.signatures(np.arange(1, size + 1, dtype=np.uint64) << np.uint64(40), np.empty(0, dtype=np.uint64), no, no, 75))
        assert bool(found) == signs


def test_near_copies_that_do_not_link(spark):
    """A cluster of heavily edited copies: most of its members are similar to none, some to a few, and all share signatures."""
    import random

    from .brute import components
    draw = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(150):
        words = list(base)
        for at in draw.sample(range(120), draw.randint(2, 9)):
            words[at] = f"e{draw.randrange(400)}"
        texts.append(" ".join(words))
    texts += ["one", "two words", "one", "three short words", "a b c d e f g", "a b c d e f h", "a b c d e f g x"] + [f"short{i}" for i in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == components(dict(docs))
    assert 80 < len({c for _, c in got.values()}) < len(docs) - 20


def test_line_dedup(docs, none):
    got = line_dedup.drop_lines(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: TEXT, 2: None, 3: "", 4: "", None: TEXT, 5: " \n\t ", 6: LONG, 7: "x"}
    assert line_dedup.report(none).count() == 0


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, TEXT), (1, TEXT), (2, "x"), (3, None), (None, "lazy"), (4, "")], "item_id long, text string")
    for block in (decontaminate.BLOCK, 2):
        got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.find_windows(docs, bench, block=block).collect()}
        assert got == {(1, 14, 14, (1,)), (4, 14, 14, (1,)), (None, 14, 14, (1,)), (2, 0, 0, ()), (3, 0, 0, ()), (5, 0, 0, ()), (6, 40_000, 0, ()), (7, 1, 1, (2,))}
    assert sorted(r.doc_id or 0 for r in decontaminate.drop_contaminated(docs, bench).collect()) == [0, 2, 3, 5, 6]
    assert decontaminate.find_windows(docs, bench.limit(0)).filter("n_hit > 0").count() == 0 and decontaminate.find_windows(none, bench).count() == 0


def test_language(docs, none):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, docs.select("text", "lang")).collect()}
    assert got[2] == got[3] == got[5] == ("und", 0.0) and got[1][0] == "en"
    assert {r.lang_pred for r in langid.identify(docs, none.select("text", "lang")).collect()} == {"und"} and langid.identify(none, docs.select("text", "lang")).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 0), (6, 1), (None, 0)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5} and quality.score(none, labels).count() == 0
    assert quality.drop_rejected(docs, labels).columns == docs.columns


def test_sentencepiece(docs, none):
    got = {r.doc_id: r for r in sentencepiece_bpe.encode(docs, queries.vocabulary(), whole=1).collect()}
    assert all(r.checked for r in got.values()) and got[2].ids == got[3].ids == [] and got[6].decoded == LONG
    assert sentencepiece_bpe.encode(none, queries.vocabulary()).count() == 0


def test_personal_data(spark, docs, none):
    assert all(r.spans == "" for r in personal_data.digests(personal_data.find_spans(docs)).collect())
    assert personal_data.find_spans(none).count() == 0
    for text, want in {"write joe [at] mail (dot) org now": ("email", "joe [at] mail (dot) org"), "ann at site dot example dot com": ("email", "ann at site dot example dot com"),
                       "jоe@mаil.com": ("email", "jоe@mаil.com"), "ring plus one five five five one two three four five six seven": ("phone", "plus one five five five one two three four five six seven"),
                       "host 10 (dot) 0 (dot) 0 (dot) 7 up": ("ip", "10 (dot) 0 (dot) 0 (dot) 7")}.items():
        base, added = personal_data.find(text)
        assert (want[0], text.index(want[1]), text.index(want[1]) + len(want[1])) in base + added, (text, base, added)


def test_disguise_around_a_base_span():
    """A plain remainder that is an identifier of its own stays, and the whole disguised one stands beside it."""
    for text, plain in {"jоe@mail.com": "e@mail.com", "joe@mail.cоm": "joe@mail.c", "joe@mail.example [dot] com": "joe@mail.example", "ann dot lee@site.com": "lee@site.com"}.items():
        at = text.index(plain)
        assert personal_data.find("to " + text + " now") == ([("email", 3 + at, 3 + at + len(plain))], [("email", 3, 3 + len(text))]), text
    assert personal_data.find("joe@mail.com and ten [dot] net")[1] == []


def test_mixed_disguises():
    for text in ("ann at example (dot) com", "ann at mail.example dot com", "ann at example.com", "ann (at) example dot com", "ann at mail dot example.com", "ann at mail [dot] example dot com"):
        assert personal_data.find("to " + text + " now") == ([], [("email", 3, 3 + len(text))]), text
    number = "plus four 4 two 0 seven 9 four 6 one 2 three"
    assert personal_data.find("ring " + number) == ([], [("phone", 5, 5 + len(number))])
    for text in ("we met at 10.30 and at 10.0.0.7", "meet me at home. Then go", "at one dot"):
        assert personal_data.find(text) == (personal_data.detect(text), []), text


def test_detectors_equal_the_plain_patterns():
    import random
    import time
    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choice("a1.@-_ 29") for _ in range(draw.randint(0, 30)))
        found = personal_data.detect(text)
        assert [s[1:] for s in found if s[0] == "email"] == [m.span() for m in personal_data.EMAIL.finditer(text)], text
        assert [m.span() for m in personal_data._IP_RUNS.finditer(text)] == [m.span() for m in personal_data.IP.finditer(text)], text
    for text in ("1" * 1_000_000 + ".", "a" * 1_000_000 + "@", "1." * 500_000 + "x", "a@" * 500_000, "+1(" * 300_000, "a at " + "1." * 400_000):
        begun = time.time()
        personal_data.find(text)
        assert time.time() - begun < 10, text[:8]


def test_exit_misses_nothing():
    """A text that the exit takes for plain has no hidden span and is not rewritten."""
    import random

    rng = random.Random(6)
    parts = ["ann", "mail", "com", "at", "At", "dot", "DOT", "[dot]", "(at)", "<.>", "@", ".", "plus", "+", "one", "Two", "oh", "zero", "seven", "4", "0", "79", "10.0", "jо", "é", "x_", "-", ",", "punkt", "{ punto }"]
    seen = [0, 0]
    for _ in range(40_000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " ", " ", "\n", "  "]) for _ in range(rng.randint(2, 14)))
        exits = personal_data.plain(text)
        seen[exits] += 1
        if exits:
            assert personal_data.normalise(text).text == text and not personal_data.hidden(text, personal_data.detect(text)), text
    assert min(seen) > 1000, seen


def test_fingerprints(docs, none):
    got = {r.doc_id: r for r in fingerprints.compared(docs).collect()}
    assert got[1].fingerprint == got[4].fingerprint and got[2].fingerprint == got[3].fingerprint == got[5].fingerprint == fingerprints.EMPTY
    assert got[2].near_next is not None and got[None].near_next is None and fingerprints.compared(none).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "https://a.example.org/es/1?q"), (2, None), (3, "no scheme"), (4, "http://EXAMPLE.org/x"), (5, "http://b.com/de/"), (6, "http://free-bets.net"), (7, "ftp://org?x"), (7, "ftp://org?x")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("example.org", "/x", "org/", "allow"),
                   5: ("b.com", "/de/", "com/de/", "block"), 6: ("free-bets.net", "", None, "block"), 7: ("org", "", None, "allow")}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_first_url_level_passes_few_keys():
    """About as many other keys pass the first level as are listed, also in a universe that is far larger."""
    import numpy as np

    draw = np.random.default_rng(3)
    for n, size in ((10, 3_000_000), (40, 1_000_000), (5_000, 1_000_000), (3, 4)):
        passed = [int(url_filter.Level(0, keys[:n], min(0.5, n / size)).passes(keys[n:]).sum()) for keys in (draw.integers(0, 1 << 63, size, dtype=np.uint64) for _ in range(3))]
        assert np.mean(passed) <= 4 * n + 10, (n, size, passed)
        keys = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        assert url_filter.Level(0, keys, min(0.5, n / size)).passes(keys).all()


def test_html(spark):
    page = ('<html><head><title>t</title></head><body><nav><a href="/">home</a></nav><main><h1>Big news of the day</h1><p>One &amp; two, and more words here.<p>Three <b>four</b>ty lines of text, it says.'
            '<div class="comments"><div class="comment"><p>I like this very much, thanks.</p></div></div></main><footer>&copy; us</footer>')
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<<<p"), (1, "u", page)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_crf.extract(pages).collect()}
    assert got[1] == "Big news of the day One & two, and more words here. Three fourty lines of text, it says." and got[2] == got[3] == ""
    assert html_crf.extract(pages.limit(0)).count() == 0


def test_html_unclosed_silent_tags():
    def texts(html):
        return [b[0] for b in html_crf.blocks_of(html)]
    rest = "<article><h1>Big news</h1>\n<p>One two three.<p>Four."
    want = ["Big news", "One two three.", "Four."]
    assert texts("<html><head><title>t</title>" + rest) == want and texts("<html><head><script>x</script><style>y</style>\n" + rest) == want
    for tag, inside in {"noscript": "hidden", "object": "<param name=x>hidden", "select": "<option>hidden", "svg": "<g><text>hidden</text>"}.items():
        assert texts(f"<body><{tag}>{inside}\n{rest}") == want, tag
        assert texts(f"<head><{tag}>{inside}\n{rest}") == want, tag
        assert texts(f"<{tag}>{inside}{rest}<{tag}>{inside}</{tag}><p>end") == want + ["end"], tag
        assert texts(f"<body><{tag}>{inside}<p>hidden too</p></{tag}>{rest}") == want, tag       # closed: silent to its end
    assert texts("<svg><svg></svg><p>hidden</p></svg><p>x") == ["x"] and texts("<svg/>" + rest) == want
    assert texts("<head><noscript><img src=x>hidden</noscript><title>t</title></head><body>" + rest) == want


def test_row_agendas_equal_heaps():
    """Units of all lengths and of characters in and outside the vocabulary: rows, heaps and the library agree."""
    import random

    from duelframe.llm import queries, sentencepiece_bpe as bpe

    library, pieces, byte_ids, _, pairs = bpe.load(queries.vocabulary())
    rng = random.Random(5)
    known = sorted(pieces[1])
    units = [bpe.SPACE + "".join(rng.choice(known).replace(bpe.SPACE, "") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    units += [bpe.SPACE + "".join(chr(rng.choice([rng.randint(33, 600), rng.randint(0x4E00, 0x4FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 90))) for _ in range(1000)]
    units += [bpe.SPACE + "a" * n for n in range(1, 140)]
    rows = bpe.encode_units(units, pieces, pairs, byte_ids)
    assert rows == [bpe.encode_unit(u, pieces, byte_ids) for u in units]
    plain = [i for i, u in enumerate(units) if u.isascii() or u[1:].isalpha()]
    assert sum(rows[i] != library.encode(units[i][1:]) for i in plain) == 0
    assert bpe.encode_units([], pieces, pairs, byte_ids) == []
