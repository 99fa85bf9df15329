"""Near-duplicate lines: exact set-similarity join with prefix, positional and length filters.

A line's tokens are its distinct 5-word shingles (the whole line, if it has fewer words). A line goes if
some earlier line (smaller doc_id, then smaller line number) has 100 * |A and B| >= 75 * |A or B|. Lines of
equal words are one class, whose first line stands for it; a class's other lines go at once.

Tokens are ordered by rarity: a count sketch of fixed size over all lines gives every token a frequency
class, and a token's sort key is (class, hash), the same for all lines. Similar lines share one of the
first n - ceil(0.75 n) + 1 tokens. Classes that share such a token meet in its group: every class
is tested against the first class of the group, and those that stay are then tested against all earlier
classes of their groups. The length filter and the positional filter (what can still be common after
the shared token) act before sets are compared, then an odd sketch of each set (256 bits, each the parity of the tokens
that fall on it: similar sets differ in no more bits than tokens); sets are compared on the lines themselves.

Everything runs on built-in expressions. Texts that are null or have no line with words stay as they are; lines without
words are never removed; rows without doc_id stay unchanged; rows of equal doc_id and text are one
document, others of equal doc_id go by their text's hash; an empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from duelframe.session import cut_lineage

from .native_text import let, shingle_hashes, shingles, word_hashes

#: Cells of the count sketch that orders tokens.
CELLS = 1 << 14
#: 64-bit words of a set's odd sketch, a power of two.
SKETCH = 4


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, line) of every line; `row` is the hash of the text."""
    return _known(docs).select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _known(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def _needed(n: Column, percent: int) -> Column:
    """Tokens of the prefix: fewer common ones than n minus this can't reach the similarity."""
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def _cell(token: Column) -> Column:
    """Cell of the count sketch: the token's uppermost bits."""
    return F.shiftrightunsigned(token, 64 - (CELLS.bit_length() - 1)).cast("int")


def _ranked(tokens: Column, classes: list[int]) -> Column:
    """Distinct tokens in order of rarity: frequency class of the token's cell above 48 bits of the token."""
    high = F.split(F.lit(",".join(str(c << 48) for c in classes)), ",").cast("array<bigint>")        # folded into one literal array
    return F.sort_array(F.transform(tokens, lambda t: F.get(high, _cell(t)).bitwiseOR(F.shiftrightunsigned(t, 16))))


def odd_sketch(tokens: Column) -> Column:
    """Parity of the number of distinct tokens on each bit."""
    def word(j: int) -> Column:
        return F.aggregate(F.filter(tokens, lambda t: t.bitwiseAND(SKETCH - 1) == j), F.lit(0).cast("long"),
                           lambda held, t: held.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, SKETCH.bit_length() - 1).bitwiseAND(63).cast("int"))))
    return F.array(*[word(j) for j in range(SKETCH)])


def matched_lines(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, row, pos) of the lines that an earlier line matches."""
    hashed = lines_of(docs).select("doc_id", "row", "pos", word_hashes(F.col("line")).alias("h")).filter("size(h) > 0")
    # sets are made anew where needed: all of them together are larger than the texts
    tokens = hashed.select(F.xxhash64("h").alias("node"), F.sort_array(F.array_distinct(shingles(F.col("h"), width))).alias("t"))
    cells = lines_of(docs).select(F.explode(shingle_hashes(F.col("line"), width)).alias("t")).groupBy(_cell(F.col("t")).alias("cell")).count().collect()
    total = max(1, sum(r["count"] for r in cells))
    classes = [0] * CELLS
    for r in cells:         # powers of two above the mean cell
        classes[r["cell"]] = max(0, int(2 * r["count"] * CELLS // total).bit_length() - 1)
    prefix = F.slice(_ranked(F.col("t"), classes), F.lit(1), _needed(F.size("t"), percent))
    # size and position share one number: these rows are the widest exchange
    postings = (tokens.select("node", F.size("t").alias("n"), F.posexplode(prefix).alias("i", "token"))
                .select("token", "node", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long")).alias("at")))
    group = W.partitionBy("token")
    shared = (postings.withColumn("lo", F.min("node").over(group)).withColumn("hi", F.max("node").over(group)).filter("lo <> hi").select("token", "node", "at").distinct()
              .select("token", "node", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(0x7FFFFFFF).cast("int").alias("i")))
    shared = cut_lineage(shared, "shared")
    lines = cut_lineage(hashed.select("doc_id", "row", "pos", F.xxhash64("h").alias("node")), "lines")

    firsts = cut_lineage(lines.groupBy("node").agg(F.min(F.struct("doc_id", "pos", "row")).alias("f"), F.count(F.lit(1)).alias("lines")).select("node", "f.*", "lines"), "classes")
    met = (shared.join(firsts, "node").select("token", F.struct("doc_id", "pos", "node", "n", "i").alias("x"))
           .withColumn("c", F.min("x").over(group)))
    met = cut_lineage(met, "met")

    def possible(a: str, b: str) -> Column:
        n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.i"), F.col(f"{b}.i")
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - i, m - j) * (100 + percent) >= (n + m) * percent)

    def candidates(rows: DataFrame, a: str, b: str) -> DataFrame:
        return rows.filter(possible(a, b)).select(F.col(f"{a}.node").alias("early"), F.col(f"{b}.node").alias("late")).distinct()

    places = (met.select("x.node").distinct().join(firsts, "node").groupBy("doc_id", "row").agg(F.collect_set(F.struct("pos", "node")).alias("at")))
    texts = (_known(docs).join(places, ["doc_id", "row"])
             .select(F.explode(let(F.split("text", "\n"), lambda ls: F.transform(F.col("at"), lambda p: F.struct(p["node"].alias("node"), F.get(ls, p["pos"]).alias("line"))))).alias("a"))
             .select("a.node", F.array_distinct(shingle_hashes(F.col("a.line"), width)).alias("t")))
    sets = cut_lineage(texts.dropDuplicates(["node"]).select("node", F.size("t").alias("n"), odd_sketch(F.col("t")).alias("bits"), "t"), "items")

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs that stay possible by their sketches."""
        both = (pairs.join(sets.select(F.col("node").alias("late"), F.struct("n", "bits").alias("y")), "late").join(sets.select(F.col("node").alias("early"), F.struct("n", "bits").alias("x")), "early"))
        differ = sum((F.bit_count(F.get("x.bits", F.lit(i)).bitwiseXOR(F.get("y.bits", F.lit(i)))) for i in range(SKETCH)), F.lit(0))
        return both.filter(differ * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)).select("early", "late")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(near(pairs), "pairs")
        both = (pairs.join(sets.select(F.col("node").alias("late"), F.col("t").alias("b")), "late").join(sets.select(F.col("node").alias("early"), F.col("t").alias("a")), "early"))
        same = F.size(F.array_intersect("a", "b"))
        return both.filter(same * 100 >= (F.size("a") + F.size("b") - same) * percent).select(F.col("late").alias("node")).distinct()

    later = met.filter(F.col("c.node") != F.col("x.node"))
    gone = cut_lineage(verified(candidates(later, "c", "x")), "gone")
    staying = later.withColumn("node", F.col("x.node")).join(gone, "node", "left_anti").select("token", F.col("x").alias("y"))
    second = candidates(later.select("token", "x").join(staying, "token").filter(F.struct("x.doc_id", "x.pos", "x.node") < F.struct("y.doc_id", "y.pos", "y.node")), "x", "y")
    gone = gone.union(cut_lineage(verified(second), "gone")).distinct()

    copies = (lines.join(firsts.filter("lines > 1").select("node", F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.col("row").alias("r")), "node")
              .filter("doc_id <> d or pos <> p or row <> r").select("doc_id", "row", "pos"))
    return copies.union(firsts.join(gone, "node").select("doc_id", "row", "pos")).distinct()


def report(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) per document; `removed` has the line numbers, from 0."""
    gone = matched_lines(docs, width, percent).groupBy("doc_id", "row").agg(F.sort_array(F.collect_list("pos")).alias("removed"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    return base.join(gone, ["doc_id", "row"], "left").select("doc_id", F.greatest("n_lines", F.lit(0).cast("long")).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                                                             F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def drop_lines(docs: DataFrame, width: int = 5, percent: int = 75, drop_emptied: bool = False) -> DataFrame:
    """The documents without the matched lines; n_chars, if there, follows the text. Documents whose lines with words all go
    stay with what is left, or go with `drop_emptied`: all they said stands in earlier documents."""
    gone = (matched_lines(docs, width, percent).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("removed_lines"))
            .select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "removed_lines"))
    joined = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_row"]), "left")
    kept = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda line, i: ~F.array_contains("removed_lines", i)), "\n")
    text = F.when(F.col("removed_lines").isNull(), docs["text"]).otherwise(kept)
    cut = joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], F.col("removed_lines").isNotNull().alias("_cut"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    if drop_emptied:
        cut = cut.filter(~F.col("_cut") | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return cut.select(*docs.columns)
