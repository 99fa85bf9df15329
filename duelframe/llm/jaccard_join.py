"""Similarity join of word n-gram sets by PartEnum signatures; exact near-duplicate components.

Sets with 100 * |A and B| >= 75 * |A or B| differ in at most k = (|A| + |B|) / 7 elements. The hashed
feature domain is cut into partitions; at most k of them differ between the two sets, so one of the
partitions agrees. Sizes are banded by powers of two; a set signs in its own band and, if a smaller
partner may live there, in the band below. Partitions are put in one order for all sets: ordinary
ones first, then one partition for each of the most frequent shingles, rarest first. A set needs only
its first k + r nonempty partitions; its signatures are the r-subsets of them (r = 2 for sets below 32
elements, whose partitions are single elements, else r = 1). Two sets with enough nonempty partitions
and at most k differing ones share such a subset; sets with fewer nonempty ones, which needs equal
32-bit hashes or a freak of them, share a signature of their own. Where k is 0 only equal sets are similar, and
those are one node: they need no signature. So no link is lost, whatever the hash values are; candidates are
verified on the sets.

Copies are one node. A signature's nodes are tested against its first node, the one that is in the
largest groups; only pairs that these links leave in different components are tested further: a group
of n copies costs n tests. A pair is dropped early if the sizes differ too much or if the odd sketches of
the two sets (1,024 bits, each the parity of the elements that fall on it) differ in more than k bits, which
no similar sets do: a differing element flips one bit. What passes is tested likewise on sketches of two to four bits
an element, which large sets don't fill; only the rest is compared on the sets. Signatures with the same nodes are one
group: near copies share most of theirs. Sets that share many groups are tested once, where their lowest shared one is
known: every node carries its lowest groups. Signatures made of very frequent shingles are salted.

Nulls and texts without words have an empty set and link with nothing; rows without doc_id are kept
with a null component; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from duelframe.session import cut_lineage

from . import tokens
from .tokens import U, mix

#: Shingles that get a partition of their own; only their order depends on this bound, no result does.
FREQUENT = 1 << 16
#: Shingles counted together before frequent ones are reported, and the count that makes one frequent there.
UNIT, UNIT_COUNT = 1 << 20, 3
#: Nodes of a signature that may meet in one group; beyond it, signatures are salted.
HOT = 20_000
#: 64-bit words of a set's odd sketch.
MAP = 16
#: Lowest signatures that a node carries, by which most of a pair's repeated meetings are left out.
LOW = 8
#: Bands of sets below twice this size sign with pairs of single elements.
SHORT = 16
#: Candidate documents whose ids may be sent to all tasks (8 bytes each); beyond it they are joined.
SENT_IDS = 1 << 20


def _row_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    for lo, hi, counts, hashes in tokens.row_words(batch.column("text"), tokens.SPACED):
        n, values = tokens.shingles(counts, hashes, width, True)
        ends = np.cumsum(n)
        for k in range(hi - lo):
            yield lo + k, np.unique(values[ends[k] - n[k]:ends[k]])


def node_of(values: np.ndarray) -> int:
    """64-bit identity of a set."""
    return int(mix(np.array([mix(values).sum() + U(len(values))], dtype=np.uint64))[0].astype(np.int64)) if len(values) else 0


def _describe(width: int):
    """Rows (doc_id, n, node, 0) of documents and (null, null, shingle, count) of locally frequent shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("seen", pa.int64())])

    def frequent(held):
        values, seen = np.unique(np.concatenate(held), return_counts=True)
        keep = seen >= UNIT_COUNT
        k = int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(values[keep].view(np.int64)),
                                           pa.array(seen[keep].astype(np.int64))], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            n, nodes = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for row, values in _row_sets(batch, width):
                n[row], nodes[row] = len(values), node_of(values)
                held.append(values)
                size += len(values)
                if size >= UNIT:
                    yield frequent(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(nodes), pa.array(np.zeros(len(n), dtype=np.int64))], schema=schema)
        if held:
            yield frequent(held)
    return run


def limit(s: int, t: int, percent: int) -> int:
    """Most elements in which sets of these sizes can differ and still reach the similarity."""
    return (s + t) * (100 - percent) // (100 + percent)


def signatures(values: np.ndarray, frequent: np.ndarray, rank: np.ndarray, seen: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signatures, frequency bound of each) of a sorted set; `frequent` is sorted, `rank` its order by count."""
    s = len(values)
    if not s:
        return
    at = np.minimum(np.searchsorted(frequent, values), max(len(frequent) - 1, 0))
    is_frequent = frequent[at] == values if len(frequent) else np.zeros(s, dtype=bool)
    plain, common = values[~is_frequent], at[is_frequent]
    common = common[np.argsort(rank[common])]
    contents = mix(np.concatenate((plain, frequent[common] if len(frequent) else plain[:0])) + U(0x5851F42D4C957F2D))
    counts = np.concatenate((np.ones(len(plain), dtype=np.int64), seen[common] if len(frequent) else np.empty(0, dtype=np.int64)))
    home = s.bit_length() - 1
    bands = [(home, limit(s, s * 100 // percent, percent))]
    if home and -(-percent * s // 100) <= (1 << home) - 1:
        bands.append((home - 1, limit(s, (1 << home) - 1, percent)))
    for band, k in bands:
        if not k:       # only equal sets
            continue
        x = 1 << band
        n = 1 << 32 if x <= SHORT else x if x >= 64 else 4 * x
        r = 2 if x <= SHORT else 1
        where = np.concatenate(((((plain >> U(32)) * U(n & 0xFFFFFFFF)) >> U(32) if n < 1 << 32 else plain >> U(32)).astype(np.int64), n + rank[common] if len(common) else np.empty(0, dtype=np.int64)))
        first = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1))
        sparse = len(first) < k + r
        stop = len(where) if len(first) <= k + r else int(first[k + r])
        first = first[:k + r]
        sums = np.add.reduceat(contents[:stop], first)
        part = mix(sums + where[first].astype(np.uint64) * U(0x9E3779B97F4A7C15))
        least = np.minimum.reduceat(counts[:stop], first)
        if r == 2 and len(part) > 1:
            pairs = np.array(list(combinations(range(len(part)), 2)))
            part, least = part[pairs[:, 0]] + part[pairs[:, 1]] * U(3), np.minimum(least[pairs[:, 0]], least[pairs[:, 1]])
        elif r == 2:
            part = part[:0]
            least = least[:0]
        if sparse:
            part, least = np.append(part, U(1)), np.append(least, 1)
        yield mix(part + U((band + 1) * 0xD1342543DE82EF95 % (1 << 64))), least


def _sign(width: int, percent: int, frequent: np.ndarray, rank: np.ndarray, seen: np.ndarray):
    schema = pa.schema([("sig", pa.int64()), ("salt", pa.int32()), ("node", pa.int64())])

    def table(sigs, nodes, salts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(np.concatenate(nodes))], schema=schema)

    def run(batches):
        done: set[int] = set()          # copies in one task sign once
        for batch in batches:
            sigs, nodes, salts, size = [], [], [], 0
            for _, values in _row_sets(batch, width):
                node = node_of(values)
                if not len(values) or node in done:
                    continue
                done.add(node)
                for sig, least in signatures(values, frequent, rank, seen, percent):
                    sigs.append(sig)
                    nodes.append(np.full(len(sig), node, dtype=np.int64))
                    ways = np.maximum(least // HOT, 0) + 1
                    salts.append(np.where(ways > 1, 1 + (node % ways), 0).astype(np.int32))
                    size += len(sig)
                if size > 1 << 18:
                    yield table(sigs, nodes, salts)
                    sigs, nodes, salts, size = [], [], [], 0
            if size:
                yield table(sigs, nodes, salts)
    return run


def odd_sketch(values: np.ndarray, words: int = MAP) -> np.ndarray:
    """Parity of the number of elements on each bit: the sketches of two sets differ in at most as many bits as the sets in elements.
    A sketch of half the words is the exclusive or of the two halves."""
    on = np.bincount((mix(values) % U(64 * words)).astype(np.int64), minlength=64 * words)
    return np.packbits((on & 1).astype(np.uint8)).view(np.int64)


def fine_words(n: int) -> int:
    """Words, a power of two, of the sketch that has at least two bits for each of n elements."""
    return max(MAP, 1 << (-(-2 * n // 64) - 1).bit_length())


def differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded to the length of the shorter."""
    size = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        parts = F.sequence(F.lit(0), (F.size(x) / size).cast("int") - 1)
        return F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), size), lambda held, k: F.zip_with(held, F.slice(x, k * size + 1, size), lambda p, q: p.bitwiseXOR(q)))
    return F.aggregate(F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x)


def _sets_of(width: int, wanted, whole: bool):
    """Rows (node, n, items) of sets if `whole`, else (node, n, bits, fine) of their odd sketches; no finer one is made where it has the same length."""
    lists = ["items"] if whole else ["bits", "fine"]
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), *((x, pa.list_(pa.int64())) for x in lists)])

    def table(nodes, sizes, held):
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in zip(*held))], schema=schema)

    def described(values):
        if whole:
            return (values.view(np.int64),)
        words = fine_words(len(values))
        return odd_sketch(values), odd_sketch(values, words) if words > MAP else np.empty(0, dtype=np.int64)

    def run(batches):
        ids = wanted.value if wanted is not None else None
        for batch in batches:
            if ids is not None:
                own = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
                batch = batch.filter(pa.array((ids[at] == own) if len(ids) else np.zeros(len(own), dtype=bool)))
            nodes, sizes, held, size = [], [], [], 0
            for _, values in _row_sets(batch, width):
                nodes.append(node_of(values))
                sizes.append(len(values))
                held.append(described(values))
                size += sum(map(len, held[-1]))
                if size > 1 << 18:
                    yield table(nodes, sizes, held)
                    nodes, sizes, held, size = [], [], [], 0
            if nodes:
                yield table(nodes, sizes, held)
    return run


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links(u, v)`, root being the smallest node that it reaches.

    Alternating stars: larger neighbours move to the smallest neighbour, then smaller ones do, until
    nothing moves. Minima are pre-aggregated and joined back, so a node of very many links is no task's burden.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges, last = cut_lineage(edges, "edges"), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.expr("cast(xxhash64(u, v) as decimal(20,0))"))).first()
        if mark == last or not mark[0]:
            break
        last = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = cut_lineage(small.filter("u <> v").distinct(), "edges")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def link_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document: the components of documents whose shingle sets
    reach a Jaccard similarity of `percent` hundredths, named by their smallest doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut_lineage(docs.mapInArrow(_describe(width), "doc_id long, n long, node long, seen long"), "sets")
    rows = found.filter("seen = 0").select("doc_id", "n", "node")
    top = (found.filter("seen > 0").groupBy("node").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "node").limit(FREQUENT)).collect()
    top.sort(key=lambda r: r.node % (1 << 64))
    frequent = np.array([r.node for r in top], dtype=np.int64).view(np.uint64)
    seen = np.array([r.seen for r in top], dtype=np.int64)
    rank = np.empty(len(top), dtype=np.int64)
    rank[np.lexsort((frequent, seen))] = np.arange(len(top))

    signed = docs.mapInArrow(_sign(width, percent, frequent, rank, seen), "sig long, salt int, node long")
    group = W.partitionBy("sig", "salt")
    met = (signed.withColumn("last", F.max("node").over(group)).withColumn("first", F.min("node").over(group)).withColumn("size", F.count(F.lit(1)).over(group))
           .filter("first < last or salt > 0").select("sig", "salt", "node", "size").distinct())
    # unsalted signatures with the same nodes become one, named by its nodes
    members = F.when(F.col("salt") == 0, F.xxhash64(F.bit_xor(F.xxhash64("node")).over(group), F.count(F.lit(1)).over(group))).otherwise(F.col("sig"))
    met = cut_lineage(met.withColumn("members", members).groupBy(F.col("members").alias("sig"), "salt", "node").agg(F.sum("size").alias("size")), "met")
    # a text from which many others were made is in most of its groups, and those are large: it goes first
    weights = cut_lineage(met.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    order = group.orderBy(F.desc("weight"), "node")
    shared = cut_lineage(met.join(weights, "node").select("sig", "salt", "node", F.first("node").over(order).alias("first"), F.row_number().over(order).alias("rank")), "shared")

    classes = rows.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    wanted = shared.select("node").distinct().join(classes, "node").select("node", "rep")
    wanted = cut_lineage(wanted, "wanted")

    def of_nodes(asked: DataFrame, whole: bool) -> DataFrame:
        """The sets or odd sketches of `asked(node, rep)`, computed from the texts of the representatives."""
        kind = "node long, n int, " + ("items array<long>" if whole else "bits array<long>, fine array<long>")
        if (n := asked.count()) <= SENT_IDS:
            ids = np.unique(np.array([r.rep for r in asked.select("rep").collect()], dtype=np.int64)) if n else np.empty(0, dtype=np.int64)
            found = docs.mapInArrow(_sets_of(width, spark.sparkContext.broadcast(ids), whole), kind)
        else:
            found = docs.join(asked.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets_of(width, None, whole), kind)
        return cut_lineage(found.join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"]), "items" if whole else "sketches")

    sketches = of_nodes(wanted, False)

    def near(a: str, b: str) -> Column:
        """What similar sets fulfil, by their sizes and sketches."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        differ = sum((F.bit_count(F.get(F.col(f"{a}.bits"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{b}.bits"), F.lit(i)))) for i in range(MAP)), F.lit(0))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))

    def near_finely(pairs: DataFrame) -> DataFrame:
        """The pairs that stay possible by their finer sketches."""
        fine = sketches.select("node", F.struct("n", F.when(F.size("fine") > 0, F.col("fine")).otherwise(F.col("bits")).alias("bits")).alias("s"))
        both = (pairs.join(fine.select(F.col("node").alias("v"), F.col("s").alias("y")), "v")
                .join(fine.select(F.col("node").alias("u"), F.col("s").alias("x")), "u"))
        return both.filter(differing(F.col("x.bits"), F.col("y.bits")) * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)).select("u", "v")

    def verified(pairs: DataFrame) -> DataFrame:
        named = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        sets = of_nodes(cut_lineage(wanted.join(named, "node"), "asked"), True)
        both = (pairs.join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v")
                .join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u"))
        same = F.size(F.array_intersect("a", "b"))
        return both.filter(same * 100 >= (F.size("a") + F.size("b") - same) * percent).select("u", "v")

    salted = shared.filter("salt > 0 and rank = 1").select("sig", "node", F.min("node").over(W.partitionBy("sig")).alias("first"))
    pairs = shared.select(F.col("first").alias("u"), F.col("node").alias("v")).union(salted.select(F.col("first").alias("u"), F.col("node").alias("v"))).filter("u <> v").distinct()
    pairs = (pairs.join(sketches.select(F.col("node").alias("v"), F.struct("n", "bits").alias("y")), "v").join(sketches.select(F.col("node").alias("u"), F.struct("n", "bits").alias("x")), "u")
             .filter(near("x", "y")).select("u", "v"))
    links = cut_lineage(verified(cut_lineage(near_finely(cut_lineage(pairs, "possible")), "pairs")), "links")
    roots = cut_lineage(connected(links), "roots")
    placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_sigs = cut_lineage(placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k"), F.max("salt").alias("salts"))
                            .filter("lo < hi and (k > 2 or salts > 0)").select("sig"), "open")
    if not open_sigs.isEmpty():
        met = cut_lineage(placed.join(open_sigs, "sig").filter("rank > 1 or salt > 0"), "open_met")
        low = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("sig")), 1, LOW).alias("low"))
        carried = cut_lineage(low.join(sketches.drop("fine"), "node"), "carried")
        rest = met.join(carried, "node").select("sig", F.struct("node", "salt", "rank", "root", "n", "bits", "low").alias("x"))
        order = F.when(F.col("x.salt") == F.col("y.salt"), (F.col("x.rank") < F.col("y.rank")) & (F.col("x.rank") > 1)).otherwise(F.col("x.salt") < F.col("y.salt"))
        lowest = F.coalesce(F.array_min(F.array_intersect("x.low", "y.low")), F.col("sig"))       # below `sig`, the pair meets there
        pairs = (rest.join(rest.withColumnRenamed("x", "y"), "sig").filter((F.col("x.root") != F.col("y.root")) & order & near("x", "y") & (lowest >= F.col("sig")))
                 .select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct())
        links = links.union(cut_lineage(verified(cut_lineage(near_finely(cut_lineage(pairs, "possible")), "pairs")), "links"))
        roots = cut_lineage(connected(links), "roots")

    least = roots.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component_id"))
    named = roots.join(least, "root").select("node", "component_id")
    place = cut_lineage(classes.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")), "place")
    return (rows.join(place, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).cast("long").alias("component_id")))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One document of each component: the one that gives the component its name. Rows without doc_id
    stay, as do all of the columns; of repeated rows one stays, but other texts of a kept doc_id stay too."""
    linked = link_components(docs, width, percent).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.filter("doc_id is not null").join(linked, "doc_id", "left_semi").withColumn("_text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_text_hash"])
    return kept.select(*docs.columns).union(docs.filter("doc_id is null").select(*docs.columns))
