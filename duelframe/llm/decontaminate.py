"""Benchmark decontamination: prefix-filtered join of item windows with document words.

An item's windows are its runs of 10 consecutive words; an item of fewer words, but not none, is one
window. The prefix of a window is its rarest word, by how often the benchmark's words occur in all
documents; a document that holds the window holds that word. So document words join the prefix words,
the position of the word in the window gives the only place where the window can start (positional
bound), it has to end inside the document (length bound), and all of its words are compared.

The benchmark is the small side: its windows go to the tasks in blocks of bounded size, and every
block meets every document. One block is the usual case; with more, the hits of a document are united.

Nulls and empty texts have no words and no hits; items without words have no windows; items with a
null item_id are left out; repeated rows are judged like any other; an empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .tokens import U

WINDOW = 10
#: Windows sent to the tasks together: about 100 bytes each.
BLOCK = 200_000


def _item_words(items: DataFrame) -> list[tuple[int, np.ndarray]]:
    out = []
    rows = items.filter("item_id is not null and text is not null").distinct().collect()     # the benchmark, never the corpus
    for lo, hi, counts, hashes in tokens.row_words(pa.array([r.text for r in rows], pa.string()), tokens.ALNUM):
        ends = np.cumsum(counts)
        out += [(rows[lo + k].item_id, hashes[ends[k] - counts[k]:ends[k]]) for k in range(hi - lo) if counts[k]]
    return out


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the sorted vocabulary occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        words = sent.value
        total = np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            for _, _, _, hashes in tokens.row_words(batch.column(0), tokens.ALNUM):
                if len(hashes) and len(words):
                    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                    total += np.bincount(at[words[at] == hashes], minlength=len(words))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    for r in docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _blocks(items: list[tuple[int, np.ndarray]], order: dict, window: int, block: int):
    """(prefix words, start in the window list, windows by prefix word) of at most `block` windows."""
    rows: list[tuple[int, int, int, np.ndarray]] = []
    seen: dict[tuple, int] = {}
    owners: list[list[int]] = []
    for item, words in items:
        size = min(window, len(words))
        for a in range(len(words) - size + 1):
            w = words[a:a + size]
            key = w.tobytes()
            if key in seen:
                if owners[seen[key]][-1] != item:
                    owners[seen[key]].append(item)
                continue
            rare = min(range(size), key=lambda k: (order[int(w[k])], int(w[k])))
            seen[key] = len(rows)
            owners.append([item])
            rows.append((int(w[rare]), rare, size, w))
    for lo in range(0, len(rows), block):
        part = sorted(zip(rows[lo:lo + block], owners[lo:lo + block]), key=lambda x: x[0][0])
        yield (np.array([r[0] for r, _ in part], dtype=np.uint64), np.array([r[1] for r, _ in part]), np.array([r[2] for r, _ in part]),
               [r[3] for r, _ in part], [o for _, o in part])


def hits(words: np.ndarray, block) -> tuple[np.ndarray, set[int]]:
    """(mark of each hit word, items with windows in it) of one document."""
    prefix, offset, size, windows, owners = block
    mark, items = np.zeros(len(words), dtype=bool), set()
    lo, hi = np.searchsorted(prefix, words, "left"), np.searchsorted(prefix, words, "right")
    for pos in np.flatnonzero(hi > lo):
        for k in range(lo[pos], hi[pos]):
            start = pos - offset[k]
            if start >= 0 and start + size[k] <= len(words) and np.array_equal(words[start:start + size[k]], windows[k]):
                mark[start:start + size[k]] = True
                items.update(owners[k])
    return mark, items


def _find(sent):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])

    def run(batches):
        block = sent.value
        prefix = block[0]
        for batch in batches:
            n, positions, found = [], [], []
            for lo, hi, counts, hashes in tokens.row_words(batch.column("text"), tokens.ALNUM):
                stop = np.cumsum(counts)
                at = np.minimum(np.searchsorted(prefix, hashes), max(len(prefix) - 1, 0))
                met = np.flatnonzero(prefix[at] == hashes) if len(prefix) else np.empty(0, dtype=np.int64)
                rows = set(np.searchsorted(stop, met, "right").tolist())
                for k in range(hi - lo):
                    n.append(int(counts[k]))
                    mark, items = hits(hashes[stop[k] - counts[k]:stop[k]], block) if k in rows else (np.zeros(0, dtype=bool), ())
                    positions.append(np.flatnonzero(mark).tolist())
                    found.append(sorted(items))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(positions, schema.field("hits").type),
                                              pa.array(found, schema.field("items").type)], schema=schema)
    return run


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, items) per document: words, words inside an occurrence of a window, and the
    sorted ids of the items with occurring windows."""
    return _marked(docs, benchmark, window, block).drop("mark")


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, block: int = BLOCK) -> DataFrame:
    """`find_windows` with the hash of each document's text as `mark`."""
    items = _item_words(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"))
    vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.empty(0, dtype=np.uint64)
    seen = _frequencies(docs, vocabulary) if items else np.empty(0, dtype=np.int64)
    order = dict(zip(vocabulary.tolist(), seen.tolist()))
    blocks = list(_blocks(items, order, window, block)) or [(np.empty(0, dtype=np.uint64), [], [], [], [])]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    context, kind = docs.sparkSession.sparkContext, "doc_id long, mark long, n_words long, hits array<long>, items array<long>"
    found = [docs.mapInArrow(_find(context.broadcast(b)), kind) for b in blocks]
    if len(found) == 1:
        out = found[0]
    else:       # blocks meet by document and text; only documents with hits are moved
        parts = found[0].filter("size(items) > 0")
        for more in found[1:]:
            parts = parts.union(more.filter("size(items) > 0"))
        flat = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
        parts = parts.groupBy("doc_id", "mark").agg(flat("hits"), flat("items")).select(F.struct("doc_id", "mark").alias("at"), "hits", "items")
        base = found[0].select("doc_id", "mark", "n_words")
        out = base.join(parts, F.struct(base["doc_id"], base["mark"]).eqNullSafe(F.col("at")), "left").withColumns(
            {c: F.coalesce(c, F.array().cast("array<bigint>")) for c in ("hits", "items")})
    return out.select("doc_id", "mark", "n_words", F.size("hits").cast("long").alias("n_hit"), F.array_sort("items").alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, with all their columns, each text judged by itself. Rows without doc_id can't be named and stay."""
    hit = _marked(docs, benchmark, window).filter("n_hit > 0 and doc_id is not null").select(F.col("doc_id").alias("_id"), "mark").distinct()
    return docs.join(hit, (docs["doc_id"] == hit["_id"]) & (F.xxhash64(docs["text"]) == hit["mark"]), "left_anti").select(*docs.columns)
