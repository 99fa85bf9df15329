"""Fill-in-middle transformation by secondary sort.

A text is cut into units (a line with its line feed). Two hashes of the document's id choose a middle
of whole units; the output puts suffix, prefix and middle into another order behind sentinels. Each task
cuts its documents into pieces of whole units, at most `CHUNK` characters long (a longer unit is split),
keyed by (row, place in the output). `repartitionAndSortWithinPartitions` brings the pieces of a row
together in order, where they stream into incremental digests: no task ever holds an output, only
sorter memory that spills. For restoration the output stream is read again as characters: a scanner
finds the sentinels, keys what lies between by (row, place in the text), and a second sort, which the
equal partitioner does without a shuffle, streams the pieces into the digest of the restored text.

Rows are keyed by partition and number, so that neither repeated nor null ids meet in one task; the input
has to come back in the same order when it is read again, as stored tables do. Null texts are empty, null
ids are hashed as an empty string, repeated rows give repeated results, an empty table gives none, and
extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import count, groupby, islice

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle"), "plain": ("prefix",)}
#: Order of the parts in the text.
ORIGINAL = {"prefix": 0, "middle": 1, "suffix": 2}
SEED, TRANSFORMED, SPM = 7, 100, 50
#: Characters of a piece; bytes of text that a sorting task takes.
CHUNK, PARTITION = 1 << 16, 1 << 24
_SENTINEL = re.compile("<[PSM]>")
_OPEN = re.compile("<[PSM]?$")
_NAMES = {s: name for name, s in SENTINELS.items()}
HEAD = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """The first four groups of eight hex digits of the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def unit_count(text: str) -> int:
    return text.count("\n") + (not text.endswith("\n") if text else 0)


def unit_end(text: str, units: int) -> int:
    """Characters of the first `units` units."""
    if not units:
        return 0
    return next((m.end() for m in islice(re.finditer("\n", text), units - 1, units)), len(text))


def plan(doc_id: int | None, text: str, seed: int = SEED, transformed: int = TRANSFORMED, spm: int = SPM) -> tuple[int, str, int, int]:
    """(units, form, end of the prefix, end of the middle) in characters."""
    n, (h1, h2, h3, h4) = unit_count(text), numbers(doc_id, seed)
    if not text or _SENTINEL.search(text) or h3 % 100 >= transformed:
        return n, "plain", len(text), len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < spm else "psm", unit_end(text, a), unit_end(text, b)


def chunks(text: str, lo: int, hi: int, size: int) -> Iterator[str]:
    """text[lo:hi] in pieces of whole units, of at most `size` characters."""
    while lo < hi:
        end = hi if hi - lo <= size else text.rfind("\n", lo, lo + size) + 1 or lo + size
        yield text[lo:end]
        lo = end


def pieces_of(doc_id: int | None, text: str, options: tuple, size: int) -> tuple[tuple, Iterator[str]]:
    """(head, pieces of the output in order)."""
    n, form, a, b = plan(doc_id, text, *options)
    if form == "plain":
        return (doc_id, n, form, None, None), chunks(text, 0, len(text), size)
    bounds = {"prefix": (0, a), "middle": (a, b), "suffix": (b, len(text))}
    return (doc_id, n, form, a, b - a), (x for part in FORMS[form] for x in (SENTINELS[part], *chunks(text, *bounds[part], size)))


def original_places(form: str, output: Iterable[str]) -> Iterator[tuple[tuple[int, int], str]]:
    """((part, number), characters) of an output that comes in any pieces: where each stands in the text."""
    part, kept, number = 0, "", count()
    for piece in output:
        if form == "plain":
            yield (0, next(number)), piece
            continue
        piece, lo = kept + piece, 0
        for m in _SENTINEL.finditer(piece):
            if m.start() > lo:
                yield (part, next(number)), piece[lo:m.start()]
            part, lo = ORIGINAL[_NAMES[m[0]]], m.end()
        cut = _OPEN.search(piece, lo)
        hi = cut.start() if cut else len(piece)
        if hi > lo:
            yield (part, next(number)), piece[lo:hi]
        kept = piece[hi:]
    if kept:
        yield (part, next(number)), kept


def _spread(key: tuple) -> int:
    """Partition of a key: rows are dealt out in turn."""
    (part, number), _ = key
    return part + number


def _by_row(records: Iterable[tuple]) -> Iterator[tuple]:
    """(row, head, values in order) of sorted records; a row's head has the lowest place."""
    for row, group in groupby(records, lambda r: r[0][0]):
        yield row, next(group)[1], (value for _, value in group)


def _emit(options: tuple, size: int):
    def run(part: int, rows: Iterable) -> Iterator[tuple]:
        for number, (doc_id, text) in enumerate(rows):
            head, pieces = pieces_of(doc_id, text or "", options, size)
            yield ((part, number), 0), head
            for place, piece in enumerate(pieces, 1):
                yield ((part, number), place), piece
    return run


def _digested(records: Iterable[tuple]) -> Iterator[tuple]:
    """Digest of each output, and its pieces keyed by their place in the text."""
    for row, head, pieces in _by_row(records):
        digest = hashlib.sha256()

        def through(pieces: Iterable[str] = pieces, digest=digest) -> Iterator[str]:
            for piece in pieces:
                digest.update(piece.encode())
                yield piece
        for place, piece in original_places(head[2], through()):
            yield (row, place), piece
        yield (row, (-1, 0)), (*head, digest.hexdigest())


def _restored(records: Iterable[tuple]) -> Iterator[tuple]:
    for _, head, pieces in _by_row(records):
        digest = hashlib.sha256()
        for piece in pieces:
            digest.update(piece.encode())
        yield (*head, digest.hexdigest())


def _joined(records: Iterable[tuple]) -> Iterator[tuple]:
    for _, head, pieces in _by_row(records):
        yield (*head, "".join(pieces))


def sorted_pieces(docs: DataFrame, options: tuple = (SEED, TRANSFORMED, SPM), size: int = CHUNK) -> RDD:
    """((row, place in the output), piece) with the pieces of each row together and in order; place 0 is the row's head."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").rdd
    n = max(rows.getNumPartitions(), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PARTITION))
    return rows.mapPartitionsWithIndex(_emit(options, size)).repartitionAndSortWithinPartitions(n, _spread)


def transform(docs: DataFrame, options: tuple = (SEED, TRANSFORMED, SPM), size: int = CHUNK) -> DataFrame:
    """Head and `output` text of each document; a task holds one output at a time."""
    return docs.sparkSession.createDataFrame(sorted_pieces(docs, options, size).mapPartitions(_joined), HEAD + ", output string", verifySchema=False)


def restore(outputs: DataFrame) -> DataFrame:
    """(doc_id, text) of (doc_id, form, output)."""
    def run(rows: Iterable) -> Iterator[tuple]:
        for doc_id, form, output in rows:
            yield doc_id, "".join(x for _, x in sorted(original_places(form, [output])))
    return outputs.sparkSession.createDataFrame(outputs.select("doc_id", "form", "output").rdd.mapPartitions(run), "doc_id long, text string", verifySchema=False)


def digests(docs: DataFrame, options: tuple = (SEED, TRANSFORMED, SPM), size: int = CHUNK) -> DataFrame:
    """Head and SHA-256 of each output and of the text restored from it."""
    pieces = sorted_pieces(docs, options, size)
    placed = pieces.mapPartitions(_digested, preservesPartitioning=True)
    back = placed.repartitionAndSortWithinPartitions(pieces.getNumPartitions(), _spread)       # same partitioner: a sort without a shuffle
    return docs.sparkSession.createDataFrame(back.mapPartitions(_restored), HEAD + ", output_sha256 string, restored_sha256 string", verifySchema=False)


#: The same rows in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(lines)::BIGINT AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
