"""SentencePiece encoding for merge-type (BPE) vocabularies, and decoding.

A text is normalised as the vocabulary says (a space before it, spaces as U+2581). No piece holds that
sign after another character, so the text falls into units (a run of the sign and what follows) that
never merge with each other. A unit's symbols are merged by an agenda of adjacent pairs: the pair
whose union has the best score goes first, the leftmost of equal ones; pairs that changed meanwhile
are skipped. Units of up to `ROW` characters keep their agendas as rows of one numpy table and merge in step,
one pair a unit and turn; longer ones have a heap each. Symbols outside the vocabulary become their
UTF-8 byte pieces.

Every unit that is new to a task is also encoded by the sentencepiece library in the same Arrow batch,
and so is every `WHOLE`-th whole text; where they differ, the library's ids are used and `checked` is
false. Known units are kept in a table of bounded size.

Null and empty texts give no ids and an empty decoded text; repeated rows are encoded alike; an empty
table gives an empty result; any extra columns are left out.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Units that a task remembers; whole texts of which one is compared with the library.
REMEMBERED, WHOLE = 500_000, 64
#: Characters of a unit whose agenda is a table row; cells of one table.
ROW, CELLS = 64, 1 << 18
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
NEVER, GONE = 1 << 40, -1
SCHEMA = "doc_id long, ids array<int>, decoded string, checked boolean"


@functools.lru_cache(maxsize=2)
def load(path: str):
    """(library processor, (rank by score, id) of the pieces, id of each byte, remembered units, `Pairs`) of a vocabulary file."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, byte_ids = {}, [library.unk_id()] * 256
    for i in range(len(library)):
        piece = library.id_to_piece(i)
        if library.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
            scores[piece] = (library.get_score(i), i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("units of this vocabulary depend on each other")
    if library.normalize("a  b") != SPACE + f"a{SPACE}{SPACE}b" or library.normalize("ｆ ") != SPACE + "ｆ ":
        raise ValueError("only vocabularies with identity normalisation are supported")
    levels = {score: rank for rank, score in enumerate(sorted({score for score, _ in scores.values()}, reverse=True))}
    pieces = {piece: levels[score] for piece, (score, _) in scores.items()}, {piece: i for piece, (_, i) in scores.items()}
    return library, pieces, byte_ids, {}, Pairs(*pieces)


class Pairs:
    """Every pair of symbols whose union is a piece, as sorted keys; symbols are piece ids, then numbers of other characters of pieces."""

    def __init__(self, rank_of: dict, id_of: dict):
        self.pieces = 1 + max(id_of.values(), default=-1)
        symbols = dict(id_of)
        for c in sorted({c for piece in rank_of for c in piece}.difference(symbols)):
            symbols[c] = self.pieces + len(symbols)
        self.other = self.pieces + len(symbols)         # a character of no piece; the next number stands for no symbol
        self.base = self.other + 2
        rows = sorted((symbols[left] * self.base + symbols[right], rank, id_of[piece]) for piece, rank in rank_of.items()
                      for cut in range(1, len(piece)) if (left := piece[:cut]) in symbols and (right := piece[cut:]) in symbols)
        self.keys, self.ranks, self.unions = (np.array([row[k] for row in rows] + [end], dtype=np.int64) for k, end in enumerate((1 << 62, NEVER, 0)))
        self.symbol = np.full(0x110000, self.other, dtype=np.int64)
        for c, number in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = number

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, union) of each pair; the rank is NEVER where they don't merge."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), self.unions[at]


def encode_rows(units: list[str], pairs: Pairs, byte_ids: list[int]) -> list[list[int]]:
    """Ids of units of similar length: a row of each table is a unit, its first and last cells are empty."""
    lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    width = int(lengths.max()) + 2
    inside = np.arange(width - 2) < lengths[:, None]
    symbol = np.full((len(units), width), pairs.other + 1, dtype=np.int64)
    symbol[:, 1:-1][inside] = pairs.symbol[np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4")]
    agenda, union = np.full(symbol.shape, NEVER, dtype=np.int64), np.zeros(symbol.shape, dtype=np.int64)
    agenda[:, :-1], union[:, :-1] = pairs.of(symbol[:, :-1], symbol[:, 1:])
    after = np.tile(np.arange(1, width + 1), (len(units), 1))
    before = np.tile(np.arange(-1, width - 1), (len(units), 1))
    rows = np.arange(len(units))
    while rows.size:
        open_pairs = agenda[rows]
        i = open_pairs.argmin(axis=1)                       # the leftmost of the best
        going = open_pairs[np.arange(rows.size), i] < NEVER
        rows, i = rows[going], i[going]
        j = after[rows, i]
        k, merged = after[rows, j], union[rows, i]
        symbol[rows, i], symbol[rows, j], agenda[rows, j] = merged, GONE, NEVER
        after[rows, i], before[rows, k] = k, i
        agenda[rows, i], union[rows, i] = pairs.of(merged, symbol[rows, k])
        h = before[rows, i]
        agenda[rows, h], union[rows, h] = pairs.of(symbol[rows, h], merged)
    symbol = symbol[:, 1:-1]
    left = inside & (symbol != GONE)
    flat, ends = symbol[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
    ids = [flat[lo:hi] for lo, hi in zip([0, *ends], ends)]
    for row in np.flatnonzero((left & (symbol >= pairs.pieces)).any(axis=1)).tolist():
        places = np.flatnonzero(left[row]).tolist()
        ids[row] = [x for s, at in zip(ids[row], places) for x in ((s,) if s < pairs.pieces else [byte_ids[b] for b in units[row][at].encode("utf-8")])]
    return ids


def encode_units(units: list[str], pieces: tuple, pairs: Pairs, byte_ids: list[int]) -> list[list[int]]:
    """Ids of each unit, in order."""
    out: list = [None] * len(units)
    order = sorted(range(len(units)), key=lambda x: len(units[x]))
    lo = 0
    while lo < len(order):
        longest = len(units[order[lo]])
        if not longest or longest > ROW:
            out[order[lo]] = encode_unit(units[order[lo]], pieces, byte_ids)
            lo += 1
            continue
        hi = lo
        while hi < len(order) and len(units[order[hi]]) <= min(ROW, longest + 3) and (hi - lo) * (longest + 5) < CELLS:
            hi += 1
        part = order[lo:hi]
        for x, ids in zip(part, encode_rows([units[x] for x in part], pairs, byte_ids)):
            out[x] = ids
        lo = hi
    return out


def encode_unit(unit: str, pieces: dict, byte_ids: list[int]) -> list[int]:
    """Ids of one unit by the agenda of adjacent symbol pairs: (rank of the union, place) in one number.

    A pair is taken if the union that stands there now still has that rank.
    """
    rank_of, id_of = pieces
    get, push, pop = rank_of.get, heapq.heappush, heapq.heappop
    n = len(unit)
    symbols = [*unit, " "]       # the last one joins with nothing
    after, before = list(range(1, n + 2)), list(range(-1, n))
    agenda = [rank << 32 | i for i in range(n - 1) if (rank := get(unit[i:i + 2])) is not None]
    heapq.heapify(agenda)
    while agenda:
        first = pop(agenda)
        i = first & 0xFFFFFFFF
        left = symbols[i]
        if left is None:
            continue
        j = after[i]
        union = left + symbols[j]
        if get(union) != first >> 32:
            continue
        symbols[i], symbols[j] = union, None
        after[i] = k = after[j]
        before[k] = i
        rank = get(union + symbols[k])
        if rank is not None:
            push(agenda, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = get(symbols[h] + union)
            if rank is not None:
                push(agenda, rank << 32 | h)
    ids = []
    for s in symbols[:n]:
        if s is None:
            continue
        if s in id_of:
            ids.append(id_of[s])
        else:
            ids.extend(byte_ids[b] for b in s.encode("utf-8"))
    return ids


def units_of(text: str) -> list[str]:
    return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def _encode(path: str, whole: int):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("checked", pa.bool_())])

    def run(batches):
        library, pieces, byte_ids, known, pairs = load(path)
        count = 0
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, batch.num_rows, 256):
                part = texts.slice(lo, 256).to_pylist()
                units = [units_of(t) for t in part]
                new = list({u for us in units for u in us}.difference(known))
                wrong = set()
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = list({u for us in units for u in us})
                library_ids = library.encode([u[1:].replace(SPACE, " ") for u in new], num_threads=1) if new else ()
                for u, ids, theirs in zip(new, encode_units(new, pieces, pairs, byte_ids), library_ids):
                    known[u] = ids
                    if ids != theirs and len(u) > 1:        # a lone sign is the library's empty text
                        wrong.add(u)
                ids, checked = [], []
                for t, us in zip(part, units):
                    own: list[int] = []
                    for u in us:
                        own += known[u]
                    right = not wrong.intersection(us) if wrong else True
                    if not right or (count % whole == 0 and t):
                        theirs = library.encode(t)
                        right = right and own == theirs
                        own = theirs
                    ids.append(own)
                    checked.append(right)
                    count += 1
                for u in wrong:
                    known.pop(u, None)
                decoded = library.decode(ids, num_threads=1)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.array([i for x in ids for i in x], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, 256), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                                                  pa.array(decoded, pa.string()), pa.array(checked)], schema=schema)
    return run


def encode(docs: DataFrame, path: str, whole: int = WHOLE) -> DataFrame:
    """(doc_id, ids, decoded, checked) per document, with the vocabulary file at `path` on every executor."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path, whole), SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of ids and decoded texts."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "checked")
