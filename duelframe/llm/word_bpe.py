"""Encoding and decoding with a word-level BPE vocabulary by tables of distinct words and pieces.

Documents are normalised and cut into words as the vocabulary file says, in blocks of at most `BLOCK`
characters (a longer document is a block of its own). A block stores its distinct words, most frequent
first, and each document as numbers of them; blocks are a table in the shared folder, bucketed by block.
The words of all blocks meet by hash of the word, where each distinct word of the corpus is encoded once;
its ids go back to the blocks that have it and are joined with the documents by position. Only distinct words are
shuffled, never texts, packed as one row for each block and hash; a very frequent word is one entry a block.
Decoding joins each id with the vocabulary's table of pieces, whose size is that of the vocabulary file.

The library's rules for whole texts are kept: special strings are found in the raw text first, then what
lies between is normalised. Characters of the Latin blocks are normalised here, other texts by the library.

Null and empty texts give no ids and an empty decoded text; repeated rows are encoded alike; an empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.session import shared_path

#: Characters of a block; words of documents whose ids are gathered together; hashes of words a shuffle partition.
BLOCK, PART, HASHES = 16_000_000, 200_000, 2
#: Texts of these characters only are the same in NFC, and lower-case here as in the library.
_PLAIN = regex.compile("[\t\n\r\x20-\x7e\xa0-\u024f]*+")
_SHARE = pa.struct([("hash", pa.int32()), ("places", pa.binary()), ("words", pa.binary())])
_BLOCKS = pa.schema([("block", pa.int64()), ("shares", pa.list_(_SHARE)), ("ids", pa.list_(pa.int64())), ("codes", pa.list_(pa.binary()))])
_BLOCKS_SQL = "block long, shares array<struct<hash: int, places: binary, words: binary>>, ids array<long>, codes array<binary>"
_WORDS = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])


class Vocabulary:
    """The library's tokenizer of a file, its rule for words, special strings and pieces by id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        split, self.specials = parts["pre_tokenizer"]["pretokenizers"][0], {t["content"]: t["id"] for t in parts["added_tokens"]}
        normalizers = [n["type"] for n in parts["normalizer"]["normalizers"]]
        if (normalizers, split["type"], split["behavior"], split["invert"]) != (["NFC", "Replace", "Lowercase"], "Split", "Removed", True) or any(t["normalized"] for t in parts["added_tokens"]):
            raise ValueError("only vocabularies of lower-cased words are supported")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        pieces = self.library.get_vocab(with_added_tokens=True)
        by_id = {i: piece for piece, i in pieces.items()}
        self.pieces = pa.array([by_id.get(i) for i in range(1 + max(by_id))], pa.string())

    def words(self, text: str) -> list[str]:
        """Words in order; a special string is a word of its own."""
        if "<|" not in text:
            return self._words(text)
        return [w for part in self.special.split(text) for w in ([part] if part in self.specials else self._words(part))]

    def _words(self, text: str) -> list[str]:
        plain = _PLAIN.fullmatch(text)
        return self.word.findall(text.lower() if plain else self.library.normalizer.normalize_str(text))

    def ids(self, word: str) -> list[int]:
        if word in self.specials:
            return [self.specials[word]]
        return [t.id for mapped, _ in self.library.pre_tokenizer.pre_tokenize_str(word) for t in self.library.model.tokenize(mapped)]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress well where most numbers are small."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _block(doc_ids: list, texts: list[np.ndarray], found: dict[str, int], hashes: int) -> pa.RecordBatch:
    """One row: the words by falling frequency, shared out by hash, and the documents as numbers of words."""
    order = np.argsort(-np.bincount(np.concatenate(texts), minlength=len(found)), kind="stable")
    rank = np.empty(len(found), dtype=np.uint32)
    rank[order] = np.arange(len(found), dtype=np.uint32)
    words = list(found)
    words = [words[i] for i in order.tolist()]
    hashed = np.fromiter((zlib.crc32(w.encode()) % hashes for w in words), dtype=np.int64, count=len(words))
    by_hash, press = np.argsort(hashed, kind="stable"), zstandard.ZstdCompressor(level=3).compress
    shares = [{"hash": int(hashed[places[0]]), "places": press(packed(np.diff(places, prepend=0))), "words": press("\n".join([words[i] for i in places.tolist()]).encode())}
              for places in np.split(by_hash, np.flatnonzero(np.diff(hashed[by_hash])) + 1) if len(places)]
    row = [uuid.uuid4().int >> 65, shares, doc_ids, [packed(rank[t]) for t in texts]]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCKS)], schema=_BLOCKS)


def _split(path: str, block: int, hashes: int):
    def run(batches):
        vocabulary = load(path)
        doc_ids, texts, found, size = [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                if doc_ids and size + len(text) > block:
                    yield _block(doc_ids, texts, found, hashes)
                    doc_ids, texts, found, size = [], [], {}, 0
                doc_ids.append(doc_id)
                texts.append(np.array([found.setdefault(w, len(found)) for w in vocabulary.words(text)], dtype=np.uint32))
                size += len(text)
        if doc_ids:
            yield _block(doc_ids, texts, found, hashes)
    return run


def word_blocks(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """(block, shares, ids, codes): a stored table, bucketed by block; a share holds the block's words of one hash."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_split(path, block, HASHES * partitions), _BLOCKS_SQL)
    name = "word_blocks_" + uuid.uuid4().hex
    cut.write.format("parquet").option("path", shared_path(spark, "words")).option("compression", "zstd").bucketBy(partitions, "block").saveAsTable(name)
    return spark.table(name)


def _encode_words(path: str):
    def run(batches):
        vocabulary, last, known = load(path), None, {}
        press, unpress = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["hash"] != last:         # rows are sorted by hash, and a word has one hash
                    last, known = row["hash"], {}
                words = unpress(row["words"]).decode().split("\n")
                for w in words:
                    if w not in known:
                        known[w] = vocabulary.ids(w)
                ids = [known[w] for w in words]
                lengths = np.fromiter(map(len, ids), dtype=np.uint32, count=len(ids))
                flat = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(lengths.sum()))
                out.append((row["block"], row["places"], press(packed(lengths)), press(packed(flat))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _WORDS)] if out else [pa.array([], f.type) for f in _WORDS], schema=_WORDS)
    return run


def encode_words(blocks: DataFrame, path: str) -> DataFrame:
    """(block, places, lengths, ids) of the words of every block; each distinct word is encoded once."""
    shares = blocks.select("block", F.explode("shares").alias("s")).select("block", "s.*")
    return shares.repartition("hash").sortWithinPartitions("hash").mapInArrow(_encode_words(path), "block long, places binary, lengths binary, ids binary")


def _by_position(path: str, decoded: bool):
    """Ids of each document of a block: its numbers look up the ids of the block's words."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("decoded", pa.string())] * decoded)

    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor().decompress
        shares = [(np.cumsum(unpacked(unpress(r["places"])).view(np.int32)), unpacked(unpress(r["lengths"])), unpacked(unpress(r["ids"]))) for r in words.to_pylist()]
        flat = np.concatenate([s[2] for s in shares] or [np.empty(0)]).astype(np.int32)
        length, begin, at = np.zeros(sum(len(s[0]) for s in shares), dtype=np.int64), np.zeros(sum(len(s[0]) for s in shares), dtype=np.int64), 0
        for places, lengths, _ in shares:
            length[places] = lengths
            begin[places] = at + np.cumsum(lengths) - lengths
            at += int(lengths.sum())
        doc_ids = [i for row in block.column("ids") for i in row.as_py()]
        codes = [c.as_buffer() for row in block.column("codes") for c in row.values]
        sizes = np.cumsum([len(c) // 4 for c in codes])
        out, lo = [], 0
        while lo < len(codes):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PART, "right")))
            part = [unpacked(c) for c in codes[lo:hi]]
            code = np.concatenate(part)
            lengths = length[code]
            ends = np.cumsum(lengths)
            ids = flat[np.repeat(begin[code] - (ends - lengths), lengths) + np.arange(lengths.sum())]
            offsets = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum([len(c) for c in part])))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            columns = [pa.array(doc_ids[lo:hi], pa.int64()), lists] + [pieces_joined(lists, load(path).pieces)] * decoded
            out.append(pa.RecordBatch.from_arrays(columns, schema=schema))
            lo = hi
        return pa.Table.from_batches(out, schema=schema)
    return run


def encode(docs: DataFrame, path: str, block: int = BLOCK, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) per document, with the vocabulary file at `path` on every executor; with `decoded`, also the
    text that the ids decode to."""
    blocks = word_blocks(docs, path, block)
    kind = "doc_id long, ids array<int>" + ", decoded string" * decoded
    return blocks.select("block", "ids", "codes").groupBy("block").cogroup(encode_words(blocks, path).groupBy("block")).applyInArrow(_by_position(path, decoded), kind)


def pieces_joined(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """Every id joined with its piece; the vocabulary has no decoder, so pieces stand one space apart."""
    offsets = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(ids)))))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces.take(ids.flatten())), " ")


def _decode(path: str):
    def run(batches):
        pieces = load(path).pieces
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pieces_joined(part.column("ids"), pieces)], names=["doc_id", "ids", "decoded"])
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of stored ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of ids and decoded texts."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
