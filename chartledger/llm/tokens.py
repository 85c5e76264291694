"""Token ids in bit-plane files: encode texts, write fixed-size blocks, read documents back.

File format. A folder of Parquet files, one row per block of at most ``block_ids`` consecutive
ids of one shard (a shard is one range of the document order). A row holds

* ``shard``, ``block``, ``first`` (ids of the shard before this block), ``n_ids``;
* ``planes``: the block's ids as little-endian words, transposed into 8 planes a byte (``bit``) or
  1 plane a byte (``byte``), every plane compressed by zstandard on its own. Planes of the high
  bits hold long runs, so they shrink to almost nothing;
* ``docs``: the chunk index, one entry per document that has ids in the block: its key, its place
  in the shard's order, its first id within the block and its number of ids there. A block can be
  decoded, and its documents found, without any other block.

A second folder ``shards`` has one row per shard with its number of ids, from which the position
of a shard in the whole stream follows.
"""

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chartledger.llm.common import scratch_path, text_or_empty, written

END_ID = 1
BLOCK_IDS = 65_536
CACHED_WORDS = 250_000
# The apostrophe is no such sign: with letters behind it, it begins a word of its own.
LETTERS_SIGNS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)").fullmatch

BLOCK_SCHEMA = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("first", T.LongType()),
    T.StructField("n_ids", T.IntegerType()),
    T.StructField("planes", T.ArrayType(T.BinaryType())),
    T.StructField("docs", T.ArrayType(T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
    ]))),
])


def id_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordIds(dict):
    """Ids of text pieces without white space, as bytes; a piece is encoded when first asked for.

    ``older`` is the generation before: pieces found there move here, so frequent ones stay.
    """

    def __init__(self, library, older: dict[str, bytes]):
        super().__init__({"": b""})
        self.library, self.merge, self.older = library, library.model.tokenize, older
        # Bytes that the vocabulary writes as themselves; the others follow from 256.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encoded(piece)
        self[piece] = ids
        return ids

    def encoded(self, piece: str) -> bytes:
        last = piece[-1]
        if last in ".,!" and piece[-2:-1].isalpha() and piece[-2] != "\u0130":
            return self[piece[:-1]] + self[last]
        # Latin letters alone are one word to the vocabulary's rules: lower case, then merging.
        # A dotted capital I has no single lower-case letter: its dot is a sign of its own.
        if piece.isalpha():
            if piece.isascii():
                return self.merged(piece.lower())
            if max(piece) < "\u0180" and "\u0130" not in piece:
                word = piece.lower().encode("utf-8").decode("latin-1")
                return self.merged(word.translate(self.letters))
        else:
            # Letters and the signs behind them are two words.
            two = LETTERS_SIGNS(piece)
            if two and two[1].isalpha() and max(two[1]) < "\u0180" and "\u0130" not in piece:
                return self[two[1]] + self[two[2]]
        found = self.library.encode(piece, add_special_tokens=False)
        return id_bytes(found.ids)

    def merged(self, word: str) -> bytes:
        return id_bytes([t.id for t in self.merge(word)])


class WordEncoder:
    """Encodes texts by the tokenizers library, each distinct word once.

    The vocabulary's own rules cut at white space and drop it, so the ids of a text are the ids of
    the pieces between blanks and line ends, one after the other. Pieces seen before come from a
    cache of two generations of at most ``words`` pieces and one run of texts. New pieces of Latin
    letters go straight to the library's merging model, apart from the signs behind them; all others
    go through the whole library.
    """

    def __init__(self, path: str, words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.library, self.words = Tokenizer.from_file(path), words
        self.known = WordIds(self.library, {})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > self.words:
            self.known.older = {}
            self.known = WordIds(self.library, self.known)
        known = self.known.__getitem__
        return [b"".join(map(known, t.replace("\n", " ").split(" "))) for t in texts]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a Python worker: words learnt by one task serve the next."""
    return WordEncoder(path)


def pack_planes(ids: np.ndarray, kind: str, compress) -> list[bytes]:
    """A block's ids as compressed planes, lowest bits first."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if kind == "byte":
        raw = ids.view(np.uint8).reshape(-1, 4)
        return [compress(np.ascontiguousarray(raw[:, i]).tobytes()) for i in range(4)]
    used = int(ids.max(initial=0)).bit_length()
    planes = [compress(np.packbits((ids >> np.uint32(i)) & np.uint32(1) != 0,
                                   bitorder="little").tobytes()) for i in range(used)]
    # Planes above the highest bit in use are alike: all zero.
    return planes + [compress(bytes(-(-len(ids) // 8)))] * (32 - used)


def unpack_planes(planes: list[bytes], n: int, decompress) -> np.ndarray:
    """The ids of a block of either kind."""
    parts = [np.frombuffer(decompress(p), dtype=np.uint8) for p in planes]
    if len(parts) == 4:
        return np.ascontiguousarray(np.stack(parts, axis=1)).view("<u4").reshape(-1)
    ids = np.zeros(n, dtype="<u4")
    for i, part in enumerate(parts):
        if part.any():
            ids |= np.unpackbits(part, count=n, bitorder="little").astype("<u4") << np.uint32(i)
    return ids


def _slices(texts: list, chars: int = 2_000_000) -> Iterator[slice]:
    """Runs of texts of about ``chars`` characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def block_writer(path: str, kind: str, block_ids: int, end_id: int):
    """The task that turns the ordered texts of one shard into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder, compress = word_encoder(path), zstandard.ZstdCompressor(level=3).compress
        end = struct.pack("<I", end_id)
        schema = pa.schema([
            ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()),
            ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())),
            ("docs", pa.list_(pa.struct([
                ("doc_id", pa.int64()), ("place", pa.int64()), ("at", pa.int32()),
                ("n", pa.int32())]))),
        ])
        buffer, docs, filled, block, place = [], [], 0, 0, 0

        def close():
            nonlocal buffer, docs, filled, block
            ids = np.frombuffer(b"".join(buffer), dtype="<u4")
            row = {"shard": shard, "block": block, "first": block * block_ids, "n_ids": filled,
                   "planes": pack_planes(ids, kind, compress), "docs": docs}
            buffer, docs, filled, block = [], [], 0, block + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            keys, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for part in _slices(texts):
                for key, raw in zip(keys[part], encoder.encode(texts[part]), strict=True):
                    raw, at = raw + end, 0
                    while at < len(raw):
                        take = min(len(raw) - at, (block_ids - filled) * 4)
                        docs.append({"doc_id": key, "place": place, "at": filled, "n": take // 4})
                        buffer.append(raw[at:at + take])
                        filled, at = filled + take // 4, at + take
                        if filled == block_ids:
                            yield close()
                    place += 1
        if filled:
            yield close()

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, kind: str = "bit", block_ids: int = BLOCK_IDS,
    end_id: int = END_ID, order: tuple[str, ...] = ("doc_id",),
) -> None:
    """Encode the texts of ``docs`` and write them as plane blocks in the given order.

    The texts are shuffled once, into ranges of the order; each range is then encoded and packed
    by one task as a stream, so a task holds one batch and one block. The range key ends with a
    hash of the text, so that a repeated document id can be split over tasks.

    Null texts are empty and have the end id alone. Null ids come first. Rows of equal order keep
    the order of their texts' hashes; equal rows are all written. An empty table gives no block.
    """
    rows = docs.select(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
    ).withColumn("_h", F.xxhash64("text"))
    keys = [*[f"_o{i}" for i in range(len(order))], "_h"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    blocks = ranged.select("doc_id", "text").mapInArrow(
        block_writer(tokenizer, kind, block_ids, end_id), BLOCK_SCHEMA)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    written_blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    written_blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).write.parquet(
        f"{path}/shards")


PIECE_SCHEMA = ("shard int, block int, first long, doc_id long, place long, at int, n int, "
                "crc long, ids binary")


def _decode(with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.itertuples(index=False):
                raw = unpack_planes(list(row.planes), row.n_ids, decompress).tobytes()
                out = []
                for d in row.docs:
                    part = raw[d["at"] * 4:(d["at"] + d["n"]) * 4]
                    out.append((row.shard, row.block, row.first, d["doc_id"], d["place"], d["at"],
                                d["n"], zlib.crc32(part), part if with_ids else None))
                frame = pd.DataFrame(out, columns=[
                    "shard", "block", "first", "doc_id", "place", "at", "n", "crc", "ids"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return run


def read_pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document and block it has ids in, decoded from the planes.

    Each block is decoded on its own. ``start`` is the piece's position in the whole stream.
    """
    # A block is a few hundred kB of Arrow data and expands; few of them go to Python at a time.
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    shards = spark.read.schema("shard int, n_ids long").parquet(f"{path}/shards")
    before = F.coalesce(
        F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    # One row per shard, that is per task of the write: tens of thousands at most.
    offsets = F.broadcast(shards.select("shard", before.alias("before")))
    pieces = blocks.mapInPandas(_decode(with_ids), PIECE_SCHEMA)
    return pieces.join(offsets, "shard", "left").withColumn(
        "start", F.col("before") + F.col("first") + F.col("at")).drop("before", "first", "at")


def _matrix_apply(matrix: list[int], value: int) -> int:
    out = 0
    for row in matrix:
        if not value:
            break
        if value & 1:
            out ^= row
        value >>= 1
    return out


def crc32_join(first: int, second: int, second_bytes: int) -> int:
    """The crc32 of two byte strings joined, from their crc32s and the length of the second."""
    step = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit
    for _ in range(3):  # one zero byte
        step = [_matrix_apply(step, row) for row in step]
    while second_bytes:
        if second_bytes & 1:
            first = _matrix_apply(step, first)
        step = [_matrix_apply(step, row) for row in step]
        second_bytes >>= 1
    return first ^ second


@F.pandas_udf(T.LongType())
def _joined_crc(parts: pd.Series) -> pd.Series:
    out = []
    for pieces in parts:
        crc = 0
        for p in pieces:
            crc = crc32_join(crc, int(p["crc"]), int(p["n"]) * 4)
        out.append(crc)
    return pd.Series(out, dtype="int64")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    A document that lies in one block is done where it is decoded; only the pieces of documents
    that cross a block's end are grouped (one piece per block, joined by their checksums).
    """
    pieces = written(read_pieces(spark, path).drop("ids"), "pieces")
    ends = ["shard", "place"]
    crossing = F.col("n_pieces") > 1
    sizes = pieces.groupBy(*ends).agg(
        F.count("*").alias("n_pieces"), F.min("doc_id").alias("doc_id"),
        F.min("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.max("crc").alias("ids_crc32"),
        F.array_sort(F.collect_list(F.struct("block", "crc", "n"))).alias("parts"))
    whole = sizes.filter(~crossing)
    joined = sizes.filter(crossing).withColumn("ids_crc32", _joined_crc("parts"))
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return whole.select(*columns).unionByName(joined.select(*columns))


def token_files(docs: DataFrame, tokenizer: str, order: tuple[str, ...] = ("doc_id",),
                kind: str = "bit") -> DataFrame:
    """Write the documents as plane blocks in the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, tokenizer, path, kind=kind, order=order)
    return read_documents(spark, path)
