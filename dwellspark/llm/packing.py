"""Token ids in fixed-width bit-packed files.

Texts are encoded by the tokenizers library; each id takes the fewest bits that the vocabulary needs.
A file is a Parquet part whose rows are blocks of whole documents in ascending id order:

    block      number of the block within its file
    first      ids in the file before the block (the block offset)
    bits       width of an id
    doc_ids, lengths   the block's documents and how many ids each has
    payload    the ids, bit-packed, little-endian bit order

Any block is read without the ones before it, and any document or run of ids of it without unpacking
the rest: an id starts at bit `index * bits`. Files are written by Spark's writer, so a task that
is run again leaves one copy, and the store may be any that Spark can write to.

Range partitions by id make file order id order; the ids before each file are sums over the few rows of the
manifest (one row a file).

Defined results: a null or empty text has the end id alone; a null id sorts first; rows with the same id
follow one another by text; other columns are ignored; an empty table gives no files with rows and an
empty result.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from dwellspark.llm.common import frames, new_path, texts_of, workers

END_ID = 1
#: Ids that close a block.
BLOCK_IDS = 65_536
_SCHEMA = "shard int, block int, first long, bits int, doc_ids array<long>, lengths array<long>, payload binary"


def width(vocabulary: int) -> int:
    """Fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of `bits` bits each, the lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(rows[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """`n` ids from index `start` on; only their bytes are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    lo, skip = start * bits // 8, start * bits % 8
    raw = np.frombuffer(payload, np.uint8)[lo:-(-(start + n) * bits // 8)]
    rows = np.unpackbits(raw, bitorder="little")[skip:skip + n * bits].reshape(n, bits)
    out = np.zeros((n, 32), np.uint8)
    out[:, :bits] = rows
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


#: Letters that the normaliser only puts in lower case, then signs that the splitter keeps in one piece behind them.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!#$%&()*+,./:;<=>?@|~-]*)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 signs stand for
    themselves, the others follow from U+0100 on in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in visible else next(rest)) for b in range(256)}


class WordEncoder:
    """The library's encoding, one word at a time: the normaliser and the splitter never join across
    a space or line feed, so a text's ids are its words' ids in turn. Words are cached. A new word of
    plain letters goes straight to the library's merges, in lower case and as byte letters, which is what
    its normaliser and splitter make of it; any other goes through all of the library."""

    def __init__(self, path: str, cache: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library, self.limit, self.known = Tokenizer.from_file(path), cache, {"": b""}
        self.vocabulary = self.library.get_vocab_size()
        self.model, self.letters = self.library.model, byte_letters()

    def _whole(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, letters: str) -> bytes:
        text = letters.lower()
        if not text.isascii():
            text = "".join(map(self.letters.__getitem__, text.encode()))
        return np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        known = self.known
        for word in new:
            m = PLAIN.fullmatch(word)
            if m is None:
                known[word] = self._whole(word)
                continue
            letters, signs = m.groups()
            ids = known.get(letters)
            if ids is None:
                ids = self._plain(letters)
            if signs:
                if signs not in known:
                    known[signs] = self._whole(signs)
                ids += known[signs]
            known[word] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without the end id."""
        if len(self.known) > self.limit:
            self.known = {"": b""}
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(list({w for s in split for w in set(s) if w not in self.known}))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; kept between tasks."""
    return WordEncoder(path)


def write_packed(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode the documents and write their files below `path`, one a range of ids."""
    spark = workers(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = word_encoder(tokenizer)
        bits = width(max(enc.vocabulary, end_id + 1))
        block, first, ids, names = 0, 0, [], []

        def row() -> pd.DataFrame:
            lengths = [len(x) // 4 for x in ids]
            return pd.DataFrame({"shard": [shard], "block": [block], "first": [first], "bits": [bits], "doc_ids": [names], "lengths": [lengths],
                                 "payload": [pack(np.frombuffer(b"".join(ids), "<u4"), bits)]})
        size, shard = 0, -1
        for pdf in frames(batches, 1000):
            shard = int(pdf["shard"].iloc[0])
            for name, x in zip(pdf["doc_id"].astype("Int64"), enc.encode(pdf["text"].tolist())):
                ids.append(x + end)
                names.append(None if name is pd.NA else int(name))
                size += len(x) // 4 + 1
                if size >= block_ids:
                    yield row()
                    block, first, size, ids, names = block + 1, first + size, 0, [], []
        if ids:
            yield row()

    ranged = texts_of(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    (ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInPandas(blocks, _SCHEMA)
     .write.option("compression", "zstd").parquet(path))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of the files below `path`, each with `start`: the ids of all files and blocks before."""
    blocks = spark.read.schema(_SCHEMA).parquet(path)
    manifest = blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    before = manifest.select("shard", F.coalesce(F.sum("ids").over(
        W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a file
    # One row a file, as many as the writer had partitions: the blocks themselves stay where they are.
    return blocks.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("first"))


def documents_of(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the blocks, from their payloads."""
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches, 20):
            for r in pdf.itertuples():
                n = np.asarray(r.lengths, np.int64)
                at = np.cumsum(n) - n
                raw = unpack(r.payload, r.bits, 0, int(n.sum())).astype("<u4").tobytes()
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in r.doc_ids], "Int64"), "start": r.start + at, "n_tokens": n,
                                    "ids_crc32": [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist())]})
    return blocks.select("bits", "lengths", "doc_ids", "start", "payload").mapInPandas(
        one, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_at(spark: SparkSession, path: str, start: int, n: int) -> list[int]:
    """Random access: `n` ids from global position `start`; only the blocks that hold them are fetched."""
    blocks = read_packed(spark, path).withColumn("ids", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    out: list[int] = []
    for r in blocks.where((F.col("start") < start + n) & (F.col("start") + F.col("ids") > start)).orderBy("start").collect():
        lo, hi = max(start, r["start"]), min(start + n, r["start"] + r["ids"])
        out += unpack(r["payload"], r["bits"], lo - r["start"], hi - lo).tolist()
    return out


def packed_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' ids to files in the shared folder and read every document back from them."""
    path = new_path(docs.sparkSession, "packed")
    write_packed(docs, tokenizer, path)
    return documents_of(read_packed(docs.sparkSession, path))
