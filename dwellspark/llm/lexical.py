"""Ranked lexical search by the Best Position Algorithm.

Documents are indexed in shards where they lie: a shard holds up to `postings` (document, term) pairs as a forward
part (the terms of each document) and, once the weights are known, as impact lists (the documents of each term, highest
impact first). For an item all its lists in a shard are read in step, highest impacts first. Every document met is at once
looked up in all the item's lists by direct access, which gives its whole score and its place in each list. Places
seen without a gap from the top of a list are its best position; a document not seen yet can score no more than the
impacts just below the best positions together. Reading stops once that sum is strictly below the k-th score, so that
ties are complete. The best k of each shard meet in one ranking; no text and no posting is shuffled.

Items go through in blocks of about `block` (item, term) pairs (or one item), whose terms and weights are sent to the tasks;
only terms of the block are indexed. Statistics cover all documents.

Defined results: a null or empty text has no terms and is never ranked; rows that repeat a doc_id are documents of their
own; a document with a null id is ranked with that null, after others of equal score; rows of one item_id are one item with the
terms of all; items with a null id are left out; an item without terms, or whose terms no document has, has no row; other columns are
ignored; an empty table on either side gives an empty result. Texts are cut into terms in pieces, so a very long one needs
little memory besides itself.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from dwellspark.llm.common import frames, stored, workers

#: Bytes that belong to terms: digits, letters and all of code points from 0x80; A-Z become a-z, the rest space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_NO_ID = np.iinfo(np.int64).max
PIECE = 1 << 20
RESULT = "item_id long, doc_id long, score long"


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Terms of the text, a piece at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


@dataclass
class Block:
    """Items of one block: their ids, and the numbers of their terms one item after another."""
    terms: dict[bytes, int]
    ids: list[int]
    bounds: np.ndarray
    numbers: np.ndarray


def item_blocks(items: DataFrame, block: int) -> Iterator[Block]:
    """The items' distinct terms in blocks of about `block` pairs."""
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches, 500):
            rows = [(i, t) for i, text in zip(pdf["item_id"], pdf["text"]) for t in set().union(*terms_of(text))]
            yield pd.DataFrame(rows, columns=["item_id", "term"])
    given = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL")
    pairs = stored(given.mapInPandas(one, "item_id long, term binary").distinct(), "item_terms")
    blocks = -(-pairs.count() // block)
    for b in range(blocks):
        got = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "term").toPandas()  # one block
        if len(got):
            terms = {t: i for i, t in enumerate(dict.fromkeys(map(bytes, got["term"])))}
            ids, at = np.unique(got["item_id"].to_numpy(), return_index=True)
            yield Block(terms, ids.tolist(), np.append(at, len(got)), np.array([terms[bytes(t)] for t in got["term"]], np.int64))


def shards(docs: DataFrame, shared, postings: int) -> DataFrame:
    """Forward parts of the index over the terms of a block, and each shard's statistics."""
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = shared.value.terms
        held, size = [], 0
        for pdf in frames(batches):
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                n, tf = 0, Counter()
                for piece in terms_of(text):
                    n += len(piece)
                    tf.update(piece) if not tf else tf.update({t: c for t, c in Counter(piece).items() if t in terms})
                if not n:
                    continue
                got = [(terms[t], tf[t]) for t in tf.keys() & terms.keys()]
                held.append((_NO_ID if pd.isna(doc) else int(doc), n, got))
                size += len(got)
                if size >= postings or len(held) >= postings:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list) -> pd.DataFrame:
        held.sort(key=lambda r: r[0])
        lens = np.array([len(r[2]) for r in held], np.int64)
        pairs = np.array([p for r in held for p in r[2]], np.int64).reshape(-1, 2)
        number, df = np.unique(pairs[:, 0], return_counts=True)
        n = np.array([r[1] for r in held], np.int64)
        return pd.DataFrame({
            "docs": [len(held)], "occurrences": [int(n.sum())], "numbers": [number], "df": [df],
            "ids": [np.array([r[0] for r in held], np.int64).tobytes()], "n": [n.tobytes()], "lens": [lens.tobytes()],
            "term": [pairs[:, 0].astype(np.int32).tobytes()], "tf": [pairs[:, 1].tobytes()]})

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    return given.mapInPandas(one, "docs long, occurrences long, numbers array<int>, df array<long>, ids binary, n binary, lens binary, term binary, tf binary")


class Shard:
    """Forward part and impact lists of one shard."""

    def __init__(self, ids: bytes, n: bytes, lens: bytes, term: bytes, tf: bytes, terms: int, docs: int, occurrences: int):
        self.ids, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
        self.term, tf = np.frombuffer(term, np.int32), np.frombuffer(tf, np.int64)
        m = 10 + (90 * np.frombuffer(n, np.int64) * docs) // occurrences
        doc = np.repeat(np.arange(len(self.ids)), self.lens)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, -impact, self.term))
        self.first = np.searchsorted(self.term[order], np.arange(terms + 1))
        self.doc, self.impact = doc[order], impact[order]  # lists, one term after another
        self.own = impact  # in forward order
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order)) - self.first[self.term[order]]
        self.row = np.append(0, np.cumsum(self.lens))
        self.slot, self.known = np.full(terms, -1), np.zeros(len(self.ids), bool)

    def best(self, numbers: np.ndarray, weights: np.ndarray, k: int, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Places in `ids` and scores of the k documents of the highest scores above 0, ties to the smaller id."""
        size = self.first[numbers + 1] - self.first[numbers]
        use = (size > 0) & (weights > 0)
        numbers, w, size = numbers[use], weights[use], size[use]
        found, totals = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if not len(numbers):
            return found[0], totals[0]
        lo, at = self.first[numbers], np.cumsum(size) - size
        seen, position, depth = np.zeros(size.sum(), bool), np.zeros(len(size), np.int64), 0
        self.slot[numbers] = np.arange(len(numbers))
        while True:
            read = np.concatenate([self.doc[a + depth:a + min(s, depth + step)] for a, s in zip(lo.tolist(), size.tolist())])
            new = np.unique(read[~self.known[read]])
            if len(new):
                self.known[new] = True
                count = self.lens[new]
                entry = np.repeat(self.row[new] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                slot, owner = self.slot[self.term[entry]], np.repeat(np.arange(len(new)), count)
                hit = slot >= 0
                entry, slot, owner = entry[hit], slot[hit], owner[hit]
                seen[at[slot] + self.place[entry]] = True
                gain = w[slot] * self.own[entry]
                found.append(new)
                totals.append(np.add.reduceat(gain, np.flatnonzero(np.diff(owner, prepend=-1))))
            for i, (a, s, p) in enumerate(zip(at.tolist(), size.tolist(), position.tolist())):
                if p < s:
                    gap = int(seen[a + p:a + s].argmin())
                    position[i] = p + gap if not seen[a + p + gap] else s
            left = position < size
            bound = int((w[left] * self.impact[lo[left] + position[left]]).sum())
            score = np.concatenate(totals)
            if not left.any() or (len(score) >= k and np.partition(score, len(score) - k)[len(score) - k] > bound):
                break
            depth, step = depth + step, 2 * step
        docs = np.concatenate(found)
        self.slot[numbers], self.known[docs] = -1, False
        top = np.lexsort((docs, -score))[:k]
        top = top[score[top] > 0]
        return docs[top], score[top]


def weight(docs: int, df: int) -> int:
    """A term's weight, from the documents and those that hold it."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, postings: int = 1_000_000, block: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores of each item."""
    spark = workers(docs.sparkSession)
    parts = []
    for held in item_blocks(items, block):
        shared = spark.sparkContext.broadcast(held)  # a block of items
        index = stored(shards(docs, shared, postings), "impacts")
        total = index.agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences")).first()
        if not total["docs"]:
            break
        df = index.select(F.explode(F.arrays_zip("numbers", "df")).alias("e")).groupBy("e.numbers").agg(F.sum("e.df").alias("df")).collect()  # a row a term of the block
        weights = np.zeros(len(held.terms), np.int64)
        for r in df:
            weights[r["numbers"]] = weight(total["docs"], r["df"])
        parts.append(_answers(index, shared, spark.sparkContext.broadcast(weights), total["docs"], total["occurrences"], k))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _answers(index: DataFrame, shared, weights, docs: int, occurrences: int, k: int) -> DataFrame:
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, w = shared.value, weights.value
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                shard = Shard(r.ids, r.n, r.lens, r.term, r.tf, len(w), docs, occurrences)
                out = []
                for item, a, b in zip(held.ids, held.bounds.tolist(), held.bounds[1:].tolist()):
                    numbers = held.numbers[a:b]
                    at, score = shard.best(numbers, w[numbers], k)
                    out += zip([item] * len(at), shard.ids[at].tolist(), score.tolist())
                got = pd.DataFrame(out, columns=["item_id", "doc_id", "score"], dtype=np.int64)
                yield got.assign(doc_id=got["doc_id"].astype("Int64").mask(got["doc_id"] == _NO_ID))
    return index.select("ids", "n", "lens", "term", "tf").mapInPandas(one, RESULT)


def ranked_sql(k: int = 10) -> str:
    """DuckDB SQL for the rows of `ranked` over documents and benchmark."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = lambda t: f"regexp_extract_all(translate({t}, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, {cut("text")} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, terms, len(terms) AS n FROM rows_ WHERE len(terms) > 0),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs),
asked AS (SELECT DISTINCT item_id, unnest({cut("text")}) AS term FROM benchmark WHERE item_id IS NOT NULL),
held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term),
scored AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), total GROUP BY item_id, r, doc_id),
best AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= {k}"""
