"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Columns (n-gram hashes) have one order for all documents: frequent ones last, else by hash. Two
documents with similarity t or more share a column among the first n - ceil(t n) + 1 of each, so a
first product over those columns finds every candidate. It runs in blocks of columns: each block
holds the packed entries (column, document, size, place) of one hash range. Candidates whose sizes rule the
similarity out are dropped at once, and so are those whose places do: the first column that a pair shares leaves
it at most the columns from there on, so a pair counts only where those reach the bound. The others' first columns are multiplied as a whole: their overlap up to
where the shorter list of the two ends, and all that is left behind it, must reach the bound. For what stays the
product runs over all columns in blocks, adding up overlaps and dropping a pair as soon as the rest cannot reach
the bound.

Only components are wanted, so a column with many documents is not expanded into its pairs: its
documents meet one of them (the hub) first. Columns whose documents are then still in different
components go through further hubs, and at last the remaining pairs across components. No link
between components is lost. Documents with equal sets are one node from the start.

Defined results: null and empty texts have no set, size 0 and are their own component; a text with
fewer words than n is one n-gram; rows that share an id are one node; a row with a null id is returned
with a null component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dwellspark.llm.common import blocks_for, cut, frames, removed, shingle_set, stored, texts_of, workers
from dwellspark.llm.components import components

#: A column in so many different texts of a batch of BATCH counts as frequent.
FREQUENT, BATCH = 3, 4000
#: Bound of the frequent columns that every task is told; it moves work, never results.
MAX_FREQUENT = 200_000
#: Columns with more documents than this meet a hub first.
WIDE = 6
#: Hubs tried before the pairs across components.
HUBS = 2
_LATE = np.uint64(1 << 63)
_ENTRY = np.dtype([("s", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("at", "<i4")])


def needed(nx, ny, percent: int):
    """Smallest overlap that reaches the similarity: 100 o >= p (nx + ny - o)."""
    return -(-percent * (nx + ny) // (100 + percent))


def frequent_columns(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of columns seen often in some batch, most frequent first kept, sorted."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches, BATCH):
            sets = {}
            for t in pdf["text"]:
                s = shingle_set(t, k)
                sets[hash(s.tobytes())] = s
            values, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets.values()]), return_counts=True)
            yield pd.DataFrame({"s": values[n >= FREQUENT].view(np.int64), "n": n[n >= FREQUENT]})

    top = (docs.select("text").mapInPandas(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "s").limit(MAX_FREQUENT).select("s").toPandas())
    return np.sort(top["s"].to_numpy(np.int64).view(np.uint64))


def incidence(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n (set size), sig (digest of the set), head (its first columns in order, packed). A column's
    number is its hash with the lowest bit dropped and the highest set if it is frequent."""
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches):
            n, sig, head = [], [], []
            for t in pdf["text"]:
                s = shingle_set(t, k)
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                m = len(s) - math.ceil(percent * len(s) / 100) + 1 if len(s) else 0
                columns = s >> np.uint64(1)
                if len(frequent) and len(s):
                    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    columns = np.concatenate([columns[~late], columns[late] | _LATE])
                head.append(columns[:m].tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": n, "sig": sig, "head": head})
    return docs.mapInPandas(one, "doc_id long, n int, sig binary, head binary")


def _column_blocks(sets: DataFrame, blocks: int) -> DataFrame:
    """Entries of the first columns, packed by hash range: one row per batch and range."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches, 5000):
            heads = [np.frombuffer(h, np.uint64) for h in pdf["head"]]
            size = [len(h) for h in heads]
            e = np.empty(sum(size), _ENTRY)
            e["s"] = np.concatenate([np.empty(0, np.uint64), *heads])
            e["doc"], e["n"] = np.repeat(pdf["rep"].to_numpy(np.int64), size), np.repeat(pdf["n"].to_numpy(), size)
            e["at"] = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
            block = (e["s"] % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            e, block = e[order], block[order]
            at = np.flatnonzero(np.diff(block, prepend=-1))
            yield pd.DataFrame({"block": block[at], "payload": [x.tobytes() for x in np.split(e, at[1:])] if len(e) else []})
    return sets.mapInPandas(pack, "block long, payload binary")


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether entries of one column, if it is the first that their documents share, can belong to a link."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    return np.minimum(na - a["at"], nb - b["at"]) >= needed(na, nb, percent)


def _candidates(packed: DataFrame, percent: int) -> DataFrame:
    """Rows x, y (a candidate pair) or s, x, n, at (a document of a wide column)."""
    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.concatenate([np.frombuffer(p, _ENTRY) for p in pdf["payload"]])
        e = np.sort(e, order=["s", "at", "doc"])  # the document with the column foremost is the hub
        first = np.flatnonzero(np.concatenate([[True], e["s"][1:] != e["s"][:-1]]))
        size = np.diff(np.append(first, len(e)))
        keep = np.repeat(size > 1, size)
        e, size = e[keep], size[size > 1]
        start = np.repeat(np.cumsum(size) - size, size)
        reach = np.repeat(size, size)
        at, pairs = np.arange(len(e)), []
        for gap in range(1, WIDE):
            a = at[(at + gap < start + reach) & (reach <= WIDE)]
            pairs.append((a, a + gap))
        wide = at[reach > WIDE]
        pairs.append((start[wide], wide))
        a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        ok = (e["doc"][a] != e["doc"][b]) & _near(e[a], e[b], percent)
        x, y = e["doc"][a[ok]], e["doc"][b[ok]]
        xy = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1).reshape(-1, 2), axis=0)
        return pd.DataFrame({
            "x": np.concatenate([xy[:, 0], e["doc"][wide]]), "y": np.concatenate([xy[:, 1], np.full(len(wide), -1)]),
            "s": np.concatenate([np.zeros(len(xy), np.int64), e["s"][wide].view(np.int64)]),
            "n": np.concatenate([np.full(len(xy), -1), e["n"][wide].astype(np.int64)]),
            "at": np.concatenate([np.zeros(len(xy), np.int64), e["at"][wide].astype(np.int64)])})
    return packed.groupBy("block").applyInPandas(multiply, "x long, y long, s long, n long, at long")


def overlap_reaches(x: np.ndarray, y: np.ndarray, percent: int, blocks: int = 4) -> bool:
    """Whether two sorted sets reach the similarity. Overlaps add up over ranges of columns; the
    pair is discarded once the rest cannot reach the bound."""
    want, got = needed(len(x), len(y), percent), 0
    cuts = (np.arange(1, blocks, dtype=np.uint64) * np.uint64(2**64 // blocks)).astype(np.uint64)
    ax, ay = [0, *np.searchsorted(x, cuts), len(x)], [0, *np.searchsorted(y, cuts), len(y)]
    for i in range(blocks):
        if got + min(len(x) - ax[i], len(y) - ay[i]) < want:
            return False
        a, b = x[ax[i]:ax[i + 1]], y[ay[i]:ay[i + 1]]
        if len(a) and len(b):
            got += int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return bool(len(x)) and got >= want


def head_reaches(a: np.ndarray, b: np.ndarray, na: int, nb: int, percent: int) -> bool:
    """Whether sets of sizes na and nb with these first columns can still reach the similarity."""
    end = min(a[-1], b[-1])
    ka, kb = int(np.searchsorted(a, end, "right")), int(np.searchsorted(b, end, "right"))
    got = int((b[np.minimum(np.searchsorted(b, a[:ka]), len(b) - 1)] == a[:ka]).sum())
    return got + min(na - ka, nb - kb) >= needed(na, nb, percent)


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) that the product over their first columns leaves."""
    head = sets.select(F.col("rep").alias("id"), "n", "head")
    rows = pairs.join(head.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("head").alias("hx")), "x").join(
        head.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("head").alias("hy")), "y")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches, 5000):
            ok = [head_reaches(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), m, n, percent)
                  for a, b, m, n in zip(pdf["hx"], pdf["hy"], pdf["nx"], pdf["ny"])]
            yield pdf.loc[ok, ["x", "y"]]
    return rows.select("x", "y", "nx", "ny", "hx", "hy").mapInPandas(check, "x long, y long").distinct()


def _links(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (x, y) whose whole sets reach the similarity. Only the texts of documents in a pair that
    is still possible travel; rows of one document come together and share its set."""
    left = cut(_possible(pairs, sets, percent))
    ids = left.select(F.col("x").alias("doc_id")).union(left.select("y")).distinct()
    texts = stored(docs.join(ids, "doc_id", "left_semi"), "texts")
    rows = left.join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("of_y")), "y").join(
        texts.select(F.col("doc_id").alias("x"), F.col("text").alias("of_x")), "x")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, kept = None, None
        for pdf in frames(batches):
            ok = []
            for a, b in zip(pdf["of_x"], pdf["of_y"]):
                if a != text:
                    text, kept = a, shingle_set(a, k)
                ok.append(overlap_reaches(kept, shingle_set(b, k), percent))
            yield pdf.loc[ok, ["x", "y"]]
    linked = stored(rows.select("x", "y", "of_x", "of_y").mapInPandas(check, "x long, y long").distinct(), "links")
    removed(texts)
    return linked


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the smallest id that links reach."""
    workers(docs.sparkSession)
    texts = texts_of(docs)
    rows = stored(incidence(texts, k, percent, frequent_columns(texts, k)), "incidence")
    sets = stored(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min_by("head", "doc_id").alias("head")), "sets")
    size = sets.agg(F.sum(F.length("head"))).first()[0] or 0  # 8 bytes a column
    found = stored(_candidates(_column_blocks(sets, blocks_for(size * _ENTRY.itemsize // 8)), percent), "candidates")
    pairs = found.where("n < 0").select("x", "y").distinct()
    member = cut(rows.select("doc_id", "n", "sig").join(sets.select("sig", "rep"), "sig", "left").select("doc_id", "n", "rep"))
    removed(rows)
    same_id = member.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u <> v")
    edges = cut(_links(pairs, sets, texts, k, percent).select(F.col("x").alias("u"), F.col("y").alias("v"))
                .union(same_id.select("u", "v")))
    comp = cut(components(edges))
    wide = found.where("n >= 0").select("s", F.col("x").alias("doc"), "n", "at")
    for step in range(HUBS + 1):
        split = _split_columns(wide, comp)
        if split.isEmpty():
            break
        more = _hub_pairs(split, percent, step) if step < HUBS else _cross_pairs(split, percent)
        new = _links(more, sets, texts, k, percent).select(F.col("x").alias("u"), F.col("y").alias("v"))
        edges = cut(edges.union(new))
        comp = cut(components(edges))
        wide = split.select("s", "doc", "n", "at")
    removed(found)
    removed(sets)
    named = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def _split_columns(wide: DataFrame, comp: DataFrame) -> DataFrame:
    """Entries of the wide columns whose documents are in more than one component."""
    named = wide.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select(
        "s", "doc", "n", "at", F.coalesce("component", "doc").alias("component"))
    several = named.groupBy("s").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("s")
    return cut(named.join(several, "s"))


def _may_link(n: str, at: str, m: str, to: str, percent: int) -> F.Column:
    """As `_near`, for columns."""
    return (100 + percent) * F.least(F.col(n) - F.col(at), F.col(m) - F.col(to)) >= percent * (F.col(n) + F.col(m))


def _hub_pairs(split: DataFrame, percent: int, step: int) -> DataFrame:
    """Each split column's documents against one of them, another one in each step."""
    hub = split.groupBy("s").agg(F.min_by(F.struct("doc", "n", "at", "component"), F.struct("at", F.xxhash64("doc", F.lit(step)))).alias("h"))
    return (split.join(hub, "s").where("component <> h.component").where(_may_link("n", "at", "h.n", "h.at", percent))
            .select(F.least("doc", "h.doc").alias("x"), F.greatest("doc", "h.doc").alias("y")).distinct())


def _cross_pairs(split: DataFrame, percent: int) -> DataFrame:
    """What hubs left open: pairs of a split column across components, sizes and places permitting."""
    a, b = split, split.select("s", F.col("doc").alias("d2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("component").alias("c2"))
    return (a.join(b, "s").where("component < c2").where(_may_link("n", "at", "n2", "at2", percent))
            .select(F.least("doc", "d2").alias("x"), F.greatest("doc", "d2").alias("y")).distinct())
