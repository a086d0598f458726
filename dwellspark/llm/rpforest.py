"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees are fitted on a bounded sample of the vectors (`sample` rows, those of the smallest hash
of their id; the recall test holds the sample's size to account). Each inner node splits by the
plane half-way between two sampled vectors. Every distinct vector is then put into its leaf of every
tree. A query walks all trees through one priority queue ordered by the distance to the worst plane
crossed, and takes leaves until they hold `search` vectors; `search` is set by a pilot, for which `pilot` queries
meet all vectors and their true neighbours' places in the queue's order are noted, so that the share
`recall` of them is within reach. All members of those leaves are candidates and are reranked by their exact
cosine in double precision, leaf by leaf as matrix products.

Equal vectors are one entry with their `k + 1` smallest ids, which is all that a top k can return of
them, so a common vector does not fill a leaf. The queries' leaves meet the index by a shuffle on (tree,
leaf) in blocks. Only the trees (bounded by the sample) and the leaf counts (bounded by the trees) are
sent to tasks.

Defined results: vectors null, empty, zero or with null or non-finite components, or of another length than
most, take no part; a query with fewer candidates gets fewer rows; ties go to the smaller id; rows with the
same id are one row of that id for each distinct vector; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from dwellspark.llm.common import blocks_for, cut, frames, workers


@dataclass
class Tree:
    """Inner nodes as arrays: plane, offset, children; a child below zero is leaf -1 - child."""
    plane: np.ndarray
    offset: np.ndarray
    child: np.ndarray
    leaves: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.zeros(len(x), np.int64) if len(self.plane) else np.full(len(x), -1, np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = (np.einsum("ij,ij->i", x[inner], self.plane[node]) > self.offset[node]).astype(int)
            at[inner] = self.child[node, side]
        return -1 - at


def grow(x: np.ndarray, leaf_size: int, rng: np.random.Generator) -> Tree:
    """A tree over the rows of x, its leaves holding `leaf_size` at most (more where rows are equal)."""
    planes, offsets, children, leaves = [], [], [], 0

    def build(rows: np.ndarray) -> int:
        nonlocal leaves
        for _ in range(5 if len(rows) > leaf_size else 0):
            a, b = x[rng.choice(rows, 2, replace=False)]
            p = a - b
            size = np.linalg.norm(p)
            if size == 0:
                continue
            p = p / size
            d = x[rows] @ p
            right = d > (cutoff := np.median(d) if rng.random() < 0.5 else p @ (a + b) / 2)
            if not 0.1 <= right.mean() <= 0.9:
                cutoff = np.median(d)
                right = d > cutoff
            if 0 < right.sum() < len(rows):
                node = len(planes)
                planes.append(p)
                offsets.append(cutoff)
                children.append([0, 0])
                children[node][0] = build(rows[~right])
                children[node][1] = build(rows[right])
                return node
        leaves += 1
        return -leaves
    build(np.arange(len(x)))
    d = x.shape[1]
    return Tree(np.array(planes).reshape(-1, d), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves)


def leaves_in_order(trees: list[Tree], counts: list[np.ndarray], q: np.ndarray) -> Iterator[tuple[int, int]]:
    """(tree, leaf) pairs for one query, nearest first, from the queue that all trees share."""
    queue = [(-np.inf, t, 0 if len(trees[t].plane) else -1) for t in range(len(trees))]
    heapq.heapify(queue)
    margins = [t.plane @ q - t.offset for t in trees]
    while queue:
        worst, t, node = heapq.heappop(queue)
        tree = trees[t]
        while node >= 0:
            m = margins[t][node]
            heapq.heappush(queue, (max(worst, abs(m)), t, tree.child[node, 0 if m > 0 else 1]))
            node = tree.child[node, 1 if m > 0 else 0]
        if counts[t][-1 - node]:
            yield t, int(-1 - node)


def search_leaves(trees: list[Tree], counts: list[np.ndarray], q: np.ndarray, search: int) -> list[tuple[int, int]]:
    """The first leaves that hold `search` vectors together."""
    found, held = [], 0
    for t, leaf in leaves_in_order(trees, counts, q):
        found.append((t, leaf))
        held += counts[t][leaf]
        if held >= search:
            break
    return found


def _shortlist(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of v and exact cosine of each query's best k, ties to the smaller id. Rounded cosines leave out only what is
    below the k-th by more than their error."""
    rough = _unit(q) @ _unit(v).T
    least = np.partition(rough, len(v) - min(k, len(v)), axis=1)[:, len(v) - min(k, len(v))]
    at, to, score = [], [], []
    size = np.sqrt(np.einsum("ij,ij->i", v, v))
    for i, x in enumerate(q):
        near = np.flatnonzero(rough[i] >= least[i] - 1e-9)
        exact = np.einsum("ij,j->i", v[near], x) / (np.sqrt(np.einsum("i,i->", x, x)) * size[near])
        best = np.lexsort((ids[near], -exact))[:k]
        at.append(np.full(len(best), i))
        to.append(near[best])
        score.append(exact[best])
    return np.concatenate(at), np.concatenate(to), np.concatenate(score)


def pilot_search(entries: DataFrame, asked: np.ndarray, trees: list[Tree], counts: list[np.ndarray], k: int, recall: float) -> int:
    """How many vectors the leaves taken must hold so that `recall` of the true neighbours of `asked` are among them."""
    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches, 5000):
            v = _matrix(pdf["v"])
            at, to, score = _shortlist(asked, v, np.arange(len(v)), k + 1)
            yield pd.DataFrame({"q": at, "score": score, "v": list(v[to])})
    near = (entries.mapInPandas(exact, "q int, score double, v array<double>")
            .withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k + 1)
            .where(F.col("r") > 1).toPandas())  # k rows a pilot query; its own vector is the first
    if not len(near):
        return 1
    homes = np.stack([t.leaf(_unit(_matrix(near["v"]))) for t in trees], 1)
    places = []
    for q, rows in near.groupby("q").indices.items():
        wanted = {(t, int(homes[r, t])): [] for r in rows for t in range(len(trees))}
        for r in rows:
            for t in range(len(trees)):
                wanted[t, int(homes[r, t])].append(r)
        held, missing = 0, set(rows)
        for t, leaf in leaves_in_order(trees, counts, _unit(asked[q:q + 1])[0]):
            held += counts[t][leaf]
            for r in missing.intersection(wanted.get((t, leaf), ())):
                places.append(held)
                missing.discard(r)
            if not missing:
                break
    return int(np.quantile(places, recall)) + 1


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v of vectors that take part; components stay as stored if they are floats."""
    v, given = F.col("v"), F.col("embedding")
    if dict(rows.dtypes)["embedding"] != "array<float>":
        given = given.cast("array<double>")
    ok = rows.select(F.col("vec_id").cast("long").alias("vec_id"), given.alias("v")).where(
        (F.size(v) > 0) & F.col("vec_id").isNotNull() & ~F.exists(v, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
        & F.exists(v, lambda a: a != 0))
    length = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")  # one row
    return ok.join(F.broadcast(length), F.size("v") == F.col("n"), "left_semi")


def nearest(rows: DataFrame, k: int = 5, every: int = 50, trees: int = 24, leaf_size: int = 24, recall: float = 0.97,
            pilot: int = 64, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of the candidates found."""
    spark = workers(rows.sparkSession)
    items = cut(usable(rows).dropDuplicates(["vec_id", "v"]))
    ranked = items.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = cut(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))  # k + 1 ids at most
    picked = entries.orderBy(F.xxhash64(F.element_at("ids", 1), F.lit(seed)), F.element_at("ids", 1)).limit(sample)
    base = np.array([r["v"] for r in picked.select("v").collect()], float)  # `sample` rows at most
    if not len(base):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    forest = [grow(base, leaf_size, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forest)

    kind = dict(entries.dtypes)["v"]
    blocks = blocks_for(entries.count() * trees * 8 * (base.shape[1] + 8), 32 << 20)
    offset = np.cumsum([0] + [t.leaves for t in forest])

    def block(tree: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Neighbouring leaves of a tree are in one block."""
        return (offset[tree] + leaf) * blocks // offset[-1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches, 2000):
            x = _unit(_matrix(pdf["v"]))
            leaf = np.stack([t.leaf(x) for t in shared.value], 1)
            n, at = leaf.shape[1], np.repeat(np.arange(len(pdf)), leaf.shape[1])
            tree = np.tile(np.arange(n), len(pdf))
            yield pd.DataFrame({"block": block(tree, leaf.ravel()), "tree": tree, "leaf": leaf.ravel(),
                                "ids": pdf["ids"].to_numpy()[at], "v": pdf["v"].to_numpy()[at]})

    index = entries.mapInPandas(place, f"block int, tree int, leaf int, ids array<long>, v {kind}")
    counts = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in index.groupBy("tree", "leaf").count().collect():  # a row a leaf, bounded by the sample
        counts[r["tree"]][r["leaf"]] = r["count"]
    queries = items.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    tried = queries.orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(pilot).select("qv").collect()
    if not tried:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    search = pilot_search(entries, np.array([r["qv"] for r in tried], float), forest, counts, k, recall)
    sizes = spark.sparkContext.broadcast(counts)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches, 50):
            got = [search_leaves(shared.value, sizes.value, q, search) for q in _unit(_matrix(pdf["qv"]))]
            at = np.repeat(np.arange(len(pdf)), [len(g) for g in got])
            flat = np.array([p for g in got for p in g], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"block": block(flat[:, 0], flat[:, 1]), "tree": flat[:, 0], "leaf": flat[:, 1],
                                "query_id": pdf["query_id"].to_numpy()[at], "qv": pdf["qv"].to_numpy()[at]})

    asked = queries.mapInPandas(walk, f"block int, tree int, leaf int, query_id long, qv {kind}")

    def rerank(near: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        """Each query's best entries of the block, by exact cosine, ties to the smaller id."""
        held = far.groupby(["tree", "leaf"]).indices
        first, out = np.array([i[0] for i in far["ids"]], np.int64), []
        for key, rows in near.groupby(["tree", "leaf"]).indices.items():
            if key in held:
                at, to, score = _shortlist(_matrix(near["qv"].iloc[rows]), _matrix(far["v"].iloc[held[key]]), first[held[key]], k + 1)
                out.append(pd.DataFrame({"query_id": near["query_id"].to_numpy()[rows[at]], "score": score, "at": held[key][to]}))
        if not out:
            return pd.DataFrame({"query_id": [], "score": [], "ids": pd.Series([], dtype=object)})
        best = pd.concat(out)
        best["first"] = first[best["at"]]  # a vector comes from several trees
        best = best.sort_values(["query_id", "score", "first"], ascending=[True, False, True]).drop_duplicates(["query_id", "first"])
        best = best[best.groupby("query_id").cumcount() < k + 1]
        return pd.DataFrame({"query_id": best["query_id"].to_numpy(), "score": best["score"].to_numpy(), "ids": far["ids"].to_numpy()[best["at"]]})

    met = asked.groupBy("block").cogroup(index.groupBy("block")).applyInPandas(rerank, "query_id long, score double, ids array<long>")
    flat = met.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    best = (flat.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)
