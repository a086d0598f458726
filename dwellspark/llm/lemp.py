"""Hard negatives by inner product, with coordinate pruning over length buckets.

Vectors are rounded down to integers. Rows are dealt by length into buckets; a bucket keeps, for each coordinate, the order of its
directions (vectors over their length). An anchor that asks for inner products of `t` or more needs a cosine of at least
c = t / (its length x the bucket's greatest length). No row of a bucket where c is above 1 can do; elsewhere a
direction with that cosine has, in each coordinate f where the anchor's own direction is q, a value within
q c - sqrt((1 - c^2)(1 - q^2)) and q c + sqrt((1 - c^2)(1 - q^2)), open to -1 or 1 where the axis itself is near enough. For the anchor's
focus coordinates, those of greatest |q|, these ranges are cut out of the sorted lists, and the rows in all of them are the candidates, whose
inner products are then verified exactly in integers.

Positives: each anchor first meets its own bucket, which bounds its last positive's score from below; with that bound it
meets all buckets. Negatives: the lowest score that any of its positives admits is the bound. A pair of one bucket (`bucket` rows
about) and one block of anchors (`anchors` rows about) is one group; anchors leave a bucket out by its greatest length before anything is shuffled.

Defined results: rows with a null id, label or vector, or with null or non-finite components, take no part, nor do vectors of another length
than most; equal rows are one row; rows of one id with other vectors or labels are rows of their own, but never partners of their own id; an
anchor without other rows of its label has no result; a zero vector takes part with scores 0; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from dwellspark.llm.common import stored, workers

FOCUS = 4
FOUND = "a_key long, anchor_id long, cut long, vec_id long, score long"


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and integer vector v of the rows that take part, with the length of v; equal rows once."""
    given, v = F.col("embedding").cast("array<double>"), F.col("v")
    ok = (rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), given.alias("v"))
          .where("vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0")
          .where(~F.exists(v, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))))
    length = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")  # one row
    same = ok.join(F.broadcast(length), F.size("v") == F.col("n"), "left_semi")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(v, lambda a: F.floor(a * scale))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, a: s + a.cast("double") * a))
    return same.select("vec_id", label.alias("label"), whole.alias("v")).distinct().withColumn("size", size)


class Bucket:
    """Rows of one range of lengths, with a sorted list of directions for each coordinate asked for."""

    def __init__(self, v: np.ndarray):
        self.v, self.size = v, np.linalg.norm(v, axis=1)
        self.top = float(self.size.max(initial=0.0))
        self.direction = v / np.where(self.size > 0, self.size, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Order and values of the directions in coordinate f."""
        if f not in self.lists:
            order = np.argsort(self.direction[:, f], kind="stable")
            self.lists[f] = order, self.direction[order, f]
        return self.lists[f]

    def candidates(self, q: np.ndarray, least: float) -> np.ndarray | None:
        """Rows whose inner product with q may be `least` or more; None for all."""
        size = float(np.linalg.norm(q))
        if least <= 0 or not size:
            return None if least <= 0 else np.empty(0, np.int64)
        if not self.top or (c := least / (size * self.top) - 1e-9) > 1:
            return np.empty(0, np.int64)
        direction = q / size
        focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
        ranges = []
        for f in focus.tolist():
            x = float(direction[f])
            spread = np.sqrt(max(0.0, (1 - c * c) * (1 - x * x))) + 1e-9
            low, high = (-1.1 if -x >= c else x * c - spread), (1.1 if x >= c else x * c + spread)
            order, values = self.sorted_list(f)
            a, b = np.searchsorted(values, low), np.searchsorted(values, high, "right")
            ranges.append((int(b - a), f, low, high, order[a:b]))
        ranges.sort(key=lambda r: r[0])
        rows = ranges[0][4]
        if 2 * len(rows) > len(self.v):
            return None  # the narrowest range leaves most rows: all are verified
        for _, f, low, high, _ in ranges[1:]:
            values = self.direction[rows, f]
            rows = rows[(values >= low) & (values <= high)]
        return rows

    def products(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Candidates and their exact inner products with q."""
        rows = self.candidates(q, least)
        if rows is None:
            return np.arange(len(self.v)), (self.v @ q).astype(np.int64)
        return rows, (self.v[rows] @ q).astype(np.int64)


def first(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    if len(score) > 4 * k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _meet(asked: DataFrame, rows: DataFrame, keys: list[str], choose: Callable) -> DataFrame:
    """Groups of anchors and rows with equal keys, each anchor's choice among its candidates there. `choose` gets the anchor's record, and the
    ids, labels and scores of its candidates, and returns places with the cut they belong to."""
    def one(near: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(near) and len(far):
            bucket = Bucket(np.vstack(far["v"].to_numpy()).astype(float))
            ids, labels = far["vec_id"].to_numpy(), far["label"].to_numpy()
            for r in near.itertuples(index=False):
                at, score = bucket.products(np.asarray(r.v, float), float(r.least))
                for cut, places in choose(r, ids[at], labels[at], score):
                    out += [(r.a_key, r.anchor_id, cut, int(ids[at[p]]), int(score[p])) for p in places]
        return pd.DataFrame(out, columns=["a_key", "anchor_id", "cut", "vec_id", "score"], dtype=np.int64)
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(one, FOUND)


def _positives(k: int) -> Callable:
    def choose(r, ids, labels, score) -> Iterator[tuple[int, np.ndarray]]:
        ok = np.flatnonzero((labels == r.a_label) & (ids != r.anchor_id) & (score >= r.least))
        yield 0, ok[first(ids[ok], score[ok], k)]
    return choose


def _negatives(k: int) -> Callable:
    def choose(r, ids, labels, score) -> Iterator[tuple[int, np.ndarray]]:
        ok = np.flatnonzero((labels != r.a_label) & (ids != r.anchor_id))
        for p in r.cuts:
            within = ok[(80 * p <= 100 * score[ok]) & (score[ok] <= p)]
            yield int(p), within[first(ids[within], score[within], k)]
    return choose


def hard_negatives(rows: DataFrame, k: int = 5, every: int = 100, bucket: int = 20_000, anchors: int = 20_000) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    workers(rows.sparkSession)
    empty = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    kept = stored(usable(rows), "vectors")
    n = kept.count()
    if not n:
        return empty
    dealt = kept.repartitionByRange(-(-n // bucket), F.desc("size"), "vec_id").withColumn("bucket", F.spark_partition_id())
    items = stored(dealt, "buckets")
    tops = items.groupBy("bucket").agg(F.max("size").alias("top"))
    last = tops.agg(F.max("bucket").alias("b")).first()["b"]
    at = F.col("vec_id") % every == 0
    asked = stored(items.where(at).select(F.xxhash64("vec_id", "label", "v").alias("a_key"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"),
                                          "v", F.col("size").alias("a_size"), "bucket"), "anchors")
    blocks = -(-asked.count() // anchors)
    if not blocks:
        return empty
    order = lambda *by: W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    inner = items.select("bucket", "vec_id", "label", "v")
    home = _meet(asked.withColumn("least", F.lit(-2.0 ** 62)), inner, ["bucket"], _positives(k))
    bound = home.groupBy("a_key").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))  # k rows an anchor at most

    # every anchor with every bucket that can reach its bound, one block of anchors at a time
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    far = inner.withColumn("block", each)

    def reach(queries: DataFrame) -> DataFrame:
        pairs = queries.drop("bucket").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(tops, "bucket")
        near = pairs.where((F.col("least") <= 0) | (F.col("a_size") * F.col("top") * 1.000001 >= F.col("least")))
        return near.withColumn("block", F.pmod("a_key", F.lit(blocks)).cast("int"))

    ranged = asked.join(bound, "a_key", "left").withColumn("least", F.coalesce(F.col("least").cast("double"), F.lit(-2.0 ** 62)))
    met = _meet(reach(ranged), far, ["bucket", "block"], _positives(k))
    best = met.withColumn("r", F.row_number().over(order("a_key"))).where(F.col("r") <= k).select("a_key", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = stored(best, "positives")
    cuts = positives.where("positive_score >= 0").groupBy("a_key").agg(F.sort_array(F.collect_set("positive_score")).alias("cuts"))  # k at most
    wanted = asked.join(cuts, "a_key").withColumn("least", F.element_at("cuts", 1) * 0.8)
    found = _meet(reach(wanted), far, ["bucket", "block"], _negatives(k))
    ranks = found.withColumn("rank", F.row_number().over(order("a_key", "cut"))).where(F.col("rank") <= k)
    return (positives.join(ranks.select("a_key", F.col("cut").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")),
                           ["a_key", "positive_score"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def hard_negatives_sql(k: int = 5, every: int = 100) -> str:
    """DuckDB SQL for the rows of `hard_negatives` over embeddings."""
    return f"""
WITH ok AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
most AS (SELECT len(e) AS n FROM ok GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
items AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(e, lambda x: floor(256 * x::DOUBLE)) AS v FROM ok WHERE len(e) = (SELECT n FROM most)),
pairs AS (SELECT a.vec_id AS anchor_id, a.label AS a_label, a.v AS av, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM items a JOIN items b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, a_label, av ORDER BY score DESC, vec_id) AS r
  FROM pairs WHERE label = a_label) WHERE r <= {k}),
ranked AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.a_label, p.av, p.r ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.a_label = p.a_label AND n.av = p.av AND n.label <> p.a_label
  WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {k}"""
