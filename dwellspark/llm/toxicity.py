"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the character n-grams it holds, hashed into a table of fixed width. For each feature the
labelled rows give two counts, the toxic and the clean documents with it, and from them the log ratio of its shares in
the two classes. The ratio is drawn towards zero by `doubt` of its standard errors and by `slack`, so features whose ratio may be chance, or
is no more than a habit of style, have the scale zero and fall away. A logistic regression over the features times their scales is then fitted on a bounded, stratified
sample of labelled rows, weighted back to the shares of all labelled rows.

Counts cover the labelled rows outside the held-out fold, `labelled` / 2 of each class at most, so that their ids can go to every task and no
text is shuffled. The driver gets the counts of the table (fixed width) and the features
of the sample; the tasks get one weight a feature.

Defined results: a null or empty text holds no n-gram and is scored by the intercept; a null id is never held out and has no label;
labels that are null, repeated or contradict each other count once per id by their largest value; without labelled rows of both classes
every score is 0.5; repeated rows are scored each; other columns of either table are ignored; an empty table gives an empty result. Very
long texts are hashed in pieces and scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dwellspark.llm.common import frames, stored, texts_of, workers

SIZES = (3, 4, 5)
BITS = 20
RANGES, LANES = 16, 256
PIECE = 1 << 20
_FOLD = np.array([c if chr(c).isalnum() else 32 for c in range(128)], np.uint32)
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Places in the table of the text's n-grams, with repeats, a piece at a time."""
    if not text:
        return
    for at in range(0, len(text), PIECE):
        piece = text[max(0, at - max(SIZES) + 1):at + PIECE].lower()
        points = np.frombuffer(f" {piece} ".encode("utf-32-le", "surrogatepass"), "<u4")
        plain = points < 128
        points = np.where(plain, _FOLD[np.where(plain, points, 0)], points).astype(np.uint64)
        run = points
        for n in range(2, max(SIZES) + 1):
            run = run[:-1] * _STEP + points[n - 1:]
            if n in SIZES and len(run):
                yield ((run + np.uint64(n)) * _SPREAD >> np.uint64(64 - BITS)).astype(np.int64)


def counts(rows: DataFrame) -> np.ndarray:
    """Toxic and clean documents (text, toxic) that hold each feature, as an array of two rows. Each task sends its table once, packed
    by ranges of features; sums go over lanes of tasks first, so no group grows with the table."""
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, bool)
        for pdf in frames(batches):
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                for g in grams(text):
                    seen[g] = True
                at = np.flatnonzero(seen)
                total[int(not toxic), at] += 1
                seen[at] = False
        if total.any():
            yield packed(total.reshape(2, RANGES, -1).swapaxes(0, 1), range(RANGES), TaskContext.get().partitionId() % LANES)

    def packed(tables: np.ndarray, ranges, lane: int) -> pd.DataFrame:
        return pd.DataFrame({"range": list(ranges), "lane": lane, "table": [zlib.compress(t.tobytes(), 1) for t in tables]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1, 2, (1 << BITS) // RANGES), np.int64)
        for t in pdf["table"]:
            total[0] += np.frombuffer(zlib.decompress(t), np.int64).reshape(2, -1)
        return packed(total, [pdf["range"].iloc[0]], 0)

    shape = "range int, lane int, table binary"
    sums = rows.select("text", "toxic").mapInPandas(one, shape).groupBy("range", "lane").applyInPandas(add, shape).groupBy("range").applyInPandas(add, shape)
    out = np.zeros((2, RANGES, (1 << BITS) // RANGES), np.int64)
    for r in sums.collect():  # a row a range
        out[:, r["range"]] = np.frombuffer(zlib.decompress(r["table"]), np.int64).reshape(2, -1)
    return out.reshape(2, -1)


def log_ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, doubt: float, slack: float) -> np.ndarray:
    """Log of the feature's share in toxic documents over that in clean ones, drawn towards zero by `slack` and `doubt` standard errors."""
    p, q = toxic + 1.0, clean + 1.0
    ratio = np.log(p / (n_toxic + 2.0)) - np.log(q / (n_clean + 2.0))
    return np.sign(ratio) * np.maximum(0.0, np.abs(ratio) - slack - doubt * np.sqrt(1 / p + 1 / q))


def features(text: str | None, scale: np.ndarray) -> np.ndarray:
    """Distinct features of the text whose scale is not zero."""
    return np.unique(np.concatenate([np.empty(0, np.int64), *(g[scale[g] != 0] for g in grams(text))]))


@dataclass
class Model:
    """Weight of each feature (its scale times its coefficient), and the intercept."""
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[features(text, self.weights)].sum(dtype=float))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def regression(rows: list[np.ndarray], scale: np.ndarray, toxic: np.ndarray, mass: np.ndarray, ridge: float, passes: int) -> Model:
    """Accelerated gradient steps on the weighted logistic loss over rows of scaled features."""
    used, at = np.unique(np.concatenate([np.empty(0, np.int64), *rows]), return_inverse=True)
    owner, value = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), scale[used][at]
    mass = mass / mass.sum()
    w, b = np.zeros(len(used)), float(np.log((mass[toxic].sum() + 1e-6) / (mass[~toxic].sum() + 1e-6)))
    norms = np.bincount(owner, value ** 2, len(rows)) + 1
    rate = 1 / (0.25 * float((mass * norms).sum()) + ridge)
    ahead, ahead_b, last = w, b, 1.0
    for _ in range(passes):
        z = np.bincount(owner, value * ahead[at], len(rows)) + ahead_b
        error = mass * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic)
        new = ahead - rate * (np.bincount(at, value * error[owner], len(used)) + ridge * ahead)
        new_b = ahead_b - rate * error.sum()
        t = (1 + np.sqrt(1 + 4 * last * last)) / 2
        ahead, ahead_b, last = new + (last - 1) / t * (new - w), new_b + (last - 1) / t * (new_b - b), t
        w, b = new, new_b
    weights = np.zeros(len(scale), np.float32)
    weights[used] = w * scale[used]
    return Model(weights, float(b))


def bounded(labels: DataFrame, most: int) -> DataFrame:
    """`most` / 2 labels of each class at most, those of the smallest hash of their id."""
    marked = labels.select("doc_id", "toxic", F.xxhash64("doc_id", F.lit(12)).alias("h"))
    kept = [marked.where(F.col("toxic") == y).orderBy("h").limit(most // 2) for y in (True, False)]
    return stored(kept[0].union(kept[1]), "labels")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 200_000, sample: int = 8_000, doubt: float = 2.0, slack: float = 0.7, ridge: float = 1e-5, passes: int = 400) -> Model | None:
    """Fit on the documents (doc_id, text) that `labels` (doc_id, toxic boolean) name, of `labelled` labels at most; the regression takes
    `sample` / 2 of each class at most. None where a class has no row."""
    spark = docs.sparkSession
    share = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    known = bounded(labels, labelled)
    given = docs.join(F.broadcast(known.select("doc_id", "toxic")), "doc_id")  # `labelled` rows at most
    size = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    toxic, clean = counts(given)
    scale = log_ratios(toxic, clean, size[True], size[False], doubt, slack)
    chosen = bounded(known, sample)
    shared = spark.sparkContext.broadcast(scale.astype(np.float32))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches, 500):
            yield pd.DataFrame({"toxic": pdf["toxic"], "x": [features(t, shared.value).astype(np.int32) for t in pdf["text"]]})
    rows = docs.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").select("toxic", "text").mapInPandas(one, "toxic boolean, x array<int>").limit(2 * sample).toPandas()  # repeated rows do not swell it
    toxic = rows["toxic"].to_numpy(bool)
    if not (toxic.any() and (~toxic).any()):
        return None
    mass = np.where(toxic, share[True] / toxic.sum(), share[False] / (~toxic).sum())
    return regression([np.asarray(x, np.int64) for x in rows["x"]], scale, toxic, mass, ridge, passes)


def held_out():
    """Whether an id belongs to the fold whose labels are not used."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """One row an id outside the held-out fold: whether it is toxic."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("y"))
            .where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out()).groupBy("doc_id").agg((F.max("y") == 1).alias("toxic")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = workers(docs.sparkSession)
    rows = texts_of(docs)
    model = fit(rows, training_labels(labels), **options)
    shared = spark.sparkContext.broadcast(model)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"),
                                "score": [shared.value.score(t) if shared.value else 0.5 for t in pdf["text"]]})
    return rows.mapInPandas(one, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
