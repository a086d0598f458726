"""Quality classifier by positive-unlabelled learning.

Trusted positives and the unlabelled documents train a linear scorer over style features by
minimising the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with logistic loss. The class prior is estimated from the two score distributions: the smallest
ratio of unlabelled to positive mass above a threshold. Labels of both classes calibrate the score.

Every expectation is a sum over all rows of a table of features, written once. Only sums of model
width, score histograms of fixed length and quantiles reach the driver.

Defined results: a null or empty text is scored like a text without words; a null id is never held
out and has no label; labels that are null, repeated or contradict each other count once per id
by their largest value; without positives every score is the share 0.5; repeated rows are scored
each; other columns of either table are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dwellspark.llm.common import cut, frames, texts_of, workers

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*@^~<>{}[]|\\=+_`", np.uint8))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
N_STYLE = 16
QUANTILES = (0.02, 0.1, 0.5, 0.9, 0.98)
BINS = 400


def style(text: str | None) -> list[float]:
    """Style features of one text; all of it is read."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    tokens = raw.split()
    n, size = len(tokens), len(raw)
    if not n:
        return [0.0] * N_STYLE
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    distinct = set(tokens)
    lines = raw.split(b"\n")
    letters = int(count[UPPER].sum() + count[LOWER].sum())
    repeats = sum(map(eq, tokens, tokens[1:]))
    packed = len(zlib.compress(raw, 1))
    return [
        np.log1p(n), np.log1p(n) - np.log1p(len(distinct)), repeats / n, count[UPPER].sum() / max(1, letters),
        count[DIGIT].sum() / size, count[SYMBOLS].sum() / n, count[124] / n, count[33] / n,
        (count[46] + count[44]) / n, np.log1p(size / n), len(lines) / n, count[32] / size,
        1 - len(set(lines)) / len(lines), count[128:].sum() / size, np.log1p(size / packed), np.log1p(max(map(len, tokens))),
    ]


def style_table(docs: DataFrame) -> DataFrame:
    """doc_id and the style features of every document."""
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "x": [style(t) for t in pdf["text"]]})
    return docs.mapInPandas(one, "doc_id long, x array<double>")


@dataclass
class Basis:
    """Hinges at quantiles of each style feature, over its spread."""
    knots: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        spread = np.maximum(self.knots[:, -1] - self.knots[:, 0], 1e-3)
        parts = [np.ones((len(x), 1)), np.clip((x - self.knots[:, 2]) / spread, -4, 4)]
        for q in range(self.knots.shape[1]):
            parts.append(np.clip((x - self.knots[:, q]) / spread, 0, 4))
        return np.hstack(parts)

    @property
    def width(self) -> int:
        return 1 + len(self.knots) * (1 + self.knots.shape[1])


@dataclass
class Model:
    """A fitted scorer: weights over the basis, then slope and shift of the calibration."""
    basis: Basis
    weights: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -30, 30)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


def _sums(rows: DataFrame, basis: Basis, w: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over all rows at weights w: counts, risk terms, gradients, curvature. Rows of the two
    samples are those with `positive` and all. One row of model width leaves each task; a tree of
    two levels adds them up."""
    d = basis.width

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 + 2 + 3 * d + d * d)
        for pdf in frames(batches, 20_000):
            b, p = basis(_matrix(pdf["x"])), pdf["positive"].to_numpy(bool)
            z = b @ w
            s, soft = 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.logaddexp(0, z)
            total += np.concatenate([[len(z), p.sum(), soft.sum(), soft[p].sum()], b.T @ s, b[p].sum(0), b[p].T @ s[p],
                                     ((b * (s * (1 - s))[:, None]).T @ b).ravel()])
        yield pd.DataFrame({"lane": [int(abs(total[2])) % 16], "v": [total]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lane": [0], "v": [np.vstack(pdf["v"].to_numpy()).sum(0)]})

    parts = rows.mapInPandas(part, "lane int, v array<double>")
    summed = parts.groupBy("lane").applyInPandas(add, "lane int, v array<double>").collect()  # 16 rows at most
    v = np.sum([r["v"] for r in summed], axis=0) if summed else np.zeros(4 + 3 * d + d * d)
    return {"n": v[0], "np": v[1], "soft_u": v[2], "soft_p": v[3], "gu": v[4:4 + d], "xp": v[4 + d:4 + 2 * d],
            "gp": v[4 + 2 * d:4 + 3 * d], "h": v[4 + 3 * d:].reshape(d, d)}


def _minimise(rows: DataFrame, basis: Basis, prior: float, passes: int, ridge: float) -> np.ndarray:
    """Newton steps on the unbiased risk; where its negative part falls below zero the step climbs
    that part instead, which is what keeps the estimate non-negative."""
    w = best = np.zeros(basis.width)
    least = np.inf
    for _ in range(passes):
        s = _sums(rows, basis, w)
        if not s["np"] or not s["n"]:
            return best
        negative = s["soft_u"] / s["n"] - prior * s["soft_p"] / s["np"]
        risk = prior * (s["soft_p"] - w @ s["xp"]) / s["np"] + max(0.0, negative) + ridge * w @ w / 2
        if risk >= least - 1e-5 and negative >= 0:
            break
        if risk < least:
            best, least = w, risk
        hessian = s["h"] / s["n"] + ridge * np.eye(len(w))
        if negative >= 0:
            slope = s["gu"] / s["n"] - prior * s["xp"] / s["np"] + ridge * w
        else:
            slope = prior * s["gp"] / s["np"] - s["gu"] / s["n"]
        step = np.linalg.solve(hessian, slope)
        w = w - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return best


def _histogram(rows: DataFrame, model: Model, flags: list[str]) -> np.ndarray:
    """Counts of the logits in fixed bins, for all rows and for those with each flag."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(flags) + 1, BINS))
        for pdf in frames(batches, 20_000):
            at = np.clip(((model.logits(_matrix(pdf["x"])) + 20) * (BINS / 40)).astype(int), 0, BINS - 1)
            for i, on in enumerate([np.ones(len(pdf), bool), *((pdf[f] == True).to_numpy(bool) for f in flags)]):
                total[i] += np.bincount(at[on], minlength=BINS)
        kind, at = np.nonzero(total)
        yield pd.DataFrame({"kind": kind, "at": at, "n": total[kind, at]})

    out = np.zeros((len(flags) + 1, BINS))
    for r in rows.mapInPandas(part, "kind int, at int, n double").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        out[r["kind"], r["at"]] = r["n"]  # BINS rows a kind at most
    return out


def estimate_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """Smallest ratio of unlabelled mass to positive mass above a bin with a fifth of the positives."""
    u, p = unlabelled[::-1].cumsum(), positive[::-1].cumsum()
    if not p[-1] or not u[-1]:
        return 0.5
    u, p = u / u[-1], p / p[-1]
    return float(np.clip((u[p > 0.2] / p[p > 0.2]).min(), 0.02, 0.98))


def _calibrate(good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the histograms of the two labels."""
    z = (np.arange(BINS) + 0.5) * (40 / BINS) - 20
    x, a = np.stack([z, np.ones(BINS)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        grad = x.T @ ((good + bad) * s - good) + np.array([1e-2, 1e-3]) * (a - [1.0, 0.0])
        curve = (x * ((good + bad) * s * (1 - s))[:, None]).T @ x + np.diag([1e-2, 1e-3])
        a = a - np.clip(np.linalg.solve(curve, grad), -1, 1)
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def fit(style_rows: DataFrame, labels: DataFrame, passes: int = 10, ridge: float = 3e-2) -> Model | None:
    """Fit on all style rows (the unlabelled sample) and `labels` (doc_id, good boolean). None
    without positives or rows."""
    joined = style_rows.join(labels.select("doc_id", "good"), "doc_id", "left").select(
        "x", F.coalesce("good", F.lit(False)).alias("positive"), (~F.col("good")).alias("bad"))
    rows = cut(joined)
    cols = [F.percentile_approx(F.element_at("x", i + 1), list(QUANTILES), 2000).alias(f"q{i}") for i in range(N_STYLE)]
    got = rows.agg(F.count_if("positive").alias("n"), *cols).first()
    if not got["n"]:
        return None
    basis = Basis(np.array([got[f"q{i}"] for i in range(N_STYLE)], float))
    first = Model(basis, _minimise(rows, basis, 0.5, max(3, passes // 2), ridge), 0.5)
    u, p = _histogram(rows, first, ["positive"])
    prior = estimate_prior(u, p)
    model = Model(basis, _minimise(rows, basis, prior, passes, ridge), prior)
    _, good, bad = _histogram(rows, model, ["positive", "bad"])
    model.slope, model.shift = _calibrate(good, bad)
    return model


def score(style_rows: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every style row."""
    if model is None:
        return style_rows.select("doc_id", F.lit(0.5).alias("score"))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches, 20_000):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": model.scores(_matrix(pdf["x"]))})
    return style_rows.mapInPandas(one, "doc_id long, score double")


def held_out(doc_id="doc_id"):
    """Whether an id belongs to the fold whose labels are not used."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """One row an id outside the held-out fold: whether its quality is 1."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
            .where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out())
            .groupBy("doc_id").agg((F.max("quality") == 1).alias("good")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    workers(docs.sparkSession)
    rows = cut(style_table(texts_of(docs)))
    model = fit(rows, training_labels(labels))
    return score(rows, model).select("doc_id", held_out().alias("held_out"), "score",
                                     (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier accepts, with their own columns: the decision is taken for
    each row, by a flag beside it."""
    workers(docs.sparkSession)
    rows = cut(style_table(texts_of(docs)))
    model = fit(rows, training_labels(labels))
    if model is None:
        return docs
    flag = _flagger(model, threshold)
    return docs.where(flag(F.coalesce(F.col("text"), F.lit(""))))


def _flagger(model: Model, threshold: float):
    @F.pandas_udf("boolean")
    def accepted(text: pd.Series) -> pd.Series:
        if not len(text):
            return pd.Series([], dtype=bool)
        return pd.Series(model.scores(np.array([style(t) for t in text], float)) >= threshold)
    return accepted
