"""Personal data: candidate spans scored by gradient-boosted trees.

Base spans are exact: e-mail addresses, IPv4 addresses, payment-card numbers and phone numbers by fixed patterns and checks,
leftmost and non-overlapping per kind. Generators of high recall then propose further spans that may overlap: every run of
neighbouring digit groups, loosely written addresses, dotted numbers, values behind a credential word and long
mixed tokens. Boosted trees score each candidate from its format and its context; a threshold per kind, calibrated for
precision on candidates kept out of the fit, selects. Selected spans that no better one and no base span overlaps are added
under kinds of their own (number, contact, host, secret), so base spans and their counts stay what they are.

The trees are fitted on a bounded sample of labelled candidates (`sample` rows, a stratum for each kind and label, smallest hash of
document and place first), the thresholds on histograms of the scores of every third candidate of the table; labels are
weak: base spans, formally valid values and national phone forms behind a word for calling are positive, all other candidates negative.

Defined results: null and empty texts have no spans, and the digest of an empty list; repeated rows give a row each; other columns are ignored;
without candidates of both labels nothing is added; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from dwellspark.llm.common import frames, stored, texts_of, workers

# The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match begins at the first digit of a run anyway
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "contact", "host", "secret")
ORDER = {kind: i for i, kind in enumerate(BASE + ADDED)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Generators, loose on purpose.
RUN = re.compile(r"[0-9 ().+/-]{7,}")
GROUP = re.compile(r"[0-9]+")
LOOSE_MAIL = re.compile(r"[^\s@]{1,64}(?:@| ?[\[(]at[\])] ?)[^\s@]{3,}", re.I)
DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3,}")
CREDENTIAL = re.compile(r"(?:key|token|secret|passw(?:or)?d|pwd|bearer)\b[\"']?\s*[:=]?\s*[\"']?([^\s\"',;]{8,})", re.I)
WORDS = ("key", "token", "secret", "passw", "pwd", "bearer")
MIXED = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
NATIONAL = re.compile(r"\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{3,4}){2}")
CONTEXT = {
    "credential": re.compile(r"key|token|secret|passw|pwd|bearer", re.I), "card": re.compile(r"card|visa|credit|iban|account", re.I),
    "call": re.compile(r"call|phone|tel|mobile|fax|whatsapp", re.I), "mail": re.compile(r"mail|contact|@", re.I), "net": re.compile(r"\bip\b|host|server|address", re.I),
}


def luhn(digits: str) -> bool:
    """The checksum of payment cards."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans in order of start, then kind. A local part can only end at an @, so
    e-mail addresses are looked for around each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end(), "email"))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    if not _has_digit(text):
        return out
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(map(_is_digit, m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _is_digit(c: str) -> bool:
    return "0" <= c <= "9"


def _has_digit(text: str) -> bool:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw.translate(None, b"0123456789")) < len(raw)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans proposed by the generators; they overlap. Sub-runs of digit groups hold 7 to 19 digits, as the numbers of
    the kinds do."""
    out = set()
    digits = _has_digit(text)
    if digits:
        for m in RUN.finditer(text):
            groups = [(g.start() + m.start(), g.end() + m.start()) for g in GROUP.finditer(m[0])]
            for i, (a, _) in enumerate(groups):
                n = 0
                for b, e in groups[i:i + 19]:
                    n += e - b
                    if n > 19:
                        break
                    if n >= 7:
                        lo = a - 1 if a and text[a - 1] in "+(" else a
                        out.add((lo - 1 if lo and text[lo] == "(" and text[lo - 1] == "+" else lo, e, "number"))
        out.update((m.start(), m.end(), "host") for m in DOTTED.finditer(text))
        out.update((m.start(), m.end(), "secret") for m in MIXED.finditer(text))
    low = text.lower()
    if "@" in text or "at]" in low or "at)" in low:
        out.update((m.start(), m.end(), "contact") for m in LOOSE_MAIL.finditer(text))
    if any(w in low for w in WORDS):
        out.update((m.start(1), m.end(1), "secret") for m in CREDENTIAL.finditer(text))
    return sorted(out)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span and what stands around it."""
    span, before, after = text[start:end], text[max(0, start - 30):start], text[end:end + 12]
    digits = "".join(c for c in span if _is_digit(c))
    letters, size = sum(c.isalpha() for c in span), len(span)
    counts = np.unique(list(span), return_counts=True)[1] / size
    dots = span.split(".")
    return [
        float(ORDER[kind]), size, len(digits), letters, len(digits) / size, float(-(counts * np.log2(counts)).sum()),
        float(len(digits) >= 12 and luhn(digits)), float(span[0] == "+"), span.count(" "), span.count("-"), span.count("."), span.count("@"),
        max((int(p[:9]) for p in dots if p.isascii() and p.isdigit()), default=-1), len(dots[-1]), float(any(c in "()" for c in span)),
        float(sum(c in "0123456789abcdef" for c in span.lower()) / size), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ("=", ":", '"', "'")),
        *[float(bool(p.search(before))) for p in CONTEXT.values()],
    ]


def weak_label(text: str, start: int, end: int, kind: str) -> bool:
    """Whether the span by itself is a formally valid value of its kind."""
    span = text[start:end]
    digits = "".join(c for c in span if _is_digit(c))
    clear = not text[max(0, start - 1):start].isalnum() and not text[end:end + 1].isalnum()
    if kind == "number":
        formal = (12 <= len(digits) <= 19 and luhn(digits) and span[0] != "+") or (span[0] == "+" and 9 <= len(digits) <= 15)
        national = span[0] in "(0123456789" and NATIONAL.fullmatch(span) and CONTEXT["call"].search(text[max(0, start - 30):start])
        return clear and bool(formal or national)
    if kind == "host":
        return span.count(".") == 3 and all(_octet(p) for p in span.split("."))
    if kind == "contact":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\W?", span, re.I))
    mixed = any(c.isalpha() for c in span) and len(digits) >= 3
    return mixed and len(span) >= 12 and bool(re.search(r"(?:key|token|secret|passw(?:or)?d|pwd|bearer)\b\W{0,4}$", text[max(0, start - 16):start], re.I))


@dataclass
class Trees:
    """Boosted regression trees on binned features. A tree is arrays: feature, bin, left child (right is next), value."""
    edges: list[np.ndarray]
    rate: float = 0.2
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], 1) if len(x) else np.empty((0, len(self.edges)), int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(b), self.start)
        for feature, cut, left, value in self.trees:
            at = np.zeros(len(b), int)
            while (inner := np.flatnonzero(left[at] > 0)).size:
                node = at[inner]
                at[inner] = left[node] + (b[inner, feature[node]] > cut[node])
            z += self.rate * value[at]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, least: int = 5, ridge: float = 1.0) -> Trees:
    """Logistic boosting with histogram splits and Newton leaves."""
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, 33)[1:-1])) for i in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, start=math.log(share / (1 - share)))
    b, z = model.bins(x), np.full(len(x), model.start)
    width = max(map(len, edges)) + 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut, left, value, rows = [0], [0], [0], [0.0], {0: np.arange(len(x))}
        for level in range(depth + 1):
            for node, own in list(rows.items()):
                value[node] = float(-g[own].sum() / (h[own].sum() + ridge))
                del rows[node]
                if level == depth or len(own) < 2 * least:
                    continue
                best, gain = None, 1e-6
                total_g, total_h = g[own].sum(), h[own].sum()
                for f in range(x.shape[1]):
                    gl = np.bincount(b[own, f], g[own], width).cumsum()[:-1]
                    hl = np.bincount(b[own, f], h[own], width).cumsum()[:-1]
                    nl = np.bincount(b[own, f], minlength=width).cumsum()[:-1]
                    got = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                    got[(nl < least) | (len(own) - nl < least)] = 0
                    if got.max() > gain:
                        gain, best = got.max(), (f, int(got.argmax()))
                if best:
                    feature[node], cut[node], left[node] = *best, len(value)
                    right = b[own, best[0]] > best[1]
                    rows[len(value)], rows[len(value) + 1] = own[~right], own[right]
                    feature += [0, 0]
                    cut += [0, 0]
                    left += [0, 0]
                    value += [0.0, 0.0]
        tree = tuple(map(np.array, (feature, cut, left, value)))
        model.trees.append(tree)
        at = np.zeros(len(b), int)
        while (inner := np.flatnonzero(tree[2][at] > 0)).size:
            node = at[inner]
            at[inner] = tree[2][node] + (b[inner, tree[0][node]] > tree[1][node])
        z = z + model.rate * tree[3][at]
    return model


#: Scores are counted in so many bins for the thresholds.
BINS = 2000


def calibrate(negatives: np.ndarray, positives: np.ndarray, precision: float) -> float:
    """Smallest edge of a bin of scores from which on the share of positives is at least `precision`; above 1 if there is none."""
    p, n = (np.cumsum(x[::-1])[::-1].astype(float) for x in (positives, negatives))
    ok = np.flatnonzero((p > 0) & (p >= precision * (p + n)))
    return max(0.5, float(ok[0]) / len(p)) if len(ok) else 2.0


def fit(docs: DataFrame, sample: int = 30_000, precision: float = 0.98, seed: int = 7) -> Trees | None:
    """Fit on a bounded sample of the candidates of all documents, an equal stratum for each kind and label;
    the thresholds, which make up for the shares of the strata, are calibrated on the scores of all candidates that are kept out of the fit by their hash, a third."""
    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches):
            rows = [(doc, a, e, kind, features(t, a, e, kind), weak_label(t, a, e, kind))
                    for doc, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"]) for a, e, kind in candidates(t)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "end", "kind", "x", "y"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))
    proposed = stored(docs.mapInPandas(propose, "doc_id long, start int, end int, kind string, x array<double>, y boolean"), "proposed")
    got = proposed.withColumn("h", F.xxhash64("doc_id", "start", "end", "kind", F.lit(seed))).withColumn("aside", F.pmod("h", F.lit(3)) == 0)
    rank = F.row_number().over(W.partitionBy("kind", "y").orderBy("h", "doc_id", "start", "end"))  # bounded, so applied before the shuffle
    picked = got.where("NOT aside").withColumn("place", rank).where(F.col("place") <= max(1, sample // (2 * len(ADDED))))
    rows = picked.select("kind", "y", "place", "x").toPandas().sort_values(["kind", "y", "place"], ignore_index=True)  # `sample` rows at most
    y = rows["y"].to_numpy(bool)
    if not (y.any() and (~y).any()):
        return None
    model = boost(np.array(rows["x"].tolist(), float), y.astype(float))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches):
            score = model.scores(np.array(pdf["x"].tolist(), float))
            yield pdf[["kind", "y"]].assign(bin=np.minimum((score * BINS).astype(int), BINS - 1))
    bins = got.where("aside").select("kind", "x", "y").mapInPandas(counted, "kind string, y boolean, bin int").groupBy("kind", "y", "bin").count()
    found = np.zeros((len(ADDED), 2, BINS))
    for r in bins.collect():  # BINS rows a kind and label at most
        found[ADDED.index(r["kind"]), int(r["y"]), r["bin"]] = r["count"]
    for kind, (negatives, positives) in zip(ADDED, found):
        model.thresholds[kind] = calibrate(negatives, positives, precision)
    return model


def spans_of(text: str, model: Trees | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and base and added spans, in order of start, then kind."""
    base = base_spans(text)
    if model is None:
        return base, base
    taken = bytearray(len(text))
    for a, e, _ in base:
        taken[a:e] = b"\1" * (e - a)
    found = [c for c in candidates(text) if not any(taken[c[0]:c[1]])]
    if not found:
        return base, base
    score = model.scores(np.array([features(text, *c) for c in found], float))
    chosen: list[tuple[int, int, str]] = []
    for i in sorted(range(len(found)), key=lambda i: (-score[i], found[i][0] - found[i][1], found[i])):
        a, e, kind = found[i]
        if score[i] >= model.thresholds[kind] and not any(taken[a:e]):
            taken[a:e] = b"\1" * (e - a)
            chosen.append(found[i])
    return base, sorted(base + chosen, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{e}" for a, e, kind in spans)


def personal_spans(docs: DataFrame, sample: int = 30_000) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and n_spans (base and added) of every document."""
    workers(docs.sparkSession)
    rows = texts_of(docs)
    model = fit(rows, sample)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(batches):
            got = [spans_of(t, model) for t in pdf["text"]]
            out = {"doc_id": pdf["doc_id"].astype("Int64")}
            out |= {f"n_{kind}": [sum(s[2] == kind for s in base) for base, _ in got] for kind in BASE}
            out |= {"base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], "spans": [joined(every) for _, every in got],
                    "n_spans": [len(every) for _, every in got]}
            yield pd.DataFrame(out)
    return rows.mapInPandas(one, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap the earlier, then longer, names them."""
    out, at = [], 0
    for a, e, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, sample: int = 30_000) -> DataFrame:
    """The documents with spans masked in `text` and `n_chars` counted again; null texts and all other columns stay."""
    workers(docs.sparkSession)
    model = fit(texts_of(docs), sample)

    @F.pandas_udf("string")
    def mask(text: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else masked(t, spans_of(t, model)[1]) for t in text], dtype=object)
    given = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        given = given.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return given
