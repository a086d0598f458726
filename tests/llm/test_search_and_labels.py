"""Hard negatives, toxicity and ranked search against brute force, held-out labels, and edge cases of each."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from dwellspark.llm import lemp, lexical, toxicity

from texts import prose

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- ranked search

def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranking(rows, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    total, all_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, wanted in asked.items():
        if i is None:
            continue
        scores = []
        for d, c in docs:
            m = 10 + (90 * sum(c.values()) * total) // all_terms
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def ranking(spark, rows, items, **options):
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, rank int, item_id string").repartition(3)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical.ranked(docs, asked, **options)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()), key=str)


def test_ranking_equals_brute_force(spark, rows, monkeypatch):
    given = [(r[0], r[1]) for r in rows] + [(None, rows[0][1]), (900, "Tie TIE tie"), (901, "tie tie tie"), (902, "tie_tie-tie"), (903, "caf\xe9\xa0x caf\xe9\xa0x")]
    items = [(1, rows[0][1][:300]), (2, rows[3][1]), (3, "tie"), (3, "word"), (4, None), (5, "..."), (6, "caf\xe9\xa0X"), (None, "tie"), (7, "nowhere0"), (8, rows[-5][1])]
    want = brute_ranking(given, items)
    assert ranking(spark, given, items) == want
    monkeypatch.setattr(lexical, "PIECE", 64)
    assert ranking(spark, given, items, postings=50, block=40) == want


def test_ranking_of_hot_terms_and_copies(spark):
    """A third of the documents are copies, one term stands in most."""
    rng = random.Random(4)
    copy = prose(rng, 40, "abc")
    given = [(i, copy if i % 3 == 0 else prose(rng, rng.randint(1, 60), "abc") + " common") for i in range(300)]
    items = [(i, prose(rng, 12, "abc") + " common") for i in range(12)]
    assert ranking(spark, given, items, postings=900) == brute_ranking(given, items)


def test_ranking_stops_early():
    """Reading ends when no document unseen can reach the last score: few places are seen of long lists."""
    n = 5000
    tf = np.where(np.arange(n) < 20, 50, 1)
    lens = np.full(n, 2)
    shard = lexical.Shard(np.arange(n).tobytes(), np.full(n, 100).tobytes(), lens.tobytes(), np.tile(np.array([0, 1], np.int32), n).tobytes(),
                          np.repeat(tf, 2).tobytes(), 2, n, 100 * n)
    looked = []
    shard.lens = type("Lens", (), {"__getitem__": lambda _, new: (looked.append(len(new)), lens[new])[1]})()
    at, score = shard.best(np.array([0, 1]), np.array([10, 20]), 10)
    assert at.tolist() == list(range(10)) and sum(looked) < 100 and len(set(score.tolist())) == 1


def test_ranking_of_empty_tables(spark):
    assert ranking(spark, [], [(1, "a")]) == [] == ranking(spark, [(1, "a")], []) == ranking(spark, [(1, None), (2, "")], [(1, "a")])


# --- hard negatives

def brute_negatives(rows, k=5, every=100):
    seen, items = set(), []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(a is None or not math.isfinite(a) for a in v) or not v:
            continue
        r = (i, (y + 1) % 10 if i % 7 == 0 else y, tuple(math.floor(256 * a) for a in v))
        if r not in seen:
            seen.add(r)
            items.append(r)
    out = []
    for a in items:
        if a[0] % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in items if b[0] != a[0]))
        for s, p, _ in [r for r in scored if r[2] == a[1]][:k]:
            got = [(n, i) for n, i, y in scored if y != a[1] and 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a[0], p, r, i, -s, -n) for r, (n, i) in enumerate(got, 1)]
    return sorted(out)


def negatives(spark, rows, **options):
    df = spark.createDataFrame([(i, v, y, 1, "s") for i, v, y in rows], "vec_id long, embedding array<float>, label int, rank int, score string").repartition(3)
    return sorted(map(tuple, lemp.hard_negatives(df, **options).collect()))


def vectors(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(a)) for a in rng.normal(0, rng.uniform(0.1, 1) * spread, d)], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("dim", [2, 6])
def test_negatives_equal_brute_force(spark, dim):
    rows = vectors(700, dim, dim)
    want = brute_negatives(rows)
    assert want and negatives(spark, rows) == want == negatives(spark, rows, bucket=90, anchors=3)


def test_negatives_of_copies_ties_and_odd_rows(spark):
    """A third of all rows are one vector; nulls, repeats, zero vectors and ids with two rows."""
    rows = [(i, [0.5, 0.25, -0.1], i % 3) for i in range(240)] + [(1000 + i, v, y) for i, v, y in vectors(300, 3, 9)]
    rows += [(2000, [0.0, 0.0, 0.0], 1), (2001, [0.001, 0.002, 0.0], 2), (2100, [0.3, 0.1, 0.2], 1), (2100, [0.1, 0.3, 0.2], 2), (2100, [0.3, 0.1, 0.2], 1),
             (3000, None, 1), (3100, [1.0, None, 2.0], 1), (3200, [float("nan"), 0.0, 0.0], 2), (3300, [float("inf"), 0.0, 0.0], 2),
             (3400, [0.5, 0.2, 0.1], None), (None, [0.5, 0.2, 0.1], 1)]
    want = brute_negatives(rows)
    assert want and negatives(spark, rows) == want == negatives(spark, rows, bucket=50, anchors=2)
    assert negatives(spark, rows + [(3500, [1.0], 1), (3600, [], 1)]) == want


def test_negatives_of_empty_tables(spark):
    assert negatives(spark, []) == [] == negatives(spark, [(1, [1.0], 0)]) == negatives(spark, [(100, [1.0], 0)])


def test_candidates_hold_every_row_of_the_bound():
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(0, 100, (2000, 4)))
    bucket = lemp.Bucket(v)
    pruned = 0
    for q in np.vstack([v[:60], np.eye(4) * 100]):
        for least in np.quantile(v @ q, [0.3, 0.9, 0.99, 0.999]):
            rows, score = bucket.products(q, float(least))
            assert set(np.flatnonzero(v @ q >= least)) <= set(rows) and (score == v[rows] @ q).all()
            pruned += len(rows) < len(v) / 4
    assert pruned > 20


# --- toxicity

def labelled(seed=8, n=600):
    rng = random.Random(seed)
    bad = ["vilekuz", "grobnash", "wurmig"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = prose(rng, rng.randint(5, 120)).split()
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def scored(spark, docs, labels):
    d = spark.createDataFrame([(i, t, "x", 2.0, 7) for i, t in docs], "doc_id long, text string, toxic string, score double, feature int").repartition(3)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return toxicity.toxicity_scores(d, y)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = labelled()
    got = {r.doc_id: r for r in scored(spark, docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held) and not any(p for p, y in held if not y)


def test_held_out_labels_are_not_used(spark):
    docs, labels = labelled(n=200)
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels]
    key = lambda df: sorted((r.doc_id, round(r.score, 6)) for r in df.collect())
    assert key(scored(spark, docs, labels)) == key(scored(spark, docs, turned))


def test_toxicity_edges(spark, monkeypatch):
    docs, labels = labelled(n=200)
    long = prose(random.Random(2), 3000)
    more = docs + [(900, None), (901, ""), (902, long), (903, long + " grobnash grobnash wurmig " + long), (None, "grobnash wurmig vilekuz"), docs[0], docs[0]]
    messy = labels + [(900, None, None), (None, 1, 1), (0, 1, 0), (5, 1, 0), (5, None, None)]
    got = scored(spark, more, messy).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in more)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score < 0.7 and by[902].predicted == 0 and by[903].predicted == 1 and by[None].predicted == 1 and not by[None].held_out
    monkeypatch.setattr(toxicity, "PIECE", 100)
    text = long[:950]
    pieces = np.unique(np.concatenate(list(toxicity.grams(text))))
    monkeypatch.setattr(toxicity, "PIECE", 1 << 20)
    whole = np.unique(np.concatenate(list(toxicity.grams(text))))
    assert set(whole) <= set(pieces)
    assert {r.score for r in scored(spark, docs, [(i, q, 0) for i, q, _ in labels]).collect()} == {0.5}
    assert scored(spark, docs[:3], []).count() == 3 and scored(spark, [], labels).count() == 0
