"""The projection forest's recall, the subpackage's SQL twins and the pipeline's stages."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from dwellspark.llm import bpe, ngram_join, pii, queries, rpforest

SF = "/root/testdata/sf0.001"


def brute(ids, x, every=50, k=5):
    size = np.linalg.norm(x, axis=1)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i] / (size * size[i])
        order = np.lexsort((ids, -np.round(s, 12)))
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order if ids[j] != ids[i]][:k]
    return out


def test_forest_recall(spark):
    df = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    rows = df.toPandas()
    want = brute(rows["vec_id"].to_numpy(), np.vstack(rows["embedding"]).astype(float))
    got = {}
    for r in rpforest.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_forest_edges(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(100)]
    vecs[0] = (0, [1.0, 0.0, 0.0, 0.0])
    vecs += [(200 + i, [2.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(200, [2.0, 0.0, 0.0, 0.0])]
    vecs += [(300, None), (350, [0.0] * 4), (400, [1.0, None, 0.0, 0.0]), (450, [float("nan"), 1.0, 0.0, 0.0]), (500, [1.0, 2.0]), (None, [1.0] * 4), (550, [])]
    df = spark.createDataFrame([(a, b, 1, "q") for a, b in vecs], "vec_id long, embedding array<float>, rank int, query_id string")
    got = [tuple(r) for r in rpforest.nearest(df, sample=50, leaf_size=10).orderBy("query_id", "rank").collect()]
    assert [r[2] for r in got if r[0] == 0] == [200, 201, 202, 203, 204]
    assert [r[2] for r in got if r[0] == 200] == [0, 201, 202, 203, 204]
    assert {r[0] for r in got} == {0, 50, 200}
    assert rpforest.nearest(df.where("false")).count() == 0
    two = rpforest.nearest(df.where("vec_id IN (50, 51)")).collect()
    assert [(r.query_id, r.vec_id) for r in two] == [(50, 51)]
    assert rpforest.nearest(df.where("vec_id = 51")).count() == 0


def test_forest_ties_of_unlike_vectors(spark):
    """Multiples of the query's vector by powers of two have one cosine: the smaller ids come first."""
    rng = np.random.default_rng(5)
    vecs = [(0, [1.0, 2.0, -1.0, 0.5])] + [(i, [2.0 ** (i % 7 - 3) * a for a in (1.0, 2.0, -1.0, 0.5)]) for i in range(1, 41)]
    vecs += [(100 + i, [float(v) for v in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").repartition(3)
    got = rpforest.nearest(df, sample=60, leaf_size=6).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] and len({r.score for r in got}) == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    import duckdb
    from compare import TABLES, compare
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    message, _, ok = compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, message


def test_pipeline_stages(spark):
    """Every stage against what brute force says of its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        assert name == "token_ids" or docs.columns == columns, name
        seen.append(docs)
    given, good, single, clean, mixed, ids = ([tuple(r) for r in d.collect()] for d in seen)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(good) <= set(given)
    kept = [labels[r[0]] for r in good if r[0] in labels]
    assert sum(kept) >= 0.9 * sum(labels.values())
    from test_text_operators import brute_components
    groups = brute_components([(r[0], r[1]) for r in good])
    assert sorted(single) == sorted(r for r in good if groups[r[0]] == r[0])
    model = pii.fit(seen[2].select("doc_id", "text"))
    assert {r[0]: r[1] for r in clean} == {r[0]: pii.masked(r[1], pii.spans_of(r[1], model)[1]) for r in single}
    assert set(mixed) == set(clean) and all(n in (1, 2) for n in Counter(mixed).values())
    assert Counter(r[0] for r in ids) == Counter(r[0] for r in mixed)
    enc = bpe.encoder(queries.vocabulary("byte_bpe_50k.tiktoken"))
    texts = {r[0]: r[1] for r in mixed}
    assert all(r[1] == len(enc.encode([texts[r[0]]])[0]) // 4 for r in ids)


def test_pipeline_run_and_empty(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_keep_rows_without_words_and_unlike_texts_of_one_id(spark):
    rows = [(1, "a b c d e f g h i j", "en", "s", 1), (2, "a b c d e f g h i j", "en", "s", 1), (2, "other words here now and then", "en", "s", 1), (3, "", "en", "s", 0), (4, None, "en", None, None), (None, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.keep_first_of_near_copies(spark, docs, "").collect()]
    assert sorted(kept, key=str) == [1, 2, 3, 4, None] and ngram_join.ngram_components(docs).count() == 6
