"""Nearest vectors: blocks and grid against a plain sort; recall of the index."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import vectors as vs
from quarry.sources.fixtures import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(asked, rows, k):
    out = {}
    for i, q in asked:
        best = sorted((-float(np.dot(q, v)), c) for c, v in rows if v is not None)[:k]
        out[i] = [c for _, c in best]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["chunk_pk"])
    return out


@pytest.mark.parametrize("block,few", [(2048, 4), (3, 100), (3, 0), (1, 2)])
def test_blocks_and_grid_equal_a_plain_sort(spark, monkeypatch, block, few):
    monkeypatch.setattr(vs, "CHUNK_BLOCK", 16)
    monkeypatch.setattr(vs, "COLUMNS", 3)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(150)] + [(150, None)]  # whole numbers: many ties
    asked = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(7)]
    chunks = spark.createDataFrame(rows, "chunk_pk bigint, embedding array<float>").selectExpr("*", "chunk_pk as other", "'x' as part").repartition(5)
    queries = spark.createDataFrame([*asked, (9, None)], "query_id bigint, embedding array<double>")
    found = vs.knn(queries, chunks.drop("part"), 6, query_block=block, few=few)
    assert got(found) == plain(asked, rows, 6)
    assert all(x["other"] == x["chunk_pk"] for x in found.collect())
    assert got(vs.knn(queries, chunks.drop("part"), 500, query_block=block, few=few)) == plain(asked, rows, 500)


def test_no_rows(spark):
    chunks, queries = (table(spark, SF, t) for t in ("chunks", "query_vectors"))
    for f in (vs.knn, vs.ann):
        assert f(queries, chunks.limit(0), 3).collect() == []
        assert f(queries.limit(0), chunks, 3).collect() == []


def test_knn_collects_nothing(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("collected"))
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("collected"))
    vs.knn(table(spark, SF, "query_vectors"), table(spark, SF, "chunks"), 5)


def recalls(spark, sf, **training):
    chunks, queries = (table(spark, sf, t) for t in ("chunks", "query_vectors"))
    index = vs.train_index(chunks, 10, **training)
    exact, near = got(vs.knn(queries, chunks, 10)), got(vs.ann(queries, chunks, 10, index=index))
    assert all(len(v) == 10 for v in near.values()) and near.keys() == exact.keys()
    return index, np.array([len(set(near[q]) & set(exact[q])) / 10 for q in exact])


def test_recall_of_unclustered_vectors(spark):
    index, recall = recalls(spark, SF.replace("0.001", "0.1"))
    assert len(index.centres) == 128 and index.probes == 10
    assert recall.mean() >= 0.9 and recall.min() >= 0.5


def test_clustered_vectors_need_little_spill(spark):
    r = np.random.default_rng(3)
    middle = r.normal(size=(40, 16))
    x = middle[r.integers(0, 40, 3000)] + 0.1 * r.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_pk bigint, embedding array<double>")
    queries = chunks.filter("chunk_pk % 50 = 0").withColumnRenamed("chunk_pk", "query_id")
    index = vs.train_index(chunks, 10, cells=64)
    exact, near = got(vs.knn(queries, chunks, 10)), got(vs.ann(queries, chunks, 10, index=index))
    assert index.spill <= 2
    assert np.mean([len(set(near[q]) & set(exact[q])) / 10 for q in exact]) >= 0.9


def test_a_product_of_two_blocks_is_held_in_strips():
    r = np.random.default_rng(6)
    block = lambda name, rows: vs._row(pa.table({name: np.arange(rows), "vector_": list(r.normal(size=(rows, 8)))}), 0)
    asked, chunks = block("query_id", vs.QUERY_BLOCK), block("chunk_pk", vs.CHUNK_BLOCK)
    best = vs._Best(asked["payload"][0], asked["vectors"][0], "query_id", "chunk_pk", 3)
    tracemalloc.start()
    best.add(chunks["payload"][0], chunks["vectors"][0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * vs.QUERY_BLOCK * vs.CHUNK_BLOCK / 2
    found = best.merged()
    x, y = (np.frombuffer(b["vectors"][0]).reshape(-1, 8) for b in (asked, chunks))
    want = np.argsort(-(x @ y.T), axis=1)[:, :3]
    order = np.lexsort((-found["score"].to_numpy(), found["q_"].to_numpy()))
    assert (found["chunk_pk"].to_numpy()[order].reshape(-1, 3) == want).all()


def test_strips_bound_the_scores_of_uneven_blocks():
    queries = np.arange(700.0).reshape(350, 2)
    for rows in (1, 4096, 100_000, 2 * vs.STRIP):
        strips = list(vs._strips(queries, rows))
        assert all(len(s) == 1 or len(s) * rows <= vs.STRIP for _, s in strips) and [at for at, _ in strips] == list(np.cumsum([0, *(len(s) for _, s in strips[:-1])]))
        assert (np.concatenate([s for _, s in strips]) == queries).all()
