"""Approximate searches against the ranking of their own candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import ann, search


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[7], x[300:310] = 0, x[5]  # an empty vector and copies, whose order is that of their ids
    return x


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)


def queries(vectors):
    return vectors.where("vec_id % 9 = 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def agrees(found, candidates, rows, metric, k):
    """found is the k nearest of each query's candidates, by distance and id, and met is their number."""
    pairs: dict[int, list[int]] = {}
    for r in candidates.select("query_id", "vec_id").collect():
        pairs.setdefault(r["query_id"], []).append(r["vec_id"])
    got: dict[int, list[tuple]] = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["distance"], r["met"], r["rank"]))
    assert set(got) == set(pairs) and len(got) > 30
    for q, ids in pairs.items():
        d = search.distances(rows[q : q + 1], rows[ids], metric)[0] if metric is not search.Metric.EUCLIDEAN else np.sqrt(((rows[ids] - rows[q]) ** 2).sum(axis=1))
        want = sorted(zip(np.round(d, 9).tolist(), ids, strict=True))[:k]
        assert [(round(x, 9) + 0.0, i) for i, x, _, _ in got[q]] == [(x + 0.0, i) for x, i in want]
        assert {m for _, _, m, _ in got[q]} == {len(ids)} and [n for *_, n in got[q]] == list(range(1, len(want) + 1))


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product", "manhattan"])
def test_cells_meet_rows_without_a_table_of_pairs(vectors, rows, metric):
    cells = ann.InvertedLists.train(vectors, 9, metric, 4)
    lists = cells.index(vectors)
    found = cells.search_batch(lists, queries(vectors), 6, 4)
    assert joins(found) == 0
    agrees(found, cells.candidates(lists, queries(vectors), 4), rows, search.Metric.of(metric), 6)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("probes", [1, 30])
def test_hash_tables_meet_rows_without_a_table_of_pairs(vectors, rows, metric, probes):
    lsh = ann.HyperplaneHashing(8, 12, 7, probes, 2, metric=search.Metric.of(metric))
    tables = lsh.index(vectors)
    found = lsh.search_batch(tables, queries(vectors), 6)
    assert joins(found) == 0
    agrees(found, lsh.candidates(tables, queries(vectors)), rows, lsh.metric, 6)


def test_probed_buckets_of_many_vectors_are_found_in_parts(rows):
    lsh = ann.HyperplaneHashing(8, 5, 9, 20)
    assert np.array_equal(lsh.probed(rows), np.concatenate([lsh.probed(rows[i : i + 1]) for i in range(len(rows))]))
