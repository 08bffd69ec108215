"""Graphs: what they hold does not depend on files or tasks, and cores share the building."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.contract import Metric
from halyard.operators import graph, search


def line(spark, n, parts=1):
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id"), F.cos(F.col("id") * 3)).alias("embedding")).repartition(parts)


def test_edges_do_not_depend_on_partitions(spark):
    """Rows of one partition, as of a file with one row group, make several graphs in as many tasks."""
    one, many = (graph.graph_edges(line(spark, 300, n), graph_rows=100) for n in (1, 6))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert one.select(F.spark_partition_id()).distinct().count() > 2
    assert graph.graph_stats(one).first()["nodes"] == 300


def test_graph_counts():
    assert [graph.graph_count(n, 20_000) for n in (0, 1, 2000, 2001, 10_000, 100_000, 320_000, 600_000)] == [1, 1, 1, 2, 5, 16, 17, 32]
    assert graph.graph_count(200, 50) == 5


def test_many_queries_find_graphs_built_once(spark):
    rows = line(spark, 60)
    queries = spark.range(5000).select(F.col("id").alias("query_id"), F.array(F.cos(F.col("id") % 60), F.sin(F.col("id") % 60), F.cos((F.col("id") % 60) * 3)).alias("query"))
    found = graph.graph_search(rows, queries, 1, "euclidean")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # builds, searches
    assert {(r["query_id"], r["vec_id"]) for r in found.collect()} == {(i, i % 60) for i in range(5000)}


def test_blocks_of_queries_give_what_one_gives(spark, monkeypatch):
    rows = line(spark, 80)
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = sorted(map(tuple, graph.graph_search(rows, queries, 3, "euclidean").collect()))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 500)
    assert sorted(map(tuple, graph.graph_search(rows, queries, 3, "euclidean").collect())) == want and len(want) == 240


def test_stored_graphs_lie_in_files_of_their_own(spark, tmp_path):
    index = graph.write_graphs(line(spark, 300), str(tmp_path / "g"), graph_rows=100)
    assert index.count() == len(index.inputFiles()) > 2
    assert index.agg(F.max(F.size("ids"))).first()[0] <= 100


@pytest.mark.parametrize("metric", list(Metric))
def test_links_are_chosen_as_by_plain_loops(metric):
    rows = np.random.default_rng(1).normal(size=(90, 5))
    rows[40] = rows[41] = 0
    g = graph.Graph(rows, metric, 4, 20, 4, 7)
    assert np.allclose(g._among(list(range(90))), search.distances(rows, rows, metric), atol=1e-9)
    for i in (0, 40, 77):
        q = g.x[i]
        assert np.allclose(g._to(q, list(range(90))), search.distances(rows[i : i + 1], rows, metric)[0], atol=1e-7)
        found = sorted((d, j) for j, d in enumerate(g._to(q, list(range(90))).tolist()) if j != i)[:30]
        out, rest = [], []
        for d, j in found:
            if len(out) < 6:
                (rest if any(g._among([j, o])[0, 1] < d for _, o in out) else out).append((d, j))
        if i != 40:  # ties of an empty vector are decided by the last digit
            assert g._chosen(found, 6) == (out + rest[: 6 - len(out)])
