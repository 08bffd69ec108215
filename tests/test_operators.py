import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.contract import AlreadyExists, CapacityExceeded, Closed, CollectionConfig, EngineError, InvalidConfig, InvalidRequest, NotFound, SearchRequest
from halyard.functions import predicates as P
from halyard.operators import ann, graph, oplog, placement, quantize, search, stats
from halyard.operators.catalog import Catalog
from halyard.operators.collection import Collection
from halyard.operators.kmeans import kmeans
from halyard.plans import planner
from halyard.sources import files
from halyard.streaming import stream

ARTICLES = [
    ("doc1", [1.0, 0.0, 0.0], "technology", 4.5, 2023), ("doc2", [0.0, 1.0, 0.0], "science", 4.2, 2022), ("doc3", [0.0, 0.0, 1.0], "sports", 3.8, 2023), ("doc4", [0.7, 0.3, 0.0], "technology", 4.8, 2023),
]


@pytest.fixture
def articles(spark):
    df = spark.createDataFrame(ARTICLES, "id string, vector array<float>, category string, rating double, year int")
    return Collection(CollectionConfig("articles", 3, "euclidean"), df)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_search_order_and_distances(articles):
    found = articles.search(SearchRequest([0.6, 0.4, 0.0], 10)).collect()
    assert [r["id"] for r in found] == ["doc4", "doc1", "doc2", "doc3"]
    assert [r["distance"] for r in found] == pytest.approx([0.1414, 0.5657, 0.8485, 1.2329], abs=1e-4)
    assert [r["rank"] for r in found] == [1, 2, 3, 4]
    assert "vector" not in found[0].asDict()


def test_search_filters_before_it_cuts(articles):
    f = P.eq("category", "technology") & P.gt("rating", 4.0) & P.eq("year", 2023)
    assert ids(articles.search(SearchRequest([0.0, 1.0, 0.0], 2, f))) == ["doc4", "doc1"]
    assert ids(articles.search(SearchRequest([0.6, 0.4, 0.0], 10, max_distance=0.6))) == ["doc4", "doc1"]
    assert ids(articles.search(SearchRequest([0.6, 0.4, 0.0], 10, min_score=0.8))) == ["doc4"]
    out = articles.search(SearchRequest([0.6, 0.4, 0.0], 1, include_vector=True, include_metadata=False))
    assert out.columns == ["id", "distance", "score", "rank", "vector"]


def test_search_errors(articles):
    with pytest.raises(EngineError):
        articles.search(SearchRequest([1.0], 3))
    assert articles.clear().search(SearchRequest([1.0, 0, 0], 3)).count() == 0
    articles.close()
    with pytest.raises(Closed):
        articles.count()


def test_verbs(articles, spark):
    new = spark.createDataFrame([("doc5", [1.0, 1.0, 1.0], "arts", 1.0, 2020)], articles.df.schema)
    more = articles.put(new)
    assert more.count() == 5 and articles.count() == 4
    for bad in (new.union(new), articles.df.limit(1)):
        with pytest.raises(AlreadyExists):
            articles.put(bad)
    changed = articles.df.where("id = 'doc1'").withColumn("rating", F.lit(0.5))
    assert articles.put_batch(changed).get("doc1").first()["rating"] == 0.5
    assert ids(articles.delete("doc1", "doc2").list()) == ["doc3", "doc4"]
    with pytest.raises(NotFound):
        articles.delete("nobody")
    with pytest.raises(NotFound):
        articles.get("nobody")
    assert ids(articles.delete_batch(spark.createDataFrame([("doc1",), ("nobody",)], "id string")).list()) == ["doc2", "doc3", "doc4"]
    assert articles.contains("doc1") and not articles.contains("x")
    assert ids(articles.get_batch(["doc3", "x", "doc1"])) == ["doc3", "doc1"]
    assert ids(articles.list(2, 1)) == ["doc2", "doc3"]
    assert ids(articles.scan_range("doc2", "")) == ["doc2", "doc3", "doc4"]
    assert ids(articles.filter(P.eq("category", "technology"), 1)) == ["doc1"]
    assert ids(articles.filter_keys(P.gt("rating", 4.4))) == ["doc1", "doc4"]
    seen = []
    articles.scan(lambda r: seen.append(r["id"]) or len(seen) < 2)
    assert seen == ["doc1", "doc2"]
    with pytest.raises(InvalidRequest):
        articles.list(-1)


def test_wrong_dimension_fails_and_capacity_holds(articles, spark):
    bad = spark.createDataFrame([("z", [1.0], "a", 1.0, 1)], articles.df.schema)
    with pytest.raises(Exception, match="expected 3"):
        articles.put(bad).df.collect()
    small = Collection(CollectionConfig("c", 3, max_vectors=4), articles.df)
    with pytest.raises(CapacityExceeded):
        small.put(spark.createDataFrame([("z", [1.0, 1.0, 1.0], "a", 1.0, 1)], articles.df.schema))


def test_deleted_and_overwritten_rows_are_not_found(articles):
    q = SearchRequest([1.0, 0.0, 0.0], 1)
    assert ids(articles.delete("doc1").search(q)) == ["doc4"]
    moved = articles.df.where("id = 'doc1'").withColumn("vector", F.lit([0.0, 0.0, 9.0]).cast("array<float>"))
    assert ids(articles.update(moved).search(q)) == ["doc4"]


def test_validate_and_repair(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", []), (None, [1.0, 2.0]), ("c", None), ("d", [1.0])], "id string, vector array<float>")
    c = Collection(CollectionConfig("c", 2), df)
    assert c.validate().count() == 4 and ids(c.repair().list()) == ["a"]
    assert tuple(oplog.valid_segment(df, "id", "vector", 2).first())[2:] == (4, False)


def test_catalog(articles):
    cat = Catalog()
    cat.create(articles, owner="x")
    with pytest.raises(AlreadyExists):
        cat.create(articles)
    cat.update(articles, state="ready")
    assert cat.properties("articles") == {"owner": "x", "state": "ready"} and cat.names() == ["articles"]
    cat.drop("articles")
    with pytest.raises(NotFound):
        cat.get("articles")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), int(i % 3)) for i in range(300)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan", "dot_product"])
@pytest.mark.parametrize("way", ["one block", "blocks", "chunks"])
def test_batches_equal_single_searches(spark, vectors, metric, way, monkeypatch):
    if way != "one block":
        monkeypatch.setattr(search, "QUERY_BLOCK", 4)
        monkeypatch.setattr(search, "SEGMENT_ROWS", 64)
    queries = vectors.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = search.batch_top_k(vectors, queries, 5, metric, P.ne("label", 1), max_broadcast=0 if way == "chunks" else 1 << 20).collect()
    for q in queries.where("query_id IN (0, 7)").collect():
        want = search.top_k(vectors, q["query"], 5, metric, P.ne("label", 1)).collect()
        own = sorted((r for r in got if r["query_id"] == q["query_id"]), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in own] == [r["vec_id"] for r in want]
        assert [r["distance"] for r in own] == pytest.approx([r["distance"] for r in want], abs=1e-9)
        assert [r["score"] for r in own] == pytest.approx([r["score"] for r in want], abs=1e-9)


def test_no_queries_no_rows(spark, vectors):
    assert search.batch_top_k(vectors, spark.createDataFrame([], "query_id long, query array<float>"), 3).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9, 1)], "vec_id long, embedding array<float>").repartition(4)
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<float>")
    assert [r["vec_id"] for r in search.batch_top_k(df, queries, 2).orderBy("rank").collect()] == [1, 3]


def test_merge_diversify_recall(spark):
    hits = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("a", 0.1), ("c", 0.15)], "id string, distance double")
    assert ids(search.merge_shards(hits, 2)) == ["a", "c"]
    ranked = search.merge_shards(hits, 3)
    assert ids(search.diversify(ranked, 0.08, "id").orderBy("rank")) == ["a", "b"]
    found = spark.createDataFrame([(1, 10), (1, 11)], "query_id long, vec_id long")
    truth = spark.createDataFrame([(1, 10, 1), (1, 12, 2)], "query_id long, vec_id long, rank int")
    assert search.recall(found, truth, 2).first()["recall"] == 0.5


def test_approximate_search_recall(vectors):
    queries = vectors.where("vec_id < 30").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    truth = search.batch_top_k(vectors, queries, 5)
    cells = ann.InvertedLists.train(vectors, 6, "cosine", 5)
    lsh = ann.HyperplaneHashing(16, 40, 8, 24)
    ways = [cells.search_batch(cells.index(vectors), queries, 5, 5), lsh.search_batch(lsh.index(vectors), queries, 5), graph.graph_search(vectors, queries, 5)]
    for found in ways:
        assert search.recall(found, truth, 5).agg(F.avg("recall")).first()[0] >= 0.9
    q = queries.where("query_id = 3").first()["query"]
    assert cells.search(cells.index(vectors), q, 1, 1).first()["vec_id"] == 3
    s = graph.graph_stats(graph.graph_edges(vectors)).first()
    assert s["nodes"] == 300 and 0 < s["avg_degree"] <= 24


def test_kmeans_finds_clusters_whatever_the_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(scale=0.05, size=4) + 10 * np.eye(4)[i % 3]).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = (kmeans(df.repartition(n), "embedding", "vec_id", 3, 10) for n in (1, 5))
    assert np.array_equal(a, b)


def test_scalar_and_product_codes(vectors):
    sq = quantize.ScalarQuantizer.train(vectors)
    out = vectors.select("embedding", sq.encode("embedding").alias("c"))
    assert out.select(F.min(F.array_min("c")), F.max(F.array_max("c"))).first() == (0, 255)
    assert quantize.quality(vectors, "embedding", sq.decode(sq.encode("embedding")), 128).first()["worst_mse"] < 1e-3
    pq = quantize.ProductQuantizer.train(vectors, subspaces=4, bits=4, iterations=5)
    row = vectors.where("vec_id = 5").select("embedding", pq.encode("embedding").alias("c"), pq.decode(pq.encode("embedding")).alias("d")).first()
    codes = [int(((np.array(b) - np.array(row["embedding"][4 * s : 4 * s + 4])) ** 2).sum(axis=1).argmin()) for s, b in enumerate(pq.codebooks)]
    assert row["c"] == codes
    got = vectors.where("vec_id = 5").select(pq.asymmetric_distance(pq.encode("embedding"), [0.5] * 16)).first()[0]
    assert got == pytest.approx(((np.array(row["d"]) - 0.5) ** 2).sum())
    assert pq.compression_ratio() == 32 * 16 / 16
    with pytest.raises(InvalidConfig):
        quantize.ProductQuantizer.train(vectors, subspaces=5)
    assert quantize.choose(vectors, largest_mse=1e-3)[0] == "scalar"


def test_unit_codes_round_trip(spark):
    df = spark.createDataFrame([([0.0, 0.5, 1.0, 0.25, 0.75, -1.0, 2.0],)], "v array<double>")
    back = df.select(quantize.unit_decode(quantize.unit_encode("v"))).first()[0]
    assert back == pytest.approx([0, 0.5, 1, 0.25, 0.75, 0, 1], abs=0.01)
    assert df.select(quantize.signed_encode("v")).first()[0] == [127, 191, 255, 159, 223, 0, 255]


def test_binary_codes(spark):
    bq = quantize.BinaryQuantizer(4, 12)
    x = [0.3, -0.2, 0.9, 0.1]
    bits = [int(sum(math.sin(i * 4 + j) * x[j] for j in range(4)) > 0) for i in range(12)]
    got = spark.createDataFrame([(x,)], "v array<double>").select(bq.encode("v")).first()[0]
    assert got == [sum(b << k for k, b in enumerate(bits[8 * n : 8 * n + 8])) for n in range(2)]


def test_replay_snapshot_and_recovery(spark, tmp_path):
    ops = [(1, "insert", "a", 1), (2, "insert", "b", 2), (3, "clear", None, None), (4, "insert", "c", 3), (5, "update", "c", 4), (6, "insert", "d", 5), (7, "delete", "d", None), (8, "batch_insert", "e", 6)]
    log = spark.createDataFrame(ops, "lsn long, op string, id string, x int")
    state = {r["id"]: r["x"] for r in oplog.replay(log).collect()}
    assert state == {"c": 4, "e": 6}
    assert {r["id"] for r in oplog.replay(log, 6).collect()} == {"e"}
    snapshot = oplog.replay(log.where("lsn <= 5")).select("id", "x")
    assert {r["id"]: r["x"] for r in oplog.recover(snapshot, log, 5).collect()} == state
    with pytest.raises(EngineError):
        oplog.replay(log.withColumn("op", F.lit("compaction")))
    path = str(tmp_path / "snaps")
    for n in range(4):
        oplog.write_snapshot(snapshot.withColumn("n", F.lit(n)), path, f"s{n}", keep=2)
    assert oplog.list_snapshots(spark, path) == ["s3", "s2"]
    assert oplog.restore_snapshot(spark, path).first()["n"] == 3
    with pytest.raises(EngineError):
        oplog.restore_snapshot(spark, path, "s0")


def test_append_numbers_and_checksums(spark):
    empty = spark.createDataFrame([], "lsn long, op string, id string, crc long")
    log = oplog.append(empty, spark.createDataFrame([("insert", "a", 1), ("delete", "b", 2)], "op string, id string, seq int"), "seq")
    assert [r["id"] for r in log.orderBy("lsn").collect()] == ["a", "b"] and oplog.corrupt(log).count() == 0
    assert oplog.corrupt(log.withColumn("id", F.lit("z"))).count() == 2


def test_segments_merge_and_compact(spark, tmp_path):
    parts = [spark.createDataFrame(rows, "id string, x int") for rows in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)])]
    merged = oplog.merge_segments(parts)
    assert sorted(map(tuple, merged.collect())) == [("a", 1), ("b", 2), ("c", 2)]
    oplog.compact(merged.repartition(3), str(tmp_path / "c"), 2)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3


def test_rings(spark):
    for kind in ("crc32", "sha256"):
        ring = placement.Ring(("n1", "n2", "n3"), 20, kind)
        df = spark.createDataFrame([(f"key{i}",) for i in range(200)], "k string")
        got = {r["k"]: r["owners"] for r in ring.place(df, "k", 2).collect()}
        for k, owners in got.items():
            assert owners == ring.owners(k, 2) and len(set(owners)) == 2
        left = ring.without("n2")
        for k, owners in got.items():
            if owners[0] != "n2":
                assert left.owners(k) == owners[:1]
        assert {r["source"] for r in placement.moves(df, "k", ring, left).collect()} == {"n2"}
        assert sum(placement.range_size(a + 1, b, placement.KINDS[kind][1]) if a != b else 0 for _, a, b in ring.ranges()) == placement.KINDS[kind][1]
    assert placement.Ring((), 3).owners("x") == []
    ranges = placement.shard_ranges(3)
    assert ranges[0][1] == 0 and ranges[-1][2] == (1 << 64) - 1 and all(a[2] + 1 == b[1] for a, b in zip(ranges, ranges[1:], strict=False))


def test_statistics_of_little(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (None, None), (float("inf"), "b"), (3.0, "b")], "x double, s string")
    r = stats.numeric_stats(df, "x").first()
    assert tuple(r) == (1.0, 3.0, 2, 4, 1, 1, 1)
    assert stats.categorical_stats(df, "s").first()["distinct_values"] == 2
    n = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    p = stats.index_percentiles(n, "x").first()
    assert (p["median"], p["p95"], p["p99"], p["p999"]) == (50, 95, 99, 99)
    ema = stats.exponential_average(spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 2.0, 3.0])], "g int, i int, v double"), "v", "i", ["g"]).first()["ema"]
    assert ema == pytest.approx((1.0 * 0.9 + 0.2) * 0.9 + 0.3)
    assert stats.health(spark.createDataFrame([], "ok boolean"), F.col("ok")).first()["status"] == "healthy"
    one = spark.createDataFrame([(1, 5, "immutable")], "segment int, size_bytes long, state string")
    assert stats.compaction_candidates(one, "segment").count() == 0


def test_estimates_and_plans():
    d = {"a": 4}
    assert stats.estimated_selectivity(P.eq("a", 1), d) == 0.25 and stats.estimated_selectivity(P.eq("b", 1), d) == 0.1
    assert stats.estimated_selectivity(P.Or(tuple(P.isin("a", [1]) for _ in range(9))), d) == 1.0
    assert stats.estimated_selectivity(P.Function(lambda s: None), d) == 0.5
    p = planner.plan(["a", "b", "c"], ["n"])
    assert planner.optimized(p).parallelism == 2 and planner.estimated_cost(planner.optimized(p)) > p.cost
    assert planner.choose_strategy(64, 10, 10**9) == "graph" and planner.choose_strategy(64, 10, 10**9, 1e-6) == "flat"
    assert planner.batch_size(64) == (16 << 20) // 512


@pytest.mark.parametrize("format", files.FORMATS)
def test_formats(spark, tmp_path, format):
    df = spark.createDataFrame([(1, "a \"q\"\nb", [1.0, 2.0])], "id int, s string, v array<double>")
    files.write(df, str(tmp_path / format), format)
    back = files.read(spark, str(tmp_path / format), format, "id int, s string, v string" if format == "csv" else df.schema)
    if format == "csv":
        back = back.withColumn("v", F.from_json("v", "array<double>"))
    assert back.select("id", "s", "v").collect() == df.collect()


def test_bloom_filters_are_written(spark, tmp_path):
    import pyarrow.parquet as pq

    files.write(spark.range(1000).selectExpr("id * 7 AS id").coalesce(1), str(tmp_path / "b"), bloom_on=("id",))
    assert files.read(spark, str(tmp_path / "b")).where("id = 49").count() == 1
    [part] = (tmp_path / "b").glob("part-*.parquet")
    assert b"parquet" in pq.read_metadata(part).created_by.encode().lower()


def test_two_levels_are_better_than_one(vectors):
    q = quantize.MultiLevelQuantizer.train(vectors, subspaces=4, iterations=3)
    c = vectors.select("embedding", q.encode("embedding").alias("c"))
    coarse, both = c.select(F.avg(quantize.mean_squared_error("embedding", q.coarse.decode(F.col("c")["coarse"]))), F.avg(quantize.mean_squared_error("embedding", q.decode(F.col("c"))))).first()
    assert both < coarse / 4


def test_records_and_variants(spark):
    df = spark.createDataFrame([(1, [1.0], '{"k": 5}'), (2, [2.0], "no json")], "i int, e array<double>, props string")
    r = files.records(df, "i", "e")
    assert r.dtypes[:2] == [("id", "string"), ("vector", "array<float>")]
    assert P.where(files.with_variant(df, "props"), P.gt("props.k", 4)).count() == 1
    wire = files.record_json(r)
    assert files.from_record_json(wire, "id string, vector array<float>").first()["id"] == "1"


def test_graph_search_takes_any_number_of_queries(spark):
    vectors = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    queries = spark.range(2100).select(F.col("id").alias("query_id"), F.array(F.cos(F.col("id") % 40), F.sin(F.col("id") % 40)).alias("query"))
    got = graph.graph_search(vectors, queries, 1, "euclidean").collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(i, i % 40) for i in range(2100)} and len(got) == 2100


def test_stored_graphs_take_batches_and_are_compacted(spark, vectors, tmp_path):
    index = graph.write_graphs(vectors.where("vec_id < 200"), str(tmp_path / "g"), graph_rows=50)
    few = index.count()
    index = graph.write_graphs(vectors.where("vec_id >= 200"), str(tmp_path / "g"), graph_rows=50)
    assert index.count() > few and index.agg(F.sum(F.size("ids"))).first()[0] == 300
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for stored in (index, graph.compact_graphs(index, str(tmp_path / "h"))):
        found = graph.search_graphs(stored, queries, 5)
        assert search.recall(found, search.batch_top_k(vectors, queries, 5), 5).agg(F.avg("recall")).first()[0] >= 0.95


def test_searches_are_routed_to_indexes(spark, vectors, tmp_path):
    c = Collection(CollectionConfig("v", 16, id_column="vec_id", vector_column="embedding"), vectors)
    cells = ann.InvertedLists.train(vectors, 6, "cosine", 5)
    graphs = graph.write_graphs(vectors, str(tmp_path / "g"))
    q = vectors.where("vec_id = 7").first()["embedding"]
    request, filtered = SearchRequest(q, 3), SearchRequest(q, 3, P.eq("label", 1))
    assert c.strategy(request) == "flat"
    few, many = (c.indexed(n, cells, cells.index(vectors), 6, graphs) for n in (300, 10**9))
    assert few.strategy(request) == "flat" and many.strategy(request) == "graph" and many.strategy(request, exact=True) == "flat"
    assert many.strategy(filtered) == "cells" and c.indexed(10**9, graphs=graphs).strategy(filtered) == "flat" and many.strategy(filtered, selectivity=1e-6) == "flat"
    want = [(r["vec_id"], round(r["distance"], 9), r["rank"]) for r in c.search(request).collect()]
    for way in (many, c.indexed(10**9, cells, cells.index(vectors), 6)):
        assert [(r["vec_id"], round(r["distance"], 9), r["rank"]) for r in way.search(request).collect()] == want
        assert set(way.search(request).columns) == set(c.search(request).columns)
    assert [r["vec_id"] for r in many.search(filtered).collect()] == [r["vec_id"] for r in c.search(filtered).collect()]
    assert many.delete(0).strategy(request) == "flat"  # a write leaves the indexes behind


def test_stored_catalog(spark, articles, tmp_path):
    path = str(tmp_path / "cat")
    cat = Catalog(spark, path)
    cat.create(articles, owner="x")
    with pytest.raises(AlreadyExists):
        Catalog(spark, path).create(articles)
    again = Catalog(spark, path)
    assert again.names() == ["articles"] and again.get("articles").count() == articles.count() and again.get("articles").config == articles.config
    first = articles.list(1).first()[articles.config.id_column]
    again.update(again.get("articles").delete(first), state="cut")
    assert Catalog(spark, path).get("articles").count() == articles.count() - 1 and Catalog(spark, path).properties("articles") == {"owner": "x", "state": "cut"}
    with pytest.raises(EngineError):  # a writer that has not seen the newest version
        stale = Catalog(spark, path)
        monkey = stale.versions
        stale.versions = lambda: [stale.version - 1]
        stale.version -= 1
        stale.update(articles)
    again = Catalog(spark, path)
    again._entries["articles"]["state"] = "dropping"  # a crash amid a drop
    again._save()
    assert Catalog(spark, path).names() == []
    newest = max((tmp_path / "cat" / "_manifest").glob("v*.json"))
    newest.write_text(newest.read_text()[:20])  # a write that broke off
    for crc in (tmp_path / "cat" / "_manifest").glob(".*.crc"):
        crc.unlink()
    assert Catalog(spark, path).version < int(newest.name[1:-5]) or monkey


def test_recovery_checks_snapshots_and_log(spark, tmp_path):
    path = str(tmp_path / "s")
    ops = [(i, "insert", f"k{i % 7}", i) for i in range(1, 31)] + [(31, "delete", "k0", None)]
    log = spark.createDataFrame(ops, "lsn long, op string, id string, x int")
    want = {r["id"]: r["x"] for r in oplog.replay(log).collect()}
    got = lambda log_, **k: {r["id"]: r["x"] for r in oplog.recover_from(spark, path, log_, **k).collect()}
    assert got(log) == want  # no snapshot yet
    for lsn in (10, 20):
        suffix = oplog.checkpoint(log, oplog.replay(log.where(F.col("lsn") <= lsn)).select("id", "x"), lsn, path, str(tmp_path / "l"))
        assert suffix.count() == 31 - lsn and got(suffix) == want and got(log) == want
    spark.createDataFrame([("zz", 1)], "id string, x int").write.mode("append").parquet(f"{path}/{oplog.list_snapshots(spark, path)[0]}")
    with pytest.raises(EngineError):
        oplog.restore_snapshot(spark, path, verify=True)
    assert got(log) == want  # from the snapshot before
    checked = log.withColumn("crc", oplog.checksum("lsn", "op", "id", "x"))
    assert got(checked) == want
    damaged = checked.withColumn("crc", F.when(F.col("lsn") == 30, 0).otherwise(F.col("crc")))
    with pytest.raises(EngineError):
        got(damaged)
    assert got(damaged, skip_corrupt=True) != want
    assert [r["lsn"] for r in oplog.since(log, 30).orderBy("lsn").collect()] == [30, 31]


def test_places_and_totals_over_tasks(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    assert {r["x"]: r["place"] for r in stats.positions(df, ["x"]).collect()} == {i: i + 1 for i in range(1000)}
    assert stats.histogram(spark.createDataFrame([(0.002,), (99.0,)], "x double"), "x").count() == 2


@pytest.mark.parametrize("parts", [1, 7])
def test_averages_in_order_over_tasks(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(k, int(i), None if rng.random() < 0.1 else float(rng.normal())) for k, n in (("hot", 900), ("b", 40), (None, 60), ("one", 1), ("c", 1)) for i in range(n)]
    rows = [(k, i, None if k == "c" else v) for k, i, v in rows]
    held = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "g string, i int, v double")
        assert df.orderBy("g", "i").rdd.getNumPartitions() == parts
        moving = {(r["g"], r["i"]): r["moving_avg"] for r in stats.moving_average(df, "v", "i", ["g"], 10, 16).collect()}
        running = {(r["g"], r["i"]): r["running_avg"] for r in stats.running_average(df, "v", "i", ["g"]).collect()}
        ema = {r["g"]: (r["ema"], r["samples"]) for r in stats.exponential_average(df, "v", "i", ["g"]).collect()}
        whole = [r["moving_avg"] for r in stats.moving_average(df.where("g = 'b'"), "v", "i", [], 10, 16).orderBy("i").collect()]
    finally:
        for n, v in held.items():
            spark.conf.set(n, v)
    assert len(moving) == len(running) == len(rows)
    mean = lambda xs: pytest.approx(sum(xs) / len(xs)) if xs else None
    want_ema = {}
    for k in {r[0] for r in rows}:
        values = [v for g, _, v in rows if g == k]
        for i in range(len(values)):
            assert moving[k, i] == mean([v for v in values[max(0, i - 9) : i + 1] if v is not None])
            assert running[k, i] == mean([v for v in values[: i + 1] if v is not None])
        present = [v for v in values if v is not None]
        if present:
            e = present[0]
            for v in present[1:]:
                e = 0.9 * e + 0.1 * v
            want_ema[k] = (pytest.approx(e), len(present))
    assert ema == want_ema
    assert whole == [moving["b", i] for i in range(40)]


def test_operations_with_searches_and_stops(spark):
    base = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    ops = [(1, "insert", "c", [1.0, 1.0]), (2, "search", None, [1.0, 0.9]), (3, "delete", "b", None), (4, "insert", None, [1.0, 1.0]), (5, "update", "a", [1.0]), (6, "explode", "a", None), (7, "delete", "a", None)]
    operations = spark.createDataFrame(ops, "seq int, op string, id string, vector array<double>")
    table, results, hits = stream.run_operations(base, operations, k=1)
    assert {r["id"] for r in table.collect()} == {"c"} and hits.first()["id"] == "c" and hits.first()["query_id"] == 2
    assert {r["seq"]: r["error"] for r in results.collect()} == {1: None, 2: None, 3: None, 4: "no id", 5: "dimension", 6: "unknown operation", 7: None}
    table, results, _ = stream.run_operations(base, operations, stop_on_error=True)
    assert {r["id"] for r in table.collect()} == {"a", "c"} and {r["seq"] for r in results.where("ok").collect()} == {1, 2, 3}
    assert {r["error"] for r in results.where("seq > 4").collect()} == {"skipped"}
