from pyspark.sql import functions as F

from halyard.functions import predicates as P
from halyard.streaming import stream


def test_upserts_from_a_stream_of_files(spark, tmp_path):
    src, table, state = (str(tmp_path / x) for x in ("src", "table", "state"))
    schema = "id string, seq long, x int, gone boolean"
    source = lambda: stream.read_files(spark, src, schema, files_per_trigger=1)
    spark.createDataFrame([("a", 1, 1, False), ("b", 1, 1, False), ("a", 2, 2, False)], schema).coalesce(1).write.mode("append").parquet(src)
    stream.upsert_stream(source(), table, state, deleted=F.col("gone")).awaitTermination()
    assert sorted((r["id"], r["x"]) for r in stream.read_table(spark, table).collect()) == [("a", 2), ("b", 1)]
    spark.createDataFrame([("b", 3, 0, True), ("c", 3, 3, False)], schema).coalesce(1).write.mode("append").parquet(src)
    query = stream.upsert_stream(source(), table, state, deleted=F.col("gone"))
    query.awaitTermination()
    assert sorted((r["id"], r["x"]) for r in stream.read_table(spark, table).collect()) == [("a", 2), ("c", 3)]
    assert stream.progress(query)["rows"] == 2
    stream.upsert_stream(source(), table, state, deleted=F.col("gone")).awaitTermination()  # nothing new
    assert stream.read_table(spark, table).count() == 2


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    src, table, state = (str(tmp_path / x) for x in ("src", "table", "state"))
    schema = "id long, seq long, x int, gone boolean"
    want = {}

    def batch(rows):
        for i, _, x, gone in rows:
            want.pop(i, None)
            if not gone:
                want[i] = x
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream.upsert_stream(stream.read_files(spark, src, schema, files_per_trigger=1), table, state, deleted=F.col("gone"), keep=2, buckets=8).awaitTermination()
        assert {r["id"]: r["x"] for r in stream.read_table(spark, table).collect()} == want

    batch([(i, 1, i, False) for i in range(200)])
    first = stream._newest(spark, table)
    assert set(first["held"].values()) == {0} and len(first["held"]) == 8
    batch([(7, 2, 70, False)])
    second = stream._newest(spark, table)
    assert sorted(second["held"].values()) == [0] * 7 + [1]  # one bucket is new, the others stay where they are
    batch([(7, 3, 0, True), (500, 3, 5, False)])
    batch([(i, 4, 0, True) for i in range(600)])  # nothing is left
    assert stream.read_table(spark, table).columns == ["id", "seq", "x", "gone"]
    batch([(1, 5, 1, False)])
    assert stream._manifests(spark, table) == [4, 3] and not (tmp_path / "table" / "v000000000000").exists()
    (tmp_path / "table" / "_manifest" / "v000000000009.json").write_text('{"number"')  # a write that broke off
    assert {r["id"]: r["x"] for r in stream.read_table(spark, table).collect()} == want


def test_processors_chain_on_a_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    spark.createDataFrame([("a", [3.0, 4.0], 1), ("b", [0.0, 1.0], 2)], "id string, vector array<double>, priority int").write.parquet(src)
    steps = stream.chain(stream.filtered(P.gt("priority", 1)), stream.normalized(), stream.quantized())
    stream.append_stream(steps(stream.read_files(spark, src, "id string, vector array<double>, priority int")), out, state).awaitTermination()
    assert [(r["id"], r["codes"]) for r in spark.read.parquet(out).collect()] == [("b", [127, 255])]


def test_batch_operations_and_report(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "id string, x int")
    ops = spark.createDataFrame([("insert", "c", 2, 1), ("delete", "a", None, 2), ("update", "b", 5, 3), ("reindex", "b", 9, 4), ("insert", None, 9, 5)], "op string, id string, x int, seq int")
    table, report = stream.apply_operations(base, ops)
    assert sorted(map(tuple, table.collect())) == [("b", 5), ("c", 2)]
    assert {r["op"]: (r["succeeded"], r["failed"]) for r in report.collect()} == {"insert": (1, 1), "delete": (1, 0), "update": (1, 0), "reindex": (0, 1)}


def test_priorities_and_windows(spark):
    df = spark.createDataFrame([(1, 0), (2, 5), (3, 5)], "seq int, priority int")
    assert [r["seq"] for r in stream.prioritized(df).collect()] == [2, 3, 1]
    t = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1.0D AS v UNION ALL SELECT timestamp'2024-01-01 00:50:00', 3.0D UNION ALL SELECT timestamp'2024-01-01 01:00:00', 5.0D")
    got = stream.windowed_stats(t, "ts", "v").orderBy("window_start").collect()
    assert [(r["n"], r["avg_value"]) for r in got] == [(2, 2.0), (1, 5.0)]
