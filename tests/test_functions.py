import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.contract import CollectionConfig, DimensionMismatch, InvalidConfig, InvalidFilter, InvalidRequest, InvalidVector, SearchRequest, checked_vector
from halyard.functions import predicates as P
from halyard.functions import vectors as V


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [3.0, 4.0], [0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>, c array<float>, z array<float>, u array<float>")


def value(df, c):
    return df.select(c).first()[0]


def test_algebra(one):
    assert value(one, V.add("a", "b")) == [5, 7, 9]
    assert value(one, V.subtract("b", "a")) == [3, 3, 3]
    assert value(one, V.scale("a", 2.0)) == [2, 4, 6]
    assert value(one, V.dot("a", "b")) == 32
    assert value(one, V.normalize("c")) == pytest.approx([0.6, 0.8])
    assert value(one, V.normalize("z")) == [0, 0]
    assert value(one, V.dimension("a")) == 3
    assert (value(one, V.smallest("a")), value(one, V.largest("a")), value(one, V.spread("a"))) == (1, 3, 2)


@pytest.mark.parametrize(("metric", "same", "apart"), [("cosine", 0, 1), ("euclidean", 0, math.sqrt(2)), ("manhattan", 0, 2), ("dot_product", -1, 0)])
def test_distances_of_axes(one, metric, same, apart):
    assert value(one, V.distance(metric, [1.0, 0, 0], [1.0, 0, 0])) == same
    assert value(one, V.distance(metric, [1.0, 0, 0], [0.0, 1, 0])) == pytest.approx(apart)


def test_zero_vectors(one):
    assert value(one, V.cosine_distance("z", "z")) == 0
    assert value(one, V.cosine_distance("z", "u")) == 1


def test_scores_and_back(one):
    d = F.lit(0.25)
    for m in ("cosine", "euclidean", "manhattan", "dot_product"):
        assert value(one, V.distance_of(m, V.score_of(m, d))) == pytest.approx(0.25)
    assert value(one, V.distance_of("euclidean", F.lit(0.0))) == 1e9


def test_hamming(one):
    assert value(one, V.hamming_distance(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)))) == 1
    assert value(one, V.bit_hamming(F.array(F.lit(255), F.lit(1)), F.array(F.lit(0), F.lit(1)))) == 8


def test_dimension_is_checked_when_run(one):
    assert value(one, V.checked("a", 3)) == [1, 2, 3]
    with pytest.raises(Exception, match="expected 2"):
        value(one, V.checked("a", 2))


def test_record_size(spark):
    df = spark.createDataFrame([("ab", [1.0, 2.0], "xyz", 5, True, None)], "id string, v array<float>, s string, n int, b boolean, m string")
    assert value(df, V.record_size("id", "v", [("s", "string"), ("n", "int"), ("b", "boolean"), ("m", "string")])) == 2 + 8 + (1 + 3) + (1 + 8) + (1 + 1)


def test_contract_errors():
    for bad in ([], None):
        with pytest.raises(InvalidVector):
            checked_vector(bad)
    with pytest.raises(DimensionMismatch):
        checked_vector([1.0], 2)
    with pytest.raises(InvalidVector):
        checked_vector([float("nan")])
    for kw in ({"k": 0}, {"k": -1}, {"max_distance": -0.1}, {"min_score": 1.1}, {"min_score": -0.1}):
        with pytest.raises(InvalidRequest):
            SearchRequest([1.0], **kw).validate()
    for kw in ({"dimension": 0}, {"m": -1}, {"ef_construction": 0}, {"metric": "bad"}, {"name": ""}):
        with pytest.raises(InvalidConfig):
            CollectionConfig(**({"name": "c", "dimension": 3} | kw))


ROW = "category string, price double, rating double, name string, n int, flag boolean, nothing string, tags array<string>, m map<string,string>"
CASES = [
    (P.eq("category", "electronics"), True), (P.eq("category", "books"), False), (P.gt("price", 90), True), (P.lt("rating", 5), True), (P.isin("category", ["electronics", "books"]), True), (P.isin("category", ["books", "toys"]), False),
    (P.match("name", "test"), True), (P.match("name", "product"), False), (P.match("name", ""), False), (P.eq("nonexistent", 1), False), (P.ne("nonexistent", 1), False), (~P.eq("nonexistent", 1), True),
    (P.eq("category", "electronics") & P.gt("price", 50), True), (P.eq("category", "electronics") & P.gt("price", 150), False), (P.eq("category", "books") | P.gt("price", 50), True), (P.eq("category", "books") | P.gt("price", 150), False),
    (~P.eq("category", "books"), True), (~P.eq("category", "electronics"), False), (P.eq("nothing", "x"), False), (P.ne("nothing", "x"), False), (P.nin("nothing", ["x"]), False), (~P.eq("nothing", "x"), True), (P.nin("category", ["books"]), True),
    (P.eq("n", 5.0), True), (P.eq("n", "5"), False), (P.ne("n", "5"), True), (P.nin("n", ["5"]), True), (P.isin("n", ["5"]), False), (P.eq("flag", True), True), (P.eq("flag", 1), False), (P.gt("category", 1), False), (P.gte("n", 5), True), (P.lte("n", 4), False),
    (P.between("price", 99.99, 100), True), (P.between("price", 99.99, 100, include_low=False), False), (P.contains("tags", "b"), True), (P.contains("tags", "z"), False), (P.eq("m.k", "v"), True), (P.eq("m.z", "v"), False), (P.Function(lambda s: F.col("n") > 4), True),
]


def test_predicates_of_one_record(spark):
    df = spark.createDataFrame([("electronics", 99.99, 4.5, "test product", 5, True, None, ["a", "b"], {"k": "v"})], ROW)
    got = df.select(*[f.validate().column(df.schema).alias(f"c{i}") for i, (f, _) in enumerate(CASES)]).first()
    assert [x for x in got] == [want for _, want in CASES]


def test_filter_validation():
    for bad in (P.eq("", 1), P.eq("a", None), P.isin("a", []), P.isin("a", "text"), P.gt("a", "x"), P.match("a", 3), P.Field("a", "like", 1), P.And(()), P.Or(()), P.Not(P.eq("a", None)), P.Function(None)):
        with pytest.raises(InvalidFilter):
            bad.validate()
    with pytest.raises(InvalidFilter):
        P.between("a")
    with pytest.raises(InvalidFilter):
        P.from_json('{"field": "a"}')


def test_filter_from_json():
    f = P.from_json('{"and": [{"field": "a", "op": "eq", "value": 1}, {"not": {"or": [{"field": "b", "op": "gt", "value": 2}]}}]}')
    assert f == P.And((P.eq("a", 1), P.Not(P.Or((P.gt("b", 2),)))))
    assert f.fields() == {"a", "b"}


def test_filters_reach_the_scan(spark, tiny):
    df = spark.read.parquet(f"{tiny}/part.parquet")
    plan = P.where(df, P.eq("p_brand", "x") & P.between("p_size", 1, 5)).select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1]
    assert "IsNotNull(p_brand)" in pushed and "GreaterThanOrEqual(p_size,1)" in pushed
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_size:int>" in plan


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3) | st.none(), st.sampled_from(["a", "b", None])), min_size=1, max_size=6), st.integers(-3, 3))
def test_negation_is_the_complement(spark, rows, n):
    df = spark.createDataFrame(rows, "n int, s string")
    for f in (P.eq("n", n), P.lt("n", n), P.nin("s", ["a"]), P.eq("s", "a") | P.ne("n", n)):
        assert P.where(df, f).count() + P.where(df, ~f).count() == len(rows)
