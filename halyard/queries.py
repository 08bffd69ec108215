"""Named queries over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.contract import CollectionConfig, SearchRequest
from halyard.functions import predicates as P
from halyard.functions import vectors as V
from halyard.operators import ann, collection, graph, oplog, placement, quantize, search, stats
from halyard.plans import planner
from halyard.sources.files import with_variant
from halyard.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(vectors: DataFrame, id: int = 0) -> list[float]:
    """A stored vector; the caller of an interactive search has it at hand."""
    return list(vectors.where(F.col("vec_id") == id).select("embedding").first()[0])


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- vectors in SQL ---------------------------------------------------------------------------------------------------------

V_SQL = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0)"


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def distance_sql(metric: str, a: str = "e", b: str = "q") -> str:
    return {
        "cosine": f"(1 - least(1.0, greatest(-1.0, {dot_sql(a, b)} / (sqrt({dot_sql(a, a)}) * sqrt({dot_sql(b, b)})))))",
        "euclidean": f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))",
        "manhattan": f"list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
        "dot_product": f"(-{dot_sql(a, b)})",
    }[metric]


def score_sql(metric: str, d: str = "d") -> str:
    return {"cosine": f"1 - {d}", "dot_product": f"-{d}"}.get(metric, f"1 / (1 + {d})")


def knn_sql(metric: str, where: str = "TRUE", k: int = 10) -> str:
    return f"""WITH {V_SQL}, s AS (SELECT vec_id, label, {distance_sql(metric)} AS d FROM v, q WHERE {where}),
r AS (SELECT *, row_number() OVER (ORDER BY d, vec_id) AS rank FROM s)
SELECT vec_id, label, round(d, 6) AS distance, round({score_sql(metric)}, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


def _knn(metric: str, f: P.Filter | None = None, k: int = 10) -> Query:
    def run(spark, sf_dir):
        vectors = table(spark, sf_dir, "embeddings")
        return rounded(search.top_k(vectors, query_vector(vectors), k, metric, f), "distance", "score")

    return run


for _m in ("cosine", "euclidean", "manhattan", "dot_product"):
    register(knn_sql(_m), f"knn_{_m}")(_knn(_m))
register(knn_sql("cosine", "label = 3"), "knn_filtered_eq")(_knn("cosine", P.eq("label", 3)))
register(knn_sql("euclidean", "label IN (1, 2, 7)"), "knn_filtered_in")(_knn("euclidean", P.isin("label", [1, 2, 7])))
register(knn_sql("cosine", "label >= 2 AND label < 6"), "knn_filtered_range")(_knn("cosine", P.between("label", 2, 6, include_high=False)))
register(knn_sql("manhattan", "NOT (label IS NOT NULL AND label = 0)"), "knn_filtered_not")(_knn("manhattan", ~P.eq("label", 0)))


@register(f"WITH {V_SQL}, s AS (SELECT vec_id, label, {distance_sql('cosine')} AS d FROM v, q) SELECT vec_id, label, round(d, 6) AS distance, round(1 - d, 6) AS score FROM s WHERE d <= 0.8")
def range_search_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(search.range_search(vectors, query_vector(vectors), 0.8), "distance", "score")


@register(f"WITH {V_SQL}, s AS (SELECT vec_id, label, {distance_sql('euclidean')} AS d FROM v, q) SELECT vec_id, label, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM s WHERE 1 / (1 + d) >= 0.42")
def min_score_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(search.min_score_search(vectors, query_vector(vectors), 0.42, "euclidean"), "distance", "score")


@register(knn_sql("cosine", "label IN (0, 1, 2, 3, 4)", 20).replace("WHERE rank <= 20", "WHERE rank <= 20 AND d <= 0.9"))
def hybrid_request_search(spark, sf_dir):
    """A whole request: filter, k and distance cut."""
    vectors = table(spark, sf_dir, "embeddings")
    c = collection.Collection(CollectionConfig("vectors", 64, id_column="vec_id", vector_column="embedding"), vectors)
    return rounded(c.search(SearchRequest(query_vector(vectors), 20, P.isin("label", [0, 1, 2, 3, 4]), max_distance=0.9)), "distance", "score")


MULTI_SQL = f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT b.vec_id AS query_id, a.vec_id, {distance_sql("cosine", "a.e", "b.e")} AS d FROM v a, v b WHERE b.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@register(MULTI_SQL)
def multi_knn_top10(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(search.batch_top_k(vectors, _queries(vectors), 10), "distance").select("query_id", "vec_id", "distance", "rank")


@register(MULTI_SQL.replace(distance_sql("cosine", "a.e", "b.e"), distance_sql("euclidean", "a.e", "b.e")))
def multi_knn_euclidean(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(search.batch_top_k(vectors, _queries(vectors), 10, "euclidean"), "distance").select("query_id", "vec_id", "distance", "rank")


@register(f"WITH t AS ({MULTI_SQL}) SELECT query_id, round(avg(distance), 4) AS avg_distance FROM t GROUP BY query_id")
def topk_avg_distance(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = rounded(search.batch_top_k(vectors, _queries(vectors), 10), "distance")
    return rounded(search.average_distance(found), "avg_distance", digits=4)


@register(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT b.vec_id AS q, a.vec_id AS id, {distance_sql("cosine", "a.e", "b.e")} AS d FROM v a, v b),
n AS (SELECT q, arg_min(id, struct_pack(d := round(d, 9), id := id)) AS nearest FROM s GROUP BY q)
SELECT count(*) AS queries, count(*) FILTER (WHERE q = nearest) AS matched, avg(CASE WHEN q = nearest THEN 1.0::DOUBLE ELSE 0 END) AS recall_at_1 FROM n""")
def self_match_recall_at_1(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = search.self_match(vectors, vectors)
    return found.agg(F.count("*").alias("queries"), F.count_if("matched").alias("matched"), F.avg(F.col("matched").cast("double")).alias("recall_at_1"))


@register(f"""WITH {V_SQL}, s AS (SELECT vec_id, vec_id % 4 AS shard, {distance_sql('cosine')} AS d FROM v, q),
p AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY d, vec_id) AS r FROM s), u AS (SELECT * FROM p WHERE r <= 10 UNION ALL SELECT * FROM p WHERE r <= 3),
m AS (SELECT vec_id, min(d) AS d FROM u GROUP BY vec_id), f AS (SELECT *, row_number() OVER (ORDER BY d, vec_id) AS rank FROM m)
SELECT vec_id, round(d, 6) AS distance, round(1 - d, 6) AS score, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 10""")
def shard_merge_topk(spark, sf_dir):
    """Hits of four shards, some of them twice (replicas), in one ranking."""
    vectors = table(spark, sf_dir, "embeddings")
    near = search.with_distance(vectors, query_vector(vectors), "cosine").select("vec_id", "distance", (F.col("vec_id") % 4).alias("shard"))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("shard").orderBy("distance", "vec_id"))).where("r <= 10")
    hits = ranked.select("vec_id", "distance", F.explode(F.when(F.col("r") <= 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rounded(search.merge_shards(hits, 10, "vec_id"), "distance", "score")


@register(f"""WITH RECURSIVE {V_SQL}, s AS (SELECT vec_id, {distance_sql('cosine')} AS d FROM v, q),
r AS (SELECT vec_id, d, 1 - d AS score, row_number() OVER (ORDER BY d, vec_id) AS rank FROM s), t AS (SELECT * FROM r WHERE rank <= 50),
w AS (SELECT 1::BIGINT AS i, [(SELECT score FROM t WHERE rank = 1)] AS kept, [1::BIGINT] AS ranks
  UNION ALL SELECT i + 1, CASE WHEN ok THEN list_append(kept, sc) ELSE kept END, CASE WHEN ok THEN list_append(ranks, i + 1) ELSE ranks END
  FROM (SELECT w.i, w.kept, w.ranks, t.score AS sc, len(list_filter(w.kept, lambda x: abs(x - t.score) < 0.05)) = 0 AS ok FROM w JOIN t ON t.rank = w.i + 1))
SELECT t.vec_id, round(t.d, 6) AS distance, round(t.score, 6) AS score, CAST(t.rank AS INTEGER) AS rank FROM t WHERE list_contains((SELECT ranks FROM w ORDER BY i DESC LIMIT 1), t.rank)""")
def diversity_rerank(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(search.diversify(search.top_k(vectors, query_vector(vectors), 50), 0.05), "distance", "score")


# --- vector functions -------------------------------------------------------------------------------------------------------

@register(f"""WITH {V_SQL} SELECT vec_id, round(sqrt({dot_sql('e', 'e')}), 9) AS norm, len(e) AS dim, round(list_min(e), 9) AS low, round(list_max(e), 9) AS high, round(list_max(e) - list_min(e), 9) AS spread FROM v""")
def vec_norms(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(e), 9).alias("norm"), V.dimension(e).cast("long").alias("dim"), F.round(V.smallest(e), 9).alias("low"), F.round(V.largest(e), 9).alias("high"), F.round(V.spread(e), 9).alias("spread"))


@register(f"""WITH {V_SQL}, n AS (SELECT vec_id, list_transform(e, lambda x: x * 3) AS t FROM v), m AS (SELECT vec_id, t, sqrt({dot_sql('t', 't')}) AS l FROM n)
SELECT vec_id, round(list_sum(list_transform(t, lambda x: x / l)), 6) AS total, round(t[1] / l, 9) AS first FROM m""")
def vec_normalize(spark, sf_dir):
    unit = V.normalize(V.scale("embedding", 3.0))
    out = table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("u"))
    return out.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.get("u", F.lit(0)), 9).alias("first"))


@register(f"""WITH {V_SQL}, s AS (SELECT vec_id, list_transform(list_zip(e, q), lambda z: z[1] + z[2]) AS a, list_transform(list_zip(e, q), lambda z: z[1] - z[2]) AS b, list_transform(e, lambda x: x * 2.5) AS c FROM v, q)
SELECT vec_id, round(list_sum(a), 6) AS add_sum, round(list_sum(b), 6) AS sub_sum, round(list_sum(c), 6) AS scale_sum FROM s""")
def vec_add_sub_scale(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = query_vector(vectors)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    return vectors.select("vec_id", total(V.add("embedding", q)).alias("add_sum"), total(V.subtract("embedding", q)).alias("sub_sum"), total(V.scale("embedding", 2.5)).alias("scale_sum"))


@register(f"""WITH {V_SQL} SELECT vec_id, CAST(len(list_filter(list_zip(list_transform(e, lambda x: CAST(floor(x * 8) AS INTEGER)), list_transform(q, lambda x: CAST(floor(x * 8) AS INTEGER))), lambda z: z[1] <> z[2])) AS INTEGER) AS hamming FROM v, q""")
def vec_hamming(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    coarse = lambda c: F.transform(c, lambda x: F.floor(x.cast("double") * 8).cast("int"))
    return vectors.select("vec_id", V.hamming_distance(coarse(F.col("embedding")), coarse(V.vector(query_vector(vectors)))).alias("hamming"))


@register(f"WITH {V_SQL} SELECT vec_id, round(list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS squared, round({dot_sql('e', 'q')}, 9) AS dot FROM v, q")
def vec_squared_l2_dot(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = query_vector(vectors)
    return vectors.select("vec_id", F.round(V.squared_euclidean("embedding", q), 9).alias("squared"), F.round(V.dot("embedding", q), 9).alias("dot"))


@register(f"""WITH {V_SQL}, d AS (SELECT vec_id, {distance_sql('cosine')} AS c, {distance_sql('euclidean')} AS l2, {distance_sql('manhattan')} AS l1, {distance_sql('dot_product')} AS dp FROM v, q)
SELECT vec_id, round(1 - c, 6) AS cosine, round(1 / (1 + l2), 6) AS euclidean, round(1 / (1 + l1), 6) AS manhattan, round(-dp, 6) AS dot_product, round(1 / (1 / (1 + l2)) - 1, 6) AS back FROM d""")
def vec_similarity_scores(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    q = query_vector(vectors)
    score = lambda m: V.score_of(m, V.distance(m, "embedding", q))
    return vectors.select("vec_id", *[F.round(score(m), 6).alias(m) for m in ("cosine", "euclidean", "manhattan", "dot_product")], F.round(V.distance_of("euclidean", score("euclidean")), 6).alias("back"))


@register("""WITH p AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY label, i)
SELECT label, round(sum(m), 6) AS total, round(max(m), 6) AS most, count(*) AS dim FROM m GROUP BY label""")
def centroid_by_label(spark, sf_dir):
    c = stats.centroids(table(spark, sf_dir, "embeddings"), "label")
    return c.select("label", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.array_max("centroid"), 6).alias("most"), F.size("centroid").cast("long").alias("dim"))


@register(f"""WITH {V_SQL}, c AS (SELECT vec_id AS cid, e AS q FROM v WHERE vec_id < 8), s AS (SELECT v.vec_id, cid, {distance_sql('euclidean', 'v.e', 'c.q')} AS d FROM v, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) AS n FROM s) SELECT vec_id, CAST(cid AS INTEGER) AS centroid FROM r WHERE n = 1""")
def nearest_centroid_assignment(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    fixed = [list(r["embedding"]) for r in vectors.where("vec_id < 8").orderBy("vec_id").collect()]
    return vectors.select("vec_id", search.nearest_centroid(vectors, fixed).alias("centroid"))


# --- predicates -------------------------------------------------------------------------------------------------------------

def _where(name: str, of: str, f: P.Filter, columns: list[str], sql: str) -> None:
    register(f"SELECT {', '.join(columns)} FROM {of} WHERE {sql}", name)(lambda spark, sf_dir: P.where(table(spark, sf_dir, of), f).select(*columns))


_where("filter_eq", "events", P.eq("event_type", "click"), ["event_id", "user_id"], "event_type IS NOT NULL AND event_type = 'click'")
_where("filter_ne", "customer", P.ne("c_mktsegment", "BUILDING"), ["c_custkey", "c_mktsegment"], "c_mktsegment IS NOT NULL AND c_mktsegment <> 'BUILDING'")
_where("filter_in", "documents", P.isin("source", ["src1", "src2", "src3"]), ["doc_id", "source"], "source IN ('src1', 'src2', 'src3')")
_where("filter_nin", "documents", P.nin("lang", ["en", "fr"]), ["doc_id", "lang"], "lang IS NOT NULL AND lang NOT IN ('en', 'fr')")
_where("filter_gt_gte_lt_lte", "part", P.all_of(P.gt("p_size", 5), P.lte("p_size", 40), P.gte("p_retailprice", 950.0), P.lt("p_retailprice", 1500.0)), ["p_partkey", "p_size"], "p_size > 5 AND p_size <= 40 AND p_retailprice >= 950 AND p_retailprice < 1500")
_where("filter_prefix", "pages", P.match("url", "https://blog."), ["page_id", "url"], "starts_with(url, 'https://blog.')")
_where("filter_and_or_not", "events", P.all_of(P.any_of(P.eq("event_type", "error"), P.gt("value", 100)), P.negate(P.lt("user_id", 50))), ["event_id", "event_type"], "(event_type = 'error' OR value > 100) AND NOT (user_id IS NOT NULL AND user_id < 50)")
_where("filter_cross_family", "customer", P.any_of(P.eq("c_mktsegment", 5), P.all_of(P.ne("c_mktsegment", 5), P.gt("c_acctbal", 9000))), ["c_custkey"], "c_mktsegment IS NOT NULL AND c_acctbal > 9000")
_where("filter_numeric_range", "lineitem", P.between("l_discount", 0.05, 0.07) & P.lt("l_quantity", 24), ["l_orderkey", "l_linenumber"], "l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24")
_where("filter_function", "orders", P.Function(lambda s: (F.year("o_orderdate") == 1995) & (F.length("o_orderpriority") > 5)), ["o_orderkey"], "year(o_orderdate) = 1995 AND length(o_orderpriority) > 5")


@register("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality IS NOT NULL AND l.quality = 1)")
def filter_missing_field(spark, sf_dir):
    """A missing field makes its leaf false, and the negation true."""
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return P.where(both, P.negate(P.eq("quality", 1))).select("doc_id")


@register("SELECT event_id, TRY_CAST(props->>'k' AS BIGINT) AS k FROM events WHERE TRY_CAST(props->>'k' AS DOUBLE) IS NOT NULL AND TRY_CAST(props->>'k' AS DOUBLE) >= 40 AND TRY_CAST(props->>'k' AS DOUBLE) < 60")
def filter_variant_field(spark, sf_dir):
    """Dynamic metadata: a field of a JSON column."""
    events = with_variant(table(spark, sf_dir, "events"), "props")
    return P.where(events, P.between("props.k", 40, 60, include_high=False)).select("event_id", F.try_variant_get("props", "$.k", "long").alias("k"))


@register("SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def filter_list_containment(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return P.where(words, P.contains("words", "the")).select("doc_id")


@register("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 25")
def filter_with_limit(spark, sf_dir):
    return collection.page(P.where(table(spark, sf_dir, "documents"), P.eq("lang", "de")), "doc_id", 25).select("doc_id", "lang", "source")


@register("SELECT count(*) FILTER (WHERE event_type = 'click') AS matches, count(*) AS total, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 9) AS selectivity FROM events")
def selectivity_actual(spark, sf_dir):
    return rounded(stats.actual_selectivity(table(spark, sf_dir, "events"), P.eq("event_type", "click")), "selectivity", digits=9)


@register("""WITH n AS (SELECT count(DISTINCT event_type) AS d FROM events) SELECT 'eq' AS filter, round(1.0::DOUBLE / d, 9) AS estimate FROM n UNION ALL SELECT 'and', round(0.3::DOUBLE / d, 9) FROM n
UNION ALL SELECT 'or', round(least(1, 0.2::DOUBLE + 0.3), 9) FROM n UNION ALL SELECT 'not', round(1 - 1.0::DOUBLE / d, 9) FROM n""")
def selectivity_estimate(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    d = {"event_type": stats.categorical_stats(events, "event_type").first()["distinct_values"]}
    e = P.eq("event_type", "click")
    forms = {"eq": e, "and": e & P.gt("value", 1), "or": P.isin("event_type", ["view"]) | P.gt("value", 1), "not": ~e}
    return spark.createDataFrame([(k, round(stats.estimated_selectivity(f, d), 9)) for k, f in forms.items()], "filter string, estimate double")


# --- collection verbs -------------------------------------------------------------------------------------------------------

@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def list_page(spark, sf_dir):
    return collection.page(table(spark, sf_dir, "orders"), "o_orderkey", 50, 100).select("o_orderkey", "o_totalprice")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 400")
def scan_range(spark, sf_dir):
    return collection.scan_range(table(spark, sf_dir, "orders"), "o_orderkey", 100, 400).select("o_orderkey", "o_custkey")


@register("SELECT vec_id FROM embeddings")
def keys(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id").orderBy("vec_id")


@register("SELECT item_id, text, CAST(p AS INTEGER) AS position FROM benchmark JOIN (VALUES (7, 0), (3, 1), (999999, 2), (11, 3)) t(id, p) ON item_id = id")
def get_batch_ordered(spark, sf_dir):
    return collection.get_batch(table(spark, sf_dir, "benchmark"), "item_id", [7, 3, 999999, 11]).select("item_id", "text", "position")


@register("SELECT vec_id, label FROM embeddings WHERE vec_id = 42")
def get_by_id(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 42").select("vec_id", "label")


@register("SELECT l.doc_id, d.doc_id IS NOT NULL AS present FROM (SELECT doc_id FROM labels UNION ALL SELECT -1) l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def contains_batch(spark, sf_dir):
    asked = table(spark, sf_dir, "labels").select("doc_id").union(spark.createDataFrame([(-1,)], "doc_id long"))
    return collection.contains_batch(table(spark, sf_dir, "documents"), "doc_id", asked)


@register("SELECT conv_id, turn, role FROM conversations WHERE conv_id >= 10 AND conv_id <= 20")
def composite_key_scan(spark, sf_dir):
    return collection.scan_range(table(spark, sf_dir, "conversations"), "conv_id", 10, 20).orderBy("conv_id", "turn").select("conv_id", "turn", "role")


CHANGES_SQL = "c AS (SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice, 1 AS seq FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice * 5, 2 FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT -o_orderkey - 1, o_custkey, 1.0, 3 FROM orders WHERE o_orderkey % 50 = 0)"


def _changes(orders: DataFrame) -> DataFrame:
    part = lambda where, key, price, seq: orders.where(where).select(F.expr(key).alias("o_orderkey"), "o_custkey", F.expr(price).alias("o_totalprice"), F.lit(seq).alias("seq"))
    return part("o_orderkey % 3 = 0", "o_orderkey", "o_totalprice * 2", 1).union(part("o_orderkey % 6 = 0", "o_orderkey", "o_totalprice * 5", 2)).union(part("o_orderkey % 50 = 0", "-o_orderkey - 1", "1.0D", 3))


@register(f"""WITH {CHANGES_SQL}, b AS (SELECT o_orderkey, o_custkey, o_totalprice, 0 AS seq FROM orders UNION ALL SELECT * FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS n FROM b)
SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice FROM r WHERE n = 1""")
def upsert_lww(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rounded(collection.upsert(orders, _changes(orders), "o_orderkey", "seq"), "o_totalprice", digits=4)


@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_batch(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return collection.delete(table(spark, sf_dir, "orders"), gone, "o_orderkey").select("o_orderkey", "o_orderstatus")


@register("SELECT vec_id, label FROM embeddings")
def clear_then_put(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    c = collection.Collection(CollectionConfig("vectors", 64, id_column="vec_id", vector_column="embedding"), vectors)
    return c.clear().put(vectors).df.select("vec_id", "label")


@register("SELECT count(*) AS count, CAST(64 AS INTEGER) AS dimension, CAST(sum(length(CAST(vec_id AS VARCHAR)) + 4 * len(embedding) + 5 + 8) AS BIGINT) AS size_bytes FROM embeddings")
def collection_stats(spark, sf_dir):
    c = collection.Collection(CollectionConfig("vectors", 64, id_column="vec_id", vector_column="embedding"), table(spark, sf_dir, "embeddings"))
    return c.stats()


@register("SELECT d.doc_id, CAST(length(CAST(d.doc_id AS VARCHAR)) + 4 * len(e.embedding) + 4 + length(d.lang) + 6 + length(d.source) + 7 + 8 AS BIGINT) AS size_bytes FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def record_size_bytes(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return both.select("doc_id", V.record_size("doc_id", "embedding", [("lang", "string"), ("source", "string"), ("n_chars", "bigint")]).alias("size_bytes"))


@register(f"""WITH v AS (SELECT d.doc_id, d.lang, d.source, CAST(e.embedding AS DOUBLE[]) AS e FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id), q AS (SELECT e AS q FROM v WHERE doc_id = 0),
s AS (SELECT doc_id, lang, source, {distance_sql('cosine')} AS d FROM v, q WHERE lang = 'en' AND source <> 'src0'), r AS (SELECT *, row_number() OVER (ORDER BY d, doc_id) AS rank FROM s)
SELECT doc_id, lang, source, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def hybrid_docs_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    both = docs.join(vectors, F.col("doc_id") == F.col("vec_id")).drop("vec_id", "label")
    found = search.top_k(both, query_vector(vectors), 10, filter=P.eq("lang", "en") & P.ne("source", "src0"), id="doc_id")
    return rounded(found, "distance").select("doc_id", "lang", "source", "distance", "rank")


# --- set operations ---------------------------------------------------------------------------------------------------------

def _users(spark, sf_dir, kind):
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id").distinct()


@register("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def set_intersect(spark, sf_dir):
    return _users(spark, sf_dir, "purchase").join(_users(spark, sf_dir, "error"), "user_id", "left_semi")


@register("SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'signup'")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup")).select("user_id").distinct()


@register("SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_complement(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").distinct().join(done, "c_custkey", "left_anti")


# --- statistics -------------------------------------------------------------------------------------------------------------

@register("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def field_value_counts(spark, sf_dir):
    return stats.value_counts(table(spark, sf_dir, "events"), "event_type")


@register("""WITH c AS (SELECT source AS v, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT count(*) AS distinct_values, CAST(sum(n) AS BIGINT) AS documents, round(avg(n), 6) AS avg_posting, max(n) AS max_posting, CAST(sum(200 + length(v) + 50 * n) AS BIGINT) AS memory_bytes FROM c""")
def field_stats_categorical(spark, sf_dir):
    return rounded(stats.categorical_stats(table(spark, sf_dir, "documents"), "source"), "avg_posting")


@register("""SELECT min(value) FILTER (WHERE isfinite(value)) AS min_value, max(value) FILTER (WHERE isfinite(value)) AS max_value, count(DISTINCT value) FILTER (WHERE isfinite(value)) AS distinct_values, count(value) AS present,
count(*) FILTER (WHERE value IS NULL) AS nulls, count(*) FILTER (WHERE isnan(value)) AS nans, count(*) FILTER (WHERE isinf(value)) AS infinities FROM events""")
def field_stats_numeric(spark, sf_dir):
    return stats.numeric_stats(table(spark, sf_dir, "events"), "value")


PERCENTILES_SQL = "SELECT {keys} count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, " + ", ".join(f"list_sort(list(value))[CAST(least(floor(count(*) * {q}), count(*) - 1) AS BIGINT) + 1] AS {n}" for n, q in (("median", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))) + " FROM events WHERE value IS NOT NULL"


@register(PERCENTILES_SQL.format(keys=""))
def latency_percentiles(spark, sf_dir):
    return rounded(stats.index_percentiles(table(spark, sf_dir, "events"), "value"), "mean", digits=4)


@register(PERCENTILES_SQL.format(keys="event_type,") + " GROUP BY event_type")
def latency_percentiles_by_type(spark, sf_dir):
    return rounded(stats.index_percentiles(table(spark, sf_dir, "events"), "value", keys=["event_type"]), "mean", digits=4)


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0]


@register("SELECT CASE " + " ".join(f"WHEN value <= {b} THEN {b}::DOUBLE" for b in BOUNDS) + " ELSE 'inf'::DOUBLE END AS upper, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE value IS NOT NULL GROUP BY 1")
def histogram_buckets(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "events"), "value", BOUNDS), "total", digits=3)


@register("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS running_avg FROM events")
def running_avg(spark, sf_dir):
    return rounded(stats.running_average(table(spark, sf_dir, "events"), "value", "event_id", ["user_id"]), "running_avg", digits=9).select("event_id", "user_id", "running_avg")


@register("SELECT event_id, event_type, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS moving_avg FROM events")
def moving_avg_100(spark, sf_dir):
    return rounded(stats.moving_average(table(spark, sf_dir, "events"), "value", "event_id", ["event_type"]), "moving_avg", digits=9).select("event_id", "event_type", "moving_avg")


@register("SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda s, x: s * 0.9 + x * 0.1), 4) AS ema, count(*) AS samples FROM events WHERE value IS NOT NULL GROUP BY user_id")
def ema_latency(spark, sf_dir):
    return rounded(stats.exponential_average(table(spark, sf_dir, "events"), "value", "event_id", ["user_id"]), "ema", digits=4)


@register("""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(value), 4) AS avg_latency, max(value) AS max_latency,
round(count(*) FILTER (WHERE event_type = 'error') / count(*) * 100, 4) AS error_rate, round(count(*) FILTER (WHERE event_type <> 'error') / sum(value), 6) AS throughput FROM events GROUP BY user_id""")
def batch_stats(spark, sf_dir):
    out = stats.batch_statistics(table(spark, sf_dir, "events"), F.col("event_type") != "error", "value", ["user_id"])
    return rounded(rounded(out, "avg_latency", "error_rate", digits=4), "throughput")


@register("SELECT event_type AS metric, round(sum(value), 3) AS counter, arg_max(value, event_id) AS gauge, max(value) AS peak FROM events WHERE value IS NOT NULL GROUP BY event_type")
def counters_and_gauges(spark, sf_dir):
    return rounded(stats.counters_and_gauges(table(spark, sf_dir, "events"), "event_type", "value", "event_id"), "counter", digits=3)


@register("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def query_history(spark, sf_dir):
    return stats.latest(table(spark, sf_dir, "events"), "ts", 100, "event_id").select("event_id", "ts", "event_type")


SEGMENTS_SQL = """g AS (SELECT CAST(o_custkey % 20 AS INTEGER) AS segment, count(*) AS rows, CAST(sum(100 + length(o_orderpriority)) AS BIGINT) AS size_bytes,
CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 100 + length(o_orderpriority) ELSE 0 END) AS BIGINT) AS deleted_bytes, CASE WHEN o_custkey % 20 < 15 THEN 'immutable' ELSE 'active' END AS state FROM orders GROUP BY o_custkey % 20)"""


def _segments(spark, sf_dir) -> DataFrame:
    size = 100 + F.length("o_orderpriority")
    orders = table(spark, sf_dir, "orders").withColumn("segment", (F.col("o_custkey") % 20).cast("int")).withColumn("state", F.when(F.col("segment") < 15, "immutable").otherwise("active"))
    extra = orders.groupBy("segment").agg(F.sum(F.when(F.col("o_orderstatus") == "F", size).otherwise(0)).alias("deleted_bytes"))
    return stats.segment_stats(orders, "segment", size, "state").join(extra, "segment")


@register(f"WITH {SEGMENTS_SQL} SELECT state, count(*) AS segments, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, round(avg(size_bytes), 4) AS avg_size FROM g GROUP BY state")
def segment_totals(spark, sf_dir):
    return rounded(stats.segment_totals(_segments(spark, sf_dir), "state"), "avg_size", digits=4)


@register(f"WITH {SEGMENTS_SQL} SELECT segment, rows, size_bytes FROM g WHERE state = 'immutable' ORDER BY size_bytes, segment LIMIT 10")
def compaction_candidates(spark, sf_dir):
    return stats.compaction_candidates(_segments(spark, sf_dir), "segment").select("segment", "rows", "size_bytes")


@register(f"""WITH {SEGMENTS_SQL} SELECT count(*) AS segments, CAST(sum(deleted_bytes) AS BIGINT) AS space_saving, round(sum(deleted_bytes) / sum(size_bytes), 6) AS space_share, round((count(*) - 1) / count(*), 6) AS io_reduction,
round(sum(deleted_bytes) / sum(size_bytes) + (count(*) - 1) / count(*), 6) AS net_benefit FROM g""")
def compaction_benefit(spark, sf_dir):
    return rounded(stats.compaction_benefit(_segments(spark, sf_dir)), "space_share", "io_reduction", "net_benefit")


@register(f"""WITH {SEGMENTS_SQL}, h AS (SELECT count(*) AS segments, count(*) FILTER (WHERE rows % 4 <> 0) AS healthy FROM g)
SELECT segments, healthy, round(healthy / segments, 6) AS score, CASE WHEN healthy / segments < 0.5 THEN 'critical' WHEN healthy / segments < 0.8 THEN 'degraded' ELSE 'healthy' END AS status FROM h""")
def segment_health(spark, sf_dir):
    return rounded(stats.health(_segments(spark, sf_dir), F.col("rows") % 4 != 0), "score")


# --- operation logs ---------------------------------------------------------------------------------------------------------

OPS_SQL = "CASE WHEN event_id = 500 THEN 'clear' WHEN event_type IN ('error', 'signup') THEN 'delete' WHEN event_type = 'click' THEN 'update' ELSE 'insert' END"


def _log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), F.expr(OPS_SQL).alias("op"), F.col("user_id").alias("id"), "value")


REPLAY_SQL = f"l AS (SELECT event_id AS lsn, {OPS_SQL} AS op, user_id AS id, value FROM events), c AS (SELECT coalesce(max(lsn) FILTER (WHERE op = 'clear'), -1) AS m FROM l)"


@register(f"WITH {REPLAY_SQL}, r AS (SELECT l.*, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS n FROM l, c WHERE lsn > m) SELECT id, lsn, value FROM r WHERE n = 1 AND op <> 'delete'")
def oplog_replay(spark, sf_dir):
    return oplog.replay(_log(spark, sf_dir)).select("id", "lsn", "value")


@register(f"""WITH {REPLAY_SQL}, s AS (SELECT id, value, 800 AS lsn, 'insert' AS op FROM (SELECT l.*, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS n FROM l, c WHERE lsn > m AND lsn <= 800) WHERE n = 1 AND op <> 'delete'),
u AS (SELECT id, value, lsn, op FROM s UNION ALL SELECT id, value, lsn, op FROM l WHERE lsn > 800), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS n FROM u) SELECT id, value FROM r WHERE n = 1 AND op <> 'delete'""")
def snapshot_plus_suffix(spark, sf_dir):
    log = _log(spark, sf_dir)
    snapshot = oplog.replay(log.where("lsn <= 800")).select("id", "value")
    return oplog.recover(snapshot, log, 800)


@register("""WITH s AS (SELECT user_id AS id, value, event_id % 4 AS segment, event_type = 'error' AS gone, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY segment DESC, event_id DESC) AS n FROM s)
SELECT id, value, segment FROM r WHERE n = 1 AND NOT gone""")
def segment_merge(spark, sf_dir):
    """The newest version over four segments wins; a tombstone deletes."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "value", (F.col("event_id") % 4).alias("segment"), (F.col("event_type") == "error").alias("tomb"), "event_id")
    return oplog.merge_by_segment(rows.withColumn("version", F.struct("segment", "event_id")), "id", "version", F.col("tomb")).select("id", "value", "segment")


@register("WITH f AS (SELECT count(*) AS rows, count(DISTINCT vec_id) AS ids, count(*) FILTER (WHERE vec_id IS NULL OR embedding IS NULL OR len(embedding) <> 64) AS faulty FROM embeddings) SELECT *, faulty = 0 AND rows = ids AS valid FROM f")
def segment_validation(spark, sf_dir):
    return oplog.valid_segment(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)


# --- quantization -----------------------------------------------------------------------------------------------------------

@register("WITH p AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings) SELECT CAST(i AS INTEGER) AS i, round(min(x), 9) AS low, round(max(x), 9) AS high FROM p GROUP BY i")
def sq_train(spark, sf_dir):
    return rounded(quantize.component_ranges(table(spark, sf_dir, "embeddings")), "low", "high", digits=9)


SQ_SQL = """p AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings), t AS (SELECT i, min(x) AS low, max(x) AS high FROM p GROUP BY i),
c AS (SELECT vec_id, i, x, low, CASE WHEN high > low THEN 255 / (high - low) ELSE 1 END AS s, floor((least(greatest(x, low), high) - low) * (CASE WHEN high > low THEN 255 / (high - low) ELSE 1 END) + 0.5) AS q FROM p JOIN t USING (i))"""


@register(f"WITH {SQ_SQL} SELECT vec_id, CAST(sum(q) AS BIGINT) AS code_sum, CAST(max(q) AS INTEGER) AS code_max, round(avg((x - (low + q / s)) * (x - (low + q / s))), 9) AS mse FROM c GROUP BY vec_id")
def sq_encode_decode_error(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    sq = quantize.ScalarQuantizer.train(vectors)
    coded = vectors.select("vec_id", "embedding", sq.encode("embedding").alias("codes"))
    return coded.select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"), F.array_max("codes").cast("int").alias("code_max"), F.round(quantize.mean_squared_error("embedding", sq.decode("codes")), 9).alias("mse"))


PROJECTIONS_SQL = "pr AS (SELECT b, list_transform(r, lambda x: x / sqrt(list_sum(list_transform(r, lambda y: y * y)))) AS w FROM (SELECT b, list_transform(range(64), lambda j: sin(CAST(b * 64 + j AS DOUBLE))) AS r FROM (SELECT unnest(range(32)) AS b)))"
BITS_SQL = f"bits AS (SELECT vec_id, b, CAST({dot_sql('e', 'w')} > 0 AS INTEGER) AS s FROM v, pr)"


@register(f"WITH {V_SQL}, {PROJECTIONS_SQL}, {BITS_SQL}, y AS (SELECT vec_id, b // 8 AS i, CAST(sum(s * pow(2, b % 8)) AS INTEGER) AS c FROM bits GROUP BY vec_id, b // 8) SELECT vec_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY i) AS codes FROM y GROUP BY vec_id")
def bq_codes(spark, sf_dir):
    bq = quantize.BinaryQuantizer(64, 32)
    coded = bq.encoded(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return coded.select("vec_id", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


@register(f"""WITH {V_SQL}, {PROJECTIONS_SQL}, {BITS_SQL}, h AS (SELECT a.vec_id, CAST(sum(CASE WHEN a.s <> z.s THEN 1 ELSE 0 END) AS INTEGER) AS distance FROM bits a JOIN bits z ON a.b = z.b AND z.vec_id = 0 GROUP BY a.vec_id)
SELECT vec_id, distance FROM h ORDER BY distance, vec_id LIMIT 10""")
def bq_hamming_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    bq = quantize.BinaryQuantizer(64, 32)
    q = vectors.where("vec_id = 0").select(bq.encode("embedding")).first()[0]
    return quantize.hamming_top_k(bq.encoded(vectors.select("vec_id", "embedding")), q, 10)


@register("SELECT vec_id, CAST(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(least(greatest(x, 0.0), 1.0) * 255 + 0.5))) AS BIGINT) AS code_sum, CAST(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(least(greatest((x + 1) * 127.5, 0.0), 255.0)))) AS BIGINT) AS signed_sum FROM embeddings")
def unit_quantize(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", total(quantize.unit_encode("embedding")).alias("code_sum"), total(quantize.signed_encode("embedding")).alias("signed_sum"))


@register("SELECT vec_id, round(list_min(CAST(embedding AS DOUBLE[])), 9) AS low, round(list_max(CAST(embedding AS DOUBLE[])), 9) AS high, round(list_max(CAST(embedding AS DOUBLE[])) - list_min(CAST(embedding AS DOUBLE[])), 9) AS range, round(len(embedding) * 32.0::DOUBLE / ceil(len(embedding) * 8 / 8) / 8, 6) AS ratio FROM embeddings")
def batch_quantize_report(spark, sf_dir):
    return rounded(rounded(quantize.batch_report(table(spark, sf_dir, "embeddings")), "low", "high", "range", digits=9), "ratio")


PQ_SQL = f"""{V_SQL}, p AS (SELECT vec_id, s, e[s * 8 + 1 : s * 8 + 8] AS x FROM v, (SELECT unnest(range(8)) AS s)), b AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY vec_id) - 1 AS c, x AS y FROM p WHERE vec_id < 16),
n AS (SELECT p.vec_id, p.s, c, y, row_number() OVER (PARTITION BY p.vec_id, p.s ORDER BY list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c) AS r FROM p JOIN b USING (s)), k AS (SELECT * FROM n WHERE r = 1)"""


def _given_codebooks(vectors: DataFrame) -> quantize.ProductQuantizer:
    """Centroids that are parts of the first stored vectors."""
    rows = [list(r["embedding"]) for r in vectors.where("vec_id < 16").orderBy("vec_id").collect()]
    return quantize.ProductQuantizer(tuple(tuple(tuple(map(float, v[8 * s : 8 * s + 8])) for v in rows) for s in range(8)))


@register(f"WITH {PQ_SQL} SELECT vec_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY s) AS codes FROM k GROUP BY vec_id")
def pq_encode_given(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    pq = _given_codebooks(vectors)
    return vectors.select("vec_id", F.array_join(F.transform(pq.encode("embedding"), lambda c: c.cast("string")), ",").alias("codes"))


@register(f"""WITH {PQ_SQL}, d AS (SELECT k.vec_id, sum(list_sum(list_transform(list_zip(q[s * 8 + 1 : s * 8 + 8], y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM k, q GROUP BY k.vec_id), r AS (SELECT *, row_number() OVER (ORDER BY round(d, 9), vec_id) AS rank FROM d)
SELECT vec_id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def pq_adc_given(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    pq = _given_codebooks(vectors)
    return rounded(quantize.adc_top_k(vectors.select("vec_id", pq.encode("embedding").alias("codes")), pq, query_vector(vectors), 10), "distance")


@register()
def quantizer_choice(spark, sf_dir):
    """The coarsest quantizer whose error stays under a bound."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = [(float(most), quantize.choose(vectors, largest_mse=most)[0]) for most in (1e-4, 1e-2)]
    return spark.createDataFrame(rows, "largest_mse double, quantizer string")


@register()
def pq_train_encode(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    pq = quantize.ProductQuantizer.train(vectors)
    return vectors.select("vec_id", pq.encode("embedding").alias("codes")).withColumn("ratio", F.lit(pq.compression_ratio()))


@register()
def pq_adc_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    pq = quantize.ProductQuantizer.train(vectors)
    return rounded(quantize.adc_top_k(vectors.select("vec_id", pq.encode("embedding").alias("codes")), pq, query_vector(vectors), 10), "distance")


@register()
def compression_report(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    sq, pq = quantize.ScalarQuantizer.train(vectors), quantize.ProductQuantizer.train(vectors)
    scalar = quantize.quality(vectors, "embedding", sq.decode(sq.encode("embedding")), 64 * 8).withColumn("quantizer", F.lit("scalar"))
    return scalar.unionByName(quantize.quality(vectors, "embedding", pq.decode(pq.encode("embedding")), 8 * 4).withColumn("quantizer", F.lit("product")))


@register()
def multilevel_error(spark, sf_dir):
    """Two levels of codes leave less error than the first alone."""
    vectors = table(spark, sf_dir, "embeddings")
    q = quantize.MultiLevelQuantizer.train(vectors, iterations=5)
    codes = vectors.select("embedding", q.encode("embedding").alias("c"))
    return codes.agg(
        F.round(F.avg(quantize.mean_squared_error("embedding", q.coarse.decode(F.col("c")["coarse"]))), 6).alias("coarse_mse"),
        F.round(F.avg(quantize.mean_squared_error("embedding", q.decode(F.col("c")))), 6).alias("mse"),
    )


# --- approximate search -----------------------------------------------------------------------------------------------------

def _recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return rounded(search.recall(found, truth, k).agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.min("recall").alias("worst")), "recall", "worst")


def _recall_and_share(found: DataFrame, truth: DataFrame, k: int, rows: int) -> DataFrame:
    """Recall beside the share of the table that a query met; both results are read once."""
    both = truth.where(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("true"), F.lit(0).alias("hit"), F.lit(0).cast("long").alias("met"))
    both = both.unionByName(found.where(F.col("rank") <= k).select("query_id", "vec_id", F.lit(0).alias("true"), F.lit(1).alias("hit"), "met"))
    pairs = both.groupBy("query_id", "vec_id").agg(F.max("true").alias("true"), F.max("hit").alias("hit"), F.max("met").alias("met"))
    each = pairs.groupBy("query_id").agg((F.sum(F.col("true") * F.col("hit")) / F.sum("true")).alias("recall"), F.max("met").alias("met"))
    return rounded(each.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.min("recall").alias("worst"), (F.avg("met") / rows).alias("share")), "recall", "worst", "share")


@register()
def recall_at_10_cells(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    cells, asked = ann.InvertedLists.train(vectors, 128, "cosine", 8), _queries(vectors)
    return _recall_and_share(cells.search_batch(cells.index(vectors), asked, 10, 52), search.batch_top_k(vectors, asked, 10), 10, vectors.count())


@register()
def recall_at_10_hyperplanes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    lsh, asked = ann.HyperplaneHashing(64), _queries(vectors)
    return _recall_and_share(lsh.search_batch(lsh.index(vectors), asked, 10), search.batch_top_k(vectors, asked, 10), 10, vectors.count())


@register()
def recall_at_10_graph(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return _recall(graph.graph_search(vectors, _queries(vectors), 10), search.batch_top_k(vectors, _queries(vectors), 10), 10)


@register()
def recall_at_10_stored_graph(spark, sf_dir):
    """Graphs that are stored, half of them by a later batch, then searched through a collection and in a batch."""
    vectors = table(spark, sf_dir, "embeddings")
    path = f"{_stream_root(spark)}/graphs"
    graph.write_graphs(vectors.where("vec_id % 2 = 0"), path)
    index = graph.write_graphs(vectors.where("vec_id % 2 = 1"), path)
    return _recall(graph.search_graphs(index, _queries(vectors), 10), search.batch_top_k(vectors, _queries(vectors), 10), 10)


@register()
def graph_statistics(spark, sf_dir):
    return rounded(graph.graph_stats(graph.graph_edges(table(spark, sf_dir, "embeddings"))), "avg_degree")


@register()
def kmeans_cells(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    cells = ann.InvertedLists.train(vectors, 10, "euclidean", 10)
    return cells.index(vectors).groupBy("cell").agg(F.count("*").alias("n"))


@register("SELECT * FROM (VALUES ('exact', 'flat'), ('few', 'flat'), ('many_results', 'flat'), ('wide', 'cells'), ('narrow', 'graph')) t(request, strategy)")
def strategy_choice(spark, sf_dir):
    asked = {"exact": (64, 10, None, 1.0, True), "few": (64, 10, 1000), "many_results": (64, 200), "wide": (1024, 10), "narrow": (64, 10)}
    return spark.createDataFrame([(k, planner.choose_strategy(*a)) for k, a in asked.items()], "request string, strategy string")


@register("SELECT * FROM (VALUES ('plan', 2, 6, 6), ('optimized', 2, 6, 4)) t(plan, phases, shards, parallelism)")
def distributed_plan(spark, sf_dir):
    p = planner.plan([f"s{i}" for i in range(6)], ["a", "b"])
    rows = [(n, len(x.phases), sum(len(y.shards) for y in x.phases), x.parallelism) for n, x in (("plan", p), ("optimized", planner.optimized(p)))]
    return spark.createDataFrame(rows, "plan string, phases int, shards int, parallelism int")


# --- placement --------------------------------------------------------------------------------------------------------------

NODES = tuple(f"node{i}" for i in range(5))
SHA_SQL = "CAST(('0x' || sha256({})[1:16]) AS UBIGINT)"
RING_SQL = f"""ring AS (SELECT n AS node, {SHA_SQL.format("n || '-' || i")} AS h FROM (SELECT unnest(['node0', 'node1', 'node2', 'node3', 'node4']) AS n), (SELECT unnest(range(160)) AS i)),
k AS (SELECT c_custkey, {SHA_SQL.format("CAST(c_custkey AS VARCHAR)")} AS h FROM customer), placed AS (SELECT c_custkey, coalesce(
(SELECT arg_min(node, r.h) FROM ring r WHERE r.h >= k.h), (SELECT arg_min(node, r.h) FROM ring r)) AS node FROM k)"""


@register(f"WITH {RING_SQL} SELECT c_custkey, node FROM placed")
def ring_sha256_placement(spark, sf_dir):
    ring = placement.Ring(NODES, 160)
    return ring.place(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.col("owners")[0].alias("node"))


@register()
def ring_crc32_placement(spark, sf_dir):
    ring = placement.Ring(NODES, 3, "crc32")
    return ring.place(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 3).select("c_custkey", F.array_join("owners", ",").alias("owners"))


@register(f"WITH {RING_SQL}, l AS (SELECT node, count(*) AS n FROM placed GROUP BY node) SELECT node, n, round(n / (SELECT sum(n) FROM l), 9) AS share, round(abs(n / (SELECT sum(n) FROM l) - 0.2), 9) AS deviation, abs(n / (SELECT sum(n) FROM l) - 0.2) <= 0.05 AS balanced FROM l")
def ring_load(spark, sf_dir):
    ring = placement.Ring(NODES, 160)
    return rounded(placement.balanced(placement.load(ring.place(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")), 5, 0.05), "share", "deviation", digits=9)


@register(f"""WITH {RING_SQL}, six AS (SELECT * FROM ring UNION ALL SELECT 'node5', {SHA_SQL.format("'node5-' || i")} FROM (SELECT unnest(range(160)) AS i)),
after AS (SELECT c_custkey, coalesce((SELECT arg_min(node, r.h) FROM six r WHERE r.h >= k.h), (SELECT arg_min(node, r.h) FROM six r)) AS target FROM k)
SELECT c_custkey, node AS source, target FROM placed JOIN after USING (c_custkey) WHERE node <> target""")
def ring_rebalance(spark, sf_dir):
    ring = placement.Ring(NODES, 160)
    return placement.moves(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", ring, ring.with_node("node5"))


@register("""WITH k AS (SELECT s_suppkey, CAST(('0x' || sha256(CAST(s_suppkey AS VARCHAR))[1:16]) AS UBIGINT) AS h FROM supplier)
SELECT s_suppkey, CAST(h // 4611686018427387904 AS INTEGER) AS shard, h >= 16000000000000000000 OR h <= 2000000000000000000 AS around FROM k""")
def hash_range_shards(spark, sf_dir):
    h = placement.sha256_hash("s_suppkey")
    wrapped = placement.in_range(h, F.lit("16000000000000000000").cast("decimal(20,0)"), F.lit("2000000000000000000").cast("decimal(20,0)"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", placement.shard_of("s_suppkey", 4).alias("shard"), wrapped.alias("around"))


@register(f"WITH {RING_SQL} SELECT c_custkey, 3::BIGINT AS copies, 3::BIGINT AS nodes, node AS first_node FROM placed")
def replicated_put(spark, sf_dir):
    """Each key on three nodes, all different, the first by the ring."""
    copies = placement.replicate(table(spark, sf_dir, "customer").select("c_custkey"), placement.Ring(NODES, 160), "c_custkey", 3)
    return copies.groupBy("c_custkey").agg(F.count("*").alias("copies"), F.count_distinct("node").alias("nodes"), F.max(F.when(F.col("replica") == 0, F.col("node"))).alias("first_node"))


@register("""WITH n AS (SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'failed' WHEN s_suppkey % 5 = 0 THEN 'joining' ELSE 'active' END AS state FROM supplier), c AS (SELECT count(*) AS nodes, count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'failed') AS failed FROM n)
SELECT *, CASE WHEN active * 2 < nodes THEN 'critical' WHEN active < nodes THEN 'degraded' ELSE 'healthy' END AS status FROM c""")
def cluster_health(spark, sf_dir):
    state = F.when(F.col("s_suppkey") % 7 == 0, "failed").when(F.col("s_suppkey") % 5 == 0, "joining").otherwise("active")
    return placement.cluster_health(table(spark, sf_dir, "supplier").select(state.alias("state")))


# --- streaming --------------------------------------------------------------------------------------------------------------

def _stream_root(spark: SparkSession) -> str:
    """A folder that all executors share: beside the checkpoints, or a temporary one where none is named."""
    import atexit
    import shutil
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="halyard-stream-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


@register("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id, round(value, 4) AS value FROM r WHERE n = 1 AND event_type <> 'error'")
def stream_transform_upsert(spark, sf_dir):
    """A file stream, transformed and upserted by user; errors delete."""
    root = _stream_root(spark)
    source = stream.read_files(spark, sf_dir, table(spark, sf_dir, "events").schema, glob="events.parquet")
    query = stream.upsert_stream(source.select("user_id", "event_id", "event_type", "value"), f"{root}/table", f"{root}/state", "user_id", "event_id", F.col("event_type") == "error")
    query.awaitTermination()
    return rounded(stream.read_table(spark, f"{root}/table"), "value", digits=4).select("user_id", "event_id", "value")


@register("""WITH n AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 2) AS t FROM embeddings WHERE label <> 3), m AS (SELECT vec_id, list_transform(t, lambda x: x / sqrt(list_sum(list_transform(t, lambda y: y * y)))) AS u FROM n)
SELECT vec_id, CAST(list_sum(list_transform(u, lambda x: floor(least(greatest((x + 1) * 127.5, 0.0), 255.0)))) AS BIGINT) AS code_sum FROM m""")
def stream_processor_chain(spark, sf_dir):
    steps = stream.chain(stream.filtered(P.ne("label", 3)), stream.normalized("embedding"), stream.quantized("embedding"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", V.scale("embedding", 2.0))
    return steps(vectors).select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"))


@register("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id >= 300), l AS (SELECT * FROM r WHERE n = 1), b AS (SELECT user_id, max(value) AS value FROM events WHERE event_id < 300 GROUP BY user_id)
SELECT user_id, value FROM b WHERE user_id NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, value FROM l WHERE event_type <> 'error'""")
def batch_operations(spark, sf_dir):
    """Inserts, updates and deletes of a batch in order, over a table."""
    events = table(spark, sf_dir, "events")
    base = events.where("event_id < 300").groupBy("user_id").agg(F.max("value").alias("value"))
    ops = events.where("event_id >= 300").select("user_id", "value", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "update").otherwise("insert").alias("op"))
    return stream.apply_operations(base, ops, "user_id")[0]


@register("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 4) AS avg_value, max(value) AS max_value FROM events GROUP BY 1, 2")
def windowed_statistics(spark, sf_dir):
    return rounded(stream.windowed_stats(table(spark, sf_dir, "events"), "ts", "value", ["event_type"]), "avg_value", digits=4)


@register("SELECT event_id, user_id, row_number() OVER (ORDER BY user_id % 5 DESC, event_id) AS place FROM events")
def priority_order(spark, sf_dir):
    batch = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 5).alias("priority"), F.col("event_id").alias("seq"))
    return stats.positions(batch, [F.desc("priority"), "seq"]).select("event_id", "user_id", "place")


@register("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place, true AS sound FROM events")
def log_append(spark, sf_dir):
    """Entries appended in two batches: numbers follow the order, checksums are right."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", F.lit("insert").alias("op"), F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("seq")).drop("ts")
    empty = spark.createDataFrame([], "lsn long, event_id long, op string, id long, crc long")
    log = oplog.append(empty, events, "seq")
    sound = F.col("crc").eqNullSafe(oplog.checksum("lsn", "event_id", "op", "id"))
    return stats.positions(log, ["lsn"]).select("event_id", "place", sound.alias("sound"))


@register(f"WITH {REPLAY_SQL}, r AS (SELECT l.*, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS n FROM l, c WHERE lsn > m) SELECT id, value FROM r WHERE n = 1 AND op <> 'delete'")
def crash_recovery(spark, sf_dir):
    """Snapshot, log truncated at it, and the state from what is stored."""
    root, log = _stream_root(spark), _log(spark, sf_dir)
    oplog.checkpoint(log, oplog.replay(log.where("lsn <= 400")).select("id", "value"), 400, f"{root}/snapshots", f"{root}/log")
    suffix = oplog.checkpoint(log, oplog.replay(log.where("lsn <= 800")).select("id", "value"), 800, f"{root}/snapshots", f"{root}/log")
    return oplog.recover_from(spark, f"{root}/snapshots", suffix)


@register("SELECT count(*) AS rows, 0::BIGINT AS errors FROM events")
def stream_progress(spark, sf_dir):
    root = _stream_root(spark)
    source = stream.read_files(spark, sf_dir, table(spark, sf_dir, "events").schema, glob="events.parquet")
    query = stream.append_stream(source.select("event_id", "value"), f"{root}/table", f"{root}/state")
    query.awaitTermination()
    p = stream.progress(query)
    return spark.createDataFrame([(p["rows"], p["errors"])], "rows long, errors long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered exact search."""
    return _knn("cosine", P.isin("label", [0, 1, 2, 3, 4]))(spark, sf_dir)
