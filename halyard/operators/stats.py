"""Statistics over collections, fields, segments, samples and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions import predicates as P


def value_counts(df: DataFrame, field: str) -> DataFrame:
    """Documents per value of a field (posting sizes); rows without it don't count."""
    return df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))


def categorical_stats(df: DataFrame, field: str) -> DataFrame:
    """Distinct values, documents, mean and largest posting, and an estimate of an index's bytes (200 a value and its length, 50 a posting)."""
    counts = value_counts(df, field)
    return counts.agg(
        F.count("*").alias("distinct_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.avg("n").alias("avg_posting"), F.max("n").alias("max_posting"),
        F.coalesce(F.sum(200 + F.length(F.col("value").cast("string")) + 50 * F.col("n")), F.lit(0)).cast("long").alias("memory_bytes"),
    )


def numeric_stats(df: DataFrame, field: str) -> DataFrame:
    """Smallest, largest and distinct finite values, and how many are null, NaN or infinite."""
    x = F.col(field).cast("double")
    infinite = x.isin(float("inf"), float("-inf"))
    finite = F.when(~F.isnan(x) & ~infinite, x)
    return df.agg(
        F.min(finite).alias("min_value"), F.max(finite).alias("max_value"), F.count_distinct(finite).alias("distinct_values"), F.count(x).alias("present"),
        F.count_if(x.isNull()).alias("nulls"), F.count_if(x.isNotNull() & F.isnan(x)).alias("nans"), F.count_if(infinite).alias("infinities"),
    )


def actual_selectivity(df: DataFrame, f: P.Filter) -> DataFrame:
    """Matches, rows and their ratio."""
    hit = f.validate().column(df.schema)
    return df.agg(F.count_if(hit).alias("matches"), F.count("*").alias("total"), F.try_divide(F.count_if(hit), F.count("*")).alias("selectivity"))


def estimated_selectivity(f: P.Filter, distinct: dict[str, int]) -> float:
    """A guess from the number of distinct values of fields: eq 1/distinct, in 0.2, ranges 0.3, other leaves 0.1."""
    if isinstance(f, P.Field):
        if f.op == "eq":
            return 1 / distinct[f.name] if distinct.get(f.name) else 0.1
        return 0.2 if f.op == "in" else 0.3 if f.op in P.COMPARISONS else 0.1
    if isinstance(f, P.Or):
        return min(1.0, sum(estimated_selectivity(c, distinct) for c in f.children))
    if isinstance(f, P.And):
        out = 1.0
        for c in f.children:
            out *= estimated_selectivity(c, distinct)
        return out
    return 1 - estimated_selectivity(f.child, distinct) if isinstance(f, P.Not) else 0.5


def segment_stats(df: DataFrame, segment: str, size: Column, state: str | None = None) -> DataFrame:
    """Rows and bytes of each segment (and state)."""
    return df.groupBy(segment, *([state] if state else [])).agg(F.count("*").alias("rows"), F.sum(size).alias("size_bytes"))


def segment_totals(segments: DataFrame, state: str) -> DataFrame:
    """Segments, rows and bytes by state, and the mean size."""
    return segments.groupBy(state).agg(F.count("*").alias("segments"), F.sum("rows").alias("rows"), F.sum("size_bytes").alias("size_bytes"), F.avg("size_bytes").alias("avg_size"))


def health(segments: DataFrame, valid: Column) -> DataFrame:
    """Share of valid segments and a status: below 0.5 critical, below 0.8 degraded. No segments are healthy."""
    score = F.coalesce(F.try_divide(F.count_if(valid), F.count("*")), F.lit(1.0))
    return segments.agg(F.count("*").alias("segments"), F.count_if(valid).alias("healthy"), score.alias("score")).withColumn(
        "status", F.when(F.col("score") < 0.5, "critical").when(F.col("score") < 0.8, "degraded").otherwise("healthy")
    )


def compaction_candidates(segments: DataFrame, id: str, state: str = "state", most: int = 10) -> DataFrame:
    """The smallest immutable segments, at most `most`; none unless there are two."""
    chosen = segments.where(F.col(state) == "immutable").orderBy("size_bytes", id).limit(most)
    return chosen.withColumn("_n", F.count("*").over(Window.partitionBy())).where("_n >= 2").drop("_n")  # at most `most` rows


def compaction_benefit(segments: DataFrame) -> DataFrame:
    """Of merging the segments: bytes of deleted rows saved, reads saved (n - 1) / n, and their sum as shares."""
    n = F.count("*")
    saved = F.try_divide(F.sum("deleted_bytes"), F.sum("size_bytes"))
    io = F.when(n > 0, (n - 1) / n)
    return segments.agg(n.alias("segments"), F.sum("deleted_bytes").alias("space_saving"), saved.alias("space_share"), io.alias("io_reduction"), (saved + io).alias("net_benefit"))


def index_percentiles(df: DataFrame, value: str, quantiles: Sequence[tuple[str, float]] = (("median", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)), keys: Sequence[str] = ()) -> DataFrame:
    """min, max, mean and the values at place floor(n * q) of the sorted values (from 0), of each group.

    Places are found by counting equal values first, so the sort runs over distinct values of pre-aggregated counts; ungrouped, it
    is a range sort over all tasks, with totals carried from one to the next.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.min("_x").alias("min"), F.max("_x").alias("max"), (F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("mean"))
    placed = counts.withColumn("_to", F.sum("_n").over(up)) if keys else running_total(counts, "_x", "_n", "_to")
    joined = placed.join(total, list(keys)) if keys else placed.crossJoin(F.broadcast(total))  # one row
    place = lambda q: F.least(F.floor(F.col("_total") * q), F.col("_total") - 1)
    at = [F.max(F.when((F.col("_to") > place(q)) & (F.col("_to") - F.col("_n") <= place(q)), F.col("_x"))).alias(name) for name, q in quantiles]
    return joined.groupBy(*keys).agg(F.first("_total").alias("n"), F.first("min").alias("min"), F.first("max").alias("max"), F.first("mean").alias("mean"), *at)


def running_total(df: DataFrame, order: str | Sequence[Column | str], n: str, to: str) -> DataFrame:
    """df with the sum of n up to each row in a global order: a range sort, sums within each task, and an offset a task.

    The sorted rows are kept until the application ends or Spark drops them, so that both uses see the same tasks.
    """
    ordered = df.orderBy(*([order] if isinstance(order, str) else order)).withColumn("_m", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_m", 33)
    sums = ordered.groupBy(part.alias("_p")).agg(F.sum(n).alias("_s")).orderBy("_p").collect()  # a row a task
    offsets, total = [], 0
    for r in sums:
        offsets.append((r["_p"], total))
        total += r["_s"]
    before = df.sparkSession.createDataFrame(offsets, "_p long, _before long")
    own = F.sum(n).over(Window.partitionBy(part).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))
    return ordered.withColumn(to, own).withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(to, F.col(to) + F.col("_before")).drop("_m", "_p", "_before")


def positions(df: DataFrame, order: Sequence[Column | str], to: str = "place") -> DataFrame:
    """df with each row's place (from 1) in a global order, without a window over all rows."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", to).drop("_one")


#: Upper bounds of buckets, in seconds, where the caller names none.
SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram(df: DataFrame, value: str, bounds: Sequence[float] = SECONDS) -> DataFrame:
    """Counts per bucket, not cumulative: the first bound >= value, or infinity."""
    bucket = F.lit(float("inf"))
    for b in sorted(bounds, reverse=True):
        bucket = F.when(F.col(value) <= b, float(b)).otherwise(bucket)
    return df.where(F.col(value).isNotNull()).groupBy(bucket.alias("upper")).agg(F.count("*").alias("n"), F.sum(F.col(value)).alias("total"))


def _in_tasks(df: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    """df in the order of keys and order over all tasks, so that a hot key spans many, with the task (_p) and the place in it (_m)."""
    return df.orderBy(*keys, order).withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))


def _carried(ordered: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """ordered (kept) with sums over the rows of the same key in earlier tasks, 0 where there are none.

    Only the first key of a task goes on from others, so what is broadcast is a row a task at most.
    """
    each = ordered.groupBy("_p", *keys).agg(*[s.alias(n) for n, s in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(F.col("_p").alias("_q"), *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *[F.sum(n).over(earlier).alias(n) for n in sums], F.count("*").over(earlier).alias("_tasks"))
    on = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    out = ordered.join(F.broadcast(before.where("_tasks > 0")), on, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in sums}).drop("_q", "_tasks", *[f"_k{i}" for i in range(len(keys))])


def running_average(df: DataFrame, value: str, order: str, keys: Sequence[str]) -> DataFrame:
    """Mean of the values up to each row, in the order within each key: sums within tasks and what earlier tasks carry over."""
    x = F.col(value).cast("double")
    rows = _carried(_in_tasks(df, order, keys).persist(), keys, _s=F.coalesce(F.sum(x), F.lit(0.0)), _c=F.count(x))
    up = Window.partitionBy("_p", *keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    total, n = F.col("_s") + F.coalesce(F.sum(x).over(up), F.lit(0.0)), F.col("_c") + F.count(x).over(up)
    return rows.withColumn("running_avg", F.try_divide(total, n)).drop("_m", "_p", "_s", "_c")


def moving_average(df: DataFrame, value: str, order: str, keys: Sequence[str], width: int = 100, block: int = 65_536) -> DataFrame:
    """Mean over the last `width` rows of each key, this one included.

    The rows of a key are cut into blocks of `block` by their place; the last rows of a block are copied to the next one, so the
    windows of a hot key run in many tasks.
    """
    block = max(block, width)
    rows = _carried(_in_tasks(df, order, keys).persist(), keys, _c=F.count("*"))
    place = F.col("_c") + F.row_number().over(Window.partitionBy("_p", *keys).orderBy("_m")) - 1
    own = F.floor(F.col("_n") / block)
    copies = F.when(F.col("_n") % block > block - width, F.array(own, own + 1)).otherwise(F.array(own))
    cut = rows.withColumn("_n", place).withColumn("_own", own).withColumn("_block", F.explode(copies))
    last = Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(-(width - 1), 0)
    return cut.withColumn("moving_avg", F.avg(value).over(last)).where("_own = _block").drop("_m", "_p", "_c", "_n", "_own", "_block")


def exponential_average(df: DataFrame, value: str, order: str, keys: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """The last exponentially weighted average of each group, started with its first value.

    The weight of the i-th value from the end is alpha * (1 - alpha)**i ((1 - alpha)**i for the first): a sum over a rank, not a
    fold over a collected list. Tasks weigh from their own end; a task's sum then fades by the number of values after it.
    """
    fade = lambda i: F.pow(F.lit(1 - alpha), i)
    ordered = _in_tasks(df.where(F.col(value).isNotNull()), order, keys)
    back = F.row_number().over(Window.partitionBy("_p", *keys).orderBy(F.desc("_m"))) - 1
    parts = ordered.withColumn("_i", back).groupBy("_p", *keys).agg(F.sum(alpha * fade(F.col("_i")) * F.col(value)).alias("_s"), F.count("*").alias("_n"), F.min_by(value, "_m").alias("_first"))
    by_task = Window.partitionBy(*keys).orderBy("_p")
    after = F.coalesce(F.sum("_n").over(by_task.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    joined = parts.withColumn("_after", after).withColumn("_start", F.row_number().over(by_task) == 1)
    start = F.when(F.col("_start"), (1 - alpha) * fade(F.col("_after") + F.col("_n") - 1) * F.col("_first")).otherwise(0.0)
    return joined.groupBy(*keys).agg(F.sum(fade(F.col("_after")) * F.col("_s") + start).alias("ema"), F.sum("_n").alias("samples"))


def batch_statistics(df: DataFrame, ok: Column, latency: str, keys: Sequence[str] = ()) -> DataFrame:
    """Operations in all, done and failed, mean and largest latency, and done per unit of latency."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.avg(latency).alias("avg_latency"), F.max(latency).alias("max_latency"),
        (F.try_divide(F.count_if(~ok), F.count("*")) * 100).alias("error_rate"), F.try_divide(F.count_if(ok), F.sum(latency)).alias("throughput"),
    )


def counters_and_gauges(df: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """Of each metric the sum (a counter), the last value (a gauge) and the largest."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(name).alias("metric")).agg(F.sum(value).alias("counter"), F.max_by(value, order).alias("gauge"), F.max(value).alias("peak"))


def latest(df: DataFrame, order: str, limit: int, tie: str) -> DataFrame:
    """History: newest first, at most limit."""
    return df.orderBy(F.desc(order), F.desc(tie)).limit(limit)


def centroids(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group."""
    parts = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
