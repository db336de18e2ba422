"""Profiles, latency reports, capacity cost and the metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.skew import HOT_ROWS, exact_percentiles

# Fixed values of the cost model
TARGET_RPS = 10_000
WORKERS_PER_POD = 16
API_VCPU_PER_POD = 4
RETRIEVAL_VCPU_PER_POD = 4
COST_PER_VCPU_HOUR = 0.04
HEADROOM = 0.40
STORES_COST_PER_HOUR = 1.20
QUERIES_PER_REQUEST = 4
ANN_LATENCY_MS = 2.0
GPU_HOURS_PER_DAY = 2.0
GPU_COST_PER_HOUR = 1.0
LLM_COST_PER_CALL = 0.0005

MAX_CATEGORY_SHARE = 0.35
ALL = "Aggregated"


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, nulls, mean, std, min, quartiles and max of numeric columns, one row per column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(pairs.alias("p")).select("p.column", "p.v")
    shape = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("v").isNull()).alias("nulls"),
        F.round(F.avg("v"), 6).alias("mean"),
        F.round(F.stddev_samp("v"), 6).alias("std"),
        F.round(F.min("v"), 6).alias("min"),
        F.round(F.max("v"), 6).alias("max"),
    )
    quartiles = exact_percentiles(long, ["column"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    rounded = quartiles.select("column", *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")])
    return shape.join(rounded, "column", "left")


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def shape_and_types(df: DataFrame) -> DataFrame:
    """(position, column, type, n_rows, n_columns): one row per column, the rows counted once."""
    kinds = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type")) for i, (c, t) in enumerate(df.dtypes)])
    counted = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(kinds).alias("_c"), "n_rows")
    return counted.select("_c.*", "n_rows", F.lit(len(df.columns)).alias("n_columns"))


def split_report(frames: dict[str, DataFrame], dated: tuple[str, ...] = ("train", "val")) -> DataFrame:
    rows = None
    for name, frame in frames.items():
        day = F.col("t_dat") if name in dated else F.lit(None).cast("date")
        row = frame.agg(
            F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
        ).select(F.lit(name).alias("frame"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def upsert_metrics(existing: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """The new rows replace those of the same model; the rest stays."""
    return existing.join(new, key, "left_anti").unionByName(new)


def stage_latency(samples: DataFrame, stage: str, millis: str) -> DataFrame:
    return samples.filter(F.col(millis).isNotNull()).groupBy(stage).agg(
        F.count(F.lit(1)).alias("latency_count"), F.round(F.sum(millis), 3).alias("latency_sum")
    )


def latency_report(requests: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per endpoint and over all: requests, failures, spread of the response time and throughput.

    The Aggregated row is one group with every request, so percentiles come from counted values and running totals.
    """
    both = F.explode(F.array(F.col("endpoint"), F.lit(ALL)))
    named = requests.select(both.alias("name"), "response_time_ms", "success", "ts")
    seconds = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    shape = named.groupBy("name").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~F.col("success")).alias("failures"),
        F.min("response_time_ms").alias("min_ms"),
        F.max("response_time_ms").alias("max_ms"),
        F.round(F.avg("response_time_ms"), 6).alias("mean_ms"),
        F.round(F.try_divide(F.count(F.lit(1)), seconds / F.lit(1e6)), 6).alias("requests_per_s"),
    )
    points = exact_percentiles(named, ["name"], "response_time_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, hot_rows)
    return shape.join(points.select("name", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")]), "name", "left")


def latency_histogram(requests: DataFrame, bins: int = 40) -> DataFrame:
    """Equal bins between the smallest and largest value; the last bin includes its upper edge."""
    v = F.col("response_time_ms")
    lo, hi = requests.select(F.min(v)).scalar(), requests.select(F.max(v)).scalar()
    width = (hi - lo) / F.lit(float(bins))
    at = F.least(F.lit(bins), F.floor(F.try_divide(v - lo, width)) + 1)
    counts = requests.select(F.coalesce(at, F.lit(1)).cast("int").alias("bin")).groupBy("bin")
    return counts.agg(F.count(F.lit(1)).alias("requests"))


def _ceil(c: Column) -> Column:
    return F.ceil(c).cast("bigint")


def capacity(report: DataFrame, target_rps: int = TARGET_RPS) -> DataFrame:
    """Pods and cost that the mean latency of each row implies."""
    rps = F.lit(float(target_rps))
    per_pod = F.try_divide(F.lit(float(WORKERS_PER_POD)), F.col("mean_ms") / 1000.0)
    cores = rps * QUERIES_PER_REQUEST * (ANN_LATENCY_MS / 1000.0)
    hourly = (
        F.col("api_pods") * API_VCPU_PER_POD * F.lit(COST_PER_VCPU_HOUR)
        + F.col("retrieval_pods") * RETRIEVAL_VCPU_PER_POD * F.lit(COST_PER_VCPU_HOUR)
        + F.lit(STORES_COST_PER_HOUR)
    )
    online = F.col("cost_per_hour") / (rps * 3600) * 1000
    offline = F.lit(GPU_HOURS_PER_DAY * GPU_COST_PER_HOUR) / (rps * 86400) * 1000
    return (
        report.select("name", "mean_ms")
        .withColumn("in_flight", rps * F.col("mean_ms") / 1000.0)
        .withColumn("throughput_per_pod", per_pod)
        .withColumn("api_pods", _ceil(F.try_divide(rps, F.col("throughput_per_pod")) * F.lit(1 + HEADROOM)))
        .withColumn("retrieval_pods", _ceil(cores / RETRIEVAL_VCPU_PER_POD))
        .withColumn("cost_per_hour", hourly)
        .withColumn("cost_per_1000", online + offline)
        .withColumn("cost_per_million", F.col("cost_per_1000") * 1000)
        .withColumn("llm_cost_per_million", F.lit(LLM_COST_PER_CALL * 1000 * 1000))
        .withColumn("llm_multiple", F.try_divide(F.lit(LLM_COST_PER_CALL * 1000), F.col("cost_per_1000")))
    )


def mean_latency_for(report: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Mean latency of each asked endpoint, or of the aggregate row where the endpoint is not in the report."""
    whole = report.filter(F.col("name") == ALL).select(F.max("mean_ms")).scalar()
    return endpoints.join(report.select("name", "mean_ms"), "name", "left").withColumn(
        "mean_ms", F.coalesce("mean_ms", whole)
    )


def category_share(lists: DataFrame, list_key: str = "list_id") -> DataFrame:
    """Share of each category in a list, and whether it is above the cap."""
    named = lists.withColumn("category", F.coalesce("category_l1", F.lit("unknown")))
    counts = named.groupBy(list_key, "category").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(list_key).agg(F.sum("n").alias("_total"))
    shared = counts.join(totals, list_key).withColumn("share", F.round(F.col("n") / F.col("_total"), 6))
    return shared.withColumn("over_cap", F.col("n") / F.col("_total") > F.lit(MAX_CATEGORY_SHARE)).drop("_total")
