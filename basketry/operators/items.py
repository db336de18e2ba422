"""Item statistics, metadata and centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import UNKNOWN, days_between
from basketry.functions.vectors import mean_vector

# Fixed values
CTR_SMOOTHING = 20.0
MISSING_DAYS = 9999.0


def item_stats(tx: DataFrame) -> DataFrame:
    return tx.groupBy("article_id").agg(F.min("t_dat").alias("first_seen"), F.avg("price").alias("avg_price"))


def item_meta(items: DataFrame, train: DataFrame, first_seen: str = "epoch") -> DataFrame:
    """Category, popularity, smoothed click rate, first day and mean price per item.

    Items without train rows start at 1970-01-01 (`first_seen="epoch"`, for training) or on the last train day
    (`"reference"`, for serving).
    """
    n = F.coalesce("n_interactions", F.lit(0))
    top = F.coalesce(F.nullif(items.select(F.max("n_interactions")).scalar(), F.lit(0)), F.lit(1))
    start = F.lit("1970-01-01").cast("date") if first_seen == "epoch" else train.select(F.max("t_dat")).scalar()
    return items.join(item_stats(train), "article_id", "left").select(
        "article_id",
        F.coalesce("category_l1", F.lit(UNKNOWN)).alias("category_l1"),
        (n / top).alias("popularity"),
        (n / (n + F.lit(CTR_SMOOTHING))).alias("ctr"),
        F.coalesce("first_seen", start).alias("first_seen"),
        F.coalesce("avg_price", F.lit(0.0)).alias("avg_price"),
    )


def days_since_first_seen(meta: DataFrame, now: Column) -> DataFrame:
    return meta.withColumn("days_since_first_seen", days_between(now, F.col("first_seen")).cast("double"))


def with_meta(rows: DataFrame, meta: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Item metadata, or the default row for items that have none."""
    joined = rows.join(meta, by or ["article_id"], "left")
    return joined.select(
        *rows.columns,
        F.coalesce("category_l1", F.lit(UNKNOWN)).alias("category_l1"),
        F.coalesce("popularity", F.lit(0.0)).alias("popularity"),
        F.coalesce("ctr", F.lit(0.0)).alias("ctr"),
        F.coalesce("avg_price", F.lit(0.0)).alias("avg_price"),
        F.coalesce("days_since_first_seen", F.lit(MISSING_DAYS)).alias("days_since_first_seen"),
    )


def category_centroids(items: DataFrame, vectors: DataFrame) -> DataFrame:
    return items.join(vectors, "article_id").groupBy("category_l1").agg(mean_vector(F.col("vector")).alias("centroid"))


def global_centroid(vectors: DataFrame) -> DataFrame:
    return vectors.agg(mean_vector(F.col("vector")).alias("centroid"))
