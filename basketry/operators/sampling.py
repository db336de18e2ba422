"""Recent window, densest customers and articles, and the split on time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import age_band
from basketry.operators.skew import first_n, running_total
from basketry.session import durable


@dataclass(frozen=True)
class SampleSpec:
    weeks: int = 16
    val_days: int = 7
    n_customers: int = 20_000
    min_support: int = 5
    n_articles: int = 15_000


def last_day(tx: DataFrame):
    return tx.select(F.max("t_dat")).scalar()


def recent(tx: DataFrame, weeks: int) -> DataFrame:
    return tx.filter(F.col("t_dat") >= F.date_sub(last_day(tx), 7 * weeks))


def split(tx: DataFrame, val_days: int, until: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, val): val is the last `val_days` days inclusive, measured on `until` (default: the rows themselves)."""
    start = F.date_sub(last_day(tx if until is None else until), val_days - 1)
    return tx.filter(F.col("t_dat") < start), tx.filter(F.col("t_dat") >= start)


def top_by_count(df: DataFrame, key: str, n: int, min_support: int = 1) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_tx")).filter(F.col("n_tx") >= min_support)
    return first_n(counts.withColumn("_down", -F.col("n_tx")), ["_down", key], n).drop("_down")


def build_samples(
    tx: DataFrame, articles: DataFrame, customers: DataFrame, spec: SampleSpec = SampleSpec()
) -> dict[str, DataFrame]:
    # Each of these is read by several of the frames below.
    windowed = durable(recent(tx, spec.weeks))
    top_customers = durable(top_by_count(windowed, "customer_id", spec.n_customers))
    by_customers = windowed.join(top_customers, "customer_id", "left_semi")
    top_articles = durable(top_by_count(by_customers, "article_id", spec.n_articles, spec.min_support))
    sampled = durable(by_customers.join(top_articles, "article_id", "left_semi"))
    train, val = split(sampled, spec.val_days, until=windowed)
    counts = top_articles.withColumnRenamed("n_tx", "n_interactions")
    return {
        "train": train,
        "val": val,
        "items": articles.join(top_articles, "article_id", "left_semi").join(counts, "article_id", "left"),
        "users": customers.join(top_customers, "customer_id", "left_semi").withColumn("age_band", age_band(F.col("age"))),
    }


def absent_customers(val: DataFrame, train: DataFrame) -> DataFrame:
    return val.select("customer_id").distinct().join(train, "customer_id", "left_anti")


def leakage_audit(train: DataFrame, val: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """One row per rule with its number of violations."""
    seen = train.select("customer_id", "article_id").unionByName(val.select("customer_id", "article_id"))

    def rule(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")

    orphans = seen.select("article_id").distinct().join(items, "article_id", "left_anti")
    strangers = seen.select("customer_id").distinct().join(users, "customer_id", "left_anti")
    blank = items.filter(F.col("category_l1").isNull())
    late = train.agg(F.max("t_dat").alias("d")).filter(F.col("d") >= val.select(F.max("t_dat")).scalar())
    return (
        rule("article_not_in_items", orphans)
        .unionByName(rule("customer_not_in_users", strangers))
        .unionByName(rule("null_category", blank))
        .unionByName(rule("val_not_after_train", late))
    )


def subsample(df: DataFrame, key: list[str], n: int, seed: int = 0, total: int | None = None) -> DataFrame:
    """At most n rows without replacement, the same ones on every run: those with the smallest hashes.

    On large inputs rows far above the n-th hash are filtered out first, so the final sort sees about 2 n rows. Should
    fewer than n be left, all rows are sorted. Where the number of rows, `total`, is known and the rows are cheap to make again,
    only those that the filter leaves are stored.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    hashed = df.withColumn("_digest", digest)
    if total is None:
        hashed = durable(hashed)
        total = hashed.count()
    if total > 20 * n:
        limit = f"{int(2 * n / total * 16**12):012x}"
        low = durable(hashed.filter(F.col("_digest") < F.lit(limit)))
        hashed = low if low.count() >= n else hashed
    return hashed.orderBy("_digest", *key).limit(n).drop("_digest")


def systematic(df: DataFrame, key: str, size: int) -> DataFrame:
    """Every (n/size)-th row in key order, at most `size` of them."""
    total = df.select(F.count(F.lit(1))).scalar()
    step = F.greatest(F.lit(1), F.floor(total / F.lit(size)))
    # No key column: every row belongs to one group, so large catalogues take the range-partitioned path.
    placed = running_total(df.withColumn("_all", F.lit(0)), ["_all"], [key], F.lit(1), "_seq").drop("_all")
    at = F.col("_seq") - 1
    return placed.filter((at % step == 0) & (at / step < size)).drop("_seq")
