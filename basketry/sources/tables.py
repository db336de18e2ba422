"""The data model: retail views over the given star schema, one DataFrame each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Purchases of one customer are ordered by these; rows equal in all of them are interchangeable.
TX_ORDER = ["t_dat", "order_id", "line_no", "article_id", "paid", "quantity"]


# Stated schemas: without one, every scan starts with a job that reads file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("article_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_extendedprice").alias("paid"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_discount") > 0.05).alias("discounted"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("t_dat"),
    )
    return priced(lines.join(orders, "order_id"))


def priced(bought: DataFrame) -> DataFrame:
    """Purchases with the price of a piece, which is neither moved nor stored, as it follows from two other columns."""
    price = (F.col("paid") / F.col("quantity")).alias("price")
    names = ("order_id", "article_id", "line_no", "paid", "quantity")
    return bought.select(*names, price, "discounted", "customer_id", "t_dat")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("article_id"),
        F.col("p_name").alias("prod_name"),
        F.col("p_type").alias("category_l1"),
        F.col("p_brand").alias("category_l2"),
        F.substring_index("p_name", " ", 1).alias("colour"),
        F.concat(F.lit("D"), F.floor(F.col("p_size") / 10)).alias("dept"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("list_price"),
        (F.col("p_size") > 5).alias("in_stock"),
        (F.col("p_size") >= 46).alias("age_restricted"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = transactions(spark, sf_dir).groupBy("article_id").agg(F.count(F.lit(1)).alias("n_interactions"))
    return articles(spark, sf_dir).join(counts, "article_id", "left")


def synthetic_age(custkey: Column) -> Column:
    """The test data carries no age, so one is made from the key."""
    return F.when(custkey % 13 == 0, F.lit(None)).otherwise(10 + (custkey * 7) % 60).cast("int")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")
    )
    return (
        table(spark, sf_dir, "customer")
        .join(nation, "c_nationkey")
        .join(region, "n_regionkey")
        .select(
            F.col("c_custkey").alias("customer_id"),
            synthetic_age(F.col("c_custkey")).alias("age"),
            "region",
            F.col("c_mktsegment").alias("club_status"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("article_id"), F.col("embedding").alias("vector")
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events; unknown categories stay null here."""
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        F.get_json_object("props", "$.k").cast("bigint").alias("article_id"),
        F.col("value").alias("price"),
        (F.col("value") < 5).alias("discounted"),
    )
    categories = articles(spark, sf_dir).select("article_id", "category_l1")
    return events.join(categories, "article_id", "left")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("endpoint"),
        F.col("value").alias("response_time_ms"),
        (F.col("event_type") != "error").alias("success"),
        "ts",
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("query")).distinct()


def consent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("signup", "error"))
        .select(
            F.col("user_id").alias("customer_id"),
            F.when(F.col("event_id") % 2 == 0, "personalization").otherwise("analytics").alias("purpose"),
            (F.col("event_type") == "signup").alias("granted"),
            F.col("ts").alias("granted_at"),
            "event_id",
        )
    )
