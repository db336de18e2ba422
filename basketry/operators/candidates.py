"""Merging query results, popularity by segment, and the recommenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import COLD_START, UNKNOWN, age_band
from basketry.functions.vectors import pooled, unit
from basketry.operators.retrieval import top_k, top_k_merged
from basketry.operators.sequences import HISTORY, last_rows
from basketry.operators.skew import newest
from basketry.session import durable

# Fixed values
K_PER_QUERY = 150
MERGE_SIZE = 500
FALLBACK = "popularity_fallback"


def merge_results(results: DataFrame, merge_size: int = MERGE_SIZE) -> DataFrame:
    """Results of several queries of a list (list_id, query_pos, label, article_id, score): best score per item, label
    of the first query that returned it, the best `merge_size` of them."""
    merged = results.groupBy("list_id", "article_id").agg(
        F.max("score").alias("score"), F.min_by("label", "query_pos").alias("label")
    )
    return newest(merged, ["list_id"], [F.desc("score"), F.asc("article_id")], merge_size, "rank")


def popularity(tx: DataFrame, users: DataFrame, limit: int = MERGE_SIZE) -> DataFrame:
    """Best sellers per region and age band, and over everybody under ('unknown', 'unknown').

    Purchases fold to one row per customer and article before they meet the customer table. Counts are read twice, so they are
    stored.
    """
    bought = tx.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"))
    who = users.select("customer_id", "region", age_band(F.col("age")).alias("age_band"))
    counted = durable(
        bought.join(who, "customer_id", "left")
        .groupBy(F.coalesce("region", F.lit(UNKNOWN)).alias("region"), F.coalesce("age_band", F.lit(UNKNOWN)).alias("age_band"), "article_id")
        .agg(F.sum("n").alias("n"))
    )
    everybody = counted.groupBy("article_id").agg(F.sum("n").alias("n"))
    whole = everybody.select(F.lit(UNKNOWN).alias("region"), F.lit(UNKNOWN).alias("age_band"), "article_id", "n")
    counted = counted.filter((F.col("region") != UNKNOWN) | (F.col("age_band") != UNKNOWN))
    return newest(counted.unionByName(whole), ["region", "age_band"], [F.desc("n"), F.asc("article_id")], limit, "rank")


def popular_for(contexts: DataFrame, popular: DataFrame, limit: int, label: str, exclude: DataFrame | None = None) -> DataFrame:
    """Best sellers of each list's segment, score 1 in order of rank. A segment's are packed into one row, so that lists stay
    where they are instead of moving to the few tasks that segments hash to."""
    stock = popular.filter(F.col("rank") <= limit).groupBy("region", "age_band").agg(
        F.collect_list(F.struct("article_id", F.col("rank").alias("query_rank"))).alias("_shelf")
    )
    found = contexts.select("list_id", "region", "age_band").join(F.broadcast(stock), ["region", "age_band"])
    found = found.select("list_id", "region", "age_band", F.inline("_shelf"))
    if exclude is not None:
        found = found.join(exclude.select("list_id", "article_id").distinct(), ["list_id", "article_id"], "left_anti")
    return found.select(
        "list_id", "article_id", F.lit(1.0).alias("score"), F.lit(label).alias("label"), F.col("query_rank").alias("rank")
    )


def pooled_vectors(recent: DataFrame, vectors: DataFrame) -> DataFrame:
    """Unit mean vector of each customer's newest purchases (customer_id, article_id) that have a vector; others give no row."""
    return pooled(recent, vectors, ["customer_id"]).select("customer_id", unit(F.col("m")).alias("user_vector"))


def newest_purchases(train: DataFrame, n: int = HISTORY) -> DataFrame:
    return last_rows(train, n).select("customer_id", "article_id")


def vector_recommend(recent: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """Nearest unseen items to the pooled vector of each customer's newest purchases (customer_id, article_id).

    What is seen and could be found has a vector, so it is gathered where the vectors are pooled; the vectors go straight on to
    the search, which needs no more than the number of customers ahead of them."""
    met = pooled(recent, vectors, ["customer_id"], seen=True)
    queries = met.select(F.col("customer_id").alias("query_id"), unit(F.col("m")).alias("vector"), _of_known("customer_id", "out"))
    return top_k(queries, vectors, k, n_query=recent.select("customer_id").distinct().count()).select(
        F.col("query_id").alias("user_id"), "article_id", "score", "rank"
    )


def _of_known(key: str, column: str) -> Column:
    """Null where the key is: what an unknown customer bought is not known to be the same one's."""
    return F.when(F.col(key).isNotNull(), F.col(column)).alias(column)


def _unwanted(intents: DataFrame, seen: DataFrame) -> DataFrame:
    """What each intent leaves out: all that its list has seen."""
    by = ("list_id", "intent_rank")
    return intents.select(*by).join(seen, "list_id").select(*by, "article_id")


def intent_results(intents: DataFrame, vectors: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Top k unseen items of every intent: (list_id, query_pos, label, weight, article_id, score)."""
    by = ("list_id", "intent_rank")
    found = top_k(intents.select(*by, "vector"), vectors, k, _unwanted(intents, seen), by=by).drop("rank")
    named = intents.select(*by, "label", "weight")
    return found.join(named, list(by)).withColumnRenamed("intent_rank", "query_pos")


def merged_results(intents: DataFrame, vectors: DataFrame, seen: DataFrame, k: int, merge_size: int = MERGE_SIZE) -> DataFrame:
    """`merge_results` of `intent_results`, merged where they are found: (list_id, article_id, score, label, rank)."""
    return top_k_merged(intents, vectors, k, _unwanted(intents, seen), merge_size)


def multi_intent_recommend(
    intents: DataFrame, vectors: DataFrame, seen: DataFrame, k: int = 20, n_intents: int | None = None
) -> DataFrame:
    """Score times intent weight, best over the intents, top k. `n_intents` is their number, or a little more; then intents, most
    of what the query moves, are not stored but go on to the search."""
    warm = intents.filter(F.col("label") != COLD_START)
    warm = durable(warm) if n_intents is None else warm
    # What a list has seen comes to its intents in one row.
    out = seen.groupBy("list_id").agg(F.collect_set(F.col("article_id").cast("bigint")).alias("out"))
    ranked = top_k_merged(warm.join(out, "list_id", "left"), vectors, k, None, k, weighed=True, n_query=n_intents)
    return ranked.select(F.col("list_id").alias("user_id"), "article_id", "score", "rank")


def feed_candidates(
    contexts: DataFrame,
    intents: DataFrame,
    vectors: DataFrame,
    seen: DataFrame,
    popular: DataFrame,
    k_per_query: int = K_PER_QUERY,
    merge_size: int = MERGE_SIZE,
) -> DataFrame:
    """Candidates of every list (list_id, region, age_band): (list_id, article_id, score, label, rank, degraded).

    A list whose one intent is cold takes its segment's best sellers, and vector search only where the segment has
    none. Other lists take the merged results of their intents; where that gives nothing, best sellers, marked degraded.
    Intents and best sellers are read by several branches, so they are stored once.
    """
    intents, popular = durable(intents), durable(popular)
    cold = intents.filter(F.col("label") == COLD_START).select("list_id").distinct()
    chilly = contexts.join(cold, "list_id", "left_semi")
    popular_cold = popular_for(chilly, popular, merge_size, COLD_START)
    # Which lists have results follows from their segments, so the rows of the lists themselves are laid out once, at the end.
    stocked = popular.filter(F.col("rank") <= merge_size).select("region", "age_band").distinct()
    served = chilly.join(stocked, ["region", "age_band"], "left_semi").select("list_id")
    unserved = cold.join(served, "list_id", "left_anti")
    warm = intents.join(cold, "list_id", "left_anti")
    searched = warm.unionByName(intents.join(unserved, "list_id", "left_semi"))
    merged = durable(merged_results(searched, vectors, seen, k_per_query, merge_size))
    primary = popular_cold.unionByName(merged.select(*popular_cold.columns)).withColumn(
        "degraded", F.lit(None).cast("string")
    )
    reached = served.unionByName(merged.select("list_id")).distinct()
    empty = contexts.join(reached, "list_id", "left_anti")
    rescued = popular_for(empty, popular, merge_size, FALLBACK).withColumn("degraded", F.lit("retrieval"))
    return primary.unionByName(rescued)
