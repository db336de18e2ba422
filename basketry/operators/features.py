"""The ten ranking features of every candidate of every list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketry.functions.columns import UNKNOWN
from basketry.operators.intents import mixed_intents, recency
from basketry.operators.items import with_meta
from basketry.operators.retrieval import with_products
from basketry.operators.skew import HOT_ROWS, running_total

# Fixed values
FEATURE_NAMES = (
    "two_tower_dot",
    "intent_dot",
    "item_popularity",
    "item_ctr",
    "price_percentile_in_category",
    "category_match_count",
    "recency_same_category_minutes",
    "session_length",
    "is_new_item",
    "days_since_first_seen",
)
NEW_ITEM_DAYS = 14.0


def price_percentile(rows: DataFrame, keys: list[str], price: str = "price", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Share of strictly cheaper rows among the others of the group, 0.5 for a row alone; for groups of any size.

    Rows without a price stay, with no percentile, and count for nobody else's; null keys are a group like others.
    """
    priced = rows.filter(F.col(price).isNotNull())
    counted = priced.groupBy(*keys, price).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counted, keys, [price], F.col("_n"), "_upto", hot_rows)
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    share = F.when(F.col("_total") == 1, F.lit(0.5)).otherwise(
        F.try_divide(F.col("_upto") - F.col("_n"), F.col("_total") - 1)
    )
    totals = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "_total")
    both = placed.join(totals, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
    scored = both.select(*[F.col(c).alias(f"_s_{c}") for c in (*keys, price)], share.alias("price_percentile"))
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in keys] + [F.col(price) == F.col(f"_s_{price}")]
    return rows.join(scored, same, "left").select(*rows.columns, "price_percentile")


def build_features(
    candidates: DataFrame,
    meta: DataFrame,
    vectors: DataFrame,
    user_vectors: DataFrame,
    intents: DataFrame,
    session: DataFrame,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """candidates (list_id, article_id, ...): lists are cut to a few hundred rows before they come here, so the
    per-list window is bounded. Only numbers move with them, no vectors; user_vectors has a row per list. Candidates without a vector are left out; those without metadata get the default row.

    meta (article_id, category_l1, popularity, ctr, avg_price, days_since_first_seen) may also carry list_id, where
    the age of an item depends on the list. session (list_id, category_l1, ts) is the list's events.
    """
    by = ["list_id", "article_id"] if "list_id" in meta.columns else ["article_id"]
    sides = user_vectors.join(mixed_intents(intents), "list_id", "full_outer").select(
        "list_id", F.col("user_vector").alias("two_tower_dot"), F.col("intent_mix").alias("intent_dot")
    )
    moved = candidates.select("list_id", "article_id", *keep)
    # Metadata that is the same for all lists goes with the items.
    if "list_id" in meta.columns:
        rows = with_meta(with_products(moved, sides, vectors), meta, by)
    else:
        rows = with_products(moved, sides, with_meta(vectors, meta))
    named = session.withColumn("category_l1", F.coalesce("category_l1", F.lit(UNKNOWN)))
    per_category = named.groupBy("list_id", "category_l1").agg(F.count(F.lit(1)).alias("matches"), F.max("ts").alias("last_ts"))
    # A row per list, so that candidates move by list alone and the window needs no further move.
    of_list = per_category.groupBy("list_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category_l1", F.struct("matches", "last_ts")))).alias("_kinds"),
        F.sum("matches").alias("length"),
        F.max("last_ts").alias("now_ts"),
    )
    rows = rows.join(of_list, "list_id", "left").withColumn("_of_kind", F.try_element_at("_kinds", F.col("category_l1")))
    group = W.partitionBy("list_id", "category_l1")
    percentile = F.when(F.count(F.lit(1)).over(group) == 1, F.lit(0.5)).otherwise(
        F.percent_rank().over(group.orderBy("avg_price"))
    )
    return rows.select(
        "list_id",
        "article_id",
        "category_l1",
        *keep,
        "two_tower_dot",
        "intent_dot",
        F.col("popularity").alias("item_popularity"),
        F.col("ctr").alias("item_ctr"),
        percentile.alias("price_percentile_in_category"),
        F.coalesce("_of_kind.matches", F.lit(0)).cast("double").alias("category_match_count"),
        recency(F.col("now_ts"), F.col("_of_kind.last_ts")).alias("recency_same_category_minutes"),
        F.coalesce("length", F.lit(0)).cast("double").alias("session_length"),
        (F.col("days_since_first_seen") < F.lit(NEW_ITEM_DAYS)).cast("double").alias("is_new_item"),
        "days_since_first_seen",
    )
