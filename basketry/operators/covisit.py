"""Items bought near each other in time, and the lift of items bought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketry.operators.sequences import last_rows
from basketry.operators.skew import HOT_ROWS, hot_keys, newest, paired, split_hot
from basketry.session import durable

WINDOW_DAYS = 7
MAX_NEIGHBOURS = 50
RECENT = 5
# History rows whose customers a task recommends to: their sums fit into some hundred MB however many customers there are.
ROWS_PER_TASK = 100_000
# Purchases whose neighbours a task adds up by item, some millions of pairs.
PURCHASES_PER_TASK = 500_000


def mirrored(pairs: DataFrame, a: str, b: str, value: list[str]) -> DataFrame:
    """(a, b) with a < b in both directions."""
    both = F.explode(
        F.array(
            F.struct(F.col(a).alias("item"), F.col(b).alias("neighbour")),
            F.struct(F.col(b).alias("item"), F.col(a).alias("neighbour")),
        )
    )
    return pairs.select(both.alias("_p"), *value).select("_p.item", "_p.neighbour", *value)


def nearby(
    tx: DataFrame, window_days: int = WINDOW_DAYS, hot_rows: int = 50_000, carry: dict[str, Column] | None = None
) -> DataFrame:
    """(item, times, near) of each customer's purchases of an article on a day: how many they are, and the purchases of other
    articles at most `window_days` apart, as (neighbour, n). `carry` are further columns of a neighbour.

    Repeat purchases of an article on a day fold into one row before anything is paired. Rows move to their customer once; a
    frame of days finds the neighbours there. Customers above `hot_rows` are paired by days instead: days fall into buckets one
    window wide, and a row meets only the same and the next bucket. `tx` is read twice, so it should be stored.
    """
    carry, day = carry or {}, ["customer_id", "article_id", "day"]
    rows = tx.select("customer_id", "article_id", F.unix_date("t_dat").alias("day")).dropna()
    plain, hot = split_hot(rows, ["customer_id"], hot_rows)
    daily = plain.repartition("customer_id").groupBy(*day).agg(F.count(F.lit(1)).alias("n")).withColumns(carry)
    around = W.partitionBy("customer_id").orderBy("day").rangeBetween(-window_days, window_days)
    fields = [F.col("article_id").alias("neighbour"), "n", *carry]
    met = daily.withColumn("near", F.collect_list(F.struct(*fields)).over(around))
    others = F.filter("near", lambda e: e["neighbour"] != F.col("article_id"))
    found = met.select(F.col("article_id").alias("item"), F.col("n").alias("times"), others.alias("near"))
    if hot is not None:
        folded = hot.groupBy(*day).agg(F.count(F.lit(1)).alias("n")).withColumns(carry)
        found = found.unionByName(_nearby_hot(folded, list(carry), window_days, hot_rows))
    return found.filter(F.size("near") > 0)


def _nearby_hot(folded: DataFrame, carried: list[str], window_days: int, hot_rows: int) -> DataFrame:
    """A row for each pair and direction."""
    # Both sides and the size check read these rows.
    daily = durable(folded)
    width = window_days + 1
    bucket = F.floor(F.col("day") / width)
    early = daily.withColumn("bucket", bucket)
    late = daily.withColumn("bucket", F.explode(F.array(bucket, bucket - 1)))
    ahead = F.col("r.day") - F.col("l.day")
    near = ((ahead > 0) & (ahead <= window_days) & (F.col("l.article_id") != F.col("r.article_id"))) | (
        (ahead == 0) & (F.col("l.article_id") < F.col("r.article_id"))
    )
    joined = paired(early, late, ["customer_id", "bucket"], near, "article_id", hot_rows)

    def seen_from(own: str, other: str) -> Column:
        fields = [F.col(f"{other}.article_id").alias("neighbour"), F.col(f"{other}.n").alias("n"), *[F.col(f"{other}.{c}").alias(c) for c in carried]]
        return F.struct(F.col(f"{own}.article_id").alias("item"), F.col(f"{own}.n").alias("times"), F.array(F.struct(*fields)).alias("near"))

    return joined.select(F.explode(F.array(seen_from("l", "r"), seen_from("r", "l"))).alias("_p")).select("_p.*")


def purchase_pairs(tx: DataFrame, window_days: int = WINDOW_DAYS, hot_rows: int = 50_000) -> DataFrame:
    """(a, b, n) with a < b: purchase pairs of one customer at most `window_days` apart, not yet added up."""
    later = F.filter("near", lambda e: e["neighbour"] > F.col("item"))
    rows = nearby(tx, window_days, hot_rows).select("item", "times", F.explode(later).alias("e"))
    return rows.select(F.col("item").alias("a"), F.col("e.neighbour").alias("b"), (F.col("times") * F.col("e.n")).alias("n"))


def at_items(tx: DataFrame, hoods: DataFrame) -> DataFrame:
    """`nearby` rows of `tx` at their item, a bounded number of them in a task; whatever is added up per item next, needs no
    further shuffle."""
    parts = -(-tx.count() // PURCHASES_PER_TASK) or 1
    return hoods.repartition(parts, "item")


def one_task_per_item(tx: DataFrame, hot_rows: int = HOT_ROWS) -> bool:
    """Whether no article has more purchases than a task should take unsummed."""
    return hot_keys(tx, ["article_id"], hot_rows).isEmpty()


def near_items(tx: DataFrame, limit: int = MAX_NEIGHBOURS, hot_items: int = HOT_ROWS) -> DataFrame:
    """`neighbours` of the `covisit_counts`. A purchase moves to its item once, with all its neighbours in a row, and is counted
    and ranked there; where an item has more than `hot_items` purchases, pairs are counted before they move."""
    if not one_task_per_item(tx, hot_items):
        return neighbours(covisit_counts(tx), limit)
    rows = at_items(tx, nearby(tx)).select("item", "times", F.explode("near").alias("e"))
    counts = rows.groupBy("item", F.col("e.neighbour").alias("neighbour")).agg(F.sum(F.col("times") * F.col("e.n")).alias("cnt"))
    return neighbours(counts, limit)


def covisit_counts(tx: DataFrame, window_days: int = WINDOW_DAYS, hot_rows: int = 50_000) -> DataFrame:
    """Directed pair counts (item, neighbour, cnt). The join's output goes straight into the partial aggregate, so what is
    shuffled is distinct pairs; only a < b is counted, then mirrored."""
    pairs = purchase_pairs(tx, window_days, hot_rows).groupBy("a", "b").agg(F.sum("n").alias("cnt"))
    return mirrored(pairs, "a", "b", ["cnt"])


def neighbours(counts: DataFrame, limit: int = MAX_NEIGHBOURS) -> DataFrame:
    return newest(counts, ["item"], [F.desc("cnt"), F.asc("neighbour")], limit, "rk")


def covisit_recommend(
    near: DataFrame, train: DataFrame, k: int = 20, recent: int = RECENT, history: int = 20, rows: DataFrame | None = None
) -> DataFrame:
    """Neighbours of each customer's newest purchases, counts summed, what the history holds left out. `rows` are the newest
    `history` purchases (customer_id, article_id, age) where they are stored already."""
    if rows is None:
        rows = durable(last_rows(train, history).select("customer_id", "article_id", "age"))
    parts = -(-rows.count() // ROWS_PER_TASK) or 1
    # Duplicates among the newest rows count twice, as a weight rather than as two rows.
    seeds = rows.filter(F.col("age") <= recent).groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("times"))
    # An item's neighbours go to its buyers as one packed row; there all sums of a customer are made without a further shuffle.
    packed = near.groupBy("item").agg(F.collect_list(F.struct("neighbour", "cnt")).alias("_n"))
    packed = packed.select("item", F.col("_n.neighbour").alias("candidate"), F.col("_n.cnt").alias("cnt"))
    moved = seeds.join(packed, F.col("article_id") == F.col("item")).select("customer_id", "times", "candidate", "cnt")
    met = moved.repartition(parts, "customer_id").select("customer_id", "times", F.inline(F.arrays_zip("candidate", "cnt")))
    scored = met.groupBy("customer_id", "candidate").agg(F.sum(F.col("cnt") * F.col("times")).alias("score"))
    # Dealt like the sums, which would move once more to meet them otherwise.
    seen = rows.repartition(parts, "customer_id").groupBy("customer_id").agg(F.collect_set("article_id").alias("_seen"))
    known = F.coalesce(F.array_contains("_seen", F.col("candidate")), F.lit(False))
    fresh = scored.join(seen, "customer_id", "left").filter(~known).drop("_seen")
    ranked = newest(fresh, ["customer_id"], [F.desc("score"), F.asc("candidate")], k, "rank")
    return ranked.select(
        F.col("customer_id").alias("user_id"),
        F.col("candidate").alias("article_id"),
        F.col("score").cast("double").alias("score"),
        "rank",
    )


def complements(tx: DataFrame, limit: int = MAX_NEIGHBOURS, hot_rows: int = 50_000) -> DataFrame:
    """Lift of two items sharing a basket: baskets with both x all baskets / (baskets with one x with the other).

    Each line takes its item's support to its basket and moves on to its item in one row with the rest of the basket, where
    pairs are counted and ranked. Where a basket or an item has more lines than a task should take, pairs are counted before
    they move, and meet both supports in joins."""
    lines = durable(tx.select("order_id", "article_id").distinct())
    support = lines.groupBy("article_id").agg(F.count(F.lit(1)).alias("support"))
    n_baskets = lines.select(F.count_distinct("order_id")).scalar()
    if hot_keys(lines, ["order_id"], hot_rows).isEmpty() and one_task_per_item(lines):
        return newest(_lift_at_items(lines, support, n_baskets), ["item"], [F.desc("lift"), F.asc("neighbour")], limit, "rk")
    ordered = F.col("l.article_id") < F.col("r.article_id")
    pairs = (
        paired(lines, lines, ["order_id"], ordered, "article_id", hot_rows)
        .groupBy(F.col("l.article_id").alias("a"), F.col("r.article_id").alias("b"))
        .agg(F.count(F.lit(1)).alias("together"))
    )
    sa = support.select(F.col("article_id").alias("a"), F.col("support").alias("support_a"))
    sb = support.select(F.col("article_id").alias("b"), F.col("support").alias("support_b"))
    lifted = pairs.join(sa, "a").join(sb, "b").withColumn("_n", n_baskets)
    lift = F.round(F.col("together") * F.col("_n") / (F.col("support_a") * F.col("support_b")), 6)
    edges = mirrored(lifted.withColumn("lift", lift), "a", "b", ["together", "lift"])
    return newest(edges, ["item"], [F.desc("lift"), F.asc("neighbour")], limit, "rk")


def _lift_at_items(lines: DataFrame, support: DataFrame, n_baskets: Column) -> DataFrame:
    """(item, neighbour, together, lift) of all pairs, each at its item."""
    marked = lines.dropna().join(support, "article_id").select("order_id", F.struct("article_id", "support").alias("e"))
    baskets = marked.groupBy("order_id").agg(F.collect_list("e").alias("all"))
    rows = baskets.select(F.explode("all").alias("own"), "all")
    others = F.filter("all", lambda e: e["article_id"] != F.col("own.article_id"))
    rows = rows.select(F.col("own.article_id").alias("item"), F.col("own.support").alias("_own"), others.alias("near"))
    met = at_items(lines, rows.filter(F.size("near") > 0)).select("item", "_own", F.explode("near").alias("e"))
    pairs = met.groupBy("item", F.col("e.article_id").alias("neighbour")).agg(
        F.count(F.lit(1)).alias("together"), F.first("_own").alias("_own"), F.first("e.support").alias("_other")
    )
    lift = F.round(F.col("together") * F.col("_n") / (F.col("_own") * F.col("_other")), 6)
    return pairs.withColumn("_n", n_baskets).select("item", "neighbour", "together", lift.alias("lift"))


def list_position(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """0-based place in a list that is already cut to its limit."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
