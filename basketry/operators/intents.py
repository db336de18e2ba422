"""Session intents: label scores, intent vectors and cold starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketry.functions.columns import COLD_START, UNKNOWN, minutes_between
from basketry.functions.vectors import dot, pooled, unit, zeros
from basketry.operators.skew import HOT_ROWS, newest, ordered_window

# The labels in their declared order, which breaks ties between scores
LABELS = ("urgent_replacement", "seasonal_browsing", "complementary", "bargain_hunting")
SESSION_EVENTS = 20
MAX_INTENTS = 4
COLLAPSE_COSINE = 0.8
MINUTE = 60


def current_sessions(events: DataFrame, gap_seconds: int, n: int = SESSION_EVENTS, key: str = "user_id") -> DataFrame:
    """The newest n events of each key's last session: events with no idle gap between them and the newest one.

    The last session is the tail of a key's events, so its newest n are among the key's newest n; those are cut out
    map-side, and the gap is looked for in at most n rows.
    """
    tail = newest(events, [key], [F.desc("ts"), F.desc("event_id")], n)
    spec = W.partitionBy(key).orderBy("age")
    idle = F.unix_micros(F.lag("ts").over(spec).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    broken = F.coalesce((idle > F.lit(gap_seconds * 1_000_000)).cast("int"), F.lit(0))
    marked = tail.withColumn("_gap", broken)
    upto = spec.rowsBetween(W.unboundedPreceding, 0)
    return marked.withColumn("_gaps", F.sum("_gap").over(upto)).filter(F.col("_gaps") == 0).drop("_gap", "_gaps")


def sessions(events: DataFrame, gap_seconds: int, key: str = "user_id") -> DataFrame:
    """All sessions of each key: first and last time and number of events.

    Events first fold into slots one gap long (all events of a slot are of one session), so a key with very many
    events meets the window with at most two rows per slot and gap of time.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    slots = (
        events.select(key, micros.alias("t"))
        .groupBy(key, F.floor(F.col("t") / F.lit(gap_seconds * 1_000_000)).alias("slot"))
        .agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    )
    spec = W.partitionBy(key).orderBy("slot")
    starts = (F.col("first") - F.lag("last").over(spec) > F.lit(gap_seconds * 1_000_000)).cast("int")
    numbered = slots.withColumn("_new", F.coalesce(starts, F.lit(1)))
    numbered = numbered.withColumn("session", F.sum("_new").over(spec.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(
        F.timestamp_micros(F.min("first")).cast("timestamp_ntz").alias("first_ts"),
        F.timestamp_micros(F.max("last")).cast("timestamp_ntz").alias("last_ts"),
        F.sum("n").alias("events"),
    )


def event_gaps(events: DataFrame, key: str = "user_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Minutes since the key's event before; the first event of a key has none."""
    order = ["ts", "event_id"]
    return ordered_window(
        events, [key], order, lambda w: {"previous_ts": F.lag("ts").over(w)}, before=1, hot_rows=hot_rows
    ).withColumn("gap_minutes", minutes_between(F.col("ts"), F.col("previous_ts")))


def label_scores(events: DataFrame, key: str = "list_id") -> DataFrame:
    """The four label scores of each session.

    The gaps between ordered events add up to last minus first, so the mean gap needs no ordering.
    """
    per_category = events.groupBy(key, F.coalesce("category_l1", F.lit(UNKNOWN)).alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.sum("price").alias("paid"),
        F.sum(F.col("discounted").cast("int")).alias("discounts"),
    )
    whole = per_category.groupBy(key).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("categories"),
        F.sum("discounts").alias("discounts"),
        minutes_between(F.max("last"), F.min("first")).alias("span"),
    )
    prices = events.groupBy(key).agg((F.stddev_pop("price") / (F.avg("price") + F.lit(1e-6))).alias("variation"))
    n = F.col("n")
    gap = F.coalesce(F.try_divide("span", n - 1), F.lit(0.0))
    spread = F.col("categories") / n
    one = F.lit(1.0)
    return whole.join(prices, key).select(
        key,
        ((one / (one + gap)) * (one - spread)).alias("urgent_replacement"),
        (spread * F.least(one, gap / 10.0 + 0.3)).alias("seasonal_browsing"),
        (spread * (one - F.least(one, gap / 10.0))).alias("complementary"),
        (0.6 * (F.col("discounts") / n) + 0.4 * F.least(one, F.col("variation"))).alias("bargain_hunting"),
    )


def ranked_labels(scores: DataFrame, key: str = "list_id", places: int = 9) -> DataFrame:
    """Labels of each session, best score first, declared order on a tie."""
    rows = F.explode(
        F.array(*[F.struct(F.lit(i).alias("declared"), F.lit(l).alias("label"), F.round(l, places).alias("score")) for i, l in enumerate(LABELS)])
    )
    long = scores.select(key, rows.alias("r")).select(key, "r.*")
    return newest(long, [key], [F.desc("score"), F.asc("declared")], len(LABELS), "label_rank")


def intent_vectors(events: DataFrame, vectors: DataFrame, key: str = "list_id", n: int = MAX_INTENTS) -> DataFrame:
    """Up to n intents per session: its commonest categories, as unit mean vectors weighted by their share."""
    named = events.withColumn("category_l1", F.coalesce("category_l1", F.lit(UNKNOWN)))
    groups = pooled(named, vectors, [key, "category_l1"]).select(key, "category_l1", "n", unit(F.col("m")).alias("vector"))
    kept = newest(groups, [key], [F.desc("n"), F.asc("category_l1")], n, "intent_rank")
    total = F.sum("n").over(W.partitionBy(key))
    return kept.withColumn("weight", F.col("n") / total).drop("n")


def infer_intents(keys: DataFrame, events: DataFrame, vectors: DataFrame, dim: int, key: str = "list_id") -> DataFrame:
    """Intents of every key, by category. No event, or none with a vector: one cold start with a zero vector and weight 1."""
    return labelled_intents(keys, events, intent_vectors(events, vectors, key), dim, key)


def labelled_intents(keys: DataFrame, events: DataFrame, heads: DataFrame, dim: int, key: str = "list_id") -> DataFrame:
    """Heads (key, intent_rank, weight, vector) with the session's label of the same rank; keys without one start cold.

    A session's labels come in one row, so that heads, which are already with their key, are not moved for them."""
    ranked = ranked_labels(label_scores(events, key), key)
    labels = ranked.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label_rank", "label"))).alias("_labels"))
    warm = heads.join(labels, key).withColumn("label", F.try_element_at("_labels", F.col("intent_rank")))
    warm = warm.filter(F.col("label").isNotNull()).drop("_labels")
    found = keys.select(key).join(warm, key, "left")
    cold = F.col("vector").isNull()
    return found.select(
        key,
        F.coalesce("intent_rank", F.lit(1)).alias("intent_rank"),
        F.when(cold, F.lit(COLD_START)).otherwise(F.col("label")).alias("label"),
        F.when(cold, F.lit(1.0)).otherwise(F.col("weight")).alias("weight"),
        F.when(cold, zeros(dim)).otherwise(F.col("vector")).alias("vector"),
    )


def mixed_intents(intents: DataFrame, key: str = "list_id") -> DataFrame:
    """Sum of weight x vector over a session's (at most four) intents; its dot product is the intent-weighted dot."""
    weighted = F.transform("vector", lambda x: x * F.col("weight"))
    packed = F.sort_array(F.collect_list(F.struct("intent_rank", weighted.alias("v"))))
    rows = intents.groupBy(key).agg(packed.alias("heads"))
    added = F.aggregate(
        F.slice("heads", 2, MAX_INTENTS), F.col("heads")[0]["v"], lambda acc, h: F.zip_with(acc, h["v"], lambda x, y: x + y)
    )
    return rows.select(key, added.alias("intent_mix"))


def pairwise_cosine(intents: DataFrame, key: str = "list_id") -> DataFrame:
    """Cosine of each pair of heads of a session (at most six; head vectors are unit length)."""
    a, b = intents.alias("a"), intents.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.intent_rank") < F.col("b.intent_rank")))
    return pairs.select(
        F.col(f"a.{key}").alias(key),
        F.col("a.intent_rank").alias("head_a"),
        F.col("b.intent_rank").alias("head_b"),
        dot(F.col("a.vector"), F.col("b.vector")).alias("cosine"),
    )


def collapse_report(pairs: DataFrame, limit: float = COLLAPSE_COSINE) -> DataFrame:
    """Mean and largest cosine per pair of heads, and whether the mean is above the collapse limit."""
    summary = pairs.groupBy("head_a", "head_b").agg(
        F.count(F.lit(1)).alias("sessions"), F.avg("cosine").alias("mean_cosine"), F.max("cosine").alias("max_cosine")
    )
    return summary.withColumn("collapsed", F.col("mean_cosine") > F.lit(limit))


def session_rows(history: DataFrame, meta: DataFrame) -> DataFrame:
    """Purchases as session events: midnight of the day, category from the item metadata."""
    kinds = meta.select("article_id", F.col("category_l1").alias("_category"))
    return history.join(kinds, "article_id", "left").select(
        *[c for c in history.columns if c not in ("t_dat", "category_l1", "discounted")],
        F.col("t_dat").cast("timestamp_ntz").alias("ts"),
        F.coalesce("_category", F.lit(UNKNOWN)).alias("category_l1"),
        F.lit(False).alias("discounted"),
    )


def recency(now: Column, last: Column) -> Column:
    """Minutes since the last event of the category, -1 where there was none."""
    return F.coalesce(minutes_between(now, last), F.lit(-1.0))
