"""Purchase histories, training examples and padding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.sampling import subsample
from basketry.operators.skew import HOT_ROWS, newest, ordered_window
from basketry.session import durable
from basketry.sources.tables import TX_ORDER

HISTORY = 20
# Numbers of purchases that are laid out at once.
RUN = 10_000


def newest_first(order: list[str] = TX_ORDER) -> list[Column]:
    return [F.desc(c) for c in order]


def numbered(tx: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Full history as rows: (customer, seq). An array per customer would be unbounded."""
    return ordered_window(tx, ["customer_id"], TX_ORDER, lambda w: {}, hot_rows=hot_rows)


def last_rows(tx: DataFrame, n: int = HISTORY) -> DataFrame:
    """The newest n purchases per customer as rows; `age` 1 is the newest."""
    return newest(tx, ["customer_id"], newest_first(), n)


def last_history(tx: DataFrame, n: int = HISTORY) -> DataFrame:
    """The newest n purchases per customer as one bounded array, oldest first."""
    rows = last_rows(tx, n).select("customer_id", F.struct((-F.col("age")).alias("at"), "article_id").alias("e"))
    return rows.groupBy("customer_id").agg(
        F.transform(F.sort_array(F.collect_list("e")), lambda e: e["article_id"]).alias("history")
    )


def training_examples(tx: DataFrame, n: int = HISTORY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For every purchase after the first: the up to n ids ahead of it, and itself as the target."""
    rows = ordered_window(
        tx,
        ["customer_id"],
        TX_ORDER,
        lambda w: {"history": F.collect_list("article_id").over(w.rowsBetween(-n, -1))},
        before=n,
        hot_rows=hot_rows,
    )
    return rows.filter(F.col("seq") > 1).select(
        "customer_id", "seq", "history", F.col("article_id").alias("target"), "t_dat", "price"
    )


DETAIL = ("article_id", "t_dat", "price", "position")


def detailed_examples(tx: DataFrame, n: int = HISTORY, hot_rows: int = HOT_ROWS, detail: tuple[str, ...] = DETAIL) -> DataFrame:
    """Training examples whose history keeps `detail` of each purchase: (example_id, customer_id, target, t_dat,
    position of the target, events)."""
    detail = tuple(c for c in detail if c in tx.columns)
    rows = ordered_window(
        tx, ["customer_id"], TX_ORDER, lambda w: {"events": F.collect_list(F.struct(*detail)).over(w.rowsBetween(-n, -1))},
        before=n, hot_rows=hot_rows,
    )
    return rows.filter(F.col("seq") > 1).select(
        _example_id("-").alias("example_id"), "customer_id", F.col("article_id").alias("target"), "t_dat",
        *[c for c in ("position",) if c in tx.columns], "events",
    )


def _example_id(mark: str) -> Column:
    return F.concat_ws(mark, F.col("customer_id").cast("string"), F.col("seq").cast("string"))


def _events(pieces: DataFrame, keys: list[str], detail: list[str]) -> DataFrame:
    """At most `HISTORY` pieces (at, detail...) per key as one array in order."""
    packed = F.sort_array(F.collect_list(F.struct("at", *detail)))
    return pieces.groupBy(*keys).agg(F.transform(packed, lambda e: F.struct(*[e[c].alias(c) for c in detail])).alias("events"))


def _numbers(sizes: DataFrame) -> DataFrame:
    """(customer_id, seq) for 2 to `_n` of each customer, in runs, so that no array grows with a customer."""
    runs = sizes.select("customer_id", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 2) / RUN))).alias("_run"))
    first = F.col("_run") * RUN + 2
    numbers = runs.select("customer_id", F.explode(F.sequence(first, F.least(F.col("_n"), first + (RUN - 1)))).alias("seq"))
    return numbers.withColumn("seq", F.col("seq").cast("int"))


def chosen_examples(
    tx: DataFrame,
    max_examples: int,
    n: int = HISTORY,
    seed: int = 0,
    hot_rows: int = HOT_ROWS,
    detailed: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """At most `max_examples` of the detailed training examples.

    Which examples there are follows from the number of each customer's purchases, so they are drawn first, and only the
    purchases of the customers drawn are put in order; each example asks for its n places ahead by (customer, seq). `detailed`
    adds columns to purchases, a row for each, and sees those of the customers drawn alone.
    """
    sizes = durable(tx.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1))
    total = sizes.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]
    drawn = durable(subsample(_numbers(sizes).withColumn("example_id", _example_id("-")), ["example_id"], max_examples, seed, total))
    few = detailed(tx.join(drawn.select("customer_id").distinct(), "customer_id", "left_semi"))
    detail = [c for c in DETAIL if c in few.columns]
    placed = durable(numbered(few, hot_rows).select("customer_id", "seq", *detail))
    places = F.explode(F.sequence(F.greatest(F.lit(1), F.col("seq") - n), F.col("seq") - 1))
    asked = drawn.select("example_id", "customer_id", places.alias("seq"))
    pieces = placed.join(asked, ["customer_id", "seq"]).withColumnRenamed("seq", "at")
    rows = drawn.join(placed, ["customer_id", "seq"]).withColumnRenamed("article_id", "target").drop("seq", "price")
    return rows.join(_events(pieces, ["example_id"], detail), "example_id")


def detailed_validation(train: DataFrame, val: DataFrame, n: int = HISTORY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same for every validation purchase of a customer with train history."""
    detail = [c for c in DETAIL if c in train.columns]
    pieces = last_rows(train, n).withColumn("at", -F.col("age")).select("customer_id", "at", *detail)
    rows = numbered(val, hot_rows).join(_events(pieces, ["customer_id"], detail), "customer_id")
    return rows.select(
        _example_id("-v").alias("example_id"), "customer_id", F.col("article_id").alias("target"), "t_dat",
        *[c for c in ("position",) if c in val.columns], "events",
    )


def chosen_validation(
    train: DataFrame,
    val: DataFrame,
    max_examples: int,
    n: int = HISTORY,
    seed: int = 0,
    hot_rows: int = HOT_ROWS,
    detailed: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """At most `max_examples` of the `detailed_validation` examples, drawn before the histories are gathered."""
    known = train.select("customer_id").distinct()
    rows = numbered(val, hot_rows).join(known, "customer_id", "left_semi").withColumn("example_id", _example_id("-v"))
    drawn = detailed(durable(subsample(rows, ["example_id"], max_examples, seed)))
    few = detailed(train.join(drawn.select("customer_id").distinct(), "customer_id", "left_semi"))
    detail = [c for c in DETAIL if c in few.columns]
    pieces = last_rows(few, n).withColumn("at", -F.col("age")).select("customer_id", "at", *detail)
    return drawn.join(_events(pieces, ["customer_id"], detail), "customer_id").select(
        "example_id", "customer_id", F.col("article_id").alias("target"), "t_dat",
        *[c for c in ("position",) if c in drawn.columns], "events",
    )


def validation_examples(train: DataFrame, val: DataFrame, n: int = HISTORY, known: DataFrame | None = None) -> DataFrame:
    """Newest train history against every validation purchase; customers without history, and articles not in
    `known`, give no example."""
    rows = val if known is None else val.join(known, "article_id", "left_semi")
    return rows.join(last_history(train, n), "customer_id").select(
        "customer_id", "history", F.col("article_id").alias("target"), "t_dat", "price"
    )


def padded(history: Column, length: int, pad: Column) -> Column:
    """The newest `length` entries, filled up on the right."""
    kept = F.slice(history, F.greatest(F.lit(1), F.size(history) - length + 1), F.lit(length))
    return F.concat(kept, F.array_repeat(pad, F.greatest(F.lit(0), F.lit(length) - F.size(history))))


def mask(history: Column, length: int) -> Column:
    used = F.least(F.size(history), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1.0), used), F.array_repeat(F.lit(0.0), F.lit(length) - used))
