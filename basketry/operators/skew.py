"""Ordered windows, running totals and pairings that hold when one key owns a third of the rows.

Row counts per key are aggregated first (they combine map-side). Keys at or below `hot_rows` take the plain window, one
shuffle. Keys above it are range-partitioned by (key, order), so that their rows spread over many tasks, and get exact
positions from per-partition counts. Nothing is dropped, capped or collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketry.session import durable

HOT_ROWS = 2_000_000
CHUNK_ROWS = 200_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.filter(F.col("_rows") > hot_rows)


def split_hot(df: DataFrame, keys: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None). One boolean comes back to the driver."""
    hot = hot_keys(df, keys, hot_rows).select(*keys)
    if hot.isEmpty():
        return df, None
    same = [df[k].eqNullSafe(hot[k]) for k in keys]
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def running_total(
    df: DataFrame, keys: list[str], order: list[str], weight: Column, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds the inclusive running sum of `weight` per key; rows equal in `order` are taken in any sequence."""
    plain, hot = split_hot(df, keys, hot_rows)
    spec = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    done = plain.withColumn(name, F.sum(weight).over(spec))
    if hot is None:
        return done
    ranged = durable(hot.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per key and range partition, so this window is bounded by the number of partitions.
    starts = (
        ranged.groupBy(*keys, "_part")
        .agg(F.sum(weight).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    right = starts.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_part").alias("_r_part"), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_part") == F.col("_r_part")]
    spread = (
        ranged.withColumn("_inside", F.sum(weight).over(inside))
        .join(right, same)
        .withColumn(name, F.col("_inside") + F.col("_before"))
    )
    return done.unionByName(spread.select(*df.columns, name))


def ordered_window(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds `seq` (1-based position) and window columns whose frames reach at most `before`/`after` rows.

    A hot key's rows are cut by position into chunks; each chunk also sees the last `before` rows of the one ahead of
    it and the first `after` rows of the one behind it, so every frame is complete.
    """
    plain, hot = split_hot(df, keys, hot_rows)
    spec = W.partitionBy(*keys).orderBy(*order)
    made = columns(spec)
    done = plain.select("*", F.row_number().over(spec).alias("seq"), *[c.alias(n) for n, c in made.items()])
    if hot is None:
        return done
    chunk_rows = max(chunk_rows, before, after)
    numbered = running_total(hot, keys, order, F.lit(1), "seq", hot_rows=0)
    offset = (F.col("seq") - 1) % chunk_rows
    chunk = F.floor((F.col("seq") - 1) / chunk_rows)
    copies = [F.struct(chunk.alias("chunk"), F.lit(False).alias("halo"))]
    if before:
        copies.append(F.when(offset >= chunk_rows - before, F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("halo"))))
    if after:
        copies.append(F.when(offset < after, F.struct((chunk - 1).alias("chunk"), F.lit(True).alias("halo"))))
    placed = numbered.withColumn("_at", F.explode(F.array_compact(F.array(*copies))))
    spec = W.partitionBy(*keys, "_at.chunk").orderBy("seq")
    spread = placed.select("*", *[c.alias(n) for n, c in columns(spec).items()]).filter(~F.col("_at.halo"))
    return done.unionByName(spread.select(*done.columns).withColumn("seq", F.col("seq").cast("int")))


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of all in `order`. Taking a large n of every task into one would not hold; those are placed by
    range instead."""
    if n <= 1000:
        return df.orderBy(*order).limit(n)
    placed = running_total(df.withColumn("_all", F.lit(0)), ["_all"], order, F.lit(1), "_place")
    return placed.filter(F.col("_place") <= n).drop("_all", "_place")


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "age") -> DataFrame:
    """The first n rows per key in `order`. Each map task keeps only n rows per key before the shuffle."""
    spec = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(spec)).filter(F.col(name) <= n)


def paired(
    left: DataFrame, right: DataFrame, keys: list[str], on: Column, spread_by: str, hot_rows: int = 50_000
) -> DataFrame:
    """Equi-join on `keys` with a further condition. Groups above `hot_rows` are cut by the hash of `spread_by` into
    slices of about that size: each left row meets every right row exactly once, in one of many tasks."""
    sizes = hot_keys(left, keys, hot_rows)
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    if sizes.isEmpty():
        return left.alias("l").join(right.alias("r"), [*same, on])
    slices = sizes.select(*keys, F.ceil(F.col("_rows") / hot_rows).alias("_slices"))
    n = F.coalesce("_slices", F.lit(1))
    cut = left.join(slices, keys, "left").withColumn("_slice", F.pmod(F.xxhash64(spread_by), n)).drop("_slices")
    copied = (
        right.join(slices, keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), n - 1))).drop("_slices")
    )
    return cut.alias("l").join(copied.alias("r"), [*same, F.col("l._slice") == F.col("r._slice"), on])


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Linearly interpolated percentiles. Equal values are counted first; positions come from running totals, so no
    task ever holds all values of a key."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counted, keys, [value], F.col("_n"), "_upto", hot_rows)
    totals = counted.groupBy(*keys).agg((F.sum("_n") - 1).alias("_last"))
    both = placed.join(totals, keys)
    picks = []
    for name, p in points.items():
        at = F.col("_last") * F.lit(float(p))
        picks.append(F.min(F.when(F.col("_upto") > F.floor(at), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value))).alias(f"_hi_{name}"))
    picked = both.groupBy(*keys, "_last").agg(*picks)
    out = []
    for name, p in points.items():
        at = F.col("_last") * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, *out)
