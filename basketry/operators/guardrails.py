"""Filters, the category cap, diversity and their report, for many lists at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import ADULT_AGE_BANDS
from basketry.operators.skew import newest
from basketry.session import durable

# Fixed values
MAX_SHARE = 0.35
LAMBDA = 0.7
STEPS = ("filter_availability", "filter_policy", "filter_sensitive", "filter_seen", "cap_category", "mmr_diversify")


def _by_score() -> list[Column]:
    return [F.desc("score"), F.asc("article_id")]


def flagged(
    candidates: DataFrame, contexts: DataFrame, seen: DataFrame | None = None, blocked: DataFrame | None = None
) -> DataFrame:
    """Candidates with `dropped_by`: the first filter that rejects them, or null.

    contexts (list_id, age_band); seen (list_id, article_id); blocked (category_l1, and list_id where it differs).
    """
    rows = candidates.join(contexts.select("list_id", "age_band"), "list_id", "left")
    if seen is None:
        rows = rows.withColumn("_seen", F.lit(False))
    else:
        # One row per list, so that the candidates move by list alone and a list's rows stay together.
        marks = seen.groupBy("list_id").agg(F.collect_set("article_id").alias("_out"))
        known = F.coalesce(F.array_contains("_out", F.col("article_id")), F.lit(False))
        rows = rows.join(marks, "list_id", "left").withColumn("_seen", known).drop("_out")
    if blocked is None:
        rows = rows.withColumn("_blocked", F.lit(None).cast("boolean"))
    else:
        by = [c for c in ("list_id", "category_l1") if c in blocked.columns]
        rows = rows.join(blocked.select(*by).distinct().withColumn("_blocked", F.lit(True)), by, "left")
    reason = _reason(F.col("age_band"), F.col("_blocked").isNotNull(), F.col("_seen"))
    return rows.withColumn("dropped_by", reason).drop("_seen", "_blocked", "age_band")


def _reason(age_band: Column, blocked: Column, seen: Column) -> Column:
    """The first filter that rejects a row with in_stock and age_restricted, or null."""
    adult = F.coalesce(age_band.isin(*ADULT_AGE_BANDS), F.lit(False))
    return (
        F.when(~F.col("in_stock"), STEPS[0])
        .when(~adult & F.col("age_restricted"), STEPS[1])
        .when(blocked, STEPS[2])
        .when(seen, STEPS[3])
    )


def flagged_by_segment(shelves: DataFrame, contexts: DataFrame, seen: DataFrame, blocked: DataFrame) -> DataFrame:
    """`flagged` where all lists of a segment have the same candidates: shelves (region, age_band, article_id, score,
    category_l1, in_stock, age_restricted), a bounded number per segment; blocked has list_id.

    What a list has seen and what is blocked for it go along as arrays, and the segment's candidates, packed into a row, are
    laid out per list last: they pass no shuffle, and a list's rows are together for whatever ranks or counts them."""
    out = seen.groupBy("list_id").agg(F.collect_set("article_id").alias("_out"))
    no = blocked.groupBy("list_id").agg(F.collect_set("category_l1").alias("_no"))
    bands = contexts.select("list_id", F.col("age_band").alias("_band"))
    asked = contexts.select("list_id", "region", "age_band").join(bands, "list_id", "left")
    asked = durable(asked.join(out, "list_id", "left").join(no, "list_id", "left"))
    fields = ("article_id", "score", "category_l1", "in_stock", "age_restricted")
    packed = durable(shelves.groupBy("region", "age_band").agg(F.collect_list(F.struct(*fields)).alias("_shelf")))
    # A row per segment, so the lists stay where they are.
    met = asked.repartition("list_id").join(F.broadcast(packed), ["region", "age_band"])
    rows = met.select("list_id", "_band", "_out", "_no", F.explode("_shelf").alias("_item"))
    rows = rows.select("list_id", *[F.col(f"_item.{f}").alias(f) for f in fields], "_band", "_out", "_no")
    held = [F.coalesce(F.array_contains(a, F.col(c)), F.lit(False)) for a, c in (("_no", "category_l1"), ("_out", "article_id"))]
    return rows.withColumn("dropped_by", _reason(F.col("_band"), *held)).drop("_band", "_out", "_no")


def _share_floor(m: Column, max_share: float) -> Column:
    return F.floor(F.lit(max_share) * m)


def list_targets(rows: DataFrame, limit: int, max_share: float = MAX_SHARE) -> DataFrame:
    """Per list: the largest m up to the limit for which some m candidates keep every category within the share.

    Only the sizes of categories matter, and only up to the largest per-category limit; equal sizes fold together, so
    a list carries at most that many (size, number of categories) pairs. One item is always allowed.
    """
    most = max(1, math.floor(max_share * limit))
    sizes = rows.groupBy("list_id", "category_l1").agg(F.count(F.lit(1)).alias("n"))
    folded = sizes.groupBy("list_id", F.least("n", F.lit(most)).alias("size")).agg(
        F.count(F.lit(1)).alias("times"), F.sum("n").alias("n")
    )
    lists = folded.groupBy("list_id").agg(F.sum("n").alias("available"), F.collect_list(F.struct("size", "times")).alias("sizes"))

    def pickable(m: Column) -> Column:
        cap = _share_floor(m, max_share)
        return F.aggregate("sizes", F.lit(0).cast("bigint"), lambda acc, s: acc + F.least(s["size"], cap) * s["times"])

    ms = F.sequence(F.lit(1), F.least(F.col("available"), F.lit(limit)).cast("int"))
    target = F.array_max(F.filter(ms, lambda m: (m == 1) | (pickable(m) >= m)))
    return lists.select("list_id", "available", target.alias("target")).withColumn(
        "per_category", F.when(F.col("target") == 1, F.lit(1)).otherwise(_share_floor(F.col("target"), max_share))
    )


def cap_category(rows: DataFrame, limit: int, max_share: float = MAX_SHARE) -> DataFrame:
    """The list's target number of rows, by score, with no category above its limit.

    Both rankings stop at a constant, so map tasks pass on only the best few rows of a list and category.
    """
    if limit <= 0:
        return rows.filter(F.lit(False))
    most = max(1, math.floor(max_share * limit))
    best = newest(rows, ["list_id", "category_l1"], _by_score(), most, "_in_category")
    # Stored lists that look alike fit into few bytes, so the size of the files says nothing about whether they can be broadcast.
    allowed = best.hint("merge").join(list_targets(rows, limit, max_share), "list_id").filter(F.col("_in_category") <= F.col("per_category"))
    ranked = newest(allowed, ["list_id"], _by_score(), limit, "_place")
    return ranked.filter(F.col("_place") <= F.col("target")).drop("_in_category", "_place", "available", "target", "per_category")


def _unit_rows(embeddings: pd.Series) -> np.ndarray:
    """Unit-length rows; a missing, empty or zero vector is a zero row."""
    width = max((len(e) for e in embeddings if e is not None), default=0)
    out = np.zeros((len(embeddings), max(width, 1)))
    for i, e in enumerate(embeddings):
        if e is not None and len(e):
            out[i, : len(e)] = e
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(lengths > 0, lengths, 1.0)


def _greedy(scores: np.ndarray, unit: np.ndarray, limit: int, lam: float) -> np.ndarray:
    """Place of each row of a list, -1 where it is not chosen."""
    cosines = unit @ unit.T
    places = np.full(len(scores), -1, dtype=np.int32)
    closest = np.zeros(len(scores))
    for place in range(min(limit, len(scores))):
        # Rounded, so that equal trade-offs go to the earlier row whatever the order of the sums.
        value = np.round(lam * scores - (1 - lam) * closest, 9)
        value[places >= 0] = -np.inf
        best = int(value.argmax())
        places[best] = place
        closest = np.maximum(closest, cosines[best]) if place else cosines[best]
    return places


def _mmr(limit: int, lam: float):
    def placed(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["list_id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        scores, unit = rows["score"].to_numpy(dtype=np.float64), _unit_rows(rows["embedding"])
        bounds = zip(starts, np.r_[starts[1:], len(rows)])
        places = np.concatenate([_greedy(scores[a:b], unit[a:b], limit, lam) for a, b in bounds])
        return rows.drop(columns=["embedding"]).assign(position=places)[places >= 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # The last list may go on in the next batch.
            ids = rows["list_id"].to_numpy()
            cut = int(np.argmax(ids == ids[-1]))
            held = rows.iloc[cut:]
            if cut:
                yield placed(rows.iloc[:cut])
        if held is not None:
            yield placed(held)

    return run


def mmr_diversify(rows: DataFrame, limit: int, lam: float = LAMBDA) -> DataFrame:
    """Greedy choice of lam x score - (1 - lam) x closest chosen cosine. Lists must be cut to a bounded size first;
    `cap_category` leaves at most `limit` rows of each.

    Tasks stream over whole lists side by side, since a Python call per list would cost more than the choice itself.
    """
    if limit <= 0:
        return rows.filter(F.lit(False)).drop("embedding").withColumn("position", F.lit(0))
    ordered = rows.repartition("list_id").sortWithinPartitions("list_id", *_by_score())
    return ordered.mapInPandas(_mmr(limit, lam), rows.drop("embedding").withColumn("position", F.lit(0)).schema)


def drop_report(marked: DataFrame, limit: int, max_share: float = MAX_SHARE) -> DataFrame:
    """Rows dropped per list and step, from counts alone.

    Exactly `target` rows survive the cap, and diversity only reorders them, so neither ranking has to run for this.
    """
    counts = marked.groupBy("list_id").agg(
        *[F.count_if(F.col("dropped_by") == s).alias(s) for s in STEPS[:4]],
        F.count_if(F.col("dropped_by").isNull()).alias("_left"),
    )
    if limit > 0:
        targets = list_targets(marked.filter(F.col("dropped_by").isNull()), limit, max_share).select("list_id", "target")
        counts = counts.join(targets, "list_id", "left")
    else:
        counts = counts.withColumn("target", F.lit(0))
    counts = counts.withColumn(STEPS[4], F.col("_left") - F.coalesce("target", F.lit(0))).withColumn(STEPS[5], F.lit(0))
    steps = F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).cast("bigint").alias("dropped")) for s in STEPS])
    return counts.select("list_id", F.explode(steps).alias("s")).select("list_id", "s.step", "s.dropped")


def summary(report: DataFrame) -> DataFrame:
    """Per list: whether the cap dropped anything, how many rows fell in all, and which filters fired."""
    fired = F.concat_ws(
        ",",
        F.sort_array(F.collect_list(F.when(F.col("dropped") > 0, F.concat(F.col("step"), F.lit("="), F.col("dropped").cast("string"))))),
    )
    capped = F.max((F.col("step") == STEPS[4]) & (F.col("dropped") > 0))
    return report.groupBy("list_id").agg(
        capped.alias("diversity_cap_applied"), F.sum("dropped").alias("items_dropped"), fired.alias("filters_fired")
    )


def apply_all(
    candidates: DataFrame,
    contexts: DataFrame,
    limit: int,
    seen: DataFrame | None = None,
    blocked: DataFrame | None = None,
    max_share: float = MAX_SHARE,
    lam: float = LAMBDA,
    embeddings: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(final lists with their position, drops per list and step). Lists leave only through here.

    With `embeddings` (article_id, embedding) the vectors join after the cap, so the filters and rankings move rows
    without them.
    """
    # The cap, its targets and the report all read the marked rows.
    return arranged(durable(flagged(candidates, contexts, seen, blocked)), limit, max_share, lam, embeddings)


def arranged(
    marked: DataFrame, limit: int, max_share: float = MAX_SHARE, lam: float = LAMBDA, embeddings: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The same from rows that the filters have marked."""
    left = marked.filter(F.col("dropped_by").isNull()).drop("dropped_by")
    capped = cap_category(left, limit, max_share)
    if embeddings is not None:
        capped = capped.join(embeddings, "article_id", "left")
    return mmr_diversify(capped, limit, lam), drop_report(marked, limit, max_share)


def write_guarded(final: DataFrame, path: str) -> None:
    """The one way to the output table. A failed job leaves no committed files, so no list leaves unguarded."""
    final.write.mode("errorifexists").parquet(path)
