"""Hard negatives of anchors, read off a shuffle that sorts each anchor's pairs by descending score."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.llm.common import column, in_blocks
from basketry.session import durable

POSITIVES = 5
NEGATIVES = 3
# A negative's score is at least FLOOR and at most CEILING hundredths of its positive's.
FLOOR = 50
CEILING = 95
SCALE = 256
# Rows and anchors whose products one task works out; and sorted pairs of one task of the shuffle, about.
BLOCK_ROWS = 4096
BLOCK_ANCHORS = 2048
SORTED_PAIRS = 1_000_000
_STEP = 128
_TOP = 1 << 63
_KEY = ">QQBQ"
LONGEST_SQUARE = float(1 << 62)


def packed_key(anchor: int, score: int, negative: bool, row: int) -> bytes:
    """Sorts by anchor, then descending score, positives before negatives of one score, then id."""
    return struct.pack(_KEY, anchor + _TOP, _TOP - 1 - score, negative, row + _TOP)


def unpacked_key(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, row = struct.unpack(_KEY, key)
    return anchor - _TOP, _TOP - 1 - score, bool(negative), row - _TOP


def stream(keys: Iterator[bytes], positives: int, negatives: int, floor: int, ceiling: int) -> Iterator[tuple[int, ...]]:
    """(anchor, positive, rank, negative, positive score, negative score) from sorted keys.

    A positive opens a window, up to `positives` for an anchor; a negative is given out for each window that it falls into.
    A window closes when it is full or its lowest score is passed. Nothing of an anchor is held but its open windows.
    """
    now, opened, windows = None, 0, []
    for key in keys:
        anchor, score, negative, row = unpacked_key(key)
        if anchor != now:
            now, opened, windows = anchor, 0, []
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([row, score, 0])
            continue
        left = []
        for window in windows:
            positive, high, given = window
            if 100 * score < floor * high:
                continue
            if 100 * score <= ceiling * high:
                given = window[2] = given + 1
                yield now, positive, given, row, high, score
            if given < negatives:
                left.append(window)
        windows = left


def _scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products, exact: by floating point where every sum stays below 2**53, by integers beyond."""
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _first(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first k columns of each row that are ok, by descending score, then column."""
    n = scores.shape[1]
    held = np.where(ok, scores, np.iinfo(np.int64).min)
    if n > k:
        least = np.partition(held, n - k, axis=1)[:, n - k]
        ok = ok & (held >= least[:, None])
    row, col = np.nonzero(ok)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def _held(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    df = df.sort_values("id")
    return df["id"].to_numpy(np.int64), df["label"].to_numpy(np.int64), np.stack(df["vector"].to_list()).astype(np.float64)


def _bound(a: np.ndarray, b: np.ndarray) -> float:
    """No sum of products of parts of two rows is larger."""
    return float(np.sqrt((a * a).sum(axis=1).max() * (b * b).sum(axis=1).max()) + 1)


def _nearest_of_label(k: int):
    def nearest(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The block's first k other rows of each anchor's label."""
        found: list[tuple] = [tuple(np.zeros(0, np.int64) for _ in range(3))]
        if len(anchors) and len(rows):
            (who, kinds, wanted), (ids, labels, held) = _held(anchors), _held(rows)
            largest = _bound(wanted, held)
            for label in np.unique(kinds):
                mine, theirs = np.flatnonzero(kinds == label), np.flatnonzero(labels == label)
                for start in range(0, len(mine), _STEP) if len(theirs) else ():
                    some = mine[start : start + _STEP]
                    scores = _scores(wanted[some], held[theirs], largest)
                    row, col = _first(scores, who[some][:, None] != ids[theirs][None, :], k)
                    found.append((who[some[row]], scores[row, col], ids[theirs[col]]))
        return pd.DataFrame(dict(zip(("anchor", "score", "row"), map(np.concatenate, zip(*found)))))

    return nearest


def _in_windows(k: int, floor: int, ceiling: int):
    def inside(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The block's first k rows of other labels in any window of each anchor; `highs` are its positives' scores."""
        found: list[tuple] = [tuple(np.zeros(0, np.int64) for _ in range(3))]
        if len(anchors) and len(rows):
            anchors = anchors.sort_values("id")
            (who, kinds, wanted), (ids, labels, held) = _held(anchors), _held(rows)
            highs, largest = anchors["highs"].to_list(), _bound(wanted, held)
            most = max(len(h) for h in highs)
            for start in range(0, len(who), _STEP):
                some = np.arange(start, min(start + _STEP, len(who)))
                scores = _scores(wanted[some], held, largest)
                other = kinds[some][:, None] != labels[None, :]
                met = []
                for j in range(most):
                    # A window without a positive holds nothing.
                    low = np.array([-(-floor * int(highs[i][j]) // 100) if j < len(highs[i]) else 1 for i in some], np.int64)
                    high = np.array([ceiling * int(highs[i][j]) // 100 if j < len(highs[i]) else 0 for i in some], np.int64)
                    row, col = _first(scores, other & (scores >= low[:, None]) & (scores <= high[:, None]), k)
                    met.append(row * len(ids) + col)
                row, col = np.divmod(np.unique(np.concatenate(met)), len(ids))
                found.append((who[some[row]], scores[row, col], ids[col]))
        return pd.DataFrame(dict(zip(("anchor", "score", "row"), map(np.concatenate, zip(*found)))))

    return inside


def cleaned(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, vector) of the rows that take part, vectors scaled and rounded down, one row for an id."""
    own = vectors.select(
        column(id_col).cast("bigint").alias("id"),
        column(label_col).cast("bigint").alias("label"),
        F.transform(column(vector_col).cast("array<double>"), lambda x: x * scale).alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    # Long results reach so far; by the lengths' product no score of two such rows is larger. Adding 0.0 unites both zeros.
    floors = F.transform("vector", lambda x: F.floor(F.when(F.abs(x) < float(1 << 31), x).otherwise(0)).cast("double") + F.lit(0.0))
    short = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) < F.lit(LONGEST_SQUARE)
    own = own.filter(short & F.forall("vector", lambda x: F.abs(x) < float(1 << 31)))
    return own.select("id", F.struct("label", floors.alias("vector")).alias("held")).groupBy("id").agg(F.min("held").alias("held")).select("id", "held.*")


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    floor: int = FLOOR,
    ceiling: int = CEILING,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
    sorted_pairs: int = SORTED_PAIRS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `is_anchor` holds.

    A component x counts as floor(scale * x); a score is the inner product with the anchor. An anchor's positives are its
    first `positives` other rows of the same label by descending score, then id; for each, the first `negatives` rows of
    other labels whose score is `floor` to `ceiling` hundredths of the positive's are returned, all if fewer. A positive
    with a negative score has none.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do rows whose scores may not
    fit a long (components beyond 2**31 after scaling, or a length beyond 2**31). Empty vectors score 0 with each other;
    vectors of different lengths are not compared. Of rows with the same id the smallest (label, vector) takes part, so
    repeated rows change nothing. Other columns are not read. An empty table gives an empty result.

    All pairs are worked out in blocks, and a block passes on those that can be in the result: of each anchor its own first
    rows of the label, then, with the positives known, its own first rows of each window. Those go to the shuffle under
    (anchor, descending score, id), are sorted there, and each task reads its anchors as a stream.
    """
    rows = durable(cleaned(vectors, id_col, label_col, vector_col, scale).withColumn("dim", F.size("vector")))
    chosen = durable(rows.join(vectors.filter(is_anchor).select(column(id_col).cast("bigint").alias("id")).distinct(), "id", "left_semi"))
    kinds = "anchor bigint, score bigint, row bigint"
    left, right = in_blocks(chosen, rows, "dim", "id", "id", block_anchors, block_rows)
    near = durable(left.cogroup(right).applyInPandas(_nearest_of_label(positives), kinds))
    order = W.partitionBy("anchor").orderBy(F.desc("score"), F.asc("row"))
    first = near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives)
    highs = first.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("highs"))
    left, right = in_blocks(durable(chosen.join(highs, "id")), rows, "dim", "id", "id", block_anchors, block_rows)
    far = left.cogroup(right).applyInPandas(_in_windows(negatives, floor, ceiling), kinds)
    pairs = durable(near.withColumn("negative", F.lit(False)).union(far.withColumn("negative", F.lit(True))))

    spark = vectors.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // sorted_pairs))
    keys = pairs.rdd.map(lambda r: (packed_key(r[0], r[1], r[3], r[2]), None))
    dealt = keys.repartitionAndSortWithinPartitions(tasks, lambda key: zlib.crc32(key[:8]))
    found = dealt.mapPartitions(lambda part: stream((key for key, _ in part), positives, negatives, floor, ceiling))
    kinds = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.createDataFrame(found, kinds)
