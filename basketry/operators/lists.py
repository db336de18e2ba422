"""Inverted lists over item vectors: exact search that skips lists by their bounds, and search of the nearest few lists.

Items are dealt to the nearest of a set of centres. A list keeps its centre, its radius (the largest distance of an item from
the centre) and its size. No item of a list scores above q.c + |q| r, so a query looks at its lists in falling order of that
bound and can leave out every list whose bound is under the score it already has in its last place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import durable

# Centres are fitted on at most this many items, chosen by a hash of the id; every item is listed.
SAMPLE = 16_384
# The list table goes to every task, so it has a fixed bound; lists of a larger catalogue hold more items.
MAX_LISTS = 4096
ROUNDS = 8
# Lists beside the square root of the catalogue, where a query looks at some of them only.
LISTS_PER_ROOT = 2.0
RECALL = 0.95
# Queries, chosen by a hash of the id, that the number of lists to look at is worked out from.
JUDGED = 200
MARGIN = 1e-6


@dataclass
class Lists:
    """The list table, and the items with the list that holds them (cell, article_id, vector), stored once."""

    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    items: DataFrame

    def first(self):
        """(vector, fetch) -> lists of the best bounds, as many as hold `fetch` items."""
        centres, radii, sizes = self.centres, self.radii, self.sizes

        def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for vectors, fetch in batches:
                if not len(vectors):
                    yield pd.Series([], dtype=object)
                    continue
                order, _ = ranked(np.stack(vectors.to_list()).astype(np.float64), centres, radii)
                held = np.cumsum(sizes[order], axis=1)
                wanted = held - sizes[order] < fetch.to_numpy()[:, None]
                yield pd.Series([o[w] for o, w in zip(order, wanted)])

        return F.pandas_udf(of, "array<int>")

    def within(self):
        """(vector, floor) -> all lists whose bound reaches the floor."""
        centres, radii = self.centres, self.radii

        def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for vectors, floor in batches:
                if not len(vectors):
                    yield pd.Series([], dtype=object)
                    continue
                order, bounds = ranked(np.stack(vectors.to_list()).astype(np.float64), centres, radii)
                yield pd.Series([o[w] for o, w in zip(order, bounds >= floor.to_numpy(np.float64)[:, None] - MARGIN)])

        return F.pandas_udf(of, "array<int>")

    def nearest(self, probes: int):
        """vector -> the `probes` lists of the nearest centres, as `places` orders them."""
        centres = self.centres

        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                if not len(vectors):
                    yield pd.Series([], dtype=object)
                    continue
                yield pd.Series(list(places(np.stack(vectors.to_list()).astype(np.float64), centres)[:, :probes]))

        return F.pandas_udf(of, "array<int>")


def ranked(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lists, bounds) of each query, largest bound first."""
    bounds = queries @ centres.T + np.linalg.norm(queries, axis=1, keepdims=True) * radii[None, :]
    order = np.argsort(-bounds, axis=1, kind="stable")
    return order, np.take_along_axis(bounds, order, axis=1)


def places(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lists of each query by falling product with the centre."""
    return np.argsort(-(queries @ centres.T), axis=1, kind="stable")


def _nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * vectors @ centres.T).argmin(axis=1)


def fit(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by k-means; the first are spread over the sample, each next one taken where the squared distance to those
    before is largest. Centres that lose all their vectors go."""
    lists = min(lists, len(sample))
    centres = np.empty((lists, sample.shape[1]))
    centres[0] = sample[0]
    gap = ((sample - centres[0]) ** 2).sum(axis=1)
    for i in range(1, lists):
        centres[i] = sample[gap.argmax()]
        gap = np.minimum(gap, ((sample - centres[i]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = _nearest_centre(sample, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = sums[n > 0] / n[n > 0, None]
    return centres


def build(items: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> Lists:
    """Deal all items (article_id, vector) to `lists` lists at most, MAX_LISTS if fewer."""
    stock = items.select("article_id", F.col("vector").cast("array<double>").alias("vector"))
    chosen = stock.orderBy(F.xxhash64("article_id"), "article_id").limit(sample).select("vector").toPandas()
    centres = fit(np.stack(chosen["vector"].to_list()), min(lists, MAX_LISTS), rounds)

    def deal(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            m = np.stack(vectors.to_list()) if len(vectors) else np.zeros((0, centres.shape[1]))
            own = _nearest_centre(m, centres)
            yield pd.DataFrame({"cell": own.astype(np.int32), "away": np.linalg.norm(m - centres[own], axis=1)})

    dealt = stock.withColumn("_d", F.pandas_udf(deal, "cell int, away double")("vector"))
    dealt = durable(dealt.select("_d.cell", "_d.away", "article_id", "vector"))
    table = dealt.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).toPandas()
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    radii[table["cell"]], sizes[table["cell"]] = table["radius"], table["n"]
    return Lists(centres, radii, sizes, dealt.select("cell", "article_id", "vector"))


def lists_for(items: int, per_root: float = LISTS_PER_ROOT) -> int:
    return max(1, min(MAX_LISTS, round(per_root * math.sqrt(items))))


def rank_of_list(queries: DataFrame, held: Lists) -> DataFrame:
    """(..., cell, probe): each query (vector) beside every list, with the list's place in the query's order, from 0."""
    placed = held.nearest(len(held.centres))
    return queries.select("*", F.posexplode(placed("vector")).alias("probe", "cell"))


def probes_for(truth: DataFrame, queries: DataFrame, held: Lists, recall: float = RECALL) -> int:
    """The fewest nearest lists that hold the share `recall` of the true results (query_id, article_id) of `queries`."""
    places = rank_of_list(queries.select("query_id", "vector"), held).select("query_id", "cell", "probe")
    met = truth.join(held.items.select("article_id", "cell"), "article_id").join(places, ["query_id", "cell"])
    steps = met.groupBy("probe").count().orderBy("probe").toPandas()
    if not len(steps):
        return 1
    share = steps["count"].cumsum() / steps["count"].sum()
    return int(steps["probe"][(share >= recall).to_numpy().argmax()]) + 1
