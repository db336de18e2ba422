"""Boosted trees grown leaf by leaf from histograms that Spark adds up, for several labels at once.

Features are cut into quantile bins. A tree grows by its best leaf first: gradients are summed per leaf, feature and bin in the
tasks and then by Spark, and the driver, which sees only these sums, picks the splits. The left children of all leaves that may
still be split are summed in one job, so a tree needs as many jobs as it is deep; what its best-first order does not use is
left out of it. All labels grow their trees in the same jobs. Rows are never collected, drawn or cut.

Gradients are summed as whole numbers, so the trees do not depend on how the rows are dealt to tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import durable

# Fixed values
LEAVES = 15
RATE = 0.05
ROUNDS = 100
PATIENCE = 10

MIN_ROWS = 20
MIN_HESSIAN = 1e-3
BINS = 64
# Gradients become whole numbers of this fraction; 2**63 / UNIT rows of one label can be summed.
UNIT = 1 << 24
# Probabilities are counted in so many steps when the area under the curve is worked out after each round.
STEPS = 1 << 14
# Trees that are added to the stored scores at once; between, a task adds them itself.
STORE_EVERY = 10

SUMS = "label int, slot int, feature int, bin int, n bigint, g bigint, h bigint"


@dataclass
class Tree:
    """Nodes are numbered as in a heap: 1 is the root, 2 i and 2 i + 1 the children of i. A row goes left where its bin is not
    above the cut."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        node = np.ones(len(codes), dtype=np.int64)
        if not self.splits:
            return node
        feature = np.full(max(self.splits) + 1, -1, dtype=np.int64)
        cut = np.zeros(len(feature), dtype=np.int64)
        for i, (f, c) in self.splits.items():
            feature[i], cut[i] = f, c
        open_ = np.arange(len(codes))
        while len(open_):
            at = node[open_]
            open_ = open_[at < len(feature)]
            open_ = open_[feature[node[open_]] >= 0]
            at = node[open_]
            node[open_] = 2 * at + (codes[open_, feature[at]] > cut[at])
        return node

    def score(self, codes: np.ndarray) -> np.ndarray:
        leaves, back = np.unique(self.leaf_of(codes), return_inverse=True)
        return np.array([self.values[int(i)] for i in leaves])[back] if len(leaves) else np.zeros(0)


@dataclass
class Booster:
    """edges: the upper ends of each feature's bins but the last. start: the score that all rows begin with."""

    edges: list[list[float]]
    start: float
    trees: list[Tree]

    def raw(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.start)
        for tree in self.trees:
            out += tree.score(codes)
        return out


def sigmoid(raw: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-raw))


def codes_of(columns: list[np.ndarray], edges: list[list[float]]) -> np.ndarray:
    """Bin of each value: how many edges are below it. Null and NaN go to the first bin."""
    out = np.zeros((len(columns[0]), len(columns)), dtype=np.uint8)
    for j, (values, ends) in enumerate(zip(columns, edges)):
        known = np.where(np.isnan(values), -np.inf, values)
        out[:, j] = np.searchsorted(np.asarray(ends, dtype=np.float64), known, side="left")
    return out


def bin_edges(rows: DataFrame, features: tuple[str, ...], bins: int = BINS) -> list[list[float]]:
    """At most `bins` - 1 different quantiles of each feature, by Spark's summary; a feature without values has none."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be from 2 to 256")
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    known = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    found = rows.agg(*[F.percentile_approx(k, shares, 10_000).alias(f"q{j}") for j, k in enumerate(known)]).first()
    return [sorted(set(found[f"q{j}"] or [])) for j in range(len(features))]


def _doubles(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.float64())
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def _binned(rows: DataFrame, features: tuple[str, ...], labels: tuple[str, ...], edges: list[list[float]], starts: list[float]) -> DataFrame:
    """(is_val, codes, labels, scores): bins and labels as bytes, one score per label."""
    fields = [F.col(f).cast("double").alias(f"f{j}") for j, f in enumerate(features)]
    slim = rows.select("is_val", *fields, *[F.col(o).cast("double").alias(f"y{k}") for k, o in enumerate(labels)])
    d, m = len(features), len(labels)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            codes = codes_of([_doubles(batch, f"f{j}") for j in range(d)], edges)
            marks = np.stack([_doubles(batch, f"y{k}") > 0 for k in range(m)], axis=1).astype(np.uint8)
            scores = np.tile(np.array(starts), (n, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _bytes(codes), _bytes(marks), _bytes(scores)], names=["is_val", "codes", "labels", "scores"]
            )

    return slim.mapInArrow(pack, "is_val boolean, codes binary, labels binary, scores binary")


def _bytes(rows: np.ndarray) -> pa.Array:
    """One binary value per row of the array."""
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(batch: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    """The array that a column of `_bytes` came from."""
    column = batch.column(batch.schema.get_field_index(name))
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


def _with_scores(stored: DataFrame, fresh: list[list[Tree]]) -> DataFrame:
    """The stored rows with the scores of new trees added."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, scores = _rows(batch, "codes", np.uint8), _rows(batch, "scores", np.float64).copy()
                for k, trees in enumerate(fresh):
                    for tree in trees:
                        scores[:, k] += tree.score(codes)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _bytes(scores)], names=["is_val", "codes", "labels", "scores"])

    return stored.mapInArrow(add, stored.schema)


def _sums_in_task(
    fresh: list[list[Tree]], grown: dict[int, Tree], wanted: dict[int, list[int]], judged: list[int], d: int, bins: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows, gradients and second derivatives per (label, wanted node, feature, bin) of a task's training rows; and under slot
    -1, feature the label 0 or 1, counts of validation rows per step of probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((3, len(nodes) * d * bins), dtype=np.int64) for k, nodes in wanted.items()}
        steps = {k: np.zeros(2 * STEPS, dtype=np.int64) for k in judged}
        for batch in batches:
            if not batch.num_rows:
                continue
            held_out = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            codes, marks = _rows(batch, "codes", np.uint8), _rows(batch, "labels", np.uint8)
            stored = _rows(batch, "scores", np.float64)
            for k in sorted({*wanted, *judged}):
                raw = stored[:, k].copy()
                for tree in fresh[k]:
                    raw += tree.score(codes)
                p = sigmoid(raw)
                if k in steps:
                    at = np.minimum((p[held_out] * STEPS).astype(np.int64), STEPS - 1)
                    steps[k] += np.bincount(marks[held_out, k].astype(np.int64) * STEPS + at, minlength=2 * STEPS)
                if k not in wanted:
                    continue
                slot_of = {node: s for s, node in enumerate(wanted[k])}
                nodes, back = np.unique(grown[k].leaf_of(codes), return_inverse=True)
                slot = np.array([slot_of.get(int(i), -1) for i in nodes], dtype=np.int64)[back]
                used = np.flatnonzero((slot >= 0) & ~held_out)
                g = np.rint((p[used] - marks[used, k]) * UNIT)
                h = np.rint(p[used] * (1.0 - p[used]) * UNIT)
                for j in range(d):
                    # A batch's sums of whole numbers are below 2**53, so doubles hold them exactly.
                    cell = (slot[used] * d + j) * bins + codes[used, j]
                    for row, weight in enumerate((None, g, h)):
                        got = np.bincount(cell, weights=weight, minlength=sums[k].shape[1])
                        sums[k][row] += got.astype(np.int64)
        for k, (n, g, h) in sums.items():
            at = np.flatnonzero(n)
            yield _sum_rows(k, at // (d * bins), at // bins % d, at % bins, n[at], g[at], h[at])
        for k, n in steps.items():
            at = np.flatnonzero(n)
            yield _sum_rows(k, np.full(len(at), -1), at // STEPS, at % STEPS, n[at], 0 * at, 0 * at)

    return run


def _sum_rows(k: int, slot, feature, bin_, n, g, h) -> pa.RecordBatch:
    ints = [np.full(len(n), k), slot, feature, bin_]
    columns = [pa.array(np.asarray(c), type=pa.int32()) for c in ints] + [pa.array(np.asarray(c), type=pa.int64()) for c in (n, g, h)]
    return pa.RecordBatch.from_arrays(columns, names=["label", "slot", "feature", "bin", "n", "g", "h"])


def area(counts: np.ndarray) -> float:
    """Area under the ROC curve from counts (2, steps) of negatives and positives; the same step counts half."""
    bad, good = counts[0].astype(float), counts[1].astype(float)
    if not bad.sum() or not good.sum():
        return 0.5
    below = np.cumsum(bad) - bad
    return float((good * (below + bad / 2)).sum() / (bad.sum() * good.sum()))


@dataclass
class _Node:
    sums: np.ndarray  # (3, features, bins): rows, gradients, second derivatives
    gain: float = 0.0
    split: tuple[int, int] | None = None

    def totals(self) -> tuple[int, int, int]:
        return tuple(int(x) for x in self.sums[:, 0, :].sum(axis=1))


def best_split(sums: np.ndarray, min_rows: int) -> tuple[float, tuple[int, int] | None]:
    """Gain and (feature, cut) of the best split of a node; equal gains go to the first feature, then the lowest cut."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = sums.sum(axis=2)[:, :, None] - left
    floor = MIN_HESSIAN * UNIT
    allowed = (left[0] >= min_rows) & (right[0] >= min_rows) & (left[2] >= floor) & (right[2] >= floor)

    def strength(part: np.ndarray) -> np.ndarray:
        return part[1].astype(float) ** 2 / np.maximum(part[2], 1) / UNIT

    whole = sums.sum(axis=2)[:, :, None]
    gain = np.where(allowed, strength(left) + strength(right) - strength(whole), 0.0)
    at = int(np.argmax(gain))
    # Differences below the rounding of the sums are none.
    if gain.size == 0 or gain.flat[at] <= 1e-9:
        return 0.0, None
    return float(gain.flat[at]), (at // gain.shape[1], at % gain.shape[1])


class _Growth:
    """One tree while it grows: known nodes, and which splits its best-first order has taken."""

    def __init__(self, leaves: int, min_rows: int, rate: float):
        self.leaves, self.min_rows, self.rate = leaves, min_rows, rate
        self.known: dict[int, _Node] = {}
        self.taken: dict[int, tuple[int, int]] = {}
        self.open: list[tuple[float, int]] = []
        self.ends: set[int] = set()

    def learn(self, node: int, sums: np.ndarray) -> None:
        gain, split = best_split(sums, self.min_rows)
        self.known[node] = _Node(sums, gain, split)
        if node == 1:
            self._leaf(1)

    def _leaf(self, node: int) -> None:
        self.ends.add(node)
        if self.known[node].split is not None:
            heapq.heappush(self.open, (-self.known[node].gain, node))

    def advance(self) -> list[int]:
        """Take splits, best first, as far as sums are known; the left children whose sums are needed next, none when done."""
        while self.open and len(self.ends) < self.leaves:
            node = self.open[0][1]
            if 2 * node not in self.known:
                # All open leaves at once; some will not be split.
                return sorted(2 * i for _, i in self.open if 2 * i not in self.known)
            heapq.heappop(self.open)
            self.taken[node] = self.known[node].split
            self.ends.remove(node)
            self._leaf(2 * node)
            self._leaf(2 * node + 1)
        return []

    def routes(self) -> Tree:
        """The taken splits and those that are being looked at."""
        return Tree(self.taken | {i: self.known[i].split for _, i in self.open})

    def tree(self) -> Tree:
        values = {}
        for node in self.ends:
            n, g, h = self.known[node].totals()
            values[node] = -self.rate * g / h if h else 0.0
        return Tree(dict(self.taken), values)


def train(
    rows: DataFrame,
    features: tuple[str, ...],
    labels: tuple[str, ...],
    rounds: int = ROUNDS,
    leaves: int = LEAVES,
    rate: float = RATE,
    min_rows: int = MIN_ROWS,
    bins: int = BINS,
    patience: int = PATIENCE,
) -> dict[str, Booster]:
    """One booster per 0/1 label, from all rows whose is_val is false; those whose is_val is true stop it.

    A label stops after `patience` rounds without a better area under the curve, counted in steps of 1 / 16,384 of
    probability, and keeps the trees up to its best round; without validation rows it stops only where no leaf can be
    split. Null features go to the lowest bin, a null label counts as 0, a null is_val as false. Without training rows
    or with one value of a label alone there are no trees. To the driver come, per job, as many sums as open leaves x features x
    bins x labels, whatever the rows.
    """
    marked = rows.withColumn("is_val", F.coalesce("is_val", F.lit(False)))
    learned = marked.filter(~F.col("is_val"))
    edges = bin_edges(learned, features, bins)
    counted = learned.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(o) > 0).alias(f"n{k}") for k, o in enumerate(labels)]).first()
    starts, live = [], []
    for k in range(len(labels)):
        good = counted[f"n{k}"]
        mixed = 0 < good < counted["n"]
        share = good / counted["n"] if counted["n"] else 0.5
        starts.append(float(np.log(good / (counted["n"] - good))) if mixed else float(np.log((share + 1e-9) / (1 - share + 1e-9))))
        live += [k] if mixed else []
    stored = durable(_binned(marked, features, labels, edges, starts))
    d = len(features)
    trees: list[list[Tree]] = [[] for _ in labels]
    fresh: list[list[Tree]] = [[] for _ in labels]
    best = {k: (-1.0, 0) for k in live}

    def gather(growth: dict[int, _Growth], wanted: dict[int, list[int]], judged: list[int]) -> dict[int, np.ndarray]:
        """Adds the sums of the wanted nodes to the growing trees; returns the validation counts."""
        routes = {k: growth[k].routes() for k in wanted}
        task = _sums_in_task([list(t) for t in fresh], routes, wanted, judged, d, bins)
        summed = stored.mapInArrow(task, SUMS).groupBy("label", "slot", "feature", "bin")
        found = summed.agg(*[F.sum(c).alias(c) for c in ("n", "g", "h")]).toPandas()
        counts = {k: np.zeros((2, STEPS), dtype=np.int64) for k in judged}
        held = {k: np.zeros((len(nodes), 3, d, bins), dtype=np.int64) for k, nodes in wanted.items()}
        for k, part in found.groupby("label"):
            judge = part[part["slot"] < 0]
            if k in counts:
                counts[k][judge["feature"].to_numpy(), judge["bin"].to_numpy()] = judge["n"].to_numpy()
            part = part[part["slot"] >= 0]
            for row, name in enumerate(("n", "g", "h")):
                if k in held:
                    held[k][part["slot"].to_numpy(), row, part["feature"].to_numpy(), part["bin"].to_numpy()] = part[name].to_numpy()
        for k, nodes in wanted.items():
            for sums, node in zip(held[k], nodes):
                growth[k].learn(node, sums)
                if node > 1:
                    growth[k].learn(node + 1, growth[k].known[node // 2].sums - sums)
        return counts

    def settle(counts: dict[int, np.ndarray]) -> list[int]:
        """Labels that go on after their last round was judged."""
        on = []
        for k, found in counts.items():
            if found.sum() and trees[k]:
                reached = area(found)
                if reached > best[k][0]:
                    best[k] = (reached, len(trees[k]))
            elif trees[k]:
                best[k] = (0.0, len(trees[k]))
            if len(trees[k]) - best[k][1] < patience:
                on.append(k)
        return on

    for done in range(rounds):
        if not live:
            break
        if done and done % STORE_EVERY == 0:
            stored = durable(_with_scores(stored, fresh))
            fresh = [[] for _ in labels]
        growth = {k: _Growth(leaves, min_rows, rate) for k in live}
        live = settle(gather(growth, {k: [1] for k in live}, live))
        growth = {k: growth[k] for k in live}
        while wanted := {k: nodes for k, g in growth.items() if (nodes := g.advance())}:
            gather(growth, wanted, [])
        for k, grown in growth.items():
            tree = grown.tree()
            if tree.splits:
                trees[k].append(tree)
                fresh[k].append(tree)
            else:
                live.remove(k)
                _judge_last(k, best, trees, gather)
    # The last round of those still growing has not been judged.
    for k in live:
        _judge_last(k, best, trees, gather)
    return {o: Booster(edges, starts[k], trees[k][: best[k][1]] if k in best else []) for k, o in enumerate(labels)}


def _judge_last(k: int, best: dict, trees: list[list[Tree]], gather: Callable) -> None:
    found = gather({}, {}, [k])[k]
    if trees[k] and (not found.sum() or area(found) > best[k][0]):
        best[k] = (area(found), len(trees[k]))


def probabilities(models: dict[str, Booster], rows: DataFrame, features: tuple[str, ...], prefix: str = "p_") -> DataFrame:
    """Adds one probability per label, in Arrow batches; the columns of rows stay as they are."""
    names = list(models)
    fields = ", ".join(f"s{k} double" for k in range(len(names)))

    @F.pandas_udf(fields)
    def scored(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for series in columns:
            values = [s.to_numpy(dtype=np.float64, na_value=np.nan) for s in series]
            binned: dict[int, np.ndarray] = {}
            out = {}
            for k, name in enumerate(names):
                model = models[name]
                if id(model.edges) not in binned:
                    binned[id(model.edges)] = codes_of(values, model.edges)
                out[f"s{k}"] = sigmoid(model.raw(binned[id(model.edges)]))
            yield pd.DataFrame(out)

    found = rows.withColumn("_scored", scored(*[F.col(f).cast("double") for f in features]))
    return found.withColumns({f"{prefix}{name}": F.col(f"_scored.s{k}") for k, name in enumerate(names)}).drop("_scored")


def nodes_of(models: dict[str, Booster], rows: DataFrame) -> DataFrame:
    """The trees as rows (objective, tree, node, feature, upto, value): a split sends values up to `upto` left, a leaf has a value."""
    out = []
    for name, model in models.items():
        for t, tree in enumerate(model.trees):
            out += [(name, t, i, f, float(model.edges[f][c]), None) for i, (f, c) in sorted(tree.splits.items())]
            out += [(name, t, i, None, None, v) for i, v in sorted(tree.values.items())]
    return rows.sparkSession.createDataFrame(out, "objective string, tree int, node int, feature int, upto double, value double")
