"""Leaf-wise boosting beside plain loops, and its results."""

import numpy as np
import pytest

from basketry.operators import boosting, learning
from basketry.operators.features import FEATURE_NAMES
from basketry.plans.models_and_streams import j5_leafwise, j6_leafwise, leafwise
from basketry.plans.registry import together

SMALL = "/root/testdata/sf0.001"
SCHEMA = "a double, b double, c double, y int, z int, is_val boolean"


def made(n=600, seed=3):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = float(draw.normal()), float(draw.integers(0, 4)), float(draw.random())
        y = int(a + 0.8 * (b == 2) * (c > 0.5) + 0.5 * draw.normal() > 0.3)
        z = int(c * b + draw.normal() > 2)
        rows.append((None if i % 37 == 0 else a, b, c, None if i % 101 == 0 else y, z, i % 4 == 0))
    return rows


def plain_trees(rows, edges, label, start, rounds, leaves, rate, min_rows):
    """Every split of every leaf by sums over its rows, best gain first."""
    codes = [[0 if v is None else sum(e < v for e in edges[j]) for j, v in enumerate(r[:3])] for r in rows]
    marks = [1 if (r[label] or 0) > 0 else 0 for r in rows]
    raw, unit, trees = [start] * len(rows), boosting.UNIT, []
    for _ in range(rounds):
        p = [1 / (1 + np.exp(-s)) for s in raw]
        g = [int(np.rint((p[i] - marks[i]) * unit)) for i in range(len(rows))]
        h = [int(np.rint(p[i] * (1 - p[i]) * unit)) for i in range(len(rows))]

        def strength(part):
            return float(sum(g[i] for i in part)) ** 2 / max(sum(h[i] for i in part), 1) / unit

        members, splits = {1: list(range(len(rows)))}, {}
        while len(members) < leaves:
            found = []
            for node, part in members.items():
                for f in range(3):
                    for cut in range(boosting.BINS - 1):
                        left = [i for i in part if codes[i][f] <= cut]
                        right = [i for i in part if codes[i][f] > cut]
                        if min(len(left), len(right)) >= min_rows:
                            found.append((-(strength(left) + strength(right) - strength(part)), node, f, cut, left, right))
            if not found or min(found)[0] >= -1e-9:
                break
            _, node, f, cut, left, right = min(found)
            splits[node] = (f, cut)
            del members[node]
            members[2 * node], members[2 * node + 1] = left, right
        values = {node: -rate * sum(g[i] for i in part) / sum(h[i] for i in part) for node, part in members.items()}
        for node, part in members.items():
            for i in part:
                raw[i] += values[node]
        trees.append((splits, values))
    return trees


def test_trees_equal_plain_loops_however_rows_are_dealt(spark):
    rows = made()
    asked = dict(rounds=3, leaves=6, rate=0.3, min_rows=8, bins=8, patience=100)
    models = [
        boosting.train(spark.createDataFrame(rows, SCHEMA).repartition(parts), ("a", "b", "c"), ("y", "z"), **asked)
        for parts in (1, 7)
    ]
    learned = [r for r in rows if not r[5]]
    for label, at in (("y", 3), ("z", 4)):
        model, other = models[0][label], models[1][label]
        assert model.edges == other.edges and 1 <= len(model.trees) <= 3
        assert [t.splits for t in model.trees] == [t.splits for t in other.trees]
        good = sum((r[at] or 0) > 0 for r in learned)
        assert model.start == pytest.approx(np.log(good / (len(learned) - good)))
        plain = plain_trees(learned, model.edges, at, model.start, len(model.trees), 6, 0.3, 8)
        for tree, (splits, values) in zip(model.trees, plain):
            assert tree.splits == splits and len(tree.values) == len(values) <= 6
            assert tree.values == pytest.approx(values)


def test_scores_follow_the_trees_past_stored_rounds(spark):
    rows = [r[:5] + (False,) for r in made()]
    df = spark.createDataFrame(rows, SCHEMA)
    model = boosting.train(df, ("a", "b", "c"), ("y",), rounds=boosting.STORE_EVERY + 2, leaves=4, min_rows=20, bins=8)["y"]
    assert len(model.trees) == boosting.STORE_EVERY + 2  # nothing stops it without validation rows
    # The last tree continues what all trees before it, stored or not, have reached.
    columns = [np.array([np.nan if r[j] is None else r[j] for r in rows]) for j in range(3)]
    codes = boosting.codes_of(columns, model.edges)
    before = boosting.Booster(model.edges, model.start, model.trees[:-1]).raw(codes)
    p, marks = boosting.sigmoid(before), np.array([(r[3] or 0) for r in rows])
    leaf = model.trees[-1].leaf_of(codes)
    for node, value in model.trees[-1].values.items():
        at = leaf == node
        assert value == pytest.approx(-boosting.RATE * (p - marks)[at].sum() / (p * (1 - p))[at].sum(), rel=1e-4, abs=1e-7)
    held = boosting.probabilities({"y": model}, df.withColumnRenamed("z", "s0"), ("a", "b", "c")).collect()
    whole = sorted(boosting.sigmoid(model.raw(codes)).tolist())
    assert sorted(r["p_y"] for r in held) == pytest.approx(whole) and "s0" in held[0].asDict()
    rows_of = boosting.nodes_of({"y": model}, df).collect()
    assert len(rows_of) == sum(len(t.splits) + len(t.values) for t in model.trees)


def test_area_equals_pairs():
    draw = np.random.default_rng(1)
    counts = np.zeros((2, 50), dtype=np.int64)
    points = [(int(draw.integers(0, 50)), int(draw.integers(0, 2))) for _ in range(300)]
    for step, mark in points:
        counts[mark, step] += 1
    good, bad = [s for s, y in points if y], [s for s, y in points if not y]
    pairs = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert boosting.area(counts) == pytest.approx(pairs)
    assert boosting.area(np.zeros((2, 50))) == 0.5


def test_empty_and_one_sided_tables_have_no_trees(spark):
    empty = boosting.train(spark.createDataFrame([], SCHEMA), ("a", "b", "c"), ("y",))
    assert empty["y"].trees == [] and empty["y"].edges == [[], [], []]
    rows = [r[:3] + (1, r[4], None) for r in made(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = boosting.train(df, ("a", "b", "c"), ("y", "z"), rounds=2)
    assert model["y"].trees == [] and len(model["z"].trees) == 2
    assert all(r["p_y"] > 0.99 for r in boosting.probabilities(model, df, ("a", "b", "c")).collect())


def test_leafwise_rankers_on_the_smallest_table(spark):
    with together():
        scored = j5_leafwise(spark, SMALL).collect()
        judged = {r["objective"]: r for r in j6_leafwise(spark, SMALL).collect()}
        models, val = leafwise(spark, SMALL)
        labels = val.collect()
    assert sorted((r["list_id"], r["article_id"]) for r in scored) == sorted((r["list_id"], r["article_id"]) for r in labels)
    assert set(judged) == set(learning.OBJECTIVES)
    names = list(FEATURE_NAMES)
    columns = [np.array([np.nan if r[f] is None else float(r[f]) for r in labels]) for f in names]
    for o, model in models.items():
        assert all(2 <= len(t.values) <= boosting.LEAVES for t in model.trees)
        p = boosting.sigmoid(model.raw(boosting.codes_of(columns, model.edges)))
        assert sorted(r[f"p_{o}"] for r in scored) == pytest.approx(sorted(p.tolist()), abs=1e-6)
        good, bad = [x for x, r in zip(p, labels) if r[o]], [x for x, r in zip(p, labels) if not r[o]]
        pairs = sum((g > np.array(bad)).sum() + (g == np.array(bad)).sum() / 2 for g in good) / (len(good) * len(bad))
        assert judged[o]["auc"] == pytest.approx(pairs, abs=1e-6) and judged[o]["trees"] == len(model.trees)
