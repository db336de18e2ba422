"""Results of the fitted rankers, which SQL cannot check."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import learning, sampling, sequences, trees
from basketry.plans import catalogue
from basketry.plans.models_and_streams import fitted, retrieve_then_rank
from basketry.plans.registry import together

SMALL = "/root/testdata/sf0.001"


def auc(rows):
    """Share of (positive, negative) pairs in the right order; equal scores count half."""
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_probabilities_and_auc_of_all_validation_rows(spark):
    queries = catalogue.queries()
    with together():
        scored = queries["J5_boosted_rankers"](spark, SMALL).collect()
        judged = {r["objective"]: r for r in queries["J6_validation_auc"](spark, SMALL).collect()}
        labels = {(r["list_id"], r["article_id"], r["is_target"]): r for r in fitted(spark, SMALL)[1].collect()}
    assert sorted((r["list_id"], r["article_id"]) for r in scored) == sorted(k[:2] for k in labels)
    assert any(not k[2] for k in labels) and set(judged) == set(learning.OBJECTIVES)
    by_pair = {k[:2]: r for k, r in labels.items()}
    for o in learning.OBJECTIVES:
        assert all(0 <= r[f"p_{o}"] <= 1 for r in scored) and judged[o]["trees"] >= 1
        rows = [(r[f"p_{o}"], by_pair[r["list_id"], r["article_id"]][o]) for r in scored]
        assert abs(judged[o]["auc"] - auc(rows)) < 0.005  # probabilities are rounded


def test_ranked_lists_hold_their_items(spark):
    queries = catalogue.queries()
    with together():
        ranked = queries["K4_retrieve_then_rank"](spark, SMALL).collect()
        allowed = {tuple(r) for r in retrieve_then_rank(spark, SMALL)[1].select("list_id", "article_id").collect()}
        found = queries["K9_search_ranked"](spark, SMALL).collect()
        feed = queries["K10_feed_ranked"](spark, SMALL).collect()
        rules = [r for name in ("K9_ranked_rules", "K10_ranked_rules") for r in queries[name](spark, SMALL).collect()]
    assert rules and all(r["allowed"] and r["within_share"] for r in rules)
    assert {(r["user_id"], r["article_id"]) for r in ranked} <= allowed
    assert all(r["reason_text"] for r in found) and all(r["reason_code"] for r in feed)
    for rows, key, place, first in ((ranked, "user_id", "rank", 1), (found, "query", "position", 0), (feed, "list_id", "position", 0)):
        lists = defaultdict(list)
        for r in rows:
            lists[r[key]].append(r)
        assert lists
        for held in lists.values():
            held.sort(key=lambda r: r[place])
            assert [r[place] for r in held] == list(range(first, first + len(held)))
            assert len({r["article_id"] for r in held}) == len(held)
            if place == "rank":
                order = [(-r["score"], r["article_id"]) for r in held]
                assert order == sorted(order)


def test_trees_read_from_a_model_score_as_the_model_does(spark):
    names = learning.FEATURE_NAMES
    rows = spark.range(3000).select("id", *[F.round(F.rand(i), 2 if i % 2 else 12).alias(n) for i, n in enumerate(names)])
    label = ((F.col(names[0]) + F.col(names[1]) * F.rand(99)) > 0.8).cast("int")
    both = rows.select("*", label.alias("click"), (1 - label).alias("cart")).cache()
    models = learning.train_rankers(both, both, 6, ("click", "cart"))
    held = trees.forest(list(models.values()), len(names))
    assert [len(w) for w in held.weights] == [m.getNumTrees for m in models.values()]
    got = {r["id"]: r for r in learning.probabilities(models, both).collect()}
    data = learning.assembled(both)
    for o, m in models.items():
        for r in m.transform(data).select("id", "probability").collect():
            assert abs(got[r["id"]][f"p_{o}"] - r["probability"][1]) < 1e-12
    both.unpersist()


def test_a_missing_feature_is_an_error(spark):
    held = trees.Forest([np.zeros(0)] * 2, [np.zeros((1, 1), np.uint16)] * 2, np.zeros((1, 16)), [np.ones(1)], [0])
    rows = spark.createDataFrame([(1, 1.0, None)], "id bigint, a double, b double")
    with pytest.raises(Exception, match="a feature is missing"):
        trees.with_probabilities(rows, held, ("a", "b"), ["p"]).collect()


def test_validation_examples_are_drawn_before_their_histories(spark):
    rows = [(c, d, 10 * c + d, c * 7 + d) for c in range(40) for d in range(12)]
    tx = spark.createDataFrame(rows, "customer_id bigint, d int, order_id bigint, article_id bigint").select(
        "customer_id", "order_id", "article_id", F.lit(1).alias("line_no"), F.lit(1.0).alias("paid"), F.lit(1.0).alias("quantity"),
        F.lit(2.0).alias("price"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("t_dat"),
    )
    train, val = tx.filter("day(t_dat) < 10 AND customer_id % 5 > 0"), tx.filter("day(t_dat) >= 10")
    want = sampling.subsample(sequences.detailed_validation(train, val), ["example_id"], 20).collect()
    seen = []

    def detailed(part):
        seen.append(part.count())
        return part

    found = sequences.chosen_validation(train, val, 20, detailed=detailed).collect()
    assert sorted(found) == sorted(want) and len(found) == 20
    # The drawn examples, and the purchases of their customers alone.
    assert seen[0] == 20 and seen[1] == 9 * len({r["customer_id"] for r in found})
