"""Inverted lists, bounded exact search, and factorised item vectors, beside dense versions."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import candidates, factors, lists, retrieval
from basketry.session import dropped, shared_dir

ROWS = "article_id bigint, vector array<double>"


def clustered(n, dim, seed, centres=12, noise=0.15):
    rng = np.random.RandomState(seed)
    held = rng.normal(size=(centres, dim))
    x = held[rng.randint(centres, size=n)] + noise * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, key="article_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} bigint, vector array<double>")


def best(x, q, k, out=()):
    scores = np.round(x @ q, 9)
    return [int(i) for i in np.lexsort((np.arange(len(x)), -scores)) if i not in out][:k]


def test_bounds_hold():
    x = clustered(400, 8, 1)
    centres = lists.fit(x, 20)
    own = lists._nearest_centre(x, centres)
    radii = np.array([np.linalg.norm(x[own == c] - centres[c], axis=1).max() if (own == c).any() else 0 for c in range(len(centres))])
    queries = np.random.RandomState(2).normal(size=(30, 8))
    order, bounds = lists.ranked(queries, centres, radii)
    for q, cells, tops in zip(queries, order, bounds):
        for c, top in zip(cells, tops):
            assert not (own == c).any() or (x[own == c] @ q).max() <= top + 1e-9


@pytest.mark.parametrize("kind", ["clustered", "scattered"])
def test_bounded_search_is_exact(spark, kind):
    x = clustered(600, 8, 3) if kind == "clustered" else np.random.RandomState(3).normal(size=(600, 8))
    x[10:40] = x[10]  # ties
    queries = np.random.RandomState(4).normal(size=(15, 8))
    queries[0] = 0.0
    out = [(q, i) for q in range(15) for i in best(x, queries[q], q)]
    exclude = spark.createDataFrame(out, "query_id bigint, article_id bigint")
    found = retrieval.top_k(frame(spark, queries, "query_id"), frame(spark, x), 12, exclude, item_block=40).collect()
    for q in range(15):
        got = [r["article_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
        assert got == best(x, queries[q], 12, {i for p, i in out if p == q})


@pytest.mark.parametrize("kind", ["exact", "hashed", "listed"])
def test_search_moves_only_queries_items_and_results(spark, kind):
    """Results are cut where they are found: none are ranked again after a shuffle, and a query moves once."""
    x = np.random.RandomState(5).normal(size=(300, 8))
    asked, stock = frame(spark, np.tile(x, (40, 1)), "query_id"), frame(spark, x)
    exclude = asked.select("query_id", (F.col("query_id") % 300).alias("article_id"))
    found = {
        "exact": lambda: retrieval.top_k(asked, stock, 5, exclude, 1000),
        "hashed": lambda: retrieval.top_k_hashed(asked, stock, 5, 8, exclude),
        "listed": lambda: retrieval.top_k_listed(asked, stock, 5, exclude, probes=4),
    }[kind]()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "FlatMapCoGroups" not in plan and plan.count("MapInArrow") == 1
    rows = found.filter("query_id < 300").collect()
    assert len(rows) == 300 * 5 and not any(r["query_id"] == r["article_id"] for r in rows)


def test_search_keeps_one_result_list_for_a_repeated_query(spark):
    x = np.random.RandomState(6).normal(size=(50, 8))
    asked = frame(spark, x[:9], "query_id")
    twice = asked.unionByName(asked.withColumn("query_id", F.lit(3).cast("bigint")))
    got = retrieval.top_k(twice, frame(spark, x), 4).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {i: 4 for i in range(9)}


def test_bounded_search_leaves_lists_out(spark):
    x = clustered(3000, 8, 5, noise=0.02)
    held = lists.build(frame(spark, x), 40)
    asked = frame(spark, x[:50], "query_id")
    work = retrieval.pairs_within_bounds(asked, held, 10).first()
    assert work["everything"] == 50 * 3000 and work["pairs"] < 0.4 * work["everything"]


def test_listed_search_keeps_its_recall_as_the_catalogue_grows(spark):
    shares = []
    base = clustered(400, 16, 6, centres=40, noise=0.4)
    for times in (1, 10):
        rng = np.random.RandomState(7)
        x = np.concatenate([base + 0.05 * rng.normal(size=base.shape) * (t > 0) for t in range(times)])
        stock, asked = frame(spark, x), frame(spark, x[:60], "query_id")
        held = lists.build(stock, lists.lists_for(len(x)))
        probes = retrieval.probes_of(asked.withColumn("fetch", F.lit(10)), held, 10)
        found = retrieval.top_k_listed(asked, stock, 10, held=held, probes=probes)
        assert retrieval.recall_against(found, retrieval.top_k(asked, stock, 10)).first()["recall"] >= 0.9
        shares.append(retrieval.listed_share(asked, held, probes).first()[0])
    assert shares[1] < shares[0]


def test_listed_search_fills_short_lists(spark):
    x = clustered(30, 4, 8)
    found = retrieval.top_k_listed(frame(spark, x[:5], "query_id"), frame(spark, x), 25, probes=1).collect()
    assert len(found) == 5 * 25


def directed(pairs):
    return [(a, b, n) for a, b, n in pairs] + [(b, a, n) for a, b, n in pairs]


def test_factorised_vectors_are_the_dense_ones(spark):
    rng = np.random.RandomState(9)
    pairs = [(i, j, int(n)) for i in range(14) for j in range(i + 1, 14) if (n := rng.poisson(3 + 9 * ((i < 7) == (j < 7)))) > 0]
    counts = spark.createDataFrame(directed(pairs), "item bigint, neighbour bigint, cnt bigint")
    dense = np.zeros((14, 14))
    for a, b, n in directed(pairs):
        dense[a, b] = n
    pmi = np.where(dense > 0, np.log(np.maximum(dense, 1) * dense.sum() / np.outer(dense.sum(1), dense.sum(1))), 0)
    pmi = np.maximum(pmi, 0)
    got = {(r["item"], r["neighbour"]): r["weight"] for r in factors.shifted_pmi(counts).collect()}
    assert got == pytest.approx({(i, j): pmi[i, j] for i, j in zip(*np.nonzero(pmi))})
    weights, directions = np.linalg.eigh(pmi)
    order = np.argsort(-np.abs(weights))[:3]
    rows = factors.factorised(counts, dim=3, rounds=60).collect()
    mine = np.zeros((14, 3))
    for r in rows:
        mine[r["item"]] = r["vector"]
    # Equal up to the sign of each component.
    want = directions[:, order] * np.sqrt(np.abs(weights[order]))
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-3)
    assert np.allclose(np.abs((mine * want).sum(axis=0)), (want * want).sum(axis=0), atol=1e-3)


def test_factorised_vectors_of_fewer_items_than_components(spark):
    counts = spark.createDataFrame(directed([(1, 2, 5), (2, 3, 1)]), "item bigint, neighbour bigint, cnt bigint")
    found = factors.item_vectors(counts, dim=6, rounds=3).collect()
    assert {r["article_id"] for r in found} <= {1, 2, 3} and all(len(r["vector"]) == 6 and np.isfinite(r["vector"]).all() for r in found)


def test_lists_whose_intents_reach_no_item_fall_back(spark):
    """A mixed case: list 1 is served by its intents, list 2 has one but finds nothing unseen, list 3 is cold."""
    contexts = spark.createDataFrame([(i, "r", "b") for i in (1, 2, 3)], "list_id bigint, region string, age_band string")
    intents = spark.createDataFrame(
        [(1, 1, "complementary", 1.0, [1.0, 0.0]), (2, 1, "complementary", 1.0, [0.0, 1.0]), (3, 1, "cold_start", 1.0, [0.0, 0.0])],
        "list_id bigint, intent_rank int, label string, weight double, vector array<double>",
    )
    stock = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0])], ROWS)
    seen = spark.createDataFrame([(2, 10), (2, 11)], "list_id bigint, article_id bigint")
    popular = spark.createDataFrame([("r", "b", 12, 5, 1)], "region string, age_band string, article_id bigint, n bigint, rank int")
    got = sorted((r["list_id"], r["article_id"], r["label"], r["degraded"]) for r in candidates.feed_candidates(contexts, intents, stock, seen, popular).collect())
    assert got == [(1, 10, "complementary", None), (1, 11, "complementary", None), (2, 12, "popularity_fallback", "retrieval"), (3, 12, "cold_start", None)]


def test_items_move_no_more_often_than_tasks_run():
    """900,000 queries of 20 results fit into one block for each of 12 tasks; blocks for more results are smaller."""
    assert retrieval._grid(900_000, 1_200_000, retrieval.block_for(20), 8192, 12) == (12, 1)
    assert retrieval.block_for(150) * (150 + retrieval.EXCLUDED) <= retrieval.RESULTS < 131_072 * 170


def test_pooled_vectors_move_as_they_are_stored(spark):
    """No partial means move: rows move once to their customer, and all of the aggregate is worked out there."""
    x = np.random.RandomState(11).normal(size=(30, 8))
    rows = spark.createDataFrame([(c, (c * 7 + i) % 40) for c in range(9) for i in range(5)], "customer_id bigint, article_id bigint")
    found = candidates.pooled_vectors(rows, frame(spark, x, "article_id"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [customer_id") < plan.index("RepartitionByExpression [customer_id")
    for r in found.collect():
        mean = np.mean([x[a] for a in ((r["customer_id"] * 7 + i) % 40 for i in range(5)) if a < 30], axis=0)
        assert np.allclose(r["user_vector"], mean / np.linalg.norm(mean))


def test_products_of_pairs_move_no_vectors_with_the_rows(spark):
    """Repeated rows and items, null keys and missing vectors and components, beside a plain loop."""
    rng = np.random.RandomState(12)
    x, users = rng.normal(size=(30, 4)), rng.normal(size=(6, 4))
    rows = [(i % 8, int(rng.randint(34)), f"r{i % 3}") for i in range(200)] + [(None, 3, "n"), (2, None, "n")]
    asked = spark.createDataFrame(rows, "list_id bigint, article_id bigint, label string")
    sides = spark.createDataFrame(
        [(i, u.tolist(), None if i == 1 else (-u).tolist()) for i, u in enumerate(users)] + [(None, [1.0] * 4, [1.0] * 4)],
        "list_id bigint, one array<double>, two array<double>",
    )
    held = [(i, v.tolist(), i * 10) for i, v in enumerate(x)] + [(5, x[5].tolist(), 51), (31, None, 0), (32, [1.0, None, 1.0, 1.0], 0)]
    items = spark.createDataFrame(held, "article_id bigint, vector array<double>, price int")
    found = retrieval.with_products(asked, sides, items)
    want = []
    for l, a, label in rows:
        for i, v, price in held:
            if a == i:
                ok = l is not None and l < 6 and v is not None and None not in v
                one = float(users[l] @ np.array(v)) if ok else 0.0
                want.append((str(l), a, label, price, round(one, 9) + 0.0, (0.0 if l == 1 else round(-one, 9)) + 0.0))
    got = [(str(r["list_id"]), r["article_id"], r["label"], r["price"], round(r["one"], 9) + 0.0, round(r["two"], 9) + 0.0) for r in found.collect()]
    assert sorted(got) == sorted(want)


def test_lists_of_a_segment_take_one_result(spark):
    from basketry.plans import surfaces

    rows = [(1, "r", "b"), (2, "r", "b"), (3, "r", "b"), (4, "r", "c"), (5, None, "b"), (6, "r", "b"), (6, "r", "b"), (7, "r", "b"), (None, "r", "b")]
    contexts = spark.createDataFrame(rows, "list_id bigint, region string, age_band string")
    asked, members = surfaces.by_segment(contexts, spark.createDataFrame([(3,)], "list_id bigint"))
    # 1 stands for 2 and 7; lists with a session, without a segment or key, or there twice stand for themselves.
    assert sorted(str(r[0]) for r in asked.select("list_id").collect()) == ["1", "3", "4", "5", "6", "6", "None"]
    found = asked.select("list_id", (F.col("list_id") * 10).alias("x"))
    got = sorted((r[0], r[1]) for r in surfaces.handed_to(members, found).collect() if r[0] is not None)
    assert got == [(1, 10), (2, 10), (3, 30), (4, 40), (5, 50), (6, 60), (6, 60), (7, 10)]


@pytest.mark.parametrize("held", [10, 1000])
def test_matrix_times_vectors_by_cells(spark, held, monkeypatch):
    """Over a grid of several ranges of items and neighbours, and of one; no vector moves with a pair."""
    monkeypatch.setattr(factors, "LEAST_ITEMS", 10)
    rng = np.random.RandomState(13)
    m = np.triu(rng.rand(40, 40) * (rng.rand(40, 40) < 0.3), 1)
    m[0, 1] = 0.5
    m = m + m.T
    pairs = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "item bigint, neighbour bigint, weight double")
    grid = factors.gridded(pairs, held)
    assert (grid.n_held, grid.n_item) == ((4, 2) if held == 10 else (1, 4))
    x = rng.normal(size=(40, 3))
    found = factors._times(grid, frame(spark, x, "item"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["item"]: r["vector"] for r in found.collect()}
    assert all(np.allclose(got[i], (m @ x)[i]) for i in range(40) if m[i].any()) and len(got) == int(m.any(axis=1).sum())


def test_products_that_single_precision_cannot_tell_apart(spark):
    # Scores differ by some 1e-8, which single precision loses, between vectors of very different lengths.
    rs = np.random.RandomState(5)
    base = rs.normal(size=16)
    items = [(i, (base + 1e-8 * rs.normal(size=16)).tolist()) for i in range(300)] + [(1000, (1e3 * rs.normal(size=16)).tolist())]
    asked = [(q, (base * s).tolist()) for q, s in enumerate((1.0, 1e-3, -1.0))]
    queries = spark.createDataFrame(asked, "query_id bigint, vector array<double>")
    stock = spark.createDataFrame(items, "article_id bigint, vector array<double>")
    found = {(r["query_id"], r["rank"]): (r["article_id"], r["score"]) for r in retrieval.top_k(queries, stock, 7).collect()}
    for q, vector in asked:
        want = sorted(((-round(float(np.dot(vector, v)), 9), i) for i, v in items))[:7]
        assert [found[q, n + 1] for n in range(7)] == [(i, -s) for s, i in want]


def test_what_a_part_lacks_is_an_empty_array(spark):
    # Null arrays make Spark's Arrow writer go over a batch again for each of its rows.
    left = spark.createDataFrame([(1, [1.0])], "a bigint, v array<double>")
    right = spark.createDataFrame([(2, ["x"])], "b bigint, w array<string>")
    rows = sorted(tuple(r) for r in retrieval.united(left, right).select("v", "w", F.coalesce("a", "b")).collect())
    assert rows == [([], ["x"], 2), ([1.0], [], 1)]


def test_a_meeting_merges_what_it_found_at_the_end(spark):
    rs = np.random.RandomState(6)
    items, asked = rs.normal(size=(5000, 8)), rs.normal(size=(300, 8))
    stock = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "article_id bigint, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id bigint, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = retrieval.top_k(queries, stock, 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    scores = np.round(asked @ items.T, 9)
    want = {(q, r + 1): int(i) for q in range(300) for r, i in enumerate(np.lexsort((np.arange(5000), -scores[q]))[:3])}
    assert {(r["query_id"], r["rank"]): r["article_id"] for r in found} == want


def test_a_round_leaves_no_earlier_ones_behind(spark, tmp_path):
    rs = np.random.RandomState(3)
    pairs = {(a, b): int(rs.randint(1, 9)) for a in range(30) for b in range(a) if rs.rand() < 0.4}
    counts = spark.createDataFrame([(a, b, n) for (x, y), n in pairs.items() for a, b in ((x, y), (y, x))], "item bigint, neighbour bigint, cnt bigint")
    shared = Path(shared_dir(spark))
    before = set(shared.glob("stored-*"))
    assert factors.factorised(counts, 4, 6).count() == len({a for pair in pairs for a in pair})
    # The items, their totals and the vectors of the last round.
    assert len(set(shared.glob("stored-*")) - before) == 3
    spark.range(3).write.parquet(str(tmp_path / "given"))
    with pytest.raises(ValueError, match="not a stored table"):
        dropped(spark.read.parquet(str(tmp_path / "given")))
    assert (tmp_path / "given").exists()
