"""Co-visitation, evaluation, sequences, retrieval and merging on small known inputs."""

import datetime as dt
import hashlib
import time

import numpy as np
from pyspark.sql import functions as F

from basketry.operators import candidates, covisit, evaluation, learning, retrieval, sequences, vocab
from basketry.operators import intents as sessions
from basketry.operators import items as I
from basketry.operators.features import price_percentile
from basketry.operators.skew import newest
from basketry.session import FILE_CLEANUP, durable

TX = "customer_id string, article_id bigint, t_dat date"


def day(text):
    return dt.date.fromisoformat(f"2024-{text}")


def purchases(spark, rows):
    df = spark.createDataFrame([(c, a, day(d)) for c, a, d in rows], TX)
    return df.select(
        "*", F.lit(0).alias("order_id"), F.lit(0).alias("line_no"), F.lit(1.0).alias("paid"), F.lit(1.0).alias("quantity"),
        F.lit(1.0).alias("price"),
    )


# The purchases, scores and expected numbers of the tests up to test_metrics_without_eligible_users pin known
# results of the same definitions.
def test_covisit_window(spark):
    tx = purchases(spark, [("u1", 1, "01-01"), ("u1", 2, "01-02"), ("u1", 3, "01-11"), ("u2", 2, "01-01"), ("u2", 3, "01-03")])
    got = {(r.item, r.neighbour): r.cnt for r in covisit.covisit_counts(tx).collect()}
    assert got == {(1, 2): 1, (2, 1): 1, (2, 3): 1, (3, 2): 1}


def test_neighbours_stop_at_fifty(spark):
    tx = purchases(spark, [(f"u{i}", a, d) for i in range(55) for a, d in ((1, "01-01"), (100 + i, "01-02"))])
    near = covisit.neighbours(covisit.covisit_counts(tx))
    assert near.filter("item = 1").count() == 50


def recommend(spark, pairs, history, k=20):
    near = spark.createDataFrame(pairs, "item bigint, neighbour bigint, cnt bigint")
    tx = purchases(spark, [("u", a, f"01-{i + 1:02d}") for i, a in enumerate(history)])
    return [r.article_id for r in covisit.covisit_recommend(near, tx, k).orderBy("rank").collect()]


def test_covisit_recommend(spark):
    pairs = [(1, 10, 5), (1, 20, 3), (2, 10, 2), (2, 30, 4)]
    assert recommend(spark, pairs, [1, 2]) == [10, 30, 20]
    assert recommend(spark, pairs, [1, 10]) == [20]
    assert recommend(spark, [(1, 99, 1), (2, 88, 1)], [1, 2, 3, 4, 5, 6]) == [88]
    assert recommend(spark, [(1, 10, 5), (1, 20, 4), (1, 30, 3)], [1], k=2) == [10, 20]


def evaluate(spark, train, val, items, recs, k):
    t, v = purchases(spark, train), purchases(spark, val)
    i = spark.createDataFrame(items, "article_id bigint, category_l1 string")
    r = spark.createDataFrame(recs, "user_id string, article_id bigint, rank int")
    return evaluation.evaluate(r, t, v, i, k, places=12).first()


def test_metrics(spark):
    train = [("u1", 10, "01-01"), ("u1", 20, "01-02"), ("u1", 30, "01-03"), ("u2", 40, "01-01")]
    items = [(10, "A"), (20, "A"), (30, "B"), (40, "B"), (101, "C"), (102, "C"), (103, "D")]
    val = [("u1", 101, "02-01"), ("u1", 999, "02-01"), ("u2", 102, "02-01")]
    recs = [(u, a, n + 1) for u in ("u1", "u2") for n, a in enumerate((101, 102, 103))]
    m = evaluate(spark, train, val, items, recs, 3)
    second = 1 / np.log2(3)
    entropy = -(2 / 3 * np.log2(2 / 3) + 1 / 3 * np.log2(1 / 3))
    want = (0.75, 1 / 3, (1 / (1 + second) + second) / 2, 3 / 7, entropy)
    assert np.allclose((m.recall, m.precision, m.ndcg, m.catalog_coverage, m.mean_category_entropy), want)


def test_metrics_without_eligible_users(spark):
    m = evaluate(spark, [("u1", 10, "01-01")], [("u9", 10, "02-01")], [(10, "A")], [("u9", 10, 1)], 20)
    assert tuple(m) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_metrics_of_a_perfect_list(spark):
    m = evaluate(spark, [("u1", 10, "01-01")], [("u1", 20, "02-01")], [(10, "A"), (20, "B")], [("u1", 20, 1)], 1)
    assert (m.recall, m.precision, m.ndcg) == (1.0, 1.0, 1.0)


def test_histories(spark):
    tx = purchases(spark, [("u1", 20, "01-02"), ("u1", 10, "01-01"), ("u2", 30, "01-01")])
    got = {r.customer_id: r.history for r in sequences.last_history(tx).collect()}
    assert got == {"u1": [10, 20], "u2": [30]}


def test_expanding_examples(spark):
    tx = purchases(spark, [("u", a, f"01-{a:02d}") for a in (10, 20, 30)])
    got = [(r.history, r.target) for r in sequences.training_examples(tx).orderBy("seq").collect()]
    assert got == [([10], 20), ([10, 20], 30)]
    tx = purchases(spark, [("u", a, f"01-{a:02d}") for a in (1, 2, 3, 4, 5)])
    last = sequences.training_examples(tx, n=2).orderBy(F.desc("seq")).first()
    assert (last.history, last.target) == ([3, 4], 5)


def test_validation_examples(spark):
    train = purchases(spark, [("u1", 1, "01-01"), ("u1", 2, "01-02")])
    val = purchases(spark, [("u1", 3, "02-01"), ("u1", 99, "02-01"), ("u2", 3, "02-01")])
    known = spark.createDataFrame([(1,), (2,), (3,)], "article_id bigint")
    got = sequences.validation_examples(train, val, known=known).collect()
    assert [(r.customer_id, r.history, r.target) for r in got] == [("u1", [1, 2], 3)]


def test_padding(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3, 4, 5],)], "h array<int>")
    rows = df.select(sequences.padded(F.col("h"), 5, F.lit(99)), sequences.mask(F.col("h"), 5), sequences.padded(F.col("h"), 3, F.lit(99))).collect()
    assert rows[0][0] == [1, 2, 99, 99, 99] and rows[0][1] == [1, 1, 0, 0, 0]
    assert rows[1][2] == [3, 4, 5]


def test_item_meta(spark):
    items = spark.createDataFrame([(1, "A", 10), (2, "B", 40), (3, None, None)], "article_id bigint, category_l1 string, n_interactions bigint")
    tx = spark.createDataFrame(
        [(1, day("01-05"), 10.0), (1, day("01-01"), 20.0), (2, day("02-01"), 5.0)], "article_id bigint, t_dat date, price double"
    )
    got = {r.article_id: r for r in I.days_since_first_seen(I.item_meta(items, tx), F.lit("2023-12-31").cast("date")).collect()}
    assert (got[1].popularity, got[1].first_seen, got[1].avg_price) == (0.25, day("01-01"), 15.0)
    assert np.isclose(got[1].ctr, 10 / 30) and got[2].popularity == 1.0
    assert got[1].days_since_first_seen == 0.0
    assert (got[3].category_l1, got[3].popularity, got[3].first_seen) == ("unknown", 0.0, dt.date(1970, 1, 1))


def test_vocabulary(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("c",)], "x string")
    assert {r.value: r.code for r in vocab.vocabulary(df, "x").collect()} == {"a": 0, "b": 1, "c": 2}


def test_top_k_against_brute_force(spark):
    rng = np.random.RandomState(3)
    items = rng.normal(size=(300, 8))
    items /= np.linalg.norm(items, axis=1, keepdims=True)
    items[7] = items[5]  # equal scores go to the smaller id
    queries = np.vstack([rng.normal(size=(20, 8)), items[5:6]])
    stock = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(items)], "article_id bigint, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, vector array<double>")
    out = [(q, 100 + (q * 7 + j) % 300) for q in range(21) for j in range(q)]
    exclude = spark.createDataFrame(out, "query_id bigint, article_id bigint")
    for blocks in ((512, 8192), (4, 37)):
        got = {}
        for r in retrieval.top_k(asked, stock, 5, exclude, *blocks).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.article_id))
        for q in range(21):
            scores = np.round(items @ queries[q], 9)
            order = [100 + i for i in np.lexsort((np.arange(300), -scores)) if (q, 100 + i) not in out][:5]
            assert [a for _, a in sorted(got[q])] == order


def test_hashed_top_k_finds_most(spark):
    rng = np.random.RandomState(1)
    centres = rng.normal(size=(10, 16))
    items = centres[rng.randint(10, size=400)] + 0.1 * rng.normal(size=(400, 16))
    stock = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(items)], "article_id bigint, vector array<double>")
    asked = stock.filter("article_id < 30").withColumnRenamed("article_id", "query_id")
    truth = retrieval.top_k(asked, stock, 10)
    found = retrieval.top_k_hashed(asked, stock, 10, 16, rows_per_cell=25)
    assert retrieval.recall_against(found, truth).first().recall > 0.8


def test_hashed_work_falls_with_the_catalogue(spark):
    rng = np.random.RandomState(0)
    shares = []
    for n in (400, 6400):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 16)))], "article_id bigint, vector array<double>")
        asked = rows.limit(50).withColumnRenamed("article_id", "query_id")
        shares.append(retrieval.compared_share(asked, rows, 16, rows_per_cell=25).first().share_compared)
    assert shares[1] < shares[0] / 4


def test_search_plans_no_cartesian_product(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "article_id bigint, vector array<double>")
    asked = rows.withColumnRenamed("article_id", "query_id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    try:
        for found in (retrieval.top_k(asked, rows, 3), retrieval.top_k_hashed(asked, rows, 3, 2)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_list_ids_may_hold_any_sign(spark):
    intents = spark.createDataFrame(
        [("a#1", 1, "x", 1.0, [1.0, 0.0]), ("a", 2, "y", 1.0, [0.0, 1.0])],
        "list_id string, intent_rank int, label string, weight double, vector array<double>",
    )
    stock = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "article_id bigint, vector array<double>")
    seen = spark.createDataFrame([("a#1", 2)], "list_id string, article_id bigint")
    got = sorted((r.list_id, r.query_pos, r.article_id, r.label) for r in candidates.intent_results(intents, stock, seen, 2).collect())
    assert got == [("a", 2, 1, "y"), ("a", 2, 2, "y"), ("a#1", 1, 1, "x")]


def test_price_percentile_keeps_rows_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), (None, 3.0)], "kind string, price double")
    got = sorted((str(r.kind), str(r.price), r.price_percentile) for r in price_percentile(rows, ["kind"]).collect())
    assert got == [("None", "3.0", 0.5), ("a", "1.0", 0.0), ("a", "2.0", 1.0), ("a", "None", None)]


def test_projected_vectors(spark):
    rows = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", 5.0)], "article_id bigint, token string, weight double")
    got = {r.article_id: r.vector for r in learning.projected(rows, "article_id", "token", "weight", 16).collect()}

    def plain(pairs):
        v = np.zeros(16)
        for token, w in pairs:
            h = hashlib.md5(token.encode()).hexdigest()
            v[int(h[:8], 16) % 16] += w if int(h[8], 16) < 8 else -w
        return v / np.linalg.norm(v)

    assert np.allclose(got[1], plain([("x", 1), ("y", 2)])) and np.allclose(got[2], plain([("x", 5)]))


def test_auc_counts_ties_half(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1)], "score double, click int")
    assert np.isclose(learning.auc_of(rows, "score", ("click",))["click"], 0.875)


def test_merge(spark):
    rows = [("l", 1, "a", 1, 0.9), ("l", 1, "a", 2, 0.5), ("l", 2, "b", 1, 0.95), ("l", 2, "b", 3, 0.7)]
    df = spark.createDataFrame(rows, "list_id string, query_pos int, label string, article_id bigint, score double")
    got = {r.article_id: (r.score, r.label) for r in candidates.merge_results(df).collect()}
    assert got == {1: (0.95, "a"), 2: (0.5, "a"), 3: (0.7, "b")}


def test_negatives(spark):
    pool = vocab.dense_index(spark.range(1, 6).withColumnRenamed("id", "article_id"), "article_id")
    examples = spark.createDataFrame([("e", [0, 1])], "example_id string, taken array<bigint>")
    got = [r.article_id for r in learning.negatives(examples, pool, 3).collect()]
    assert sorted(got) == [3, 4, 5]
    small = vocab.dense_index(spark.range(1, 3).withColumnRenamed("id", "article_id"), "article_id")
    free = spark.createDataFrame([("e", [])], "example_id string, taken array<bigint>")
    assert learning.negatives(free, small, 5).count() <= 2


def test_weak_labels(spark):
    rows = spark.createDataFrame(
        [(f"e{i}", 1, True, False) for i in range(400)] + [("n1", 2, False, True), ("n2", 3, False, False)],
        "example_id string, article_id bigint, is_target boolean, known boolean",
    )
    got = learning.weak_labels(rows, F.col("known")).collect()
    targets = [r for r in got if r.is_target]
    assert all(r.click == 1 and r.purchase == 1 for r in targets)
    assert 0.3 < sum(r.cart for r in targets) / 400 < 0.5 and 0.12 < sum(r.wishlist for r in targets) / 400 < 0.28
    others = {r.example_id: (r.click, r.cart, r.purchase, r.wishlist) for r in got if not r.is_target}
    assert others == {"n1": (1, 0, 0, 0), "n2": (0, 0, 0, 0)}


def test_results_merged_in_the_task_are_those_of_the_plain_merge(spark):
    draws = np.random.RandomState(3)
    # Components in quarters, so that scores tie; more lists than a chunk of queries holds.
    heads = [
        (i, r, "xyzw"[draws.randint(4)], float(draws.randint(1, 9)) / 7, [float(v) for v in draws.randint(-4, 5, 4) / 4])
        for i in range(400) for r in range(1, 1 + draws.randint(1, 5))
    ]
    intents = spark.createDataFrame(heads, "list_id bigint, intent_rank int, label string, weight double, vector array<double>")
    stock = spark.createDataFrame([(i, [float(v) for v in draws.randint(-4, 5, 4) / 4]) for i in range(60)], "article_id bigint, vector array<double>")
    seen = spark.createDataFrame([(i, int(draws.randint(60))) for i in range(0, 400, 3)], "list_id bigint, article_id bigint")
    plain = candidates.intent_results(intents, stock, seen, 12)
    want = sorted(candidates.merge_results(plain, 20).select("list_id", "article_id", "score", "label", "rank").collect())
    got = candidates.merged_results(intents, stock, seen, 12, 20).select("list_id", "article_id", "score", "label", "rank")
    assert sorted(got.collect()) == want
    by = F.max(F.round(F.col("score") * F.col("weight"), 9)).alias("score")
    best = newest(plain.groupBy("list_id", "article_id").agg(by), ["list_id"], [F.desc("score"), F.asc("article_id")], 5, "rank")
    blocks = retrieval.top_k_merged(intents, stock, 12, candidates._unwanted(intents, seen), 5, True, query_block=100, item_block=8)
    for found in (blocks, retrieval.top_k_merged(intents, stock, 12, candidates._unwanted(intents, seen), 5, True, query_block=20)):
        assert sorted(found.select("list_id", "article_id", "score", "rank").collect()) == sorted(best.select("list_id", "article_id", "score", "rank").collect())
    # Results leave the search as merged lists: they are not grouped by list and item afterwards.
    plan = retrieval.top_k_merged(intents, stock, 12, candidates._unwanted(intents, seen), 20, query_block=20)._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan


def test_covisit_sums_move_by_customer_alone(spark):
    train = purchases(spark, [("a", 1, "01-01"), ("a", 2, "01-02"), ("b", 2, "01-03"), ("b", 3, "01-03"), (None, 1, "01-01"), (None, 2, "01-02")])
    near = covisit.neighbours(covisit.covisit_counts(train))
    found = covisit.covisit_recommend(near, train)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(customer_id" in line and "candidate" in line]
    got = sorted((str(r.user_id), r.article_id, r.score) for r in found.collect())
    assert got == [("None", 1, 1.0), ("None", 2, 1.0), ("None", 3, 1.0), ("a", 3, 1.0), ("b", 1, 1.0)]


def test_collaborative_vectors_count_no_pairs(spark):
    train = purchases(spark, [("a", 1, "01-01"), ("a", 2, "01-02"), ("a", 2, "01-02"), ("b", 1, "01-03"), ("b", 3, "01-04")])
    found = learning.collaborative_vectors(train, 8)
    counts = covisit.covisit_counts(train).select(F.col("item").alias("article_id"), "neighbour", F.col("cnt").cast("double").alias("cnt"))
    want = {r.article_id: r.vector for r in learning.projected(counts, "article_id", "neighbour", "cnt", 8).collect()}
    assert {r.article_id: r.vector for r in found.collect()} == want
    assert "hashpartitioning(a#" not in found._jdf.queryExecution().executedPlan().toString()


def shuffled_by(df):
    """What the plan moves rows by, one entry for each shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange " in line and "Broadcast" not in line]


def near_rows(spark):
    days = [(c, a, f"2024-01-{1 + (7 * c + 3 * a) % 25:02d}") for c in range(12) for a in range(9)]
    days += [(3, 4, "2024-01-05"), (3, 4, "2024-01-05"), (None, 4, "2024-01-05"), (None, 5, "2024-01-05"), (5, None, "2024-01-06"), (6, 2, None)]
    rows = spark.createDataFrame(days, "customer_id bigint, article_id bigint, t_dat string")
    return durable(rows.withColumn("t_dat", F.col("t_dat").cast("date")))


def test_near_items_are_the_counted_ones_and_move_once(spark):
    tx = near_rows(spark)
    plain = {}
    rows = [r for r in tx.collect() if None not in tuple(r)]
    for x in rows:
        for y in rows:
            if x.customer_id == y.customer_id and x.article_id != y.article_id and abs((x.t_dat - y.t_dat).days) <= 7:
                plain[x.article_id, y.article_id] = plain.get((x.article_id, y.article_id), 0) + 1
    assert {(r.item, r.neighbour): r.cnt for r in covisit.covisit_counts(tx).collect()} == plain
    assert {(r.item, r.neighbour): r.cnt for r in covisit.covisit_counts(tx, hot_rows=5).collect()} == plain
    found = covisit.near_items(tx, 5)
    want = sorted((item, -n, other) for (item, other), n in plain.items())
    want = [(i, o, -n) for k, (i, n, o) in enumerate(want) if sum(w[0] == i for w in want[:k]) < 5]
    assert sorted((r.item, r.neighbour, r.cnt) for r in found.collect()) == sorted(want)
    assert sorted((r.item, r.neighbour, r.cnt) for r in covisit.near_items(tx, 5, hot_items=3).collect()) == sorted(want)
    # By customer, then by item: no row per pair is moved.
    assert len(shuffled_by(covisit.near_items(tx, 5))) == 2


def test_collaborative_vectors_of_frequent_items_are_the_same(spark):
    tx = near_rows(spark)
    vectors = [{r.article_id: r.vector for r in learning.collaborative_vectors(tx, 8, hot_items=n).collect()} for n in (3, 1000)]
    assert vectors[0].keys() == vectors[1].keys() and len(vectors[0]) == 9
    for key, v in vectors[0].items():
        np.testing.assert_allclose(v, vectors[1][key], atol=1e-12)
    assert len(shuffled_by(learning.collaborative_vectors(tx, 8))) == 2


def test_vector_lists_leave_out_what_is_seen(spark):
    recent = durable(spark.createDataFrame([(1, 1), (1, 2), (1, 99), (2, 3), (None, 1), (4, 99)], "customer_id bigint, article_id bigint"))
    vectors = spark.createDataFrame([(i, [float(i), 1.0, 0.5 * i * i]) for i in range(1, 7)], "article_id bigint, vector array<double>")
    found = {}
    for r in candidates.vector_recommend(recent, vectors, 3).collect():
        found.setdefault(r.user_id, []).append((r["rank"], r.article_id))
    got = {user: {a for _, a in rows} for user, rows in found.items()}
    assert set(got) == {1, 2, None} and not got[1] & {1, 2} and 3 not in got[2]
    assert all(sorted(k for k, _ in rows) == [1, 2, 3] for rows in found.values())


def test_vector_lists_are_full_where_a_seen_item_has_many_vectors(spark):
    recent = durable(spark.createDataFrame([(1, 1)], "customer_id bigint, article_id bigint"))
    rows = [(1, [1.0, 0.0])] * 6 + [(i, [1.0, float(i)]) for i in range(2, 6)]
    found = candidates.vector_recommend(recent, spark.createDataFrame(rows, "article_id bigint, vector array<double>"), 3).collect()
    assert len(found) == 3 and 1 not in {r.article_id for r in found}


def test_labelled_candidates_take_no_row_per_category(spark):
    kinds = {a: a % 3 for a in range(30)}
    pool = durable(spark.createDataFrame([(a, a, [k]) for a, k in kinds.items()], "article_id bigint, position bigint, codes array<int>"))
    rows = [(f"{i}-2", i % 30, [(i + 1) % 30, (i + 4) % 30], [kinds[(i + 1) % 30]]) for i in range(40)] + [("x-2", None, [3], [0])]
    examples = durable(spark.createDataFrame(rows, "example_id string, position bigint, taken array<bigint>, kinds array<int>"))
    made = learning.labelled_candidates(examples, pool)
    drawn = {(r.example_id, r.article_id) for r in learning.negatives(examples.select("example_id", "taken"), pool).collect()}
    held = {r[0]: r[3] for r in rows}
    found = made.collect()
    assert {(r.example_id, r.article_id) for r in found if not r.is_target} == drawn and len(found) == len(drawn) + 40
    for r in found:
        assert r.click == int(r.is_target or kinds[r.article_id] in held[r.example_id]) and r.purchase == int(r.is_target)
    # The size of the pool, and the candidates and the pool by position.
    assert len(shuffled_by(learning.labelled_candidates(examples, pool))) <= 3


def test_lift_moves_lines_not_pairs(spark):
    lines = [(o, a) for o in range(40) for a in range(8) if (o * (a + 3)) % 5 < 3] + [(1, 3), (None, 2), (None, 4), (7, None)]
    tx = durable(spark.createDataFrame(lines, "order_id bigint, article_id bigint"))
    rows = lambda **how: sorted((r.item, r.neighbour, r.together, r.lift, r.rk) for r in covisit.complements(tx, 4, **how).collect())
    assert rows() == rows(hot_rows=2) and len(rows()) == 32
    # Lines by item and supports, baskets, items; joins of pairs with supports would be more.
    assert len(shuffled_by(covisit.complements(tx, 4))) <= 5


def test_intents_that_are_not_stored_give_the_same_lists(spark):
    rs = np.random.RandomState(7)
    vectors = spark.createDataFrame([(i, rs.normal(size=4).tolist()) for i in range(60)], "article_id bigint, vector array<double>")
    heads = [(l, r, "cold_start" if l == 9 else "complementary", 1.0 / r, rs.normal(size=4).tolist()) for l in range(10) for r in range(1, 1 + l % 4)]
    intents = spark.createDataFrame(heads, "list_id bigint, intent_rank int, label string, weight double, vector array<double>")
    seen = spark.createDataFrame([(l, (7 * l + j) % 60) for l in range(10) for j in range(5)] * 2, "list_id bigint, article_id bigint")
    want = sorted(tuple(r) for r in candidates.multi_intent_recommend(intents, vectors, seen, 6).collect())
    stored = candidates.durable
    candidates.durable = None
    try:
        found = candidates.multi_intent_recommend(intents, vectors, seen, 6, n_intents=40)
    finally:
        candidates.durable = stored
    assert sorted(tuple(r) for r in found.collect()) == want and want
    out = {(r["list_id"], r["article_id"]) for r in seen.collect()}
    assert not out & {(r[0], r[1]) for r in want} and 9 not in {r[0] for r in want}


def test_a_head_takes_the_label_of_its_rank(spark):
    events = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (1, 5, "a"), (2, 7, "b")], "list_id bigint, article_id bigint, category_l1 string").select(
        "*", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit(2.0).alias("price"), F.lit(False).alias("discounted")
    )
    heads = spark.createDataFrame([(1, 1, 0.7, [1.0]), (1, 2, 0.3, [2.0]), (1, 9, 0.1, [3.0])], "list_id bigint, intent_rank int, weight double, vector array<double>")
    keys = spark.createDataFrame([(1,), (2,)], "list_id bigint")
    ranked = {(r["list_id"], r["label_rank"]): r["label"] for r in sessions.ranked_labels(sessions.label_scores(events)).collect()}
    found = sorted((r["list_id"], r["intent_rank"], r["label"], r["vector"]) for r in sessions.labelled_intents(keys, events, heads, 1).collect())
    assert found == [(1, 1, ranked[1, 1], [1.0]), (1, 2, ranked[1, 2], [2.0]), (2, 1, "cold_start", [0.0])]
    # One row per session meets the heads: rows of labels would make them move.
    plan = sessions.labelled_intents(keys, events, heads, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "_labels" in plan


def test_shuffles_go_when_rows_are_stored(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        found = blocks.getAllBlocks()
        return {found.apply(i).name() for i in range(found.size()) if found.apply(i).isShuffle()}

    before, start = spark.conf.get(FILE_CLEANUP, None), held()
    stored = durable(spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count())
    # Files go in the background.
    for _ in range(50):
        if not held() - start:
            break
        time.sleep(0.2)
    assert not held() - start and spark.conf.get(FILE_CLEANUP, None) == before
    assert stored.count() == 7
