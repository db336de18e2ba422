"""Guardrails, features, intents and the surfaces' helpers."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.functions import vectors as V
from basketry.operators import features, guardrails, intents
from basketry.plans import surfaces

ROW = "list_id string, article_id bigint, score double, category_l1 string, in_stock boolean, age_restricted boolean, embedding array<double>"


def lists(spark, rows):
    return spark.createDataFrame(rows, ROW)


def stock(list_id, sizes):
    rows, article = [], 0
    for category, n in sizes.items():
        for _ in range(n):
            article += 1
            rows.append((list_id, article, 1000.0 - article, category, True, False, None))
    return rows


def greedy(rows, limit, share=0.35):
    """The cap stated plainly for one list."""
    sizes = Counter(r[3] for r in rows)
    fits = [m for m in range(1, min(limit, len(rows)) + 1) if m == 1 or sum(min(n, math.floor(share * m)) for n in sizes.values()) >= m]
    if not fits:
        return []
    most = 1 if max(fits) == 1 else math.floor(share * max(fits))
    taken, used = [], Counter()
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        if len(taken) < max(fits) and used[r[3]] < most:
            taken.append(r[1])
            used[r[3]] += 1
    return taken


# Sizes, categories and expected numbers here, and in the known cases of diversity and filters below, pin known
# results of the same definitions.
def test_cap_known_lists(spark):
    rows = stock("a", {"shoes": 100, "bags": 5, "hats": 5}) + stock("b", {"shoes": 100})
    got = guardrails.cap_category(lists(spark, rows), 20).collect()
    assert Counter(r.category_l1 for r in got if r.list_id == "a") == {"shoes": 5, "bags": 5, "hats": 5}
    assert len([r for r in got if r.list_id == "b"]) == 1
    got = guardrails.cap_category(lists(spark, stock("c", {"shoes": 50, "bags": 50, "hats": 50})), 21).collect()
    assert len(got) == 21 and sorted(r.article_id for r in got if r.category_l1 == "shoes") == list(range(1, 8))
    assert guardrails.cap_category(lists(spark, rows), 0).count() == 0


items = st.lists(st.tuples(st.sampled_from("abcde"), st.integers(0, 50)), max_size=60)


@pytest.mark.parametrize("limit", [1, 3, 20, 40])
@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(many=st.lists(items, min_size=40, max_size=40))
def test_cap_and_order_hold_for_any_list(spark, limit, many):
    rows = []
    for n, one in enumerate(many):
        rows += [(f"l{n}", i, float(s), c, True, False, [float(s), 1.0]) for i, (c, s) in enumerate(one)]
    if not rows:
        return
    context = spark.createDataFrame([(f"l{n}", "26_35") for n in range(len(many))], "list_id string, age_band string")
    final, report = guardrails.apply_all(lists(spark, rows), context, limit)
    got = {}
    for r in final.collect():
        got.setdefault(r.list_id, []).append(r)
    dropped = {(r.list_id, r.step): r.dropped for r in report.collect()}
    for n, one in enumerate(many):
        mine = [r for r in rows if r[0] == f"l{n}"]
        kept = got.get(f"l{n}", [])
        assert sorted(r.article_id for r in kept) == sorted(greedy(mine, limit))
        assert sorted(r.position for r in kept) == list(range(len(kept))) and len(kept) <= limit
        if len(kept) > 1:
            assert max(Counter(r.category_l1 for r in kept).values()) / len(kept) <= 0.35
        if mine:
            assert dropped[f"l{n}", "cap_category"] == len(mine) - len(kept)


def test_mmr_prefers_the_different_item(spark):
    rows = [("l", 1, 10.0, "x", True, False, [1.0, 0.0]), ("l", 2, 9.0, "x", True, False, [1.0, 0.001]), ("l", 3, 8.9, "x", True, False, [0.0, 1.0])]
    got = guardrails.mmr_diversify(lists(spark, rows), 2, lam=0.5).orderBy("position").collect()
    assert [r.article_id for r in got] == [1, 3]


def test_mmr_against_a_plain_loop(spark):
    rng = np.random.RandomState(0)
    rows = [(f"l{n}", i, float(rng.rand()), "x", True, False, rng.normal(size=4).tolist() if i else None) for n in range(15) for i in range(12)]
    got = {}
    for r in guardrails.mmr_diversify(lists(spark, rows), 8).collect():
        got.setdefault(r.list_id, {})[r.position] = r.article_id
    cosine = lambda a, b: 0.0 if a is None or b is None else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for n in range(15):
        pool = sorted((r for r in rows if r[0] == f"l{n}"), key=lambda r: -r[2])
        chosen = []
        while len(chosen) < 8:
            best = max(pool, key=lambda r: 0.7 * r[2] - 0.3 * max((cosine(r[6], s[6]) for s in chosen), default=0.0))
            chosen.append(best)
            pool.remove(best)
        assert [got[f"l{n}"][i] for i in range(8)] == [r[1] for r in chosen]


def test_filters_in_order(spark):
    rows = [
        ("l", 1, 5.0, "shoes", False, False, None),
        ("l", 2, 4.0, "shoes", True, True, None),
        ("l", 3, 3.0, "health", True, False, None),
        ("l", 4, 2.0, "shoes", True, False, None),
        ("l", 5, 1.0, "bags", True, False, None),
    ]
    context = spark.createDataFrame([("l", "under_18")], "list_id string, age_band string")
    seen = spark.createDataFrame([("l", 5)], "list_id string, article_id bigint")
    blocked = spark.createDataFrame([("health",)], "category_l1 string")
    final, report = guardrails.apply_all(lists(spark, rows), context, 10, seen, blocked)
    assert [r.article_id for r in final.collect()] == [4]
    assert {r.step: r.dropped for r in report.collect()} == {
        "filter_availability": 1, "filter_policy": 1, "filter_sensitive": 1, "filter_seen": 1, "cap_category": 0, "mmr_diversify": 0,
    }
    whole = guardrails.summary(report).first()
    assert (whole.items_dropped, whole.diversity_cap_applied) == (4, False)


def events(spark, rows):
    start = dt.datetime(2024, 1, 1)
    data = [(l, a, start + dt.timedelta(minutes=m), p, c, d) for l, a, m, p, c, d in rows]
    return spark.createDataFrame(data, "list_id string, article_id bigint, ts timestamp_ntz, price double, category_l1 string, discounted boolean")


def test_label_winners(spark):
    rows = [("charger", i, i * 0.5, 10.0, "charger", False) for i in range(3)]
    rows += [("browse", i, i * 20.0, 10.0, f"c{i}", False) for i in range(5)]
    rows += [("match", i, i * 1.0, 10.0, f"c{i}", False) for i in range(3)]
    rows += [("bargain", i, i * 5.0, 10.0 * (i + 1), "x", True) for i in range(5)]
    found = intents.ranked_labels(intents.label_scores(events(spark, rows))).filter("label_rank = 1").collect()
    assert {r.list_id: r.label for r in found} == {
        "charger": "urgent_replacement", "browse": "seasonal_browsing", "match": "complementary", "bargain": "bargain_hunting",
    }


def test_cold_start_and_heads(spark):
    rows = events(spark, [("known", 1, 0, 1.0, "a", False), ("known", 2, 1, 1.0, "b", False), ("known", 3, 2, 1.0, "b", False), ("unmapped", 99, 0, 1.0, "a", False)])
    keys = spark.createDataFrame([("known",), ("unmapped",), ("empty",)], "list_id string")
    stock = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "article_id bigint, vector array<double>")
    got = {}
    for r in intents.infer_intents(keys, rows, stock, 2).collect():
        got.setdefault(r.list_id, []).append(r)
    for cold in ("unmapped", "empty"):
        (only,) = got[cold]
        assert (only.label, only.weight, only.vector) == (C.COLD_START, 1.0, [0.0, 0.0])
    first, second = sorted(got["known"], key=lambda r: r.intent_rank)
    assert first.vector == [1.0, 0.0] and np.isclose(first.weight, 2 / 3) and np.allclose(second.vector, [0.6, 0.8])


def test_mixed_intents_equal_the_weighted_dot(spark):
    heads = spark.createDataFrame([("l", 1, 0.3, [1.0, 0.0]), ("l", 2, 0.7, [0.0, 1.0])], "list_id string, intent_rank int, weight double, vector array<double>")
    got = intents.mixed_intents(heads).select(V.dot(F.col("intent_mix"), F.array(F.lit(2.0), F.lit(5.0)))).first()[0]
    assert np.isclose(got, 0.3 * 2 + 0.7 * 5)
    four = spark.createDataFrame([("l", i + 1, 0.25, [1.0, float(i)]) for i in range(4)], "list_id string, intent_rank int, weight double, vector array<double>")
    assert intents.pairwise_cosine(four).count() == 6


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [0.0, 0.0], [], None)], "a array<double>, b array<double>, z array<double>, e array<double>, n array<double>")
    a, b, z, e, n = (F.col(c) for c in "abzen")
    got = df.select(V.dot(a, b), V.cosine(a, a), V.cosine(a, z), V.cosine(a, e), V.cosine(a, n), V.unit(z), V.unit(b)).first()
    assert got[0] == 11.0 and np.isclose(got[1], 1.0) and list(got[2:5]) == [0.0, 0.0, 0.0]
    assert got[5] == [0.0, 0.0] and np.allclose(got[6], [0.6, 0.8])


def test_features(spark):
    session = events(spark, [("l", 1, 0, 1.0, "a", False), ("l", 2, 10, 1.0, "a", False), ("l", 3, 30, 1.0, "b", False)])
    meta = spark.createDataFrame(
        [(11, "a", 0.5, 0.1, 10.0, 13.0), (12, "a", 0.5, 0.1, 20.0, 14.0), (13, "a", 0.5, 0.1, 30.0, 0.0), (14, "z", 0.5, 0.1, 5.0, 99.0)],
        "article_id bigint, category_l1 string, popularity double, ctr double, avg_price double, days_since_first_seen double",
    )
    stock = spark.createDataFrame([(i, [1.0, float(i)]) for i in (11, 12, 13, 14, 16)], "article_id bigint, vector array<double>")
    users = spark.createDataFrame([("l", [1.0, 0.0])], "list_id string, user_vector array<double>")
    heads = spark.createDataFrame([("l", 1, 1.0, [0.0, 1.0])], "list_id string, intent_rank int, weight double, vector array<double>")
    asked = spark.createDataFrame([("l", i) for i in (11, 12, 13, 14, 15, 16)], "list_id string, article_id bigint")
    got = {r.article_id: r for r in features.build_features(asked, meta, stock, users, heads, session).collect()}
    assert sorted(got) == [11, 12, 13, 14, 16]  # without a vector no row; without metadata the default one
    assert (got[16].category_l1, got[16].item_popularity, got[16].days_since_first_seen) == ("unknown", 0.0, 9999.0)
    assert [got[i].price_percentile_in_category for i in (11, 12, 13, 14)] == [0.0, 0.5, 1.0, 0.5]
    assert [got[i].is_new_item for i in (11, 12)] == [1.0, 0.0]
    assert (got[11].two_tower_dot, got[11].intent_dot, got[11].category_match_count, got[11].session_length) == (1.0, 11.0, 2.0, 3.0)
    assert (got[11].recency_same_category_minutes, got[14].recency_same_category_minutes) == (20.0, -1.0)


def test_reasons(spark):
    df = spark.createDataFrame([("cold_start", 3), ("urgent_replacement", 3), ("urgent_replacement", 0)], "i string, n bigint")
    rows = df.select(C.reason_code(F.col("i"), F.col("n")), C.reason_text(F.col("i"), F.col("n"))).collect()
    assert [r[0] for r in rows] == ["POPULAR", "SESSION_AFFINITY", "INTENT_MATCH"]
    assert "3" in rows[1][1] and "urgent replacement" in rows[2][1]


def test_query_parse(spark):
    queries = spark.createDataFrame([("Summer TOPS",), ("summer tops ",), ("to",), ("shoeshine kit",), ("zzz",)], "query string")
    kinds = spark.createDataFrame([("tops",), ("bottoms",), ("shoes",)], "category_l1 string")
    got = {r["query"]: r.category_l1 for r in surfaces.parse_queries(queries, kinds).collect()}
    assert got == {"Summer TOPS": "tops", "summer tops ": "tops", "to": None, "shoeshine kit": "shoes", "zzz": None}


def test_sessions_key_and_text(spark):
    df = spark.createDataFrame([("u1", "s1"), (None, "s1"), ("", ""), (None, None)], "u string, s string")
    got = [r[0] for r in df.select(C.session_key(F.col("u"), F.col("s"))).collect()]
    assert got == ["sess:u1", "sess:s1", "sess:anonymous", "sess:anonymous"]
    df = spark.createDataFrame([("short",), ("x" * 41,), (None,)], "t string")
    got = [r[0] for r in df.select(C.truncate(F.col("t"))).collect()]
    assert got == ["short", "x" * 39 + "…", "Unknown item"]


def test_lists_of_a_segment_are_marked_as_plain_rows_are(spark):
    """Candidates of a segment are laid out per list after all joins; repeated and null lists are treated as before."""
    shelves = spark.createDataFrame(
        [("r", "18_25", 1, 5.0, "a", True, True), ("r", "18_25", 2, 4.0, "PROMO", True, False), ("r", "18_25", 3, 3.0, None, False, False),
         ("r", "under_18", 1, 5.0, "a", True, True), ("r", "under_18", 4, 1.0, "b", True, False)],
        "region string, age_band string, article_id bigint, score double, category_l1 string, in_stock boolean, age_restricted boolean",
    )
    contexts = spark.createDataFrame(
        [(10, "r", "18_25"), (11, "r", "under_18"), (12, "r", "18_25"), (12, "r", "under_18"), (13, "s", "18_25"), (None, "r", "18_25"), (14, None, "18_25")],
        "list_id bigint, region string, age_band string",
    )
    seen = spark.createDataFrame([(10, 1), (10, 1), (11, 4), (12, 9), (None, 1)], "list_id bigint, article_id bigint")
    blocked = spark.createDataFrame([(12, "PROMO"), (12, "PROMO"), (10, None)], "list_id bigint, category_l1 string")
    plain = guardrails.flagged(contexts.join(shelves, ["region", "age_band"]).drop("region", "age_band"), contexts, seen, blocked)
    found = guardrails.flagged_by_segment(shelves, contexts, seen, blocked)
    names = sorted(plain.columns)
    assert sorted(map(str, found.select(names).collect())) == sorted(map(str, plain.select(names).collect()))
    # Ranking and counting the rows of a list needs no further shuffle.
    left = found.filter("dropped_by IS NULL").drop("dropped_by")
    plan = guardrails.newest(left, ["list_id", "category_l1"], [F.desc("score"), F.asc("article_id")], 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_candidates_move_by_list_alone(spark):
    rows = [(i, a, float(a), "c", True, False) for i in (1, 2) for a in (1, 2, 3)] + [(1, None, 0.5, "c", True, False)]
    found = spark.createDataFrame(rows, "list_id bigint, article_id bigint, score double, category_l1 string, in_stock boolean, age_restricted boolean")
    contexts = spark.createDataFrame([(1, "18_25"), (2, "18_25")], "list_id bigint, age_band string")
    seen = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (1, None)], "list_id bigint, article_id bigint")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = guardrails.flagged(found, contexts, seen)
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(list_id" in line and "article_id#" in line.split("hashpartitioning(")[1].split(")")[0]]
        got = sorted((r.list_id, r.article_id) for r in marked.filter(F.col("dropped_by") == "filter_seen").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == [(1, 2), (2, 3)] and marked.count() == 7
    capped = guardrails.cap_category(marked.filter(F.col("dropped_by").isNull()), 2)
    assert "SortMergeJoin" in capped._jdf.queryExecution().executedPlan().toString()
