"""Clustered session intents beside a plain loop."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import clusters, intents
from basketry.plans import catalogue
from basketry.plans.recommenders import history_session
from basketry.sources import tables as T

SMALL = "/root/testdata/sf0.001"


def plain_heads(events, most=4, alike=clusters.ALIKE, decay=clusters.DECAY):
    """events: (article, unit vector), newest first -> (article, events, weight) of each head, by rank."""
    groups = [[i] for i in range(len(events))]

    def cosine(a, b):
        return float(np.dot(events[a][1], events[b][1]))

    while len(groups) > 1:
        pairs = []
        for x, a in enumerate(groups):
            for b in groups[x + 1 :]:
                mean = round(sum(cosine(i, j) for i in a for j in b) / (len(a) * len(b)), 9)
                pairs.append((-mean, a[0], b[0]))
        mean, a, b = min(pairs)
        if len(groups) <= most and -mean < alike:
            break
        into, out = next(g for g in groups if g[0] == a), next(g for g in groups if g[0] == b)
        groups.remove(out)
        into[:] = sorted(into + out)
    total = sum(decay**i for i in range(len(events)))
    heads = []
    for g in groups:
        medoid = min(g, key=lambda i: (-round(sum(cosine(i, j) for j in g), 9), i))
        heads.append((-round(sum(decay**i for i in g) / total, 9), medoid, len(g)))
    return [(events[m][0], n, -w) for w, m, n in sorted(heads)]


def plain_sessions(rows, vectors):
    """rows: (key, article, ts) -> heads of each key, from its newest 20 mapped events."""
    held = defaultdict(list)
    for key, article, ts in rows:
        if vectors.get(article) is not None:
            held[key].append((article, ts))
    out = {}
    for key, events in held.items():
        events.sort(key=lambda e: (e[1] is None, -e[1].timestamp() if e[1] else 0, e[0]))
        out[key] = plain_heads([(a, vectors[a]) for a, _ in events[:20]])
    return out


def unit(v):
    length = np.sqrt(np.dot(v, v))
    return np.array(v) / length if length else np.array(v, float)


def heads_by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["intent_rank"]):
        assert r["intent_rank"] == len(out[r["list_id"]]) + 1
        out[r["list_id"]].append((r["article_id"], r["events"], r["weight"]))
    return out


def alike(got, wanted, places):
    assert got.keys() == wanted.keys()
    for key, heads in wanted.items():
        assert [h[:2] for h in got[key]] == [h[:2] for h in heads], key
        assert [h[2] for h in got[key]] == pytest.approx([h[2] for h in heads], abs=places), key


def test_random_sessions_ties_and_gaps(spark):
    r = random.Random(4)
    middles = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    vectors = {a: [x + r.gauss(0, 0.4) for x in middles[a % 6]] for a in range(60)}
    vectors |= {60: [0.0] * 8, 61: None, 62: vectors[3], 63: [-x for x in vectors[3]]}
    start = dt.datetime(2024, 1, 1)
    rows = []
    for key in range(120):
        for _ in range(r.choice((1, 2, 5, 19, 20, 21, 40))):
            rows.append((f"c{key}", r.randrange(66), start + dt.timedelta(hours=r.randrange(30)) if r.random() < 0.95 else None))
    rows += [("same", 3, start)] * 25 + [("none", 61, start), ("unmapped", 99, start)]
    rows += [("tied", a, start) for a in (3, 62, 63, 60)] + [(None, 5, start)]
    events = spark.createDataFrame(rows, "list_id string, article_id bigint, ts timestamp_ntz")
    table = spark.createDataFrame(list(vectors.items()), "article_id bigint, vector array<double>")
    found = clusters.clustered_intents(events, table, 8).collect()
    units = {a: None if v is None else unit(v) for a, v in vectors.items()}
    alike(heads_by_key(found), plain_sessions(rows, units), 1e-8)
    for row in found:
        assert np.allclose(row["vector"], units[row["article_id"]])
        assert row["list_id"] not in ("none", "unmapped")
    assert any(h["events"] > 1 for h in found) and max(h["intent_rank"] for h in found) == 4


def test_query_is_the_plain_loop_over_the_whole_table(spark):
    got = heads_by_key(catalogue.queries()["L5_clustered_intents"](spark, SMALL).collect())
    rows = [tuple(r) for r in history_session(spark, SMALL).select("list_id", "article_id", "ts").collect()]
    vectors = {r["article_id"]: unit(r["vector"]) for r in T.vectors(spark, SMALL).collect()}
    alike(got, plain_sessions(rows, vectors), 1e-6)


def test_cold_starts_and_no_events(spark):
    day = dt.datetime(2024, 1, 1)
    shape = "list_id string, article_id bigint, ts timestamp_ntz, price double, category_l1 string, discounted boolean"
    events = spark.createDataFrame([("a", 1, day, 1.0, "x", False), ("b", 9, day, 1.0, "x", False)], shape)
    vectors = spark.createDataFrame([(1, [0.0, 2.0])], "article_id bigint, vector array<double>")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "list_id string")
    heads = clusters.clustered_intents(events, vectors, 2)
    got = {r["list_id"]: r for r in intents.labelled_intents(keys, events, heads, 2).collect()}
    assert got["a"]["vector"] == [0.0, 1.0] and got["a"]["weight"] == 1.0 and got["a"]["label"] != "cold_start"
    assert all(got[k]["label"] == "cold_start" and got[k]["vector"] == [0.0, 0.0] for k in "bc")
    assert clusters.clustered_intents(events.limit(0), vectors, 2).count() == 0


def test_heads_of_clear_groups():
    # Three groups far apart, the newest event alone in its group.
    axis = np.eye(3)
    vectors = np.array([[axis[0], axis[1], axis[1], axis[2], axis[2], axis[2]]])
    heads = clusters.heads_of(vectors, np.ones((1, 6), bool), 4, 0.5, 1.0)
    assert heads["medoid"].tolist() == [3, 1, 0] and heads["events"].tolist() == [3, 2, 1]
    assert np.allclose(heads["weight"], [3 / 6, 2 / 6, 1 / 6])
