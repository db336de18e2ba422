"""Reports, compliance, streams, sources and the registry."""

import datetime as dt
import random
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basketry.functions.columns import age_band
from basketry.operators import compliance, intents, reports, sampling
from basketry.plans import catalogue
from basketry.session import scratch_path
from basketry.sources import files
from basketry.sources import tables as T
from basketry.streaming import events as S

SMALL = "/root/testdata/sf0.001"


def test_capacity_at_35_ms(spark):
    report = spark.createDataFrame([("feed", 35.0), ("load", 5343.8)], "name string, mean_ms double")
    got = {r.name: r for r in reports.capacity(report).collect()}
    assert (got["feed"].api_pods, got["feed"].retrieval_pods, got["load"].api_pods) == (31, 20, 4676)
    assert round(got["load"].cost_per_hour, 2) == 752.56 and round(got["load"].cost_per_million, 2) == 20.91
    assert round(got["load"].llm_multiple) == 24 and round(got["load"].in_flight) == 53438


def test_mean_latency_falls_back(spark):
    report = spark.createDataFrame([("feed", 10.0), ("Aggregated", 30.0)], "name string, mean_ms double")
    asked = spark.createDataFrame([("feed",), ("other",)], "name string")
    assert {r.name: r.mean_ms for r in reports.mean_latency_for(report, asked).collect()} == {"feed": 10.0, "other": 30.0}


def test_category_share(spark):
    rows = spark.createDataFrame([("l", "shoes"), ("l", "shoes"), ("l", "bags"), ("l", None)], "list_id string, category_l1 string")
    got = {r.category: (r.share, r.over_cap) for r in reports.category_share(rows).collect()}
    assert got == {"shoes": (0.5, True), "bags": (0.25, False), "unknown": (0.25, False)}


def test_upsert_twice_keeps_one_row(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model string, value double")
    new = spark.createDataFrame([("a", 3.0)], "model string, value double")
    twice = reports.upsert_metrics(reports.upsert_metrics(old, new), new)
    assert sorted(tuple(r) for r in twice.collect()) == [("a", 3.0), ("b", 2.0)]


def test_histogram_includes_the_upper_edge(spark):
    log = spark.range(0, 101).select(F.col("id").cast("double").alias("response_time_ms"))
    got = {r.bin: r.requests for r in reports.latency_histogram(log).collect()}
    assert max(got) == 40 and sum(got.values()) == 101


def test_leakage_audit_counts(spark):
    day = lambda d: dt.date(2024, 1, d)
    tx = "customer_id int, article_id int, t_dat date"
    train, val = spark.createDataFrame([(1, 1, day(1)), (2, 9, day(5))], tx), spark.createDataFrame([(3, 1, day(5))], tx)
    items = spark.createDataFrame([(1, None)], "article_id int, category_l1 string")
    users = spark.createDataFrame([(1,), (2,)], "customer_id int")
    got = {r.rule: r.violations for r in sampling.leakage_audit(train, val, items, users).collect()}
    assert got == {"article_not_in_items": 1, "customer_not_in_users": 1, "null_category": 1, "val_not_after_train": 1}


def test_erasure_leaves_nothing(spark):
    frames = {
        "users": spark.createDataFrame([("u1",), ("u2",)], "customer_id string"),
        "consent": spark.createDataFrame([("u1", "p"), ("u2", "p")], "customer_id string, purpose string"),
        "sessions": spark.createDataFrame([("u1", 5)], "customer_id string, article_id int"),
        "log": spark.createDataFrame([("u1", 5), ("u2", 6), (None, 7)], "customer_id string, article_id int"),
        "tombstones": spark.createDataFrame([("u0",)], "customer_id string"),
    }
    asked = spark.createDataFrame([("u1",), ("u1",)], "customer_id string")
    got = compliance.erase(asked, frames)
    for name in ("users", "consent", "sessions", "log"):
        assert got[name].filter("customer_id = 'u1'").count() == 0
    assert got["log"].count() == 3 and got["tombstones"].count() == 2
    again = compliance.erase(asked, frames)["receipts"].collect()
    assert got["receipts"].collect() == again and len(again) == 1


def test_minors_and_consent(spark):
    users = spark.createDataFrame([(1, 30), (2, 15), (3, 30), (4, None)], "customer_id int, age int")
    at = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(1, "personalization", True, at, 1), (2, "personalization", True, at, 2), (3, "personalization", True, at, 3),
         (3, "personalization", False, at + dt.timedelta(1), 4), (4, "analytics", True, at, 5)],
        "customer_id int, purpose string, granted boolean, granted_at timestamp_ntz, event_id int",
    )
    got = {r.customer_id: r.route for r in compliance.routes(users, events).collect()}
    assert got == {1: "personalized", 2: "popular", 3: "popular", 4: "popular"}


def test_decode_drops_broken_rows(spark):
    raw = spark.createDataFrame([('{"article_id": 1, "timestamp": "2024-01-01T00:00:00"}',), ("{oops",), ('{"article_id": 2}',)], "raw string")
    (row,) = files.decode_events(raw).collect()
    assert (row.article_id, row.price, row.category_l1, row.discounted) == (1, 0.0, "unknown", False)


def session_rows(df):
    return sorted((r.session_key, tuple(r.article_ids)) for r in df.collect())


def test_stream_sessions_over_many_batches(spark):
    """Batches in time order give the same current sessions as one batch job, and idle sessions end."""
    src = scratch_path(spark, "stream-source")
    events = T.table(spark, SMALL, "events").filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    gap = 6 * 3600
    stamps = [r[0] for r in events.select(F.date_trunc("day", "ts").alias("d")).distinct().orderBy("d").collect()]
    for n, cut in enumerate(stamps):
        if n % 6 == 0:
            upto = stamps[n + 6] if n + 6 < len(stamps) else dt.datetime(2030, 1, 1)
            part = events.filter((F.col("ts") >= F.lit(cut).cast("timestamp_ntz")) & (F.col("ts") < F.lit(upto).cast("timestamp_ntz")))
            part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(S.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    state = S.session_state(S.with_defaults(S.typed(stream)), gap)
    last = S.update_to(state.filter(~F.col("expired")), "sessions", S.SESSION, ["session_key"])
    clicks = events.select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("bigint").alias("article_id"))
    tail = intents.current_sessions(clicks, gap).groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("age", "article_id"))), lambda e: e["article_id"]).alias("article_ids")
    )
    want = tail.select(F.concat(F.lit("sess:"), F.col("user_id")).alias("session_key"), "article_ids")
    assert session_rows(last) == session_rows(want)
    everything = S.update_to(state, "sessions", S.SESSION, ["session_key"])
    assert everything.filter("expired").count() > 0


def stream_of(spark, batches):
    """A stream that reads each list of (minute, event_id, user_id) as a batch of its own."""
    src, start = scratch_path(spark, "late-source"), dt.datetime(2024, 1, 1)
    for rows in batches:
        made = [(e, start + dt.timedelta(minutes=m), u, "click", 1.0, f'{{"k": {e}}}') for m, e, u in rows]
        spark.createDataFrame(made, S.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)  # files are read in the order of their times
    return spark.readStream.schema(S.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def test_late_event_joins_two_sessions(spark):
    stream = stream_of(spark, [[(0, 1, 7)], [(35, 2, 7)], [(26, 3, 7)]])
    state = S.session_state(S.with_defaults(S.typed(stream)), 1800)
    (row,) = S.update_to(state.filter(~F.col("expired")), "late", S.SESSION, ["session_key"]).collect()
    assert row.article_ids == [2, 3, 1] and row.events == 3


def test_shuffled_arrival_inside_the_watermark_equals_the_batch_job(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 2000), e, r.randint(1, 6)) for e in range(150)]
    arrivals = sorted(rows, key=lambda x: x[0] + r.uniform(0, 9))  # at most nine minutes late
    batches = [arrivals[i : i + 30] for i in range(0, 150, 30)]
    state = S.session_state(S.with_defaults(S.typed(stream_of(spark, batches))), 1800)
    last = S.update_to(state.filter(~F.col("expired")), "late", S.SESSION, ["session_key"])
    got = {x.session_key: x.article_ids for x in last.collect()}
    want = {}
    for user in {u for _, _, u in rows}:
        newest = sorted(((m, e) for m, e, u in rows if u == user), reverse=True)
        kept = newest[:1]
        for event in newest[1:20]:
            if kept[-1][0] - event[0] > 30:
                break
            kept.append(event)
        want[f"sess:{user}"] = [e for _, e in kept]
    assert got == want


def test_folders_of_updates_cover_all_batches_once():
    for fan in (2, 3, 8):
        made = set()
        for count in range(1, 200):
            made |= {(0, count), *S.folds(count, fan)}
            held = []
            for level, end in S.cover(count, fan):
                assert (level, end) in made
                held += range(end - fan**level + 1, end + 1)
            assert held == list(range(1, count + 1))
            assert max(Counter(level for level, _ in S.cover(count, fan)).values()) < fan


def test_last_rows_over_many_batches_and_what_each_writes(spark):
    rows = [(m, m, m % 5) for m in range(33)]
    state = S.session_state(S.with_defaults(S.typed(stream_of(spark, [[r] for r in rows[:11]]))), 1800)
    last = S.update_to(state.filter(~F.col("expired")), "few", S.SESSION, ["session_key"], fan=3)
    assert {r.session_key: r.article_ids for r in last.collect()} == {
        f"sess:{u}": [m for m, _, w in reversed(rows[:11]) if w == u] for u in range(5)
    }
    folder = Path(last.inputFiles()[0].removeprefix("file:")).parents[2]
    for batch in (folder / "0").iterdir():
        assert spark.read.parquet(str(batch)).count() <= 1  # its own update, not the table
    assert {p.name for p in (folder / "1").iterdir()} >= {"3", "6", "9"} and (folder / "2" / "9").exists()


def test_repeated_events_count_once(spark):
    """A stream with repeats, in the same batch and in later ones, gives what one batch job over distinct events gives."""
    r = random.Random(8)
    rows = [(r.randint(0, 600), e, r.randint(1, 3)) for e in range(90)]
    sent = rows + r.sample(rows, 60) + [x for x in rows[:3] for _ in range(30)]
    arrivals = sorted(sent, key=lambda x: x[0] + r.uniform(0, 9))
    batches = [arrivals[i : i + 60] for i in range(0, len(arrivals), 60)]
    log = spark.read.parquet(S.append_to(S.each_once(stream_of(spark, batches)), "once"))
    assert sorted(x.event_id for x in log.collect()) == list(range(90))
    state = S.session_state(S.with_defaults(S.typed(stream_of(spark, batches))), 3600)
    last = S.update_to(state.filter(~F.col("expired")), "once", S.SESSION, ["session_key"])
    clicks = log.withColumn("article_id", F.col("event_id"))
    tail = intents.current_sessions(clicks, 3600).groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("age", "article_id"))), lambda e: e["article_id"]).alias("article_ids")
    )
    want = tail.select(F.concat(F.lit("sess:"), F.col("user_id")).alias("session_key"), "article_ids")
    assert session_rows(last) == session_rows(want)
    nameless = stream_of(spark, [[(0, 1, 7), (0, 1, 7)]]).withColumn("event_id", F.lit(None).cast("bigint"))
    assert spark.read.parquet(S.append_to(S.each_once(nameless), "nameless")).count() == 2


def test_best_sellers_by_segment_expire(spark):
    r = random.Random(6)
    rows = [(r.randint(0, 300), r.randint(1, 9), r.choice([1, 2, 3, 4, None])) for _ in range(400)]
    arrivals = sorted(rows, key=lambda x: x[0] + r.uniform(0, 9))  # at most nine minutes late
    users = spark.createDataFrame([(1, 20, "north"), (2, 20, "north"), (3, 70, None)], "customer_id bigint, age int, region string")
    bands = {u.customer_id: (u.region or "unknown", u.band) for u in users.select("*", age_band(F.col("age")).alias("band")).collect()}
    stream = S.typed(stream_of(spark, [arrivals[i : i + 80] for i in range(0, 400, 80)]))
    shape = "pane timestamp, region string, age_band string, article_id bigint, n bigint"
    panes = S.update_to(S.segment_panes(stream, users), "panes", shape, ["pane", "region", "age_band", "article_id"], fan=2)
    start, want = dt.datetime(2024, 1, 1), {}
    for as_of in range(0, 400, 10):
        counts = Counter()
        for minute, article, user in rows:
            if as_of - 60 <= minute < as_of:
                own = bands.get(user, ("unknown", "unknown"))
                for segment in {own, ("unknown", "unknown")}:
                    counts[segment, article] += 1
        for segment in {k[0] for k in counts}:
            best = sorted((-n, a) for (s, a), n in counts.items() if s == segment)[:3]
            want |= {(start + dt.timedelta(minutes=as_of), *segment, i + 1): (a, -n) for i, (n, a) in enumerate(best)}
    got = {(x.as_of, x.region, x.age_band, x["rank"]): (x.article_id, x.n) for x in utc(S.best_sellers(panes, 3)).collect()}
    assert got == want
    last = (max(m for m, _, _ in rows) // 10 + 1) * 10
    live = {(x.as_of, x.region, x.age_band, x["rank"]): (x.article_id, x.n) for x in utc(S.live_best_sellers(panes, 3)).collect()}
    assert live == {k: v for k, v in want.items() if k[0] == start + dt.timedelta(minutes=last)}


def utc(rows):
    return rows.withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))


def test_empty_stream_gives_no_rows(spark):
    stream = stream_of(spark, [[]])
    state = S.session_state(S.with_defaults(S.typed(stream)), 1800)
    assert S.update_to(state, "none", S.SESSION, ["session_key"]).count() == 0


def test_guests_have_keys_of_their_own(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 5, "s1", at), (2, None, "s1", at), (3, None, "", at), (4, None, None, at)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, session_id string, ts timestamp_ntz")
    filled = events.selectExpr("*", "1L AS article_id", "1.0D AS price", "'c' AS category_l1", "true AS discounted")
    got = {r.event_id: r.session_key for r in S.with_defaults(filled).collect()}
    assert got == {1: "sess:5", 2: "sess:s1", 3: "sess:anonymous", 4: "sess:anonymous"}


def test_registry_and_names():
    names = set(catalogue.queries())
    assert set(catalogue.checks()) <= names and len(names) > 110


@pytest.mark.parametrize("name", ["D3_covisitation", "I7_vector_top_k", "N7_guarded_lists", "K10_feed", "P2_averages_and_coverage", "M3_erasure"])
def test_query_equals_sql(spark, name):
    from check_queries import compare, connect

    ok, note, n = compare(catalogue.queries()[name](spark, SMALL), connect(SMALL), catalogue.checks()[name])
    assert ok and n > 0, note
