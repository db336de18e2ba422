"""The hot-key paths give the same rows as the plain ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.operators import compliance, covisit, intents, sampling, sequences, skew
from basketry.operators.features import price_percentile
from basketry.operators.reports import latency_report
from basketry.operators.vocab import vocabulary


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def tx(spark):
    """3000 purchases; one customer holds a third of them, and one basket 200 lines."""
    n = F.col("id")
    hot = n % 3 == 0
    return (
        spark.range(3000)
        .select(
            F.when(hot, F.lit(1)).otherwise(n % 97 + 2).alias("customer_id"),
            F.pmod(F.xxhash64(n), F.lit(60)).alias("article_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod(F.xxhash64(n, F.lit(1)), F.lit(300))).cast("int")).alias("t_dat"),
            F.when(n < 200, F.lit(7)).otherwise(n).alias("order_id"),
            n.cast("int").alias("line_no"),
            (n % 13 + 1).cast("double").alias("paid"),
            F.lit(1.0).alias("quantity"),
            (n % 13 + 1).cast("double").alias("price"),
        )
        .repartition(8)
        .cache()
    )


def test_running_total(tx):
    plain = skew.running_total(tx, ["customer_id"], ["t_dat", "order_id", "line_no"], F.col("paid"), "s")
    hot = skew.running_total(tx, ["customer_id"], ["t_dat", "order_id", "line_no"], F.col("paid"), "s", hot_rows=100)
    assert rows(plain) == rows(hot)


def test_training_examples(tx):
    plain = sequences.training_examples(tx)
    hot = sequences.training_examples(tx, hot_rows=100)
    assert rows(plain) == rows(hot)
    detailed = sequences.detailed_examples(tx, hot_rows=100)
    assert rows(sequences.detailed_examples(tx)) == rows(detailed)
    # Drawing first and building histories for the drawn examples gives the same rows.
    drawn = sampling.subsample(detailed, ["example_id"], 100)
    for found in (sequences.chosen_examples(tx, 100), sequences.chosen_examples(tx, 100, hot_rows=100)):
        assert rows(found.select(*drawn.columns)) == rows(drawn)


def test_chunks_smaller_than_the_frame_are_widened(tx):
    def columns(w):
        return {"before": F.collect_list("article_id").over(w.rowsBetween(-20, -1)), "after": F.lead("article_id", 2).over(w)}

    order = ["t_dat", "order_id", "line_no"]
    plain = skew.ordered_window(tx, ["customer_id"], order, columns, 20, 2)
    hot = skew.ordered_window(tx, ["customer_id"], order, columns, 20, 2, hot_rows=50, chunk_rows=5)
    wide = skew.ordered_window(tx, ["customer_id"], order, columns, 20, 2, hot_rows=50, chunk_rows=64)
    assert rows(plain) == rows(hot) == rows(wide)


def test_numbered_history(tx):
    assert rows(sequences.numbered(tx)) == rows(sequences.numbered(tx, hot_rows=100))


def test_covisitation_and_lift(tx):
    plain = rows(covisit.covisit_counts(tx))
    assert plain == rows(covisit.covisit_counts(tx, hot_rows=10))
    data = [(r.customer_id, r.article_id, r.t_dat) for r in tx.collect()]
    counts = {}
    by_customer = {}
    for c, a, d in data:
        by_customer.setdefault(c, []).append((a, d))
    for bought in by_customer.values():
        for i, (a, d) in enumerate(bought):
            for b, e in bought[i + 1 :]:
                if a != b and abs((d - e).days) <= 7:
                    counts[a, b] = counts.get((a, b), 0) + 1
                    counts[b, a] = counts.get((b, a), 0) + 1
    assert plain == sorted((str(a), str(b), str(n)) for (a, b), n in counts.items())
    assert rows(covisit.complements(tx)) == rows(covisit.complements(tx, hot_rows=10))


def test_percentiles_and_report(spark):
    log = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("endpoint"),
        (F.pmod(F.xxhash64("id"), F.lit(400)) / 7.0).alias("response_time_ms"),
        (F.col("id") % 10 != 0).alias("success"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"),
    )
    want = log.groupBy().agg(*[F.round(F.percentile("response_time_ms", p), 6) for p in (0.5, 0.95, 0.99)]).first()
    for report in (latency_report(log), latency_report(log, hot_rows=20)):
        whole = report.filter("name = 'Aggregated'").first()
        assert (whole.p50, whole.p95, whole.p99) == tuple(want)
        assert whole.requests == 1000 and whole.failures == 100
    assert rows(latency_report(log)) == rows(latency_report(log, hot_rows=20))


def test_price_percentile(tx):
    plain = price_percentile(tx, ["customer_id"])
    assert rows(plain) == rows(price_percentile(tx, ["customer_id"], hot_rows=3))


def test_vocabulary_and_first_n(spark, tx):
    named = tx.select(F.concat(F.lit("c"), F.col("line_no")).alias("name"))
    assert rows(vocabulary(named, "name")) == rows(vocabulary(named, "name", hot_rows=100))
    few = sampling.top_by_count(tx, "line_no", 1500)
    assert few.count() == 1500 and few.agg(F.max("line_no")).first()[0] == 1499


def test_subsample_filter_keeps_the_same_rows(spark):
    df = spark.range(5000)
    digest = F.md5(F.concat_ws("|", F.lit("0"), F.col("id").cast("string")))
    want = [r.id for r in df.orderBy(digest, "id").limit(100).collect()]
    assert sorted(want) == sorted(r.id for r in sampling.subsample(df, ["id"], 100).collect())


def test_consent_and_gaps(spark):
    start = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(1 if i % 3 else i % 5, "p", i % 2 == 0, start + dt.timedelta(minutes=(i * 37) % 1000), i) for i in range(300)],
        "customer_id int, purpose string, granted boolean, granted_at timestamp_ntz, event_id int",
    )
    plain = compliance.consent_history(events)
    hot = skew.ordered_window(
        events, ["customer_id", "purpose"], ["granted_at", "event_id"],
        lambda w: {"revoked_at": F.lead("granted_at").over(w)}, after=1, hot_rows=20, chunk_rows=16,
    ).drop("seq")
    assert rows(plain) == rows(hot.select(*plain.columns)) == rows(compliance.consent_history(events, hot_rows=20))
    clicks = events.select(F.col("customer_id").alias("user_id"), F.col("granted_at").alias("ts"), "event_id")
    assert rows(intents.event_gaps(clicks)) == rows(intents.event_gaps(clicks, hot_rows=20))
