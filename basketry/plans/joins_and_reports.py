"""Joins, aggregations, samples, set operations and operating reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators import covisit, reports, sampling, vocab
from basketry.operators import items as I
from basketry.operators.sequences import last_rows
from basketry.operators.skew import newest
from basketry.plans.registry import query, shared, view
from basketry.plans.sources_and_scalars import SPEC, purchases, samples, split
from basketry.sources import tables as T

view(
    "pairs",
    ("tx",),
    """SELECT a.article_id AS item, b.article_id AS neighbour, count(*) AS cnt
       FROM (SELECT *, row_number() OVER () AS rid FROM tx) a JOIN (SELECT *, row_number() OVER () AS rid FROM tx) b
       ON a.customer_id = b.customer_id AND a.article_id <> b.article_id AND abs(a.t_dat - b.t_dat) <= 7
       GROUP BY 1, 2""",
)
view(
    "meta",
    ("items", "train"),
    """SELECT i.article_id, i.category_l1,
         coalesce(n_interactions, 0) / coalesce(nullif((SELECT max(n_interactions) FROM items), 0), 1) AS popularity,
         coalesce(n_interactions, 0) / (coalesce(n_interactions, 0) + 20.0::DOUBLE) AS ctr,
         coalesce(s.first_seen, (SELECT max(t_dat) FROM train)) AS first_seen, coalesce(s.avg_price, 0.0::DOUBLE) AS avg_price,
         greatest(0, (SELECT max(t_dat) FROM train)
           - coalesce(s.first_seen, (SELECT max(t_dat) FROM train)))::DOUBLE AS days_since_first_seen
       FROM items i LEFT JOIN (SELECT article_id, min(t_dat) AS first_seen, avg(price) AS avg_price
                               FROM train GROUP BY 1) s USING (article_id)""",
)
view(
    "centroids",
    ("articles", "vectors"),
    """SELECT category_l1, list(m ORDER BY pos) AS centroid FROM (
         SELECT category_l1, pos, avg(vector[pos]) AS m FROM (SELECT category_l1, vector, unnest(range(1, 65)) AS pos
           FROM articles JOIN vectors USING (article_id)) GROUP BY 1, 2) GROUP BY 1""",
)
view(
    "whole_centroid",
    ("vectors",),
    """SELECT list(m ORDER BY pos) AS centroid FROM (SELECT pos, avg(vector[pos]) AS m
         FROM (SELECT vector, unnest(range(1, 65)) AS pos FROM vectors) GROUP BY 1)""",
)


def serving_meta(spark, sf):
    def made():
        train, _ = split(spark, sf)
        counts = purchases(spark, sf).groupBy("article_id").agg(F.count(F.lit(1)).alias("n_interactions"))
        stock = T.articles(spark, sf).join(counts, "article_id", "left")
        meta = I.item_meta(stock, train, first_seen="reference")
        return I.days_since_first_seen(meta, sampling.last_day(train))

    return shared("serving meta", sf, made)


@query("C1_semi_join_top", "SELECT customer_id, article_id, t_dat, price FROM sampled", "sampled")
def c1(spark, sf):
    parts = samples(spark, sf)
    return parts["train"].unionByName(parts["val"]).select("customer_id", "article_id", "t_dat", "price")


@query("C2_items_left_join_counts", "SELECT article_id, category_l1, n_interactions FROM items", "items")
def c2(spark, sf):
    return T.items(spark, sf).select("article_id", "category_l1", "n_interactions")


@query("C3_purchase_pairs_in_window", "SELECT item, neighbour, cnt::BIGINT AS cnt FROM pairs", "pairs")
def c3(spark, sf):
    return covisit.covisit_counts(purchases(spark, sf))


@query(
    "C4_anti_join_seen",
    """SELECT DISTINCT v.customer_id, v.article_id FROM val v ANTI JOIN train t
       ON v.customer_id = t.customer_id AND v.article_id = t.article_id""",
    "train val",
)
def c4(spark, sf):
    train, val = split(spark, sf)
    pair = ["customer_id", "article_id"]
    return val.select(*pair).distinct().join(train.select(*pair), pair, "left_anti")


@query(
    "C5_lookup_with_default",
    """SELECT event_id, coalesce(m.category_l1, 'unknown') AS category_l1, round(coalesce(popularity, 0.0), 6) AS popularity,
         coalesce(days_since_first_seen, 9999.0::DOUBLE) AS days_since_first_seen
       FROM (SELECT event_id, article_id * 25 AS article_id FROM clicks) c LEFT JOIN meta m USING (article_id)""",
    "clicks meta",
)
def c5(spark, sf):
    # Spread over a wider id range than the catalogue, so that some items have no metadata.
    rows = T.clicks(spark, sf).select("event_id", (F.col("article_id") * 25).alias("article_id"))
    found = I.with_meta(rows, serving_meta(spark, sf))
    return found.select("event_id", "category_l1", F.round("popularity", 6).alias("popularity"), "days_since_first_seen")


@query(
    "C6_lookup_inner",
    """SELECT article_id, category_l1, round(avg_price, 6) AS avg_price FROM (SELECT DISTINCT article_id FROM tx)
       JOIN meta USING (article_id) JOIN vectors USING (article_id)""",
    "tx meta vectors",
)
def c6(spark, sf):
    asked = T.transactions(spark, sf).select("article_id").distinct()
    meta = serving_meta(spark, sf).select("article_id", "category_l1", F.round("avg_price", 6).alias("avg_price"))
    return asked.join(meta, "article_id").join(T.vectors(spark, sf).select("article_id"), "article_id")


@query(
    "C7_vocabulary_lookup",
    """SELECT b.customer_id, a.code AS age_code, coalesce(r.code, 0) AS region_code FROM banded b
       JOIN (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT age_band AS value FROM banded)) a
         ON a.value = b.age_band
       LEFT JOIN (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS value
         FROM customer WHERE c_acctbal > 9000)) r ON r.value = b.club_status""",
    "banded",
)
def c7(spark, sf):
    users = T.users(spark, sf).withColumn("age_band", C.age_band(F.col("age")))
    rich = T.table(spark, sf, "customer").filter(F.col("c_acctbal") > 9000)
    ages, clubs = vocab.vocabulary(users, "age_band"), vocab.vocabulary(rich, "c_mktsegment")
    coded = vocab.encoded(vocab.encoded(users, "age_band", ages, "age_code"), "club_status", clubs, "region_code")
    return coded.select("customer_id", "age_code", "region_code")


@query(
    "C9_val_customers_without_train",
    """SELECT customer_id FROM (SELECT customer_id FROM s_val EXCEPT SELECT customer_id FROM s_train)""",
    "s_val s_train",
)
def c9(spark, sf):
    parts = samples(spark, sf)
    return sampling.absent_customers(parts["val"], parts["train"])


@query("D1_top_customers", "SELECT customer_id, n_tx FROM top_customers", "top_customers")
def d1(spark, sf):
    return sampling.top_by_count(sampling.recent(T.transactions(spark, sf), SPEC.weeks), "customer_id", SPEC.n_customers)


@query("D2_top_articles", "SELECT article_id, n_tx FROM top_articles", "top_articles")
def d2(spark, sf):
    recent = sampling.recent(T.transactions(spark, sf), SPEC.weeks)
    kept = recent.join(sampling.top_by_count(recent, "customer_id", SPEC.n_customers), "customer_id", "left_semi")
    return sampling.top_by_count(kept, "article_id", SPEC.n_articles, SPEC.min_support)


@query(
    "D3_covisitation",
    """SELECT item, neighbour, cnt::BIGINT AS cnt, rk FROM (SELECT *, row_number() OVER (PARTITION BY item
         ORDER BY cnt DESC, neighbour)::INTEGER AS rk FROM pairs) WHERE rk <= 50""",
    "pairs",
)
def d3(spark, sf):
    return covisit.near_items(purchases(spark, sf))


@query(
    "D4_item_stats",
    "SELECT article_id, min(t_dat) AS first_seen, round(avg(price), 6) AS avg_price FROM tx GROUP BY 1",
    "tx",
)
def d4(spark, sf):
    return I.item_stats(T.transactions(spark, sf)).withColumn("avg_price", F.round("avg_price", 6))


@query(
    "D5_item_meta",
    """SELECT article_id, category_l1, round(popularity, 6) AS popularity, round(ctr, 6) AS ctr, first_seen,
         round(avg_price, 6) AS avg_price, days_since_first_seen FROM meta""",
    "meta",
)
def d5(spark, sf):
    meta = serving_meta(spark, sf)
    for c in ("popularity", "ctr", "avg_price"):
        meta = meta.withColumn(c, F.round(c, 6))
    return meta


def _centroid_rows(df, *keys):
    return df.select(*keys, F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(
    "D6_category_centroids",
    "SELECT category_l1, (unnest(range(0, 64)))::INTEGER AS pos, round(unnest(centroid), 6) AS x FROM centroids",
    "centroids",
)
def d6(spark, sf):
    return _centroid_rows(I.category_centroids(T.articles(spark, sf), T.vectors(spark, sf)), "category_l1")


@query(
    "D7_global_centroid",
    "SELECT (unnest(range(0, 64)))::INTEGER AS pos, round(unnest(centroid), 6) AS x FROM whole_centroid",
    "whole_centroid",
)
def d7(spark, sf):
    return _centroid_rows(I.global_centroid(T.vectors(spark, sf)))


@query("D8_relevant_items", "SELECT DISTINCT customer_id, article_id FROM val", "val")
def d8(spark, sf):
    return split(spark, sf)[1].select("customer_id", "article_id").distinct()


@query(
    "D9_session_category_counts",
    "SELECT user_id, coalesce(category_l1, 'unknown') AS category_l1, count(*) AS n FROM clicks GROUP BY 1, 2",
    "clicks",
)
def d9(spark, sf):
    named = T.clicks(spark, sf).fillna(C.UNKNOWN, ["category_l1"])
    return named.groupBy("user_id", "category_l1").agg(F.count(F.lit(1)).alias("n"))


@query(
    "D10_last_category_time",
    "SELECT user_id, coalesce(category_l1, 'unknown') AS category_l1, max(ts) AS last_ts FROM clicks GROUP BY 1, 2",
    "clicks",
)
def d10(spark, sf):
    named = T.clicks(spark, sf).fillna(C.UNKNOWN, ["category_l1"])
    return named.groupBy("user_id", "category_l1").agg(F.max("ts").alias("last_ts"))


@query(
    "D12_category_share",
    """SELECT list_id, category, n, round(n / t, 6) AS share, n / t > 0.35::DOUBLE AS over_cap FROM (
         SELECT list_id, category, n, sum(n) OVER (PARTITION BY list_id) AS t FROM (
           SELECT r.customer_id AS list_id, coalesce(CASE WHEN a.size > 8 THEN a.category_l1 END, 'unknown') AS category,
             count(*) AS n
           FROM (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY t_dat DESC,
                   order_id DESC, line_no DESC, article_id DESC, paid DESC, quantity DESC) AS age FROM tx) r
           JOIN articles a USING (article_id) WHERE age <= 20 GROUP BY 1, 2))""",
    "tx articles",
)
def d12(spark, sf):
    kinds = T.articles(spark, sf).select("article_id", F.when(F.col("size") > 8, F.col("category_l1")).alias("category_l1"))
    lists = last_rows(T.transactions(spark, sf)).join(kinds, "article_id").withColumnRenamed("customer_id", "list_id")
    return reports.category_share(lists)


@query(
    "D13_stage_latency",
    """SELECT endpoint AS stage, count(*) AS latency_count, round(sum(response_time_ms), 3) AS latency_sum
       FROM requests GROUP BY 1""",
    "requests",
)
def d13(spark, sf):
    return reports.stage_latency(T.requests(spark, sf).withColumnRenamed("endpoint", "stage"), "stage", "response_time_ms")


view(
    "latency",
    ("requests",),
    """SELECT name, count(*) AS requests, count(*) FILTER (NOT success) AS failures, min(response_time_ms) AS min_ms,
         max(response_time_ms) AS max_ms, round(avg(response_time_ms), 6) AS mean_ms,
         round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE), 6) AS requests_per_s,
         round(quantile_cont(response_time_ms, 0.5), 6) AS p50, round(quantile_cont(response_time_ms, 0.95), 6) AS p95,
         round(quantile_cont(response_time_ms, 0.99), 6) AS p99
       FROM (SELECT endpoint AS name, * FROM requests UNION ALL SELECT 'Aggregated', * FROM requests) GROUP BY 1""",
)


@query("D14_latency_report", "SELECT * FROM latency", "latency")
def d14(spark, sf):
    return reports.latency_report(T.requests(spark, sf))


@query(
    "D15_latency_histogram",
    """SELECT least(40, floor((response_time_ms - lo) / ((hi - lo) / 40.0::DOUBLE)) + 1)::INTEGER AS bin, count(*) AS requests
       FROM requests, (SELECT min(response_time_ms) AS lo, max(response_time_ms) AS hi FROM requests) GROUP BY 1""",
    "requests",
)
def d15(spark, sf):
    return reports.latency_histogram(T.requests(spark, sf))


@query(
    "D16_capacity_cost",
    """WITH named AS (SELECT e.name, coalesce(l.mean_ms, (SELECT mean_ms FROM latency WHERE name = 'Aggregated')) AS mean_ms
         FROM (SELECT DISTINCT endpoint AS name FROM requests UNION SELECT DISTINCT c_mktsegment FROM customer) e
         LEFT JOIN latency l USING (name)),
       pods AS (SELECT *, ceil(10000 / (16 / (mean_ms / 1000)) * 1.4::DOUBLE)::BIGINT AS api_pods, 20 AS retrieval_pods FROM named),
       cost AS (SELECT *, api_pods * 4 * 0.04::DOUBLE + retrieval_pods * 4 * 0.04::DOUBLE + 1.2::DOUBLE AS hourly FROM pods),
       unit AS (SELECT *, hourly / 36000000 * 1000 + 2.0::DOUBLE / 864000000 * 1000 AS per_1000 FROM cost)
       SELECT name, round(mean_ms, 6) AS mean_ms, round(10000 * mean_ms / 1000, 6) AS in_flight,
         round(16 / (mean_ms / 1000), 6) AS throughput_per_pod, api_pods, retrieval_pods::BIGINT AS retrieval_pods,
         round(hourly, 6) AS cost_per_hour, round(per_1000, 6) AS cost_per_1000, round(per_1000 * 1000, 6) AS cost_per_million,
         500.0::DOUBLE AS llm_cost_per_million, round(0.5::DOUBLE / per_1000, 6) AS llm_multiple FROM unit""",
    "latency requests",
)
def d16(spark, sf):
    log = T.requests(spark, sf)
    # Segments stand for endpoints that were never measured; they fall back to the aggregate row.
    asked = log.select(F.col("endpoint").alias("name")).union(T.table(spark, sf, "customer").select("c_mktsegment")).distinct()
    cost = reports.capacity(reports.mean_latency_for(reports.latency_report(log), asked))
    counts = ("name", "api_pods", "retrieval_pods")
    return cost.select(*[F.col(c) if c in counts else F.round(c, 6).alias(c) for c in cost.columns])


@query(
    "F1_sort_limit",
    "SELECT article_id, count(*) AS n FROM tx GROUP BY 1 ORDER BY n DESC, article_id LIMIT 100",
    "tx",
)
def f1(spark, sf):
    return sampling.top_by_count(T.transactions(spark, sf), "article_id", 100).withColumnRenamed("n_tx", "n")


@query(
    "F2_seeded_subsample",
    """SELECT customer_id, article_id, order_id, line_no FROM (SELECT DISTINCT customer_id, article_id, order_id, line_no
         FROM tx) ORDER BY md5('0|' || customer_id || '|' || article_id || '|' || order_id || '|' || line_no),
         customer_id, article_id, order_id, line_no LIMIT 8000""",
    "tx",
)
def f2(spark, sf):
    key = ["customer_id", "article_id", "order_id", "line_no"]
    return sampling.subsample(T.transactions(spark, sf).select(*key).distinct(), key, 8000)


@query(
    "F3_systematic_sample",
    """SELECT article_id, prod_name FROM (SELECT *, row_number() OVER (ORDER BY article_id) - 1 AS place,
         greatest(1, count(*) OVER () // 12) AS step FROM articles) WHERE place % step = 0 AND place / step < 12""",
    "articles",
)
def f3(spark, sf):
    return sampling.systematic(T.articles(spark, sf), "article_id", 12).select("article_id", "prod_name")


@query(
    "F4_latest_100_per_user",
    """SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)
         AS age FROM clicks) WHERE age <= 100""",
    "clicks",
)
def f4(spark, sf):
    order = [F.desc("ts"), F.desc("event_id")]
    return newest(T.clicks(spark, sf), ["user_id"], order, 100).select("user_id", "event_id", "ts")


@query(
    "G1_user_set_difference",
    "SELECT customer_id FROM (SELECT customer_id FROM train EXCEPT SELECT customer_id FROM val)",
    "train val",
)
def g1(spark, sf):
    train, val = split(spark, sf)
    return sampling.absent_customers(train, val)


@query(
    "G3_leakage_audit",
    """WITH seen AS (SELECT customer_id, article_id FROM s_train UNION ALL SELECT customer_id, article_id FROM s_val)
       SELECT 'article_not_in_items' AS rule, count(*) AS violations FROM (SELECT DISTINCT article_id FROM seen)
         ANTI JOIN s_items USING (article_id)
       UNION ALL SELECT 'customer_not_in_users', count(*) FROM (SELECT DISTINCT customer_id FROM seen)
         ANTI JOIN s_users USING (customer_id)
       UNION ALL SELECT 'null_category', count(*) FROM s_items WHERE category_l1 IS NULL
       UNION ALL SELECT 'val_not_after_train', count(*) FROM (SELECT max(t_dat) AS d FROM s_train)
         WHERE d >= (SELECT max(t_dat) FROM s_val)""",
    "s_train s_val s_items s_users",
)
def g3(spark, sf):
    parts = samples(spark, sf)
    return sampling.leakage_audit(parts["train"], parts["val"], parts["items"], parts["users"])


@query(
    "J1_vocabulary",
    """SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT category_l2 AS value FROM articles)""",
    "articles",
)
def j1(spark, sf):
    return vocab.vocabulary(T.articles(spark, sf), "category_l2")
