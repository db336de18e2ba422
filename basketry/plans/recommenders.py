"""Intents, ranking features, recommenders and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.columns import COLD_START
from basketry.operators import candidates, clusters, covisit, evaluation, intents
from basketry.operators.features import build_features
from basketry.plans import surfaces
from basketry.plans.joins_and_reports import serving_meta
from basketry.plans.registry import query, remembered, shared, view
from basketry.plans.sequences_and_vectors import tail_sessions
from basketry.plans.sources_and_scalars import newest_aged, newest_purchases, newest_rows, split
from basketry.session import durable
from basketry.sources import tables as T

DIM = 64

UNIT = "list_transform(m, lambda x: CASE WHEN list_dot_product(m, m) > 0 THEN x / sqrt(list_dot_product(m, m)) ELSE 0 END)"
SCORES = """SELECT *, (1 / (1 + gap)) * (1 - spread) AS urgent_replacement,
         spread * least(1, gap / 10 + 0.3::DOUBLE) AS seasonal_browsing, spread * (1 - least(1, gap / 10)) AS complementary,
         0.6::DOUBLE * ratio + 0.4::DOUBLE * least(1, variation) AS bargain_hunting FROM (
         SELECT list_id, coalesce((max(epoch_us(ts)) - min(epoch_us(ts))) / 60e6::DOUBLE / nullif(count(*) - 1, 0), 0) AS gap,
           count(DISTINCT coalesce(category_l1, 'unknown')) / count(*) AS spread,
           sum(discounted::INTEGER) / count(*) AS ratio, stddev_pop(price) / (avg(price) + 1e-6::DOUBLE) AS variation
         FROM {events} GROUP BY 1)"""
RANKED = """SELECT list_id, label, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, declared) AS label_rank
       FROM (SELECT list_id, unnest([0, 1, 2, 3]) AS declared,
         unnest(['urgent_replacement', 'seasonal_browsing', 'complementary', 'bargain_hunting']) AS label,
         round(unnest([urgent_replacement, seasonal_browsing, complementary, bargain_hunting]), 9) AS score FROM {scores})"""
HEADS = """SELECT list_id, category_l1, vector, intent_rank, n / sum(n) OVER (PARTITION BY list_id) AS weight FROM (
         SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY n DESC, category_l1) AS intent_rank FROM (
           SELECT list_id, category_l1, n, """ + UNIT + """ AS vector FROM (
             SELECT list_id, category_l1, any_value(n) AS n, list(x ORDER BY pos) AS m FROM (
               SELECT list_id, category_l1, pos, avg(vector[pos]) AS x, count(*) AS n FROM (
                 SELECT list_id, coalesce(category_l1, 'unknown') AS category_l1, vector, unnest(range(1, 65)) AS pos
                 FROM {events} JOIN vectors USING (article_id)) GROUP BY 1, 2, 3) GROUP BY 1, 2))) WHERE intent_rank <= 4"""
INTENTS = """SELECT k.list_id, coalesce(h.intent_rank, 1) AS intent_rank, coalesce(l.label, 'cold_start') AS label,
         coalesce(h.weight, 1.0::DOUBLE) AS weight, coalesce(h.vector, list_transform(range(64), lambda x: 0.0::DOUBLE)) AS vector
       FROM {keys} k LEFT JOIN {heads} h ON h.list_id = k.list_id
       LEFT JOIN {labels} l ON l.list_id = h.list_id AND l.label_rank = h.intent_rank"""

view("events20", ("sess",), "SELECT user_id AS list_id, * FROM sess")
view("keys", ("banded",), "SELECT customer_id AS list_id, region, age_band FROM banded")
view("scores", ("events20",), SCORES.format(events="events20"))
view("labels_ranked", ("scores",), RANKED.format(scores="scores"))
view("heads", ("events20", "vectors"), HEADS.format(events="events20"))
view("intents", ("keys", "heads", "labels_ranked"), INTENTS.format(keys="keys", heads="heads", labels="labels_ranked"))
view(
    "h_events",
    ("last20", "meta"),
    """SELECT customer_id AS list_id, article_id, CAST(t_dat AS TIMESTAMP) AS ts, price,
         coalesce(m.category_l1, 'unknown') AS category_l1, false AS discounted FROM last20 l LEFT JOIN meta m USING (article_id)""",
)
view("h_keys", ("last20",), "SELECT DISTINCT customer_id AS list_id FROM last20")
view("h_scores", ("h_events",), SCORES.format(events="h_events"))
view("h_labels", ("h_scores",), RANKED.format(scores="h_scores"))
view("h_heads", ("h_events", "vectors"), HEADS.format(events="h_events"))
view("h_intents", ("h_keys", "h_heads", "h_labels"), INTENTS.format(keys="h_keys", heads="h_heads", labels="h_labels"))


def contexts(spark, sf):
    from basketry.functions.columns import age_band

    users = T.users(spark, sf)
    return users.select(F.col("customer_id").alias("list_id"), "region", age_band(F.col("age")).alias("age_band"))


def sessions(spark, sf):
    return shared("sessions", sf, lambda: tail_sessions(spark, sf).withColumnRenamed("user_id", "list_id"))


def history_session(spark, sf):
    rows = newest_rows(spark, sf).select(F.col("customer_id").alias("list_id"), "article_id", "t_dat", "price")
    return intents.session_rows(rows, serving_meta(spark, sf))


def session_intents(spark, sf):
    rows = sessions(spark, sf)
    return shared("session intents", sf, lambda: intents.infer_intents(contexts(spark, sf), rows, T.vectors(spark, sf), DIM))


def history_intents(spark, sf):
    rows = shared("history session", sf, lambda: history_session(spark, sf))
    lists = rows.select("list_id").distinct()
    return shared("history intents", sf, lambda: intents.infer_intents(lists, rows, T.vectors(spark, sf), DIM))


def catalogue_of(spark, sf):
    stock = T.articles(spark, sf).select("article_id", "category_l1", "in_stock", "age_restricted")
    return surfaces.Catalogue(stock, T.vectors(spark, sf), serving_meta(spark, sf), DIM)


@query(
    "L2_label_scores",
    """SELECT list_id, round(urgent_replacement, 6) AS urgent_replacement, round(seasonal_browsing, 6) AS seasonal_browsing,
         round(complementary, 6) AS complementary, round(bargain_hunting, 6) AS bargain_hunting FROM scores""",
    "scores",
)
def l2(spark, sf):
    found = intents.label_scores(sessions(spark, sf))
    return found.select("list_id", *[F.round(l, 6).alias(l) for l in intents.LABELS])


@query("L3_ranked_labels", "SELECT list_id, label, label_rank::INTEGER AS label_rank FROM labels_ranked", "labels_ranked")
def l3(spark, sf):
    return intents.ranked_labels(intents.label_scores(sessions(spark, sf))).select("list_id", "label", "label_rank")


@query(
    "L4_cold_starts",
    """SELECT list_id, label, weight, list_dot_product(vector, vector) < 0.5 AS zero_vector FROM intents
       WHERE label = 'cold_start'""",
    "intents",
)
def l4(spark, sf):
    from basketry.functions.vectors import norm

    found = session_intents(spark, sf).filter(F.col("label") == COLD_START)
    return found.select("list_id", "label", "weight", (norm(F.col("vector")) < 0.5).alias("zero_vector"))


@query(
    "L5_intent_vectors",
    """SELECT list_id, intent_rank::INTEGER AS intent_rank, label, round(weight, 6) AS weight, pos::INTEGER AS pos,
         round(vector[pos + 1], 6) AS x FROM (SELECT *, unnest(range(0, 64)) AS pos FROM h_intents)""",
    "h_intents",
)
def l5(spark, sf):
    rows = history_intents(spark, sf)
    out = rows.select("list_id", "intent_rank", "label", F.round("weight", 6).alias("weight"), F.posexplode("vector").alias("pos", "x"))
    return out.withColumn("x", F.round("x", 6))


def clustered_heads(spark, sf):
    rows = shared("history session", sf, lambda: history_session(spark, sf))
    return shared("clustered heads", sf, lambda: clusters.clustered_intents(rows, T.vectors(spark, sf), DIM))


def clustered_history_intents(spark, sf):
    """Worked out where they are read, and not stored: they are read once."""
    rows = shared("history session", sf, lambda: history_session(spark, sf))
    heads = clusters.clustered_intents(rows, T.vectors(spark, sf), DIM)
    return intents.labelled_intents(rows.select("list_id").distinct(), rows, heads, DIM)


def most_history_intents(spark, sf):
    """How many intents of either kind there are, or a few more: a list has one for each purchase with a vector, four at most."""

    def made():
        rows = shared("history session", sf, lambda: history_session(spark, sf))
        known = T.vectors(spark, sf).select("article_id").distinct()
        sizes = rows.join(known, "article_id", "left_semi").groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(F.coalesce(F.sum(F.least("n", F.lit(intents.MAX_INTENTS))), F.lit(0))).first()[0]

    return remembered("most history intents", sf, made)


# Clusters are beyond SQL; tests/test_clusters.py holds the whole result of this query against a plain loop.
@query("L5_clustered_intents")
def l5_clustered(spark, sf):
    return clustered_heads(spark, sf).select("list_id", "intent_rank", "article_id", "events", F.round("weight", 6).alias("weight"))


# What SQL can hold of it: each session's mapped events are shared out among its heads, all of them once.
@query(
    "L5_clustered_events",
    "SELECT list_id, count(*) AS events, 1.0::DOUBLE AS weight FROM h_events SEMI JOIN vectors USING (article_id) GROUP BY 1",
    "h_events vectors",
)
def l5_clustered_events(spark, sf):
    return clustered_heads(spark, sf).groupBy("list_id").agg(F.sum("events").alias("events"), F.round(F.sum("weight"), 6).alias("weight"))


@query(
    "L6_history_session_rows",
    "SELECT list_id, article_id, ts, price, category_l1 FROM h_events",
    "h_events",
)
def l6(spark, sf):
    return history_session(spark, sf).select("list_id", "article_id", "ts", "price", "category_l1")


@query(
    "I5_intent_weighted_dot",
    """SELECT list_id, article_id, round(sum(weight * list_dot_product(i.vector, v.vector)), 6) AS score
       FROM h_intents i JOIN (SELECT DISTINCT customer_id AS list_id, article_id FROM val) c USING (list_id)
       JOIN vectors v USING (article_id) GROUP BY 1, 2""",
    "h_intents val vectors",
)
def i5(spark, sf):
    from basketry.functions.vectors import dot

    _, val = split(spark, sf)
    asked = val.select(F.col("customer_id").alias("list_id"), "article_id").distinct()
    mixed = intents.mixed_intents(history_intents(spark, sf))
    rows = asked.join(mixed, "list_id").join(T.vectors(spark, sf), "article_id")
    return rows.select("list_id", "article_id", F.round(dot(F.col("intent_mix"), F.col("vector")), 6).alias("score"))


COSINES = """SELECT a.list_id, a.intent_rank::INTEGER AS head_a, b.intent_rank::INTEGER AS head_b,
         list_dot_product(a.vector, b.vector) AS cosine
       FROM h_intents a JOIN h_intents b ON a.list_id = b.list_id AND a.intent_rank < b.intent_rank"""
view("cosines", ("h_intents",), COSINES)


@query(
    "I6_pairwise_head_cosine",
    "SELECT list_id, head_a, head_b, round(cosine, 6) AS cosine FROM cosines",
    "cosines",
)
def i6(spark, sf):
    return intents.pairwise_cosine(history_intents(spark, sf)).withColumn("cosine", F.round("cosine", 6))


@query(
    "I6_collapse_report",
    """SELECT head_a, head_b, count(*) AS sessions, round(avg(cosine), 6) AS mean_cosine, round(max(cosine), 6) AS max_cosine,
         avg(cosine) > 0.8 AS collapsed FROM cosines GROUP BY 1, 2""",
    "cosines",
)
def i6_report(spark, sf):
    found = intents.collapse_report(intents.pairwise_cosine(history_intents(spark, sf)))
    return found.withColumn("mean_cosine", F.round("mean_cosine", 6)).withColumn("max_cosine", F.round("max_cosine", 6))


@query("I6_clustered_collapse")
def i6_clustered(spark, sf):
    found = intents.collapse_report(intents.pairwise_cosine(clustered_heads(spark, sf)))
    return found.withColumn("mean_cosine", F.round("mean_cosine", 6)).withColumn("max_cosine", F.round("max_cosine", 6))


@query(
    "K1_covisit_recommend",
    "SELECT user_id, article_id, score, rank FROM covisit_recs",
    "covisit_recs",
)
def k1(spark, sf):
    train, _ = split(spark, sf)
    return covisit.covisit_recommend(covisit.near_items(train), train, rows=newest_aged(spark, sf))


view(
    "train_near",
    ("train",),
    """SELECT item, neighbour, cnt FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY cnt DESC, neighbour) AS rk
         FROM (SELECT a.article_id AS item, b.article_id AS neighbour, count(*) AS cnt
           FROM train a JOIN train b ON a.customer_id = b.customer_id AND a.article_id <> b.article_id
             AND abs(a.t_dat - b.t_dat) <= 7 GROUP BY 1, 2)) WHERE rk <= 50""",
)
view(
    "covisit_recs",
    ("train_near", "last20"),
    """SELECT customer_id AS user_id, neighbour AS article_id, score::DOUBLE AS score, rank::INTEGER AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, neighbour) AS rank FROM (
           SELECT customer_id, neighbour, sum(cnt) AS score FROM last20 JOIN train_near ON item = article_id WHERE age <= 5
           GROUP BY 1, 2) s WHERE NOT EXISTS (SELECT 1 FROM last20 l WHERE l.customer_id = s.customer_id
             AND l.article_id = s.neighbour)) WHERE rank <= 20""",
)
view(
    "vector_recs",
    ("per_customer",),
    """SELECT customer_id AS user_id, article_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (
         PARTITION BY customer_id ORDER BY score DESC, article_id) AS rank FROM per_customer) WHERE rank <= 20""",
)
view(
    "intent_recs",
    ("h_intents", "vectors", "last20"),
    """SELECT list_id AS user_id, article_id, score, rank::INTEGER AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, article_id) AS rank FROM (
           SELECT list_id, article_id, max(round(round(list_dot_product(i.vector, v.vector), 9) * weight, 9)) AS score
           FROM h_intents i, vectors v WHERE label <> 'cold_start' AND NOT EXISTS (SELECT 1 FROM last20 l
             WHERE l.customer_id = i.list_id AND l.article_id = v.article_id) GROUP BY 1, 2)) WHERE rank <= 20""",
)
view(
    "popular",
    ("train", "banded"),
    """SELECT region, age_band, article_id, n, row_number() OVER (PARTITION BY region, age_band ORDER BY n DESC, article_id)
         AS rank FROM (SELECT region, age_band, article_id, count(*) AS n FROM train JOIN banded USING (customer_id) GROUP BY 1, 2, 3
           UNION ALL SELECT 'unknown', 'unknown', article_id, count(*) FROM train GROUP BY 3)""",
)
view(
    "popular_recs",
    ("popular", "keys"),
    """SELECT k.list_id AS user_id, article_id, 1.0::DOUBLE AS score, rank::INTEGER AS rank FROM keys k
       JOIN popular USING (region, age_band) WHERE rank <= 20""",
)


@query("K2_vector_recommend", "SELECT * FROM vector_recs", "vector_recs")
def k2(spark, sf):
    return candidates.vector_recommend(newest_purchases(spark, sf), T.vectors(spark, sf))


@query("K3_multi_intent_recommend", "SELECT * FROM intent_recs", "intent_recs")
def k3(spark, sf):
    rows = shared("history session", sf, lambda: history_session(spark, sf))
    vecs = T.vectors(spark, sf)
    heads = intents.infer_intents(rows.select("list_id").distinct(), rows, vecs, DIM)
    seen = newest_purchases(spark, sf).withColumnRenamed("customer_id", "list_id")
    return candidates.multi_intent_recommend(heads, vecs, seen, n_intents=most_history_intents(spark, sf))


@query("K3_clustered_recommend")
def k3_clustered(spark, sf):
    seen = newest_purchases(spark, sf).withColumnRenamed("customer_id", "list_id")
    heads = clustered_history_intents(spark, sf)
    return candidates.multi_intent_recommend(heads, T.vectors(spark, sf), seen, n_intents=most_history_intents(spark, sf))


def popular_items(spark, sf):
    return shared("popular", sf, lambda: candidates.popularity(split(spark, sf)[0], T.users(spark, sf)))


@query(
    "K6_popularity",
    "SELECT region, age_band, article_id, n::BIGINT AS n, rank::INTEGER AS rank FROM popular WHERE rank <= 500",
    "popular",
)
def k6(spark, sf):
    return popular_items(spark, sf)


def popular_recommend(spark, sf):
    found = candidates.popular_for(contexts(spark, sf), popular_items(spark, sf), 20, COLD_START)
    return found.select(F.col("list_id").alias("user_id"), "article_id", "score", "rank")


view(
    "intent_hits",
    ("intents", "vectors", "events20"),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list_id, query_pos ORDER BY score DESC, article_id) AS rk FROM (
         SELECT i.list_id, i.intent_rank AS query_pos, i.label, v.article_id, round(list_dot_product(i.vector, v.vector), 9) AS score
         FROM intents i, vectors v WHERE i.label <> 'cold_start' AND NOT EXISTS (SELECT 1 FROM events20 s
           WHERE s.list_id = i.list_id AND s.article_id = v.article_id))) WHERE rk <= 150""",
)
view(
    "merged",
    ("intent_hits",),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, article_id) AS rank FROM (
         SELECT list_id, article_id, max(score) AS score, arg_min(label, query_pos) AS label FROM intent_hits GROUP BY 1, 2))
       WHERE rank <= 500""",
)


def merged_lists(spark, sf):
    rows = sessions(spark, sf)
    warm = session_intents(spark, sf).filter(F.col("label") != COLD_START)
    seen = rows.select("list_id", "article_id").distinct()
    return candidates.merged_results(warm, T.vectors(spark, sf), seen, candidates.K_PER_QUERY)


@query(
    "K5_merge_queries",
    "SELECT list_id, article_id, score, label, rank::INTEGER AS rank FROM merged",
    "merged",
)
def k5(spark, sf):
    return merged_lists(spark, sf).select("list_id", "article_id", "score", "label", "rank")


view(
    "routed",
    ("keys", "intents", "popular", "merged", "vectors"),
    """SELECT k.list_id, p.article_id, 1.0::DOUBLE AS score, 'cold_start' AS label, NULL::VARCHAR AS degraded
       FROM keys k JOIN popular p USING (region, age_band)
       WHERE p.rank <= 500 AND k.list_id IN (SELECT list_id FROM intents WHERE label = 'cold_start')
       UNION ALL SELECT list_id, article_id, score, label, NULL FROM merged""",
)


@query("K11_cold_start_routing", "SELECT list_id, article_id, score, label FROM routed", "routed")
def k11(spark, sf):
    rows = sessions(spark, sf)
    seen = rows.select("list_id", "article_id").distinct()
    found = candidates.feed_candidates(
        contexts(spark, sf), session_intents(spark, sf), T.vectors(spark, sf), seen, popular_items(spark, sf)
    )
    return found.select("list_id", "article_id", "score", "label")


@query(
    "K12_degradation_flag",
    """SELECT list_id, article_id, score, label, degraded FROM routed
       UNION ALL SELECT k.list_id, p.article_id, 1.0::DOUBLE, 'popularity_fallback', 'retrieval'
       FROM (SELECT * FROM keys WHERE list_id NOT IN (SELECT list_id FROM routed)) k JOIN popular p USING (region, age_band)
       WHERE p.rank <= 500""",
    "keys popular routed",
)
def k12(spark, sf):
    # Which lists fall back follows from the data: those whose intents reach no item.
    seen = sessions(spark, sf).select("list_id", "article_id").distinct()
    return candidates.feed_candidates(
        contexts(spark, sf), session_intents(spark, sf), T.vectors(spark, sf), seen, popular_items(spark, sf)
    ).drop("rank")


view(
    "users_val",
    ("val", "train"),
    "SELECT DISTINCT customer_id AS user_id FROM val SEMI JOIN train USING (customer_id)",
)
MODELS = {"covisitation": "covisit_recs", "vector": "vector_recs", "multi_intent": "intent_recs", "popularity": "popular_recs"}


def _scores_sql(recs: str) -> str:
    return f"""SELECT u.user_id, hits / n_rel AS recall, hits / 20 AS "precision", dcg / (SELECT sum(1 / log2(r + 1))
           FROM (SELECT unnest(range(1, least(n_rel, 20) + 1)) AS r)) AS ndcg, coalesce(entropy, 0) AS entropy
         FROM users_val u
         JOIN (SELECT customer_id AS user_id, count(DISTINCT article_id) AS n_rel FROM val GROUP BY 1) USING (user_id)
         JOIN (SELECT u.user_id, count(v.article_id) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (v.article_id IS NOT NULL), 0) AS dcg
           FROM users_val u LEFT JOIN {recs} r ON r.user_id = u.user_id
           LEFT JOIN (SELECT DISTINCT customer_id AS user_id, article_id FROM val) v ON v.user_id = r.user_id
             AND v.article_id = r.article_id GROUP BY 1) USING (user_id)
         LEFT JOIN (SELECT user_id, -sum(p * log2(p)) AS entropy FROM (SELECT user_id,
             count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM {recs} JOIN articles USING (article_id)
             GROUP BY user_id, category_l1) GROUP BY 1) USING (user_id)"""


def _metrics_sql(name: str, recs: str) -> str:
    return f"""SELECT '{name}' AS model, round(avg(recall), 6) AS recall, round(avg("precision"), 6) AS "precision",
         round(avg(ndcg), 6) AS ndcg, round((SELECT count(DISTINCT article_id) FROM {recs} SEMI JOIN users_val USING (user_id))
           / (SELECT count(*) FROM articles), 6) AS catalog_coverage,
         round(avg(entropy), 6) AS mean_category_entropy FROM ({_scores_sql(recs)})"""


@query(
    "P1_per_user_metrics",
    f"""SELECT user_id, round(recall, 6) AS recall, round("precision", 6) AS "precision", round(ndcg, 6) AS ndcg,
          round(entropy, 6) AS entropy FROM ({_scores_sql("covisit_recs")})""",
    "covisit_recs users_val val articles",
)
def p1(spark, sf):
    train, val = split(spark, sf)
    found = evaluation.per_user(k1(spark, sf), train, val, T.articles(spark, sf))
    return found.select("user_id", *[F.round(c, 6).alias(c) for c in found.columns if c != "user_id"])


@query("P2_averages_and_coverage", _metrics_sql("covisitation", "covisit_recs"), "covisit_recs users_val val articles")
def p2(spark, sf):
    train, val = split(spark, sf)
    found = evaluation.evaluate(k1(spark, sf), train, val, T.articles(spark, sf))
    return found.select(F.lit("covisitation").alias("model"), "*")


@query(
    "P3_model_comparison",
    " UNION ALL ".join(_metrics_sql(name, recs) for name, recs in MODELS.items()),
    "covisit_recs vector_recs intent_recs popular_recs users_val val articles",
)
def p3(spark, sf):
    train, val = split(spark, sf)
    newest_rows(spark, sf)
    models = dict(zip(MODELS, (k1(spark, sf), k2(spark, sf), k3(spark, sf), popular_recommend(spark, sf))))
    return evaluation.compare(models, train, val, T.articles(spark, sf))


@query("P3_intent_kinds")
def p3_intents(spark, sf):
    """The same recommender over both kinds of session intents, on the same split."""
    train, val = split(spark, sf)
    models = {"category_intents": k3(spark, sf), "clustered_intents": k3_clustered(spark, sf)}
    return evaluation.compare(models, train, val, T.articles(spark, sf))


@query(
    "G2_recommended_items",
    "SELECT count(DISTINCT article_id) AS recommended FROM (SELECT article_id FROM covisit_recs UNION SELECT article_id FROM vector_recs)",
    "covisit_recs vector_recs",
)
def g2(spark, sf):
    shown = k1(spark, sf).select("article_id").union(k2(spark, sf).select("article_id")).distinct()
    return shown.agg(F.count(F.lit(1)).alias("recommended"))


FEATURES_SQL = """SELECT c.list_id, c.article_id, c.category_l1,
         round(coalesce(list_dot_product(u.user_vector, v.vector), 0), 6) AS two_tower_dot,
         round(coalesce((SELECT sum(weight * list_dot_product(i.vector, v.vector)) FROM intents i WHERE i.list_id = c.list_id), 0), 6)
           AS intent_dot,
         round(c.popularity, 6) AS item_popularity, round(c.ctr, 6) AS item_ctr,
         round(CASE WHEN count(*) OVER g = 1 THEN 0.5 ELSE percent_rank() OVER (g ORDER BY c.avg_price) END, 6)
           AS price_percentile_in_category,
         coalesce(s.matches, 0)::DOUBLE AS category_match_count,
         round(coalesce((epoch_us(w.now_ts) - epoch_us(s.last_ts)) / 60e6::DOUBLE, -1), 6) AS recency_same_category_minutes,
         coalesce(w.n, 0)::DOUBLE AS session_length, (c.days_since_first_seen < 14)::INTEGER::DOUBLE AS is_new_item,
         c.days_since_first_seen
       FROM (SELECT r.list_id, r.article_id, coalesce(m.category_l1, 'unknown') AS category_l1, coalesce(m.popularity, 0) AS popularity,
           coalesce(m.ctr, 0) AS ctr, coalesce(m.avg_price, 0) AS avg_price,
           coalesce(m.days_since_first_seen, 9999.0::DOUBLE) AS days_since_first_seen
         FROM routed r LEFT JOIN meta m ON m.article_id = r.article_id) c JOIN vectors v ON v.article_id = c.article_id
       LEFT JOIN user_vec u ON u.list_id = c.list_id
       LEFT JOIN (SELECT list_id, coalesce(category_l1, 'unknown') AS category_l1, count(*) AS matches, max(ts) AS last_ts
         FROM events20 GROUP BY 1, 2) s ON s.list_id = c.list_id AND s.category_l1 = c.category_l1
       LEFT JOIN (SELECT list_id, count(*) AS n, max(ts) AS now_ts FROM events20 GROUP BY 1) w ON w.list_id = c.list_id
       WINDOW g AS (PARTITION BY c.list_id, c.category_l1)"""
view(
    "user_vec",
    ("events20", "vectors"),
    f"""SELECT list_id, {UNIT} AS user_vector FROM (SELECT list_id, list(x ORDER BY pos) AS m FROM (
         SELECT list_id, pos, avg(vector[pos]) AS x FROM (SELECT list_id, vector, unnest(range(1, 65)) AS pos
           FROM events20 JOIN vectors USING (article_id)) GROUP BY 1, 2) GROUP BY 1)""",
)


@query("L1_ranking_features", FEATURES_SQL, "routed meta vectors intents events20 user_vec")
def l1(spark, sf):
    rows, cat = sessions(spark, sf), catalogue_of(spark, sf)
    asked, members = surfaces.by_segment(contexts(spark, sf), rows.select("list_id").distinct())
    heads = durable(intents.infer_intents(asked, rows, cat.vectors, DIM))
    seen = rows.select("list_id", "article_id").distinct()
    found = candidates.feed_candidates(asked, heads, cat.vectors, seen, popular_items(spark, sf))
    made = durable(build_features(
        found.select("list_id", "article_id"), cat.meta, cat.vectors, surfaces.user_vectors(rows, cat.vectors), heads, rows
    ))
    made = surfaces.handed_to(members, made)
    exact = ("list_id", "article_id", "category_l1")
    return made.select(*[F.col(c) if c in exact else F.round(c, 6).alias(c) for c in made.columns])
