"""Histories, training examples, vector arithmetic and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.functions import vectors as V
from basketry.operators import candidates, covisit, intents, lists, retrieval, sequences
from basketry.operators.features import price_percentile
from basketry.operators.skew import newest
from basketry.plans.registry import query, shared, view
from basketry.plans.sources_and_scalars import newest_purchases, purchases, split
from basketry.plans.surfaces import parse_queries
from basketry.session import durable
from basketry.sources import tables as T

ORDER = "t_dat, order_id, line_no, article_id, paid, quantity"
NEWEST = "t_dat DESC, order_id DESC, line_no DESC, article_id DESC, paid DESC, quantity DESC"
GAP = 12 * 3600  # the test events are sparse: half a day of idle time ends a session

view("numbered", ("tx",), f"SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY {ORDER}) AS seq FROM tx")
view(
    "last20",
    ("train",),
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY {NEWEST}) AS age FROM train)
        WHERE age <= 20""",
)
view(
    "examples",
    ("tx",),
    f"""SELECT * FROM (SELECT customer_id, article_id AS target, t_dat, price,
          row_number() OVER w AS seq, list(article_id) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS history
        FROM tx WINDOW w AS (PARTITION BY customer_id ORDER BY {ORDER})) WHERE seq > 1""",
)
view(
    "pooled",
    ("last20", "vectors"),
    """SELECT customer_id, list_transform(m, lambda x: CASE WHEN list_dot_product(m, m) > 0
         THEN x / sqrt(list_dot_product(m, m)) ELSE 0 END) AS user_vector
       FROM (SELECT customer_id, list(x ORDER BY pos) AS m FROM (SELECT customer_id, pos, avg(vector[pos]) AS x
         FROM (SELECT customer_id, vector, unnest(range(1, 65)) AS pos FROM last20 JOIN vectors USING (article_id))
         GROUP BY 1, 2) GROUP BY 1)""",
)
view(
    "sess",
    ("clicks",),
    """SELECT * FROM (SELECT *, sum(CASE WHEN newer - micros > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
         ORDER BY age) AS gaps FROM (SELECT *, epoch_us(ts) AS micros, row_number() OVER w AS age, lag(epoch_us(ts)) OVER w AS newer
           FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))) WHERE gaps = 0 AND age <= 20""",
)


def tail_sessions(spark, sf):
    """The newest 20 events of each user's current session."""
    return intents.current_sessions(T.clicks(spark, sf), GAP)


@query(
    "E1_ordered_history",
    "SELECT customer_id, seq::INTEGER AS seq, article_id, t_dat, price FROM numbered",
    "numbered",
)
def e1(spark, sf):
    return sequences.numbered(purchases(spark, sf)).select("customer_id", "seq", "article_id", "t_dat", "price")


@query(
    "E2_last_20_history",
    "SELECT customer_id, string_agg(article_id::VARCHAR, ',' ORDER BY age DESC) AS history FROM last20 GROUP BY 1",
    "last20",
)
def e2(spark, sf):
    train, _ = split(spark, sf)
    found = sequences.last_history(train)
    return found.select("customer_id", F.concat_ws(",", F.col("history").cast("array<string>")).alias("history"))


def _ids(column):
    return F.concat_ws(",", F.col(column).cast("array<string>"))


@query(
    "E3_training_examples",
    """SELECT customer_id, seq::INTEGER AS seq, array_to_string(history, ',') AS history, target, t_dat FROM examples""",
    "examples",
)
def e3(spark, sf):
    found = sequences.training_examples(purchases(spark, sf))
    return found.select("customer_id", "seq", _ids("history").alias("history"), "target", "t_dat")


@query(
    "E4_validation_examples",
    """SELECT v.customer_id, h.history, v.article_id AS target, v.t_dat FROM val v JOIN (SELECT customer_id,
         string_agg(article_id::VARCHAR, ',' ORDER BY age DESC) AS history FROM last20 GROUP BY 1) h USING (customer_id)
       SEMI JOIN vectors x ON x.article_id = v.article_id""",
    "val last20 vectors",
)
def e4(spark, sf):
    train, val = split(spark, sf)
    found = sequences.validation_examples(train, val, known=T.vectors(spark, sf).select("article_id"))
    return found.select("customer_id", _ids("history").alias("history"), "target", "t_dat")


@query(
    "E5_pad_and_mask",
    """SELECT customer_id, seq::INTEGER AS seq, array_to_string(list_concat(history[-8:], list_resize([]::BIGINT[],
         greatest(0, 8 - len(history)), -1::BIGINT)), ',') AS padded, least(len(history), 8)::INTEGER AS used FROM examples""",
    "examples",
)
def e5(spark, sf):
    found = sequences.training_examples(purchases(spark, sf))
    filled = sequences.padded(F.col("history"), 8, F.lit(-1).cast("bigint"))
    used = F.aggregate(sequences.mask(F.col("history"), 8), F.lit(0.0), lambda a, x: a + x)
    rows = found.withColumn("padded", filled).withColumn("used", used.cast("int"))
    return rows.select("customer_id", "seq", _ids("padded").alias("padded"), "used")


@query(
    "E6_event_gaps",
    """SELECT user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))
         / 60e6::DOUBLE AS gap_minutes FROM clicks""",
    "clicks",
)
def e6(spark, sf):
    return intents.event_gaps(T.clicks(spark, sf)).select("user_id", "event_id", "gap_minutes")


@query(
    "E7_price_percentile",
    """SELECT customer_id, order_id, line_no, article_id, category_l1, price, round(CASE WHEN count(*) OVER g = 1 THEN 0.5
         ELSE percent_rank() OVER (g ORDER BY price) END, 6) AS price_percentile
       FROM tx JOIN articles USING (article_id) WINDOW g AS (PARTITION BY category_l1)""",
    "tx articles",
)
def e7(spark, sf):
    kinds = T.articles(spark, sf).select("article_id", "category_l1")
    rows = shared("priced", sf, lambda: T.transactions(spark, sf).join(kinds, "article_id"))
    found = price_percentile(rows, ["category_l1"])
    cols = ["customer_id", "order_id", "line_no", "article_id", "category_l1", "price"]
    return found.select(*cols, F.round("price_percentile", 6).alias("price_percentile"))


@query(
    "E8_top_k_per_key",
    """SELECT category_l1, article_id, n_interactions, rk::INTEGER AS rk FROM (SELECT *, row_number() OVER (PARTITION BY
         category_l1 ORDER BY n_interactions DESC, article_id) AS rk FROM items WHERE n_interactions IS NOT NULL) WHERE rk <= 50""",
    "items",
)
def e8(spark, sf):
    sold = T.items(spark, sf).filter(F.col("n_interactions").isNotNull())
    best = newest(sold, ["category_l1"], [F.desc("n_interactions"), F.asc("article_id")], 50, "rk")
    return best.select("category_l1", "article_id", "n_interactions", "rk")


@query(
    "E9_list_position",
    """SELECT category_l1, article_id, (rk - 1)::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY
         category_l1 ORDER BY n_interactions DESC, article_id) AS rk FROM items WHERE n_interactions IS NOT NULL) WHERE rk <= 50""",
    "items",
)
def e9(spark, sf):
    return covisit.list_position(e8(spark, sf), ["category_l1"], [F.asc("rk")]).select("category_l1", "article_id", "position")


view(
    "parsed",
    ("search_q", "articles"),
    """SELECT q.query, m.category_l1 FROM search_q q LEFT JOIN (SELECT query, min(category_l1) AS category_l1
         FROM (SELECT query, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS tok FROM search_q) t
         JOIN (SELECT DISTINCT category_l1 FROM articles) c
           ON len(tok) > 2 AND (contains(lower(category_l1), tok) OR contains(tok, lower(category_l1)))
         GROUP BY 1) m USING (query)""",
)


@query("C8_token_category_match", "SELECT query, category_l1 FROM parsed WHERE category_l1 IS NOT NULL", "parsed")
def c8(spark, sf):
    found = parse_queries(T.search_queries(spark, sf), T.articles(spark, sf))
    return found.filter(F.col("category_l1").isNotNull()).select("query", "category_l1")


@query("H6_query_intent_parse", "SELECT query, coalesce(category_l1, '') AS category_l1 FROM parsed", "parsed")
def h6(spark, sf):
    found = parse_queries(T.search_queries(spark, sf), T.articles(spark, sf))
    return found.select("query", F.coalesce("category_l1", F.lit("")).alias("category_l1"))


@query(
    "H7_category_entropy",
    """SELECT customer_id, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT customer_id,
         count(*) / (sum(count(*)) OVER (PARTITION BY customer_id)) AS p FROM tx JOIN articles USING (article_id)
         GROUP BY customer_id, category_l1) GROUP BY 1""",
    "tx articles",
)
def h7(spark, sf):
    kinds = T.articles(spark, sf).select("article_id", "category_l1")
    counts = T.transactions(spark, sf).join(kinds, "article_id").groupBy("customer_id", "category_l1")
    counts = counts.agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("customer_id").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return counts.join(totals, "customer_id").groupBy("customer_id").agg(F.round(F.sum(C.entropy_term(share)), 6).alias("entropy"))


@query(
    "H8_dcg_terms",
    """SELECT customer_id, n, round((SELECT sum(1 / log2(r + 1)) FROM (SELECT unnest(range(1, least(n, 20) + 1)) AS r)), 6)
         AS ideal FROM (SELECT customer_id, count(DISTINCT article_id) AS n FROM val GROUP BY 1)""",
    "val",
)
def h8(spark, sf):
    _, val = split(spark, sf)
    sizes = val.groupBy("customer_id").agg(F.count_distinct("article_id").alias("n"))
    return sizes.select("customer_id", "n", F.round(C.ideal_dcg(F.col("n"), 20), 6).alias("ideal"))


@query(
    "H9_price_variation",
    "SELECT user_id, round(stddev_pop(price) / (avg(price) + 1e-6::DOUBLE), 6) AS variation FROM clicks GROUP BY 1",
    "clicks",
)
def h9(spark, sf):
    variation = F.stddev_pop("price") / (F.avg("price") + F.lit(1e-6))
    return T.clicks(spark, sf).groupBy("user_id").agg(F.round(variation, 6).alias("variation"))


def _query_vectors(spark, sf):
    return candidates.pooled_vectors(newest_purchases(spark, sf), T.vectors(spark, sf))


@query(
    "I1_dot_product",
    """SELECT customer_id, t.article_id, order_id, line_no, round(list_dot_product(user_vector, vector), 6) AS score
       FROM last20 t JOIN pooled USING (customer_id) JOIN vectors v ON v.article_id = t.article_id""",
    "last20 pooled vectors",
)
def i1(spark, sf):
    train, _ = split(spark, sf)
    rows = sequences.last_rows(train).join(T.vectors(spark, sf), "article_id").join(_query_vectors(spark, sf), "customer_id")
    score = F.round(V.dot(F.col("user_vector"), F.col("vector")), 6)
    return rows.select("customer_id", "article_id", "order_id", "line_no", score.alias("score"))


@query(
    "I2_cosine",
    """SELECT article_id, round(coalesce(list_cosine_similarity(vector, centroid), 0), 6) AS cosine
       FROM articles LEFT JOIN vectors USING (article_id) LEFT JOIN centroids USING (category_l1)""",
    "articles vectors centroids",
)
def i2(spark, sf):
    from basketry.operators.items import category_centroids

    # Items without a vector give 0.
    stock, vecs = T.articles(spark, sf), T.vectors(spark, sf)
    rows = stock.join(vecs, "article_id", "left").join(category_centroids(stock, vecs), "category_l1", "left")
    return rows.select("article_id", F.round(V.cosine(F.col("vector"), F.col("centroid")), 6).alias("cosine"))


@query(
    "I3_normalise",
    """SELECT category_l1, pos::INTEGER AS pos, round(centroid[pos + 1] / sqrt(list_dot_product(centroid, centroid)), 6) AS x
       FROM (SELECT *, unnest(range(0, 64)) AS pos FROM centroids)""",
    "centroids",
)
def i3(spark, sf):
    from basketry.operators.items import category_centroids

    found = category_centroids(T.articles(spark, sf), T.vectors(spark, sf))
    rows = found.select("category_l1", F.posexplode(V.unit(F.col("centroid"))).alias("pos", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query(
    "I4_masked_mean_pool",
    """SELECT customer_id, pos::INTEGER AS pos, round(coalesce(user_vector[pos + 1], 0), 6) AS x
       FROM (SELECT customer_id, unnest(range(0, 64)) AS pos FROM users) LEFT JOIN pooled USING (customer_id)""",
    "users pooled",
)
def i4(spark, sf):
    # Customers without a mapped purchase keep the zero vector.
    everyone = T.users(spark, sf).select("customer_id").join(_query_vectors(spark, sf), "customer_id", "left")
    filled = F.coalesce("user_vector", V.zeros(64))
    return everyone.select("customer_id", F.posexplode(filled).alias("pos", "x")).withColumn("x", F.round("x", 6))


view(
    "per_customer",
    ("last20", "vectors", "pooled"),
    """SELECT p.customer_id, v.article_id, round(list_dot_product(p.user_vector, v.vector), 9) AS score
       FROM pooled p, vectors v WHERE NOT EXISTS (SELECT 1 FROM last20 l
         WHERE l.customer_id = p.customer_id AND l.article_id = v.article_id)""",
)


def _searched(spark, sf, k=20):
    queries = _query_vectors(spark, sf).select(F.col("customer_id").alias("query_id"), F.col("user_vector").alias("vector"))
    seen = newest_purchases(spark, sf).withColumnRenamed("customer_id", "query_id")
    return durable(queries), T.vectors(spark, sf), seen


@query(
    "I7_vector_top_k",
    """SELECT customer_id AS query_id, article_id, score, rank FROM (SELECT *, row_number() OVER (
         PARTITION BY customer_id ORDER BY score DESC, article_id)::INTEGER AS rank FROM per_customer) WHERE rank <= 20""",
    "per_customer",
)
def i7(spark, sf):
    queries, stock, seen = _searched(spark, sf)
    return retrieval.top_k(queries, stock, 20, seen)


def _cells_sql(rows: str, key: str, vector: str) -> str:
    """The cell of each row in each table: the signs of its products with the planes, as many as the bits in use."""
    sides = retrieval.planes(64)
    tables = []
    for t, table in enumerate(sides):
        signs = " + ".join(
            f"(list_dot_product([{','.join(f'{x:.6f}' for x in plane)}]::DOUBLE[64]::DOUBLE[], {vector}) > 0 AND bits > {b})::BIGINT * {1 << b}"
            for b, plane in enumerate(table)
        )
        tables.append(f"SELECT {key}, bits, {t << retrieval.MAX_BITS} AS base, {signs} AS home FROM {rows}, hash_bits")
    return " UNION ALL ".join(tables)


view(
    "hash_bits",
    ("vectors",),
    f"""SELECT greatest(1, least({retrieval.MAX_BITS}, ceil(log2(count(*) / {retrieval.ROWS_PER_CELL}::DOUBLE))))::INTEGER AS bits
        FROM vectors""",
)
view("item_cells", ("vectors", "hash_bits"), _cells_sql("vectors", "article_id", "vector"))
view("query_cells", ("pooled", "hash_bits"), _cells_sql("pooled", "customer_id", "user_vector"))
view(
    "looks",
    ("query_cells",),
    """SELECT customer_id, base + home AS cell FROM query_cells UNION ALL
       SELECT customer_id, base + xor(home, (1 << b)::BIGINT) FROM query_cells, (SELECT unnest(range(16))::INTEGER AS b) WHERE b < bits""",
)
view(
    "hashed",
    ("looks", "item_cells", "per_customer"),
    """SELECT customer_id AS query_id, article_id, score, rank FROM (SELECT *, row_number() OVER (
         PARTITION BY customer_id ORDER BY score DESC, article_id)::INTEGER AS rank FROM per_customer
         SEMI JOIN (SELECT DISTINCT customer_id, article_id FROM looks l JOIN item_cells i ON l.cell = i.base + i.home) m
           USING (customer_id, article_id)) WHERE rank <= 20""",
)


@query("I8_hashed_top_k", "SELECT * FROM hashed", "hashed")
def i8(spark, sf):
    queries, stock, seen = _searched(spark, sf)
    return retrieval.top_k_hashed(queries, stock, 20, 64, seen)


@query(
    "I8_hashed_recall",
    """SELECT expected, found, round(found / expected, 6) AS recall, round(pairs / (q * i), 6) AS share_compared FROM
         (SELECT count(*) AS expected, count(h.article_id) AS found FROM (SELECT customer_id AS query_id, article_id FROM (
            SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS rank FROM per_customer)
            WHERE rank <= 20) t LEFT JOIN hashed h USING (query_id, article_id)),
         (SELECT count(*) AS pairs FROM looks l JOIN item_cells c ON l.cell = c.base + c.home),
         (SELECT count(*) AS q FROM pooled), (SELECT count(*) AS i FROM vectors)""",
    "hashed per_customer looks item_cells pooled vectors",
)
def i8_recall(spark, sf):
    queries, stock, seen = _searched(spark, sf)
    truth = retrieval.top_k(queries, stock, 20, seen)
    found = retrieval.recall_against(retrieval.top_k_hashed(queries, stock, 20, 64, seen), truth)
    share = retrieval.compared_share(queries, stock, 64).select("share_compared").scalar()
    return found.select("expected", "found", F.round("recall", 6).alias("recall"), F.round(share, 6).alias("share_compared"))


# The lists follow from k-means, which SQL cannot repeat; tests hold the search against the exact one.
@query("I8_listed_top_k")
def i8_listed(spark, sf):
    queries, stock, seen = _searched(spark, sf)
    return retrieval.top_k_listed(queries, stock, 20, seen)


@query("I8_listed_recall")
def i8_listed_recall(spark, sf):
    queries, stock, seen = _searched(spark, sf)
    held = lists.build(stock, lists.lists_for(stock.count()))
    probes = retrieval.probes_of(queries, held, 20)
    truth = retrieval.top_k(queries, stock, 20, seen)
    found = retrieval.recall_against(retrieval.top_k_listed(queries, stock, 20, seen, held=held, probes=probes), truth)
    share = retrieval.listed_share(queries, held, probes).scalar()
    return found.withColumns({"share_compared": share, "lists": F.lit(len(held.centres)), "probes": F.lit(probes)})


@query(
    "I9_seed_neighbours",
    """SELECT query_id, article_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
         ORDER BY score DESC, article_id)::INTEGER AS rank FROM (SELECT a.article_id AS query_id, b.article_id,
           round(list_dot_product(a.vector, b.vector), 9) AS score FROM vectors a JOIN vectors b ON a.article_id <> b.article_id))
       WHERE rank <= 50""",
    "vectors",
)
def i9(spark, sf):
    vecs = T.vectors(spark, sf)
    queries = vecs.select(F.col("article_id").alias("query_id"), "vector")
    itself = vecs.select(F.col("article_id").alias("query_id"), "article_id")
    return retrieval.top_k(queries, vecs, 50, itself)
