"""Training sets, rankers, embeddings and the event streams."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketry.functions.columns import UNKNOWN
from basketry.operators import items as I
from basketry.operators import boosting, candidates, covisit, evaluation, factors, guardrails, intents, learning, retrieval, sampling, sequences, vocab
from basketry.operators.features import FEATURE_NAMES, build_features
from basketry.plans import surfaces
from basketry.plans.lists_and_people import capped_sql, feed_of
from basketry.plans.recommenders import DIM, UNIT, catalogue_of, contexts, sessions
from basketry.plans.registry import VIEWS, query, remembered, shared, view
from basketry.plans.sequences_and_vectors import GAP
from basketry.plans.sources_and_scalars import SPEC, first_val_day, newest_purchases, purchases, split
from basketry.session import durable, scratch_path
from basketry.sources import tables as T
from basketry.streaming import events as S

# ---- training set ---------------------------------------------------------------------------------------------------

ORDER = "t_dat, order_id, line_no, article_id, paid, quantity"


def draw(prefix: str, *parts: str) -> str:
    key = " || '|' || ".join([f"'{prefix}'", *parts])
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


view(
    "ex",
    ("train",),
    f"""SELECT * FROM (SELECT customer_id || '-' || row_number() OVER w AS example_id, customer_id, article_id AS target, t_dat,
          row_number() OVER w AS seq, list({{'article_id': article_id, 't_dat': t_dat, 'price': price}}) OVER
            (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS events
        FROM train WINDOW w AS (PARTITION BY customer_id ORDER BY {ORDER})) WHERE seq > 1""",
)
view("ex8", ("ex",), "SELECT * FROM ex ORDER BY md5('0|' || example_id), example_id LIMIT 8000")


def negatives_sql(examples: str) -> str:
    return f"""SELECT example_id, article_id, row_number() OVER (PARTITION BY example_id ORDER BY first_i)::INTEGER AS draw
        FROM (SELECT d.example_id, p.article_id, min(i) AS first_i FROM (
            SELECT example_id, target, events, i, floor({draw("neg0", "example_id", "i")} * (SELECT count(*) FROM articles))::BIGINT AS position
            FROM {examples}, (SELECT unnest(range(80)) AS i)) d
          JOIN (SELECT article_id, row_number() OVER (ORDER BY article_id) - 1 AS position FROM articles) p USING (position)
          WHERE p.article_id <> d.target AND NOT list_contains(list_transform(d.events, lambda e: e.article_id), p.article_id)
          GROUP BY 1, 2) QUALIFY draw <= 4"""


view("neg", ("ex", "articles"), negatives_sql("ex"))
view("neg8", ("ex8", "articles"), negatives_sql("ex8"))
LABELS_SQL = f"""SELECT *, (is_target OR in_session)::INTEGER AS click,
         (is_target AND {draw("cart0", "example_id", "article_id")} < 0.4)::INTEGER AS cart, is_target::INTEGER AS purchase,
         (is_target AND {draw("wishlist0", "example_id", "article_id")} < 0.2)::INTEGER AS wishlist FROM {{rows}}"""
view(
    "rows8",
    ("ex8", "neg8"),
    """SELECT example_id, target AS article_id, true AS is_target FROM ex8
       UNION ALL SELECT example_id, article_id, false FROM neg8""",
)
view("hist8", ("ex8", "articles"), """SELECT example_id, e.article_id, e.t_dat, coalesce(category_l1, 'unknown') AS category_l1
       FROM (SELECT example_id, unnest(events) AS e FROM ex8) h LEFT JOIN articles a ON a.article_id = h.e.article_id""")
view(
    "lab8",
    ("rows8", "hist8", "articles"),
    LABELS_SQL.format(
        rows="""(SELECT r.*, a.category_l1, EXISTS (SELECT 1 FROM hist8 h WHERE h.example_id = r.example_id
           AND h.category_l1 = a.category_l1) AS in_session FROM rows8 r JOIN articles a USING (article_id))"""
    ),
)


for _all, _few in (("rows_all", "rows8"), ("hist_all", "hist8"), ("lab_all", "lab8")):
    _needs, _body = VIEWS[_few]
    _wide = {"ex8": "ex", "neg8": "neg", "rows8": "rows_all", "hist8": "hist_all"}
    for _a, _b in _wide.items():
        _body = re.sub(rf"\b{_a}\b", _b, _body)
    view(_all, tuple(_wide.get(n, n) for n in _needs), _body)


def pool(spark, sf):
    return shared("pool", sf, lambda: vocab.dense_index(T.articles(spark, sf), "article_id"))


def coded_pool(spark, sf):
    """(pool with `codes`, a number for the category of each time that an article is listed; the number of 'unknown')."""
    listed = T.articles(spark, sf).select("article_id", F.coalesce("category_l1", F.lit(UNKNOWN)).alias("category_l1"))
    names = listed.select("category_l1").unionByName(spark.range(1).select(F.lit(UNKNOWN).alias("category_l1")))
    numbers = vocab.vocabulary(names, "category_l1").select(F.col("value").alias("category_l1"), F.col("code").cast("int").alias("code"))
    numbers = durable(numbers)
    codes = listed.join(numbers, "category_l1").groupBy("article_id").agg(F.collect_list("code").alias("codes"))
    unknown = numbers.filter(F.col("category_l1") == UNKNOWN).first()["code"]
    return shared("coded pool", sf, lambda: pool(spark, sf).join(codes, "article_id", "left")), unknown


def placed_split(spark, sf):
    """Train and validation purchases with the pool position of their article."""
    tx = shared("placed", sf, lambda: learning.with_positions(purchases(spark, sf), pool(spark, sf)))
    start = first_val_day(spark, sf, SPEC.val_days)
    return tx.filter(F.col("t_dat") < start), tx.filter(F.col("t_dat") >= start)


def drawing(examples):
    return examples.select("example_id", learning.taken(F.col("events"), F.col("position")).alias("taken"))


@query("J2_negative_sampling", "SELECT example_id, draw, article_id FROM neg", "neg")
def j2(spark, sf):
    train, _ = placed_split(spark, sf)
    examples = sequences.detailed_examples(train, detail=("position",))
    return learning.negatives(drawing(examples), pool(spark, sf))


def sampled_train(spark, sf, most=learning.MAX_TRAIN_EXAMPLES):
    """At most `most` training examples: the bound on what the rankers are fitted on."""
    train, _ = split(spark, sf)
    return shared(f"train examples {most}", sf, lambda: sequences.chosen_examples(train, most, detailed=placed(spark, sf)))


def sampled_val(spark, sf, most=learning.MAX_VAL_EXAMPLES):
    train, val = split(spark, sf)
    return shared(f"val examples {most}", sf, lambda: sequences.chosen_validation(train, val, most, detailed=placed(spark, sf)))


def placed(spark, sf):
    """Adds the pool position of each purchase's article."""
    return lambda tx: learning.with_positions(tx, pool(spark, sf))


def example_sessions(examples, meta):
    rows = examples.select("example_id", F.explode("events").alias("e")).select(
        F.col("example_id").alias("list_id"), "e.article_id", "e.t_dat", "e.price"
    )
    return intents.session_rows(rows, meta)


def labelled(spark, sf, examples, meta):
    """Target and negatives of each example with their weak labels."""
    drawn = learning.negatives(drawing(examples), pool(spark, sf))
    rows = learning.candidate_rows(examples, drawn).join(meta.select("article_id", "category_l1"), "article_id")
    kinds = example_sessions(examples, meta).select(F.col("list_id").alias("example_id"), "category_l1").distinct()
    marked = rows.join(kinds.withColumn("_known", F.lit(True)), ["example_id", "category_l1"], "left")
    return learning.weak_labels(marked, F.col("_known").isNotNull()).drop("_known")


def dataset(spark, sf, examples):
    """Features and labels of every candidate of every example; candidates without a vector are left out."""
    train, _ = split(spark, sf)
    vecs = T.vectors(spark, sf)
    meta = shared("item meta", sf, lambda: I.item_meta(T.items(spark, sf), train))
    rows = durable(labelled(spark, sf, examples, meta).withColumnRenamed("example_id", "list_id").drop("category_l1"))
    session = durable(example_sessions(examples, meta))
    heads = durable(intents.infer_intents(examples.select(F.col("example_id").alias("list_id")), session, vecs, DIM))
    days = examples.select(F.col("example_id").alias("list_id"), "t_dat")
    aged = rows.select("list_id", "article_id").join(days, "list_id").join(meta, "article_id")
    aged = I.days_since_first_seen(aged, F.col("t_dat")).drop("t_dat", "first_seen")
    keep = ("is_target", *learning.OBJECTIVES)
    return build_features(rows, aged, vecs, surfaces.user_vectors(session, vecs), heads, session, keep)


@query(
    "J3_weak_labels",
    """SELECT example_id, article_id, is_target, click, cart, purchase, wishlist FROM lab_all""",
    "lab_all",
)
def j3(spark, sf):
    kinds, unknown = coded_pool(spark, sf)
    train, _ = split(spark, sf)
    placed = train.join(kinds, "article_id", "left")
    every = sequences.detailed_examples(placed, detail=("position", "codes"))
    held = F.transform("events", lambda e: F.coalesce(e["codes"], F.array(F.lit(unknown))))
    examples = every.select(
        "example_id", "position", learning.taken(F.col("events"), F.col("position")).alias("taken"), F.array_distinct(F.flatten(held)).alias("kinds")
    )
    return learning.labelled_candidates(examples, kinds).select("example_id", "article_id", "is_target", *learning.OBJECTIVES)


view(
    "heads8",
    ("hist8", "vectors"),
    f"""SELECT example_id, vector, n / sum(n) OVER (PARTITION BY example_id) AS weight FROM (
          SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY n DESC, category_l1) AS r FROM (
            SELECT example_id, category_l1, n, {UNIT} AS vector FROM (
              SELECT example_id, category_l1, any_value(n) AS n, list(x ORDER BY pos) AS m FROM (
                SELECT example_id, category_l1, pos, avg(vector[pos]) AS x, count(*) AS n FROM (
                  SELECT example_id, category_l1, vector, unnest(range(1, 65)) AS pos FROM hist8 JOIN vectors USING (article_id))
                GROUP BY 1, 2, 3) GROUP BY 1, 2))) WHERE r <= 4""",
)
view(
    "user8",
    ("hist8", "vectors"),
    f"""SELECT example_id, {UNIT} AS user_vector FROM (SELECT example_id, list(x ORDER BY pos) AS m FROM (
          SELECT example_id, pos, avg(vector[pos]) AS x FROM (SELECT example_id, vector, unnest(range(1, 65)) AS pos
            FROM hist8 JOIN vectors USING (article_id)) GROUP BY 1, 2) GROUP BY 1)""",
)
view(
    "meta_train",
    ("items", "train"),
    """SELECT i.article_id, i.category_l1, coalesce(n_interactions, 0) / (SELECT max(n_interactions) FROM items) AS popularity,
         coalesce(n_interactions, 0) / (coalesce(n_interactions, 0) + 20.0::DOUBLE) AS ctr,
         coalesce(s.first_seen, DATE '1970-01-01') AS first_seen, coalesce(s.avg_price, 0) AS avg_price
       FROM items i LEFT JOIN (SELECT article_id, min(t_dat) AS first_seen, avg(price) AS avg_price FROM train GROUP BY 1) s
         USING (article_id)""",
)


@query(
    "J4_training_set",
    """SELECT c.example_id AS list_id, c.article_id, c.click, c.cart, c.purchase, c.wishlist,
         round(coalesce(list_dot_product(u.user_vector, v.vector), 0), 6) AS two_tower_dot,
         round(coalesce((SELECT sum(weight * list_dot_product(i.vector, v.vector)) FROM heads8 i WHERE i.example_id = c.example_id), 0), 6)
           AS intent_dot,
         round(m.popularity, 6) AS item_popularity, round(m.ctr, 6) AS item_ctr,
         round(CASE WHEN count(*) OVER g = 1 THEN 0.5 ELSE percent_rank() OVER (g ORDER BY m.avg_price) END, 6)
           AS price_percentile_in_category,
         coalesce(s.n, 0)::DOUBLE AS category_match_count,
         coalesce(((SELECT max(t_dat) FROM hist8 h WHERE h.example_id = c.example_id) - s.last_day) * 1440, -1)::DOUBLE
           AS recency_same_category_minutes,
         len(e.events)::DOUBLE AS session_length, (greatest(0, e.t_dat - m.first_seen) < 14)::INTEGER::DOUBLE AS is_new_item,
         greatest(0, e.t_dat - m.first_seen)::DOUBLE AS days_since_first_seen
       FROM lab8 c JOIN ex8 e USING (example_id) JOIN meta_train m ON m.article_id = c.article_id
       JOIN vectors v ON v.article_id = c.article_id LEFT JOIN user8 u ON u.example_id = c.example_id
       LEFT JOIN (SELECT example_id, category_l1, count(*) AS n, max(t_dat) AS last_day FROM hist8 GROUP BY 1, 2) s
         ON s.example_id = c.example_id AND s.category_l1 = m.category_l1
       WINDOW g AS (PARTITION BY c.example_id, m.category_l1)""",
    "lab8 ex8 meta_train vectors user8 hist8 heads8",
)
def j4(spark, sf):
    made = dataset(spark, sf, sampled_train(spark, sf)).drop("category_l1", "is_target")
    exact = ("list_id", "article_id", *learning.OBJECTIVES)
    return made.select(*[F.col(c) if c in exact else F.round(c, 6).alias(c) for c in made.columns])


# ---- rankers --------------------------------------------------------------------------------------------------------

def fitted(spark, sf):
    """The four fitted models and the validation rows, fitted once per run of a query."""

    def made():
        train = durable(dataset(spark, sf, sampled_train(spark, sf)))
        val = durable(dataset(spark, sf, sampled_val(spark, sf)))
        return learning.train_rankers(train, val), val

    return remembered("rankers", sf, made)


view(
    "val_ex",
    ("train", "val"),
    f"""SELECT * FROM (SELECT customer_id || '-v' || row_number() OVER (PARTITION BY customer_id ORDER BY {ORDER}) AS example_id,
          customer_id, article_id AS target, t_dat FROM val) SEMI JOIN train USING (customer_id)""",
)
view("val_ex2", ("val_ex",), "SELECT * FROM val_ex ORDER BY md5('0|' || example_id), example_id LIMIT 2000")


# Fitted trees are beyond SQL; tests/test_rankers.py holds the results of these two, and the queries after each what SQL can check.
@query("J5_boosted_rankers")
def j5(spark, sf):
    models, val = fitted(spark, sf)
    scored = learning.probabilities(models, val)
    return scored.select("list_id", "article_id", *[F.round(f"p_{o}", 6).alias(f"p_{o}") for o in learning.OBJECTIVES])


@query("J6_validation_auc")
def j6(spark, sf):
    return learning.auc(*fitted(spark, sf))


@query(
    "J5_target_probabilities",
    """SELECT example_id AS list_id, target AS article_id, true AS probable FROM val_ex2 SEMI JOIN vectors v ON v.article_id = target
       SEMI JOIN articles a ON a.article_id = target""",
    "val_ex2 vectors articles",
)
def j5_targets(spark, sf):
    models, val = fitted(spark, sf)
    scored = learning.probabilities(models, val).filter("is_target")
    probable = F.lit(True)
    for objective in learning.OBJECTIVES:
        probable = probable & F.col(f"p_{objective}").between(0.0, 1.0)
    return scored.select("list_id", "article_id", probable.alias("probable"))


AUC_SQL = """SELECT '{label}' AS objective, round((sum(r) FILTER ({label} = 1) - p * (p + 1) / 2) / (p * n), 6) AS auc FROM (
      SELECT {label}, avg(i) OVER (PARTITION BY item_popularity) AS r, sum({label}) OVER () AS p,
        count(*) OVER () - sum({label}) OVER () AS n
      FROM (SELECT {label}, popularity AS item_popularity, row_number() OVER (ORDER BY popularity) AS i
            FROM lab8 JOIN meta_train USING (article_id) SEMI JOIN vectors USING (article_id))) GROUP BY p, n"""


@query(
    "J6_given_score_auc",
    " UNION ALL ".join(AUC_SQL.format(label=label) for label in learning.OBJECTIVES),
    "lab8 meta_train vectors",
)
def j6_given(spark, sf):
    # The judge itself, on a score that SQL has too; J6_validation_auc runs it on the fitted models.
    rows = shared("training rows", sf, lambda: dataset(spark, sf, sampled_train(spark, sf)))
    found = learning.auc_of(rows, "item_popularity")
    return spark.createDataFrame([(o, round(a, 6)) for o, a in found.items()], "objective string, auc double")


@query(
    "J6_fitted_auc",
    "SELECT unnest(['click', 'cart', 'purchase', 'wishlist']) AS objective, true AS is_share, true AS has_trees",
)
def j6_fitted(spark, sf):
    models, val = fitted(spark, sf)
    found = learning.auc(models, val)
    return found.select("objective", F.col("auc").between(0, 1).alias("is_share"), (F.col("trees") >= 1).alias("has_trees"))


def leafwise(spark, sf):
    """Boosters grown leaf by leaf, on the same bounded examples as the other rankers, and the validation rows."""

    def made():
        train = durable(dataset(spark, sf, sampled_train(spark, sf)))
        val = durable(dataset(spark, sf, sampled_val(spark, sf)))
        both = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
        return boosting.train(both, FEATURE_NAMES, learning.OBJECTIVES), val

    return remembered("leafwise rankers", sf, made)


# Not registered: the fit takes minutes even on small tables. tests/test_boosting.py holds both against plain loops.
def j5_leafwise(spark, sf):
    models, val = leafwise(spark, sf)
    scored = boosting.probabilities(models, val, FEATURE_NAMES)
    return scored.select("list_id", "article_id", *[F.round(f"p_{o}", 6).alias(f"p_{o}") for o in learning.OBJECTIVES])


def j6_leafwise(spark, sf):
    models, val = leafwise(spark, sf)
    scored = durable(boosting.probabilities(models, val, FEATURE_NAMES))
    out = [(o, learning.auc_of(scored, f"p_{o}", (o,))[o], len(m.trees)) for o, m in models.items()]
    return spark.createDataFrame(out, "objective string, auc double, trees int")


@query(
    "J7_blended_score",
    "SELECT article_id, round(0.2::DOUBLE * ctr + 0.3::DOUBLE * popularity + 0.5::DOUBLE * (1 - ctr), 6) AS score FROM meta",
    "meta",
)
def j7(spark, sf):
    from basketry.plans.joins_and_reports import serving_meta

    meta = serving_meta(spark, sf)
    score = learning.blended(F.col("ctr"), F.col("popularity"), 1 - F.col("ctr"))
    return meta.select("article_id", F.round(score, 6).alias("score"))


@query(
    "J8_save_and_load",
    """SELECT count(*) AS targets, 0::BIGINT AS differing FROM val_ex2 SEMI JOIN vectors v ON v.article_id = target
       SEMI JOIN articles a ON a.article_id = target""",
    "val_ex2 vectors articles",
)
def j8(spark, sf):
    models, val = fitted(spark, sf)
    path = scratch_path(spark, "rankers")
    learning.save_rankers(models, path)
    key = ["list_id", "article_id", "is_target"]
    before = learning.probabilities(models, val).select(*key, F.col("p_purchase").alias("before"))
    after = learning.probabilities(learning.load_rankers(spark, path), val).select(*key, F.col("p_purchase").alias("after"))
    both = before.join(after, key, "full_outer")
    differing = F.count_if(~F.col("before").eqNullSafe(F.col("after")))
    return both.agg(F.count_if("is_target").alias("targets"), differing.alias("differing"))


def projected_sql(rows: str, token: str, weight: str) -> str:
    """Signed hashed components of each article's tokens, added up and scaled to length 1."""
    digest = f"md5(({token})::VARCHAR)"
    return f"""SELECT article_id, list_transform(m, lambda x: CASE WHEN list_dot_product(m, m) > 0 THEN x / sqrt(list_dot_product(m, m)) ELSE 0 END)
        AS vector FROM (SELECT article_id, list(x ORDER BY pos) AS m FROM (
          SELECT article_id, pos, coalesce(sum(x) FILTER (slot = pos), 0)::DOUBLE AS x FROM (
            SELECT article_id, ('0x' || substr({digest}, 1, 8))::BIGINT % 64 AS slot, {weight}
              * CASE WHEN ('0x' || substr({digest}, 9, 1))::INTEGER < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS x FROM {rows}),
            (SELECT unnest(range(0, 64)) AS pos) GROUP BY 1, 2) GROUP BY 1)"""


view(
    "near_counts",
    ("train",),
    """SELECT a.article_id, b.article_id AS neighbour, count(*)::DOUBLE AS cnt FROM train a JOIN train b
       ON a.customer_id = b.customer_id AND a.article_id <> b.article_id AND abs(a.t_dat - b.t_dat) <= 7 GROUP BY 1, 2""",
)
view("collab", ("near_counts",), projected_sql("near_counts", "neighbour", "cnt"))
view(
    "item_tokens",
    ("articles",),
    """SELECT article_id, token, ln(((SELECT count(*) FROM articles) + 1) / (count(*) OVER (PARTITION BY token) + 1)::DOUBLE) + 1 AS weight
       FROM (SELECT DISTINCT article_id, unnest(regexp_extract_all(lower(prod_name), '[a-z0-9]+')) AS token FROM articles)
       UNION ALL SELECT article_id, unnest(['category_l1=' || category_l1, 'category_l2=' || category_l2, 'colour=' || colour,
         'dept=' || dept]), 1.0::DOUBLE FROM articles""",
)
view("content", ("item_tokens",), projected_sql("item_tokens", "token", "weight"))
view(
    "blend",
    ("content", "collab", "items"),
    """SELECT c.article_id, CASE WHEN k.vector IS NULL THEN c.vector ELSE list_transform(range(1, 65),
         lambda i: n / (n + 10.0::DOUBLE) * k.vector[i] + (1 - n / (n + 10.0::DOUBLE)) * c.vector[i]) END AS vector
       FROM content c JOIN (SELECT article_id, coalesce(n_interactions, 0)::DOUBLE AS n FROM items) USING (article_id)
       LEFT JOIN collab k USING (article_id)""",
)


def item_vectors(spark, sf):
    """Vectors of both kinds: from purchases, and from titles and attributes."""
    train, _ = split(spark, sf)
    titled = T.articles(spark, sf).withColumn("title", F.col("prod_name"))
    collaborative = shared("collaborative", sf, lambda: learning.collaborative_vectors(train, DIM))
    return collaborative, shared("content", sf, lambda: learning.content_vectors(titled, DIM))


def blended_vectors(spark, sf):
    collaborative, content = item_vectors(spark, sf)
    bought = purchases(spark, sf).groupBy("article_id").agg(F.count(F.lit(1)).alias("n_interactions"))
    stock = T.articles(spark, sf).select("article_id").join(bought, "article_id", "left")
    return shared("blend", sf, lambda: learning.blend_cold_items(content, collaborative, stock))


def _components(frame):
    return frame.select("article_id", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(
    "J9_item_embeddings",
    """SELECT kind, article_id, pos::INTEGER AS pos, round(vector[pos + 1], 6) AS x FROM (
         SELECT 'collaborative' AS kind, article_id, vector FROM collab UNION ALL SELECT 'content', article_id, vector FROM content),
         (SELECT unnest(range(0, 64)) AS pos)""",
    "collab content",
)
def j9(spark, sf):
    kinds = dict(zip(("collaborative", "content"), item_vectors(spark, sf)))
    rows = [_components(frame).select(F.lit(kind).alias("kind"), "*") for kind, frame in kinds.items()]
    return rows[0].unionByName(rows[1])


def factor_vectors(spark, sf, train=None):
    train = split(spark, sf)[0] if train is None else train
    return shared("factors", sf, lambda: factors.item_vectors(covisit.covisit_counts(train), DIM))


# Eigenvectors are beyond SQL; tests hold them against a dense solver.
@query("J9_factorised_embeddings")
def j9_factorised(spark, sf):
    # Nothing else of the purchases is read here, so no more of them moves to meet its order.
    bought = durable(T.transactions(spark, sf).select("customer_id", "article_id", "t_dat"))
    last = bought.agg(F.max("t_dat")).first()[0]
    train = bought.filter(F.col("t_dat") < F.date_sub(F.lit(last).cast("date"), SPEC.val_days - 1))
    return _components(factor_vectors(spark, sf, train))


@query("P3_vector_kinds")
def p3_kinds(spark, sf):
    """The same recommender over each kind of item vector, on the same split."""
    train, val = split(spark, sf)
    stock = T.items(spark, sf)
    collaborative, content = item_vectors(spark, sf)
    learned = factor_vectors(spark, sf)
    kinds = {
        "projected": collaborative,
        "factorised": learned,
        "projected_blend": blended_vectors(spark, sf),
        "factorised_blend": learning.blend_cold_items(content, learned, stock),
    }
    recent = newest_purchases(spark, sf)
    models = {name: candidates.vector_recommend(recent, vectors) for name, vectors in kinds.items()}
    return evaluation.compare(models, train, val, T.articles(spark, sf))


@query(
    "J10_cold_item_blend",
    "SELECT article_id, pos::INTEGER AS pos, round(vector[pos + 1], 6) AS x FROM blend, (SELECT unnest(range(0, 64)) AS pos)",
    "blend",
)
def j10(spark, sf):
    return _components(blended_vectors(spark, sf))


view(
    "blend_pooled",
    ("last20", "blend"),
    """SELECT customer_id, list_transform(m, lambda x: CASE WHEN list_dot_product(m, m) > 0 THEN x / sqrt(list_dot_product(m, m)) ELSE 0 END)
         AS user_vector FROM (SELECT customer_id, list(x ORDER BY pos) AS m FROM (SELECT customer_id, pos, avg(vector[pos]) AS x
           FROM (SELECT customer_id, vector, unnest(range(1, 65)) AS pos FROM last20 JOIN blend USING (article_id)) GROUP BY 1, 2) GROUP BY 1)""",
)


@query(
    "K2_blended_recommend",
    """SELECT customer_id AS user_id, article_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (
         PARTITION BY customer_id ORDER BY score DESC, article_id) AS rank FROM (
           SELECT p.customer_id, v.article_id, round(list_dot_product(p.user_vector, v.vector), 9) AS score
           FROM blend_pooled p, blend v WHERE NOT EXISTS (SELECT 1 FROM last20 l
             WHERE l.customer_id = p.customer_id AND l.article_id = v.article_id))) WHERE rank <= 20""",
    "blend_pooled blend last20",
)
def k2_blended(spark, sf):
    """Lists by the job's own item vectors; an item without purchases takes part through its title."""
    return candidates.vector_recommend(newest_purchases(spark, sf), blended_vectors(spark, sf))


view(
    "retrieved",
    ("per_customer",),
    """SELECT customer_id AS user_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
         ORDER BY score DESC, article_id) AS rank FROM per_customer) WHERE rank <= 150""",
)


def checked_ranks(found, allowed):
    """Of each list: its places, and whether each item was among the candidates and scores no higher than the one before."""
    marks = allowed.select("user_id", "article_id").distinct().withColumn("_in", F.lit(True))
    before = F.lag("score").over(W.partitionBy("user_id").orderBy("rank"))
    rows = found.withColumn("_before", before).join(marks, ["user_id", "article_id"], "left")
    ordered = F.coalesce(F.col("score") <= F.col("_before"), F.lit(True))
    return rows.select("user_id", "rank", F.coalesce("_in", F.lit(False)).alias("retrieved"), ordered.alias("in_order"))


@query("K4_retrieve_then_rank")
def k4(spark, sf):
    return retrieve_then_rank(spark, sf)[0].select("user_id", "article_id", "score", "rank")


# The order depends on fitted trees; what must hold of every list is compared.
@query(
    "K4_ranked_rules",
    """SELECT user_id, unnest(range(1, least(20, n) + 1))::INTEGER AS rank, true AS retrieved, true AS in_order FROM (
         SELECT user_id, count(*) AS n FROM retrieved GROUP BY 1)""",
    "retrieved",
)
def k4_rules(spark, sf):
    ranked, found = retrieve_then_rank(spark, sf)
    return checked_ranks(ranked, found.withColumnRenamed("list_id", "user_id"))


def retrieve_then_rank(spark, sf):
    """(lists of 20 by the fitted models, the candidates they were chosen from)."""
    models, _ = fitted(spark, sf)
    train, _ = split(spark, sf)
    vecs = T.vectors(spark, sf)
    now = sampling.last_day(train)
    base = shared("item meta", sf, lambda: I.item_meta(T.items(spark, sf), train))
    meta = durable(I.days_since_first_seen(base, now).drop("first_seen"))
    bought = newest_purchases(spark, sf)
    pooled = durable(candidates.pooled_vectors(bought, vecs))
    queries = pooled.select(F.col("customer_id").alias("query_id"), F.col("user_vector").alias("vector"))
    recent = bought.withColumnRenamed("customer_id", "list_id")
    seen = recent.select(F.col("list_id").alias("query_id"), "article_id")
    found = durable(retrieval.top_k(queries, vecs, 150, seen).select(F.col("query_id").alias("list_id"), "article_id"))
    session = intents.session_rows(
        recent.join(meta.select("article_id", F.col("avg_price").alias("price")), "article_id", "left").withColumn("t_dat", now), meta
    )
    session = durable(session)
    heads = intents.infer_intents(recent.select("list_id").distinct(), session, vecs, DIM)
    users = pooled.select(F.col("customer_id").alias("list_id"), "user_vector")
    rows = build_features(found, meta, vecs, users, heads, session)
    ranked = learning.rank_by_models(models, rows, 20)
    return durable(ranked.select(F.col("list_id").alias("user_id"), "article_id", "score", "rank")), found


def checked_lists(items, lists, cat, seen=None):
    """Of each list: its places, whether every item passes the filters, and whether no category is over its share."""
    marked = guardrails.flagged(surfaces.guardrail_rows(items, cat), lists, seen)
    size = F.count(F.lit(1)).over(W.partitionBy("list_id"))
    most = F.greatest(F.lit(1), F.floor(F.lit(guardrails.MAX_SHARE) * size))
    in_category = F.count(F.lit(1)).over(W.partitionBy("list_id", "category_l1"))
    return marked.select(
        "list_id", "position", F.col("dropped_by").isNull().alias("allowed"), (in_category <= most).alias("within_share")
    )


def places_sql(rows: str, limit: int) -> str:
    """Places of the lists whose candidates are `rows`: as many as the cap can fill, by the sizes of categories alone."""
    return f"""SELECT list_id, unnest(range(target))::INTEGER AS position, true AS allowed, true AS within_share FROM (
        SELECT list_id, max(target) AS target FROM ({capped_sql(rows, limit)}) GROUP BY 1)"""


view(
    "feed_ranked_left",
    ("feed_left", "routed", "vectors"),
    """SELECT l.* FROM feed_left l WHERE l.article_id IN (SELECT article_id FROM vectors)
         OR l.list_id NOT IN (SELECT list_id FROM routed SEMI JOIN vectors USING (article_id))""",
)


@query("K10_feed_ranked")
def k10_ranked(spark, sf):
    items = feed_of(spark, sf, fitted(spark, sf)[0])["items"]
    return items.select("list_id", "article_id", "score", "position", "intent", "reason_code")


# As above: the fitted order is beyond SQL, the places of each list and the rules that its items keep are not.
@query("K10_ranked_rules", places_sql("feed_ranked_left", 20), "feed_ranked_left")
def k10_rules(spark, sf):
    items = k10_ranked(spark, sf).select("list_id", "article_id", "position")
    seen = sessions(spark, sf).select("list_id", "article_id")
    return checked_lists(items, contexts(spark, sf), catalogue_of(spark, sf), seen)


@query("K9_search_ranked")
def k9_ranked(spark, sf):
    cat = catalogue_of(spark, sf)
    middles = durable(I.category_centroids(cat.stock, cat.vectors))
    models, _ = fitted(spark, sf)
    items = surfaces.search(T.search_queries(spark, sf), middles, I.global_centroid(cat.vectors), cat, 20, models)["items"]
    return items.select("query", "article_id", "score", "position", "reason_text")


@query("K9_ranked_rules", places_sql("search_named", 20).replace("list_id,", "list_id AS query,", 1), "search_named")
def k9_rules(spark, sf):
    listed = durable(k9_ranked(spark, sf).select(F.col("query").alias("list_id"), "article_id", "position"))
    lists = listed.select("list_id", F.lit(UNKNOWN).alias("age_band")).distinct()
    return checked_lists(listed, lists, catalogue_of(spark, sf)).withColumnRenamed("list_id", "query")


# ---- streams --------------------------------------------------------------------------------------------------------


@query(
    "O1_session_state",
    """SELECT 'sess:' || user_id AS session_key, count(*)::INTEGER AS events, min(ts) AS first_ts, max(ts) AS last_ts,
         string_agg(article_id::VARCHAR, ',' ORDER BY age) AS articles FROM sess GROUP BY 1""",
    "sess",
)
def o1(spark, sf):
    stream = S.with_defaults(S.typed(S.event_stream(spark, sf)))
    last = S.update_to(S.session_state(stream, GAP).filter(~F.col("expired")), "sessions", S.SESSION, ["session_key"])
    return last.select(
        "session_key",
        "events",
        F.col("first_ts").cast("timestamp_ntz").alias("first_ts"),
        F.col("last_ts").cast("timestamp_ntz").alias("last_ts"),
        F.concat_ws(",", F.col("article_ids").cast("array<string>")).alias("articles"),
    )


@query(
    "O2_current_session",
    "SELECT user_id, event_id, article_id, ts, age::INTEGER AS age FROM sess",
    "sess",
)
def o2(spark, sf):
    return intents.current_sessions(T.clicks(spark, sf), GAP).select("user_id", "event_id", "article_id", "ts", "age")


@query(
    "O2_all_sessions",
    """SELECT user_id, session::BIGINT AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM (
         SELECT *, sum(CASE WHEN gap > 43200000000 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)
           AS session FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
             FROM clicks)) GROUP BY 1, 2""",
    "clicks",
)
def o2_all(spark, sf):
    return intents.sessions(T.clicks(spark, sf), GAP)


@query(
    "O3_event_defaults",
    """SELECT event_id, 'sess:' || CASE event_type WHEN 'view' THEN 's' || user_id WHEN 'error' THEN 'anonymous' ELSE user_id::VARCHAR
           END AS session_key, article_id, ts, CASE WHEN event_type = 'view' THEN 0.0 ELSE price END AS price,
         CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS category_l1,
         event_type <> 'view' AND discounted AS discounted FROM clicks""",
    "clicks",
)
def o3(spark, sf):
    # Views come from guests, who have a session_id alone; errors have neither.
    kind, user = F.col("event_type"), F.col("user_id")
    raw = S.event_stream(spark, sf).withColumn("session_id", F.when(kind == "view", F.concat(F.lit("s"), user)))
    raw = raw.withColumn("user_id", F.when(~kind.isin("view", "error"), user))
    path = S.append_to(S.with_defaults(S.typed(raw)), "event-defaults")
    return spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("O4_event_log", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def o4(spark, sf):
    return spark.read.parquet(S.append_to(S.event_stream(spark, sf), "event-log"))


@query("O4_event_log_once", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def o4_once(spark, sf):
    # Every event is delivered twice.
    twice = S.event_stream(spark, sf).unionByName(S.event_stream(spark, sf))
    log = spark.read.parquet(S.append_to(S.each_once(twice), "event-log-once"))
    return log.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "O5_rolling_popularity",
    "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, article_id, count(*) AS n FROM clicks GROUP BY 1, 2",
    "clicks",
)
def o5(spark, sf):
    stream = S.with_defaults(S.typed(S.event_stream(spark, sf)))
    shape, keys = "hour timestamp, article_id bigint, n bigint", ["hour", "article_id"]
    return S.update_to(S.rolling_popularity(stream), "popularity", shape, keys).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def segment_panes(spark, sf):
    shape = "pane timestamp, region string, age_band string, article_id bigint, n bigint"

    def made():
        counted = S.segment_panes(S.typed(S.event_stream(spark, sf)), T.users(spark, sf))
        return S.update_to(counted, "panes", shape, ["pane", "region", "age_band", "article_id"])

    return shared("segment panes", sf, made)


view(
    "panes",
    ("clicks", "banded"),
    """SELECT time_bucket(INTERVAL '10 minutes', ts) AS pane, coalesce(region, 'unknown') AS region,
         coalesce(age_band, 'unknown') AS age_band, article_id, count(*) AS n
       FROM clicks LEFT JOIN banded ON customer_id = user_id GROUP BY 1, 2, 3, 4""",
)
view(
    "sellers",
    ("panes",),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, region, age_band ORDER BY n DESC, article_id) AS rank FROM (
         SELECT as_of, region, age_band, article_id, sum(n)::BIGINT AS n FROM (
           SELECT pane + to_minutes(10 * k) AS as_of, region, age_band, article_id, n FROM panes, (SELECT unnest(range(1, 7)) AS k)
             WHERE region <> 'unknown' OR age_band <> 'unknown'
           UNION ALL SELECT pane + to_minutes(10 * k), 'unknown', 'unknown', article_id, n
             FROM panes, (SELECT unnest(range(1, 7)) AS k)) GROUP BY 1, 2, 3, 4)) WHERE rank <= 20""",
)


@query(
    "O5_segment_best_sellers",
    "SELECT as_of::TIMESTAMP AS as_of, region, age_band, article_id, n, rank::INTEGER AS rank FROM sellers",
    "sellers",
)
def o5_segments(spark, sf):
    return S.best_sellers(segment_panes(spark, sf), 20).withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))


@query(
    "O5_live_lists",
    """SELECT list_id, article_id, rank::INTEGER AS rank FROM keys JOIN (SELECT * FROM sellers
         WHERE as_of = (SELECT max(pane) + INTERVAL '10 minutes' FROM panes)) USING (region, age_band)""",
    "keys sellers panes",
)
def o5_live(spark, sf):
    """Every customer's list from the best sellers of the last hour of the stream."""
    stock = S.live_best_sellers(segment_panes(spark, sf), 20)
    return candidates.popular_for(contexts(spark, sf), stock, 20, "live").select("list_id", "article_id", "rank")


@query(
    "O6_latency_counters",
    "SELECT event_type AS stage, count(*) AS latency_count, round(sum(value), 3) AS latency_sum FROM events GROUP BY 1",
)
def o6(spark, sf):
    samples = S.event_stream(spark, sf).select(F.col("event_type").alias("stage"), F.col("value").alias("millis"))
    shape = "stage string, latency_count bigint, latency_sum double"
    return S.update_to(S.latency_counters(samples), "latency", shape, ["stage"]).withColumn("latency_sum", F.round("latency_sum", 3))
