"""Training sets, boosted trees, blending and item embeddings."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.columns import UNKNOWN, tokens, uniform
from basketry.functions.vectors import scaled_sum, unit
from basketry.operators import trees
from basketry.operators.covisit import at_items, nearby, one_task_per_item
from basketry.operators.features import FEATURE_NAMES
from basketry.operators.skew import HOT_ROWS, newest

# Fixed values
OBJECTIVES = ("click", "cart", "purchase", "wishlist")
BLEND = {"click": 0.2, "cart": 0.3, "purchase": 0.5}
CART_PROBABILITY = 0.4
WISHLIST_PROBABILITY = 0.2
N_NEGATIVES = 4
ATTEMPTS_PER_NEGATIVE = 20
COLD_ITEM_SMOOTHING = 10.0
# Bounds on the examples that the rankers are fitted on and judged by; arguments where examples are drawn.
MAX_TRAIN_EXAMPLES = 8_000
MAX_VAL_EXAMPLES = 2_000
ROUNDS = 100


def negatives(examples: DataFrame, pool: DataFrame, n: int = N_NEGATIVES, seed: int = 0) -> DataFrame:
    """n distinct uniform items per example outside its history and target, at most 20 n draws.

    examples (example_id, taken): the pool positions of the history and target; pool (article_id, position) with
    positions 0..size-1. Draws are filtered inside the row and only the n chosen ones are joined to ids.
    """
    picks = _picked(examples, pool, n, seed)
    rows = picks.select("example_id", F.posexplode("_pick").alias("draw", "position"))
    return rows.join(pool, "position").select("example_id", (F.col("draw") + 1).alias("draw"), "article_id")


def _picked(examples: DataFrame, pool: DataFrame, n: int, seed: int) -> DataFrame:
    """Examples with `_pick`, the chosen pool positions."""
    size = pool.select(F.count(F.lit(1))).scalar()
    asked = examples.withColumnRenamed("taken", "_out").withColumn("_size", size)

    def chosen(attempts: int) -> Column:
        draws = F.transform(
            F.sequence(F.lit(0), F.lit(attempts - 1)),
            lambda i: F.floor(uniform(F.lit(f"neg{seed}"), F.col("example_id"), i) * F.col("_size")).cast("bigint"),
        )
        return F.slice(F.array_distinct(F.filter(draws, lambda d: ~F.array_contains("_out", d))), 1, n)

    # Nearly all examples are done after n draws and a few; the rest look at all of them. Both give the same first n.
    short, full = chosen(min(n + 2, ATTEMPTS_PER_NEGATIVE * n)), chosen(ATTEMPTS_PER_NEGATIVE * n)
    return asked.withColumn("_short", short).withColumn("_pick", F.when(F.size("_short") >= n, F.col("_short")).otherwise(full))


def labelled_candidates(examples: DataFrame, pool: DataFrame, n: int = N_NEGATIVES, seed: int = 0) -> DataFrame:
    """`weak_labels` of the target and the negatives of each example, whose categories take no row of their own.

    examples (example_id, position, taken, kinds): the target's pool position, what may not be drawn, and the codes of the
    history's categories; pool (article_id, position, codes): also the codes of an article's categories, one for each time
    that the catalogue lists it. A candidate moves once, to the pool, and takes its example's few codes along; targets that
    the pool lacks have no category and give no row.
    """
    of_example = F.transform(
        F.concat(F.array("position"), "_pick"), lambda p, i: F.struct(p.alias("position"), (i == 0).alias("is_target"))
    )
    rows = _picked(examples, pool, n, seed).select("example_id", "kinds", F.explode(of_example).alias("c"))
    rows = rows.select("example_id", "kinds", "c.position", "c.is_target")
    met = rows.join(pool.hint("shuffle_hash"), "position")
    met = met.select("example_id", "article_id", "is_target", "kinds", F.explode("codes").alias("code"))
    return weak_labels(met, F.array_contains("kinds", F.col("code")), seed).drop("kinds", "code")


def with_positions(tx: DataFrame, pool: DataFrame) -> DataFrame:
    """Purchases with the pool position of their article; null where the pool lacks it."""
    return tx.join(pool, "article_id", "left")


def taken(events: Column, target_position: Column) -> Column:
    """Positions an example may not draw."""
    return F.array_compact(F.array_union(F.transform(events, lambda e: e["position"]), F.array(target_position)))


def weak_labels(rows: DataFrame, in_session: Column, seed: int = 0) -> DataFrame:
    """Labels of each candidate: a target was clicked and bought, and carted or wished for by chance; another item
    counts as clicked where its category is in the session."""
    hit = F.col("is_target")
    key = [F.col("example_id"), F.col("article_id")]
    cart = uniform(F.lit(f"cart{seed}"), *key) < F.lit(CART_PROBABILITY)
    wish = uniform(F.lit(f"wishlist{seed}"), *key) < F.lit(WISHLIST_PROBABILITY)
    return (
        rows.withColumn("click", F.when(hit | in_session, 1).otherwise(0))
        .withColumn("cart", F.when(hit & cart, 1).otherwise(0))
        .withColumn("purchase", F.when(hit, 1).otherwise(0))
        .withColumn("wishlist", F.when(hit & wish, 1).otherwise(0))
    )


def candidate_rows(examples: DataFrame, drawn: DataFrame) -> DataFrame:
    """The target and the negatives of each example: (example_id, article_id, is_target)."""
    targets = examples.select("example_id", F.col("target").alias("article_id"), F.lit(True).alias("is_target"))
    return targets.unionByName(drawn.select("example_id", "article_id", F.lit(False).alias("is_target")))


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="features").transform(rows)


def train_rankers(
    train: DataFrame, val: DataFrame, rounds: int = ROUNDS, objectives: tuple[str, ...] = OBJECTIVES
) -> dict[str, GBTClassificationModel]:
    """One boosted-tree model per objective; stops early on the validation rows. A fit is some hundred small jobs in a row, which
    leave most cores idle, so the objectives are fitted beside each other."""
    both = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
    data = assembled(both).select("features", "is_val", *objectives).persist()
    try:
        data.count()
        with ThreadPoolExecutor(len(objectives)) as pool:
            return dict(zip(objectives, pool.map(lambda objective: _booster(objective, rounds).fit(data), objectives)))
    finally:
        data.unpersist()


def _booster(objective: str, rounds: int) -> GBTClassifier:
    return GBTClassifier(
        labelCol=objective, featuresCol="features", maxDepth=4, maxIter=rounds, stepSize=0.05, minInstancesPerNode=20,
        validationIndicatorCol="is_val", seed=0,
    )


def probabilities(models: dict[str, GBTClassificationModel], rows: DataFrame) -> DataFrame:
    """Adds one probability per objective."""
    held = trees.forest(list(models.values()), len(FEATURE_NAMES))
    if held is not None:
        return trees.with_probabilities(rows, held, FEATURE_NAMES, [f"p_{o}" for o in models])
    out = assembled(rows)
    for objective, model in models.items():
        scored = model.copy().setPredictionCol("").setRawPredictionCol("_raw").setProbabilityCol("_p")
        out = scored.transform(out).withColumn(f"p_{objective}", vector_to_array("_p")[1]).drop("_raw", "_p")
    return out.drop("features")


def auc_of(scored: DataFrame, score: str, objectives: tuple[str, ...] = OBJECTIVES) -> dict[str, float]:
    """Area under the ROC curve of a score for each label; equal scores count half. One number each reaches the driver."""
    judge = BinaryClassificationEvaluator(rawPredictionCol=score, numBins=0)
    return {o: float(judge.setLabelCol(o).evaluate(scored.withColumn(o, F.col(o).cast("double")))) for o in objectives}


def auc(models: dict[str, GBTClassificationModel], rows: DataFrame) -> DataFrame:
    """Validation AUC and number of trees per objective."""
    data = assembled(rows).persist()
    try:
        found = {o: auc_of(m.transform(data), "rawPrediction", (o,))[o] for o, m in models.items()}
    finally:
        data.unpersist()
    out = [(o, found[o], int(m.getNumTrees)) for o, m in models.items()]
    return rows.sparkSession.createDataFrame(out, "objective string, auc double, trees int")


def blended(click: Column, cart: Column, purchase: Column) -> Column:
    return F.lit(BLEND["click"]) * click + F.lit(BLEND["cart"]) * cart + F.lit(BLEND["purchase"]) * purchase


def rank_by_models(models: dict[str, GBTClassificationModel], rows: DataFrame, k: int | None = None) -> DataFrame:
    """Candidates of each list by blended score; all of them, or the best k."""
    used = {o: models[o] for o in BLEND}
    scored = probabilities(used, rows)
    score = F.round(blended(F.col("p_click"), F.col("p_cart"), F.col("p_purchase")), 9)
    scored = scored.withColumn("score", score).drop(*[f"p_{o}" for o in BLEND])
    return scored if k is None else newest(scored, ["list_id"], [F.desc("score"), F.asc("article_id")], k, "rank")


def save_rankers(models: dict[str, GBTClassificationModel], path: str) -> None:
    for objective, model in models.items():
        model.write().overwrite().save(f"{path}/ranker_{objective}")


def load_rankers(spark: SparkSession, path: str, objectives: tuple[str, ...] = OBJECTIVES) -> dict[str, GBTClassificationModel]:
    return {o: GBTClassificationModel.load(f"{path}/ranker_{o}") for o in objectives}


def _bucket(token: Column, dim: int) -> tuple[Column, Column]:
    """Component and sign that a token adds to."""
    digest = F.md5(token.cast("string").cast("binary"))
    at = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    return at, F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)


def projected(rows: DataFrame, key: str, token: str, weight: str, dim: int = 64) -> DataFrame:
    """(key, token, weight) -> (key, vector): tokens hashed to signed components, added up, scaled to length 1.

    The sums combine map-side, and a vector holds `dim` numbers whatever the number of tokens.
    """
    at, sign = _bucket(F.col(token), dim)
    return _added_up(rows.select(key, at.alias("_at"), (sign * F.col(weight)).alias("_x")), key, dim)


def _added_up(rows: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, _at, _x): what is to be added to the components of a key's vector."""
    sums = rows.groupBy(key, "_at").agg(F.sum("_x").alias("_x"))
    held = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_x"))).alias("_m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)))
    return held.select(key, unit(filled).alias("vector"))


def collaborative_vectors(tx: DataFrame, dim: int = 64, hot_items: int = HOT_ROWS) -> DataFrame:
    """Item vectors from what is bought near each item: its co-visitation counts, projected. Items without any have none.

    A pair adds to a component as often as it is met, so pairs are not counted one by one first. The component and the sign of
    a neighbour are worked out once per purchase. A purchase moves to its item once, with all its neighbours in a row; where
    an item has more than `hot_items` purchases, its sums are begun before they move."""
    at, sign = _bucket(F.col("article_id"), dim)
    hoods = nearby(tx, carry={"_at": at, "_sign": sign.cast("tinyint")})
    slots = F.transform("near", lambda e: F.struct(e["_at"].alias("at"), (e["n"] * e["_sign"] * F.col("times")).alias("x")))
    hoods = hoods.select("item", slots.alias("near"))
    if one_task_per_item(tx, hot_items):
        hoods = at_items(tx, hoods)
    rows = hoods.select(F.col("item").alias("article_id"), F.explode("near").alias("e"))
    return _added_up(rows.select("article_id", F.col("e.at").alias("_at"), F.col("e.x").cast("double").alias("_x")), "article_id", dim)


def content_vectors(items: DataFrame, dim: int = 64) -> DataFrame:
    """Item vectors from title words, weighed by rarity, and attributes; needs no purchases, so new items have one."""
    attributes = ["category_l1", "category_l2", "colour", "dept"]
    words = items.select("article_id", F.explode(F.array_distinct(tokens(F.coalesce("title", F.lit(""))))).alias("token"))
    held = words.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    total = items.select(F.count(F.lit(1))).scalar()
    rare = F.log((total + 1) / (F.col("_n") + 1)) + 1.0
    named = [F.concat(F.lit(f"{a}="), F.coalesce(F.col(a).cast("string"), F.lit(UNKNOWN))) for a in attributes]
    kinds = items.select("article_id", F.explode(F.array(*named)).alias("token"), F.lit(1.0).alias("weight"))
    weighed = words.join(held, "token").select("article_id", "token", rare.alias("weight"))
    return projected(weighed.unionByName(kinds), "article_id", "token", "weight", dim)


def blend_cold_items(content: DataFrame, collaborative: DataFrame, items: DataFrame) -> DataFrame:
    """n / (n + 10) of the collaborative vector and the rest of the content vector; content alone where n is 0."""
    n = F.coalesce("n_interactions", F.lit(0)).cast("double")
    alpha = n / (n + F.lit(COLD_ITEM_SMOOTHING))
    collab = collaborative.select("article_id", F.col("vector").alias("_collab"))
    joined = content.join(items.select("article_id", "n_interactions"), "article_id").join(collab, "article_id", "left")
    mixed = scaled_sum(F.col("_collab"), alpha, F.col("vector"), F.lit(1.0) - alpha)
    return joined.select("article_id", F.coalesce(mixed, F.col("vector").cast("array<double>")).alias("vector"))
