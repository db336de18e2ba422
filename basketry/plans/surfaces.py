"""The product surfaces as batch jobs: feed, bundles and search over all requests at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketry.functions.columns import UNKNOWN, query_cache_key, reason_code, reason_text, tokens
from basketry.functions.vectors import pooled, unit
from basketry.operators import guardrails
from basketry.operators.candidates import feed_candidates, popular_for
from basketry.operators.features import build_features
from basketry.operators.intents import infer_intents
from basketry.operators.learning import rank_by_models
from basketry.operators.retrieval import top_k
from basketry.operators.skew import newest
from basketry.session import durable

# Fixed values
COMPLEMENT_WEIGHT = 0.6
SIMILARITY_WEIGHT = 0.4
OVERFETCH = 5
# Rows that a caller's session holds at most.
SESSION = 20


@dataclass(frozen=True)
class Catalogue:
    """stock (article_id, category_l1, in_stock, age_restricted), vectors, metadata, centroids."""

    stock: DataFrame
    vectors: DataFrame
    meta: DataFrame
    dim: int

    @property
    def embeddings(self) -> DataFrame:
        return self.vectors.select("article_id", F.col("vector").alias("embedding"))


def guardrail_rows(ranked: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Candidates as the guardrails want them; items the catalogue lacks are in stock, unrestricted, 'unknown'."""
    joined = ranked.join(catalogue.stock, "article_id", "left")
    return joined.select(
        *ranked.columns,
        F.coalesce("category_l1", F.lit(UNKNOWN)).alias("category_l1"),
        F.coalesce("in_stock", F.lit(True)).alias("in_stock"),
        F.coalesce("age_restricted", F.lit(False)).alias("age_restricted"),
    )


def user_vectors(session: DataFrame, vectors: DataFrame) -> DataFrame:
    return pooled(session, vectors, ["list_id"]).select("list_id", unit(F.col("m")).alias("user_vector"))


def model_order(candidates: DataFrame, session: DataFrame, intents: DataFrame, catalogue: Catalogue, models, users=None) -> DataFrame:
    """Candidates rescored by the rankers, stored. A list none of whose candidates has a vector keeps its retrieval order."""
    users = user_vectors(session, catalogue.vectors) if users is None else users
    keep = tuple(c for c in ("label", "degraded") if c in candidates.columns)
    rows = build_features(candidates, catalogue.meta, catalogue.vectors, users, intents, session, keep)
    # Stored, as it would be scored once more to see which lists are in it.
    scored = durable(rank_by_models(models, rows).select("list_id", "article_id", "score", *keep))
    unranked = candidates.join(scored.select("list_id").distinct(), "list_id", "left_anti")
    return scored.unionByName(durable(unranked.select(*scored.columns)))


def by_segment(contexts: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, members): contexts to be worked out, and (served_as, list_id) of the lists that take over a result.

    Without a session (active: list_id) a list depends on its region and age band alone, so one of each segment stands for
    the others. Lists that are there more than once, or lack a key or a segment, are worked out themselves."""
    alone = contexts.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("_n"), F.first("region").alias("region"), F.first("age_band").alias("age_band")
    )
    alike = alone.filter((F.col("_n") == 1) & F.col("list_id").isNotNull() & F.col("region").isNotNull() & F.col("age_band").isNotNull())
    quiet = durable(alike.drop("_n").join(active, "list_id", "left_anti"))
    first = durable(quiet.groupBy("region", "age_band").agg(F.min("list_id").alias("served_as")))
    members = quiet.join(F.broadcast(first), ["region", "age_band"]).filter(F.col("list_id") != F.col("served_as"))
    members = durable(members.select("served_as", "list_id"))
    # Null keys match nothing and stay.
    return durable(contexts.join(members.select("list_id"), "list_id", "left_anti")), members


def handed_to(members: DataFrame, found: DataFrame) -> DataFrame:
    """`found` (list_id, ...) of the lists that were worked out, and the same rows for the members of their segments. A
    segment's rows are packed into one, so that members stay where they are."""
    others = [c for c in found.columns if c != "list_id"]
    named = found.join(F.broadcast(members.select(F.col("served_as").alias("list_id")).distinct()), "list_id", "left_semi")
    packed = named.groupBy(F.col("list_id").alias("served_as")).agg(F.collect_list(F.struct(*others)).alias("_rows"))
    # Members are few bytes that become many rows, so they are dealt to all cores first.
    dealt = members.repartition(2 * members.sparkSession.sparkContext.defaultParallelism, "list_id")
    given = dealt.join(F.broadcast(packed), "served_as").select("list_id", F.inline("_rows"))
    return found.unionByName(given)


def feed(
    contexts: DataFrame,
    session: DataFrame,
    popular: DataFrame,
    catalogue: Catalogue,
    limit: int = 20,
    models=None,
    personalized: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Lists for every context (list_id, region, age_band) from its session events (list_id, article_id, ts, ...).

    Without `models` candidates keep their retrieval order. `personalized` (list_id) names the lists whose session may
    be used; the others are served as cold starts.

    Without a session event a list depends on its region and age band alone. One list of each such segment is worked
    out and its result handed to the others.
    """
    if personalized is not None:
        session = session.join(personalized, "list_id", "left_semi")
    session = durable(session)
    active = session.select("list_id").distinct()
    quiet = contexts.join(active, "list_id", "left_anti")
    segments = durable(quiet.groupBy("region", "age_band").agg(F.min("list_id").alias("served_as")))
    members = quiet.join(segments, ["region", "age_band"]).select("served_as", "list_id")
    asked = contexts.join(active, "list_id", "left_semi").select("list_id", "region", "age_band").unionByName(
        segments.select(F.col("served_as").alias("list_id"), "region", "age_band")
    )
    found = {name: durable(df) for name, df in _feed_of(asked, session, popular, catalogue, limit, models).items()}

    def handed_out(df: DataFrame) -> DataFrame:
        own = df.join(segments, df["list_id"] == segments["served_as"], "left_anti")
        # Only the lists of segments meet the members: a few dozen lists, stored, so that their size is known.
        of_segments = durable(df.join(segments.select("served_as"), df["list_id"] == segments["served_as"], "left_semi"))
        shared = of_segments.withColumnRenamed("list_id", "served_as").join(members, "served_as").select(*df.columns)
        return own.unionByName(shared)

    return {name: handed_out(df) for name, df in found.items()}


def _feed_of(
    contexts: DataFrame, session: DataFrame, popular: DataFrame, catalogue: Catalogue, limit: int, models
) -> dict[str, DataFrame]:
    intents = durable(infer_intents(contexts, session, catalogue.vectors, catalogue.dim))
    seen = session.select("list_id", "article_id").distinct()
    candidates = feed_candidates(contexts, intents, catalogue.vectors, seen, popular).drop("rank")
    if models is not None:
        candidates = model_order(candidates, session, intents, catalogue, models)
    final, report = guardrails.apply_all(
        guardrail_rows(candidates, catalogue), contexts, limit, seen, embeddings=catalogue.embeddings
    )
    matches = session.groupBy("list_id", F.coalesce("category_l1", F.lit(UNKNOWN)).alias("category_l1")).agg(
        F.count(F.lit(1)).alias("_matches")
    )
    joined = final.join(matches, ["list_id", "category_l1"], "left")
    n = F.coalesce("_matches", F.lit(0))
    items = joined.select(
        "list_id",
        "article_id",
        "position",
        "score",
        F.col("label").alias("intent"),
        reason_code(F.col("label"), n).alias("reason_code"),
        reason_text(F.col("label"), n).alias("reason_text"),
        "degraded",
    )
    items = durable(items)
    return {"items": items, "intents": intents, "report": report, "slots": intent_slots(intents, items)}


def intent_slots(intents: DataFrame, items: DataFrame) -> DataFrame:
    """Each detected intent with its confidence and how many places of the final list it fills."""
    used = items.groupBy("list_id", F.col("intent").alias("label")).agg(F.count(F.lit(1)).alias("slots"))
    joined = intents.join(used, ["list_id", "label"], "left")
    return joined.select(
        "list_id", "label", F.round("weight", 4).alias("confidence"), F.coalesce("slots", F.lit(0)).alias("slots")
    )


def bundle_candidates(seeds: DataFrame, edges: DataFrame, vectors: DataFrame, limit: int = 10) -> DataFrame:
    """Items for each seed (list_id = seed): 0.6 x complement lift + 0.4 x similarity over the seed's best similarity."""
    queries = seeds.join(vectors, "article_id").select(F.col("article_id").alias("query_id"), "vector")
    itself = queries.select("query_id", F.col("query_id").alias("article_id"))
    similar = top_k(queries, vectors, limit * OVERFETCH, itself).select(
        F.col("query_id").alias("list_id"), "article_id", F.col("score").alias("sim")
    )
    best = F.max("sim").over(W.partitionBy("list_id"))
    similar = similar.select("list_id", "article_id", (F.col("sim") / F.when(best == 0, F.lit(1.0)).otherwise(best)).alias("sim"))
    complements = edges.join(seeds.select(F.col("article_id").alias("item")), "item", "left_semi").select(
        F.col("item").alias("list_id"), F.col("neighbour").alias("article_id"), "lift"
    )
    both = complements.join(similar, ["list_id", "article_id"], "full_outer")
    zero = F.lit(0.0)
    score = F.lit(COMPLEMENT_WEIGHT) * F.coalesce("lift", zero) + F.lit(SIMILARITY_WEIGHT) * F.coalesce("sim", zero)
    source = F.when(F.col("lift").isNotNull(), "COMPLEMENT").otherwise("SIMILAR_STYLE")
    return both.select("list_id", "article_id", F.round(score, 9).alias("score"), source.alias("reason_code"))


def bundles(seeds: DataFrame, edges: DataFrame, catalogue: Catalogue, limit: int = 10) -> dict[str, DataFrame]:
    blended = bundle_candidates(seeds, edges, catalogue.vectors, limit)
    contexts = seeds.select(F.col("article_id").alias("list_id"), F.lit(UNKNOWN).alias("age_band"))
    itself = seeds.select(F.col("article_id").alias("list_id"), "article_id")
    final, report = guardrails.apply_all(guardrail_rows(blended, catalogue), contexts, limit, itself, embeddings=catalogue.embeddings)
    text = F.when(F.col("reason_code") == "COMPLEMENT", "Frequently bought with this item").otherwise("Similar style")
    return {"items": final.withColumn("reason_text", text), "report": report}


def parse_queries(queries: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds the first category in sorted order that a token of more than two letters is part of, or that is part of it.

    Both directions are equi-joins on substrings: those of the categories, and those of the tokens up to the longest
    category. Queries equal after folding are parsed once.
    """
    asked = queries.withColumn("cache_key", query_cache_key(F.col("query")))
    once = asked.groupBy("cache_key").agg(F.min("query").alias("_text"))
    words = once.select("cache_key", F.explode(F.array_distinct(tokens(F.col("_text")))).alias("token"))
    words = words.filter(F.length("token") > 2)
    distinct = words.select("token").distinct()
    names = categories.select("category_l1").distinct().filter(F.col("category_l1").isNotNull())
    names = names.withColumn("folded", F.lower("category_l1"))
    longest = names.select(F.max(F.length("folded"))).scalar()
    inside = names.select("category_l1", F.explode(_substrings(F.col("folded"), F.length("folded"))).alias("token")).distinct()
    around = distinct.withColumn("_longest", F.least(F.length("token"), longest))
    around = around.select("token", F.explode(_substrings(F.col("token"), F.col("_longest"))).alias("folded")).distinct()
    matched = distinct.join(inside, "token").select("token", "category_l1").unionByName(
        around.join(names, "folded").select("token", "category_l1")
    )
    first = words.join(matched, "token").groupBy("cache_key").agg(F.min("category_l1").alias("category_l1"))
    return asked.join(first, "cache_key", "left")


def _substrings(text: Column, longest: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)))

    def at(start: Column) -> Column:
        room = F.greatest(F.lit(1), F.least(longest, F.length(text) - start + 1))
        return F.transform(F.sequence(F.lit(1), room), lambda n: F.substring(text, start, n))

    return F.array_distinct(F.flatten(F.transform(starts, at)))


def search_candidates(parsed: DataFrame, centroids: DataFrame, whole: DataFrame, vectors: DataFrame, limit: int = 20) -> DataFrame:
    """Nearest items to each query's category centroid, or to the global one.

    Queries of one category share a vector, so the search runs once per category and the result is joined back.
    """
    known = centroids.select(F.col("category_l1").alias("query_id"), F.col("centroid").alias("vector"))
    rest = whole.select(F.lit("").alias("query_id"), F.col("centroid").alias("vector"))
    found = top_k(known.unionByName(rest), vectors, limit * OVERFETCH)
    cells = centroids.select("category_l1", F.col("category_l1").alias("query_id"))
    asked = parsed.join(cells, "category_l1", "left").withColumn("query_id", F.coalesce("query_id", F.lit("")))
    return asked.select(F.col("cache_key").alias("list_id"), "query_id").distinct().join(found, "query_id").select(
        "list_id", "article_id", "score"
    )


def search(
    queries: DataFrame, centroids: DataFrame, whole: DataFrame, catalogue: Catalogue, limit: int = 20, models=None
) -> dict[str, DataFrame]:
    """Lists for every query text; they carry the parsed category and the SEARCH_MATCH reason."""
    parsed = parse_queries(queries, catalogue.stock)
    candidates = search_candidates(parsed, centroids, whole, catalogue.vectors, limit)
    lists = parsed.select(F.col("cache_key").alias("list_id"), F.lit(UNKNOWN).alias("age_band")).distinct()
    if models is not None:
        texts = parsed.select("cache_key", "category_l1").distinct().join(centroids, "category_l1", "left")
        nothing = whole.select("centroid").scalar()
        users = texts.select(F.col("cache_key").alias("list_id"), F.coalesce("centroid", nothing).alias("user_vector"))
        intents = users.select(
            "list_id", F.lit(1).alias("intent_rank"), F.lit("search").alias("label"), F.lit(1.0).alias("weight"),
            F.col("user_vector").alias("vector"),
        )
        empty = catalogue.stock.select(
            F.lit("").alias("list_id"), "article_id", "category_l1", F.lit(None).cast("timestamp_ntz").alias("ts")
        ).filter(F.lit(False))
        candidates = model_order(candidates, empty, intents, catalogue, models, users)
    final, report = guardrails.apply_all(guardrail_rows(candidates, catalogue), lists, limit, embeddings=catalogue.embeddings)
    named = final.join(parsed.select(F.col("cache_key").alias("list_id"), "query"), "list_id")
    text = F.format_string("Matches your search for '%s'", F.col("query"))
    items = named.select(
        "query", "article_id", "position", "score", F.lit("SEARCH_MATCH").alias("reason_code"), text.alias("reason_text")
    )
    return {"items": items, "parsed": parsed, "report": report}


def session_search(
    requests: DataFrame,
    session: DataFrame,
    popular: DataFrame,
    centroids: DataFrame,
    whole: DataFrame,
    catalogue: Catalogue,
    limit: int = 20,
) -> dict[str, DataFrame]:
    """Lists for requests (list_id, query) of callers whose session (list_id, article_id) is known, at most `SESSION` rows
    each: what it holds is left out. A request whose search finds nothing takes best sellers at score 0, marked degraded.

    Requests of one category share a vector, so the search runs once per category, deep enough for any session, and its few
    rows, stored, meet the requests.
    """
    parsed = parse_queries(requests.select("query").distinct(), catalogue.stock)
    known = centroids.select(F.col("category_l1").alias("query_id"), F.col("centroid").alias("vector"))
    vectors = known.unionByName(whole.select(F.lit("").alias("query_id"), F.col("centroid").alias("vector")))
    found = durable(top_k(vectors, catalogue.vectors, limit * OVERFETCH + SESSION).drop("rank"))
    names = durable(known.select("query_id"))
    asked = requests.join(parsed.select("query", F.col("category_l1").alias("query_id")), "query")
    asked = asked.join(names.withColumn("_known", F.lit(True)), "query_id", "left")
    asked = asked.withColumn("query_id", F.when(F.col("_known"), F.col("query_id")).otherwise("")).drop("_known")
    seen = durable(session.select("list_id", "article_id").distinct())
    fresh = asked.join(found, "query_id").join(seen, ["list_id", "article_id"], "left_anti")
    best = newest(fresh, ["list_id"], [F.desc("score"), F.asc("article_id")], limit * OVERFETCH, "_place")
    hits = durable(best.select("list_id", "article_id", "score", F.lit(None).cast("string").alias("degraded")))
    empty = requests.select("list_id").join(hits.select("list_id").distinct(), "list_id", "left_anti")
    anyone = empty.select("list_id", F.lit(UNKNOWN).alias("region"), F.lit(UNKNOWN).alias("age_band"))
    rescued = popular_for(anyone, popular, limit * 3, "search").select(
        "list_id", "article_id", F.lit(0.0).alias("score"), F.lit("retrieval").alias("degraded")
    )
    lists = requests.select("list_id", F.lit(UNKNOWN).alias("age_band"))
    final, report = guardrails.apply_all(
        guardrail_rows(hits.unionByName(rescued), catalogue), lists, limit, seen, embeddings=catalogue.embeddings
    )
    text = F.format_string("Matches your search for '%s'", F.col("query"))
    items = final.join(requests, "list_id").select(
        "list_id", "query", "article_id", "position", "score", F.lit("SEARCH_MATCH").alias("reason_code"), text.alias("reason_text"), "degraded"
    )
    return {"items": items, "parsed": parsed, "report": report}


def log_rows(
    items: DataFrame, surface: str, served_at: Column, model_version: str, customer: Column | None = None, session: Column | None = None
) -> DataFrame:
    """Audit rows of served lists, one per item with its 0-based position. The request is named by its surface and list."""
    none = F.lit(None)
    return items.select(
        F.concat_ws(":", F.lit(surface), F.col("list_id").cast("string")).alias("request_id"),
        F.lit(surface).alias("surface"),
        (none if customer is None else customer).cast("bigint").alias("customer_id"),
        (none if session is None else session).cast("string").alias("session_id"),
        "article_id",
        F.col("position").alias("rank_position"),
        "score",
        "reason_code",
        F.lit(model_version).alias("model_version"),
        served_at.alias("served_at"),
    )
