"""Scans, sinks, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import columns as C
from basketry.operators import reports, sampling, sequences
from basketry.operators.sampling import SampleSpec
from basketry.plans.registry import query, remembered, shared, view
from basketry.session import scratch_path
from basketry.sources import files
from basketry.sources import tables as T

# Sample sizes scaled to the test data: two years, the last 90 days held out, the densest customers and articles.
SPEC = SampleSpec(weeks=104, val_days=90, n_customers=1000, min_support=5, n_articles=1200)

view("recent", ("tx",), "SELECT * FROM tx WHERE t_dat >= (SELECT max(t_dat) FROM tx) - 728")
view(
    "top_customers",
    ("recent",),
    "SELECT customer_id, count(*) AS n_tx FROM recent GROUP BY 1 ORDER BY n_tx DESC, customer_id LIMIT 1000",
)
view("by_customers", ("recent", "top_customers"), "SELECT r.* FROM recent r SEMI JOIN top_customers USING (customer_id)")
view(
    "top_articles",
    ("by_customers",),
    """SELECT article_id, count(*) AS n_tx FROM by_customers GROUP BY 1 HAVING count(*) >= 5
       ORDER BY n_tx DESC, article_id LIMIT 1200""",
)
view("sampled", ("by_customers", "top_articles"), "SELECT b.* FROM by_customers b SEMI JOIN top_articles USING (article_id)")
view("s_train", ("sampled", "tx"), "SELECT * FROM sampled WHERE t_dat < (SELECT max(t_dat) FROM tx) - 89")
view("s_val", ("sampled", "tx"), "SELECT * FROM sampled WHERE t_dat >= (SELECT max(t_dat) FROM tx) - 89")
view(
    "s_items",
    ("articles", "top_articles"),
    "SELECT a.*, t.n_tx AS n_interactions FROM articles a JOIN top_articles t USING (article_id)",
)
view("s_users", ("banded", "top_customers"), "SELECT b.* FROM banded b SEMI JOIN top_customers USING (customer_id)")
view("train", ("tx",), "SELECT * FROM tx WHERE t_dat < (SELECT max(t_dat) FROM tx) - 89")
view("val", ("tx",), "SELECT * FROM tx WHERE t_dat >= (SELECT max(t_dat) FROM tx) - 89")


def samples(spark, sf):
    tx = T.transactions(spark, sf)
    return sampling.build_samples(tx, T.articles(spark, sf), T.users(spark, sf), SPEC)


def purchases(spark, sf):
    """The purchases, joined once for all parts of a query that read them."""
    return T.priced(shared("purchases", sf, lambda: T.transactions(spark, sf).drop("price")))


def first_val_day(spark, sf, days):
    """The first of the last `days` days; one small value."""
    last = remembered("last day", sf, lambda: purchases(spark, sf).agg(F.max("t_dat")).first()[0])
    return F.date_sub(F.lit(last).cast("date"), days - 1)


def split(spark, sf):
    tx, start = purchases(spark, sf), first_val_day(spark, sf, SPEC.val_days)
    return tx.filter(F.col("t_dat") < start), tx.filter(F.col("t_dat") >= start)


def newest_purchases(spark, sf):
    """(customer_id, article_id) of each customer's newest train purchases, ranked once for all parts of a query."""
    return newest_aged(spark, sf).select("customer_id", "article_id")


def newest_rows(spark, sf):
    """The newest train purchases with all that is known of them. A query that reads more than `newest_aged` has asks for these
    first: then they are ranked once for both."""
    found = shared("newest purchases", sf, lambda: sequences.last_rows(split(spark, sf)[0]))
    return found if "t_dat" in found.columns else sequences.last_rows(split(spark, sf)[0])


def newest_aged(spark, sf):
    """The same with their place, 1 for the newest."""
    columns = ("customer_id", "article_id", "age")
    return shared("newest purchases", sf, lambda: sequences.last_rows(split(spark, sf)[0]).select(*columns)).select(*columns)


@query(
    "A1_csv_scan",
    "SELECT customer_id::VARCHAR AS customer_id, article_id, t_dat, price FROM tx",
    "tx",
)
def a1(spark, sf):
    path = scratch_path(spark, "transactions-csv")
    tx = T.transactions(spark, sf).select(
        F.date_format("t_dat", "yyyy-MM-dd").alias("t_dat"), "customer_id", "article_id", "price"
    )
    files.write_csv(tx, path)
    return files.scan_transactions(spark, path)


@query(
    "A2_parquet_scan",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total FROM orders
       WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderstatus = 'F'""",
)
def a2(spark, sf):
    orders = T.table(spark, sf, "orders")
    late = F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    return orders.filter(late & (F.col("o_orderstatus") == "F")).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("total")
    )


REPORT_SQL = """SELECT 'train' AS frame, count(*) AS n_rows, min(t_dat) AS first_day, max(t_dat) AS last_day FROM s_train
    UNION ALL SELECT 'val', count(*), min(t_dat), max(t_dat) FROM s_val
    UNION ALL SELECT 'items', count(*), NULL, NULL FROM s_items
    UNION ALL SELECT 'users', count(*), NULL, NULL FROM s_users"""


@query(
    "A3_parquet_sink",
    """SELECT 'train' AS frame, customer_id, article_id, t_dat, price AS amount, '' AS detail FROM s_train
       UNION ALL SELECT 'val', customer_id, article_id, t_dat, price, '' FROM s_val
       UNION ALL SELECT 'items', NULL, article_id, NULL, n_interactions, prod_name || '|' || category_l1 || '|' || dept FROM s_items
       UNION ALL SELECT 'users', customer_id, NULL, NULL, NULL, region || '|' || club_status || '|' || age_band FROM s_users""",
    "s_train s_val s_items s_users",
)
def a3(spark, sf):
    path = scratch_path(spark, "samples")
    files.write_frames(samples(spark, sf), path)
    read = files.read_frames(spark, path, ["train", "val", "items", "users"])
    long, day = F.lit(None).cast("bigint"), F.lit(None).cast("date")

    def rows(frame, customer, article, at, amount, *detail):
        return read[frame].select(
            F.lit(frame).alias("frame"), customer.alias("customer_id"), article.alias("article_id"), at.alias("t_dat"),
            amount.cast("double").alias("amount"), F.concat_ws("|", *detail).alias("detail"),
        )

    col = F.col
    return (
        rows("train", col("customer_id"), col("article_id"), col("t_dat"), col("price"))
        .unionByName(rows("val", col("customer_id"), col("article_id"), col("t_dat"), col("price")))
        .unionByName(rows("items", long, col("article_id"), day, col("n_interactions"), "prod_name", "category_l1", "dept"))
        .unionByName(rows("users", col("customer_id"), long, day, long, "region", "club_status", "age_band"))
    )


@query(
    "A4_metrics_upsert",
    """SELECT endpoint AS model, round(avg(response_time_ms), 6) AS value FROM requests
         WHERE endpoint NOT IN (SELECT DISTINCT endpoint FROM requests WHERE NOT success) GROUP BY 1
       UNION ALL
       SELECT endpoint, round(max(response_time_ms), 6) FROM requests WHERE NOT success GROUP BY 1""",
    "requests",
)
def a4(spark, sf):
    log = T.requests(spark, sf).withColumnRenamed("endpoint", "model")
    old = log.groupBy("model").agg(F.round(F.avg("response_time_ms"), 6).alias("value"))
    new = log.filter(~F.col("success")).groupBy("model").agg(F.round(F.max("response_time_ms"), 6).alias("value"))
    path = scratch_path(spark, "metrics")
    old.write.parquet(f"{path}/v1")
    reports.upsert_metrics(spark.read.parquet(f"{path}/v1"), new).write.parquet(f"{path}/v2")
    return spark.read.parquet(f"{path}/v2")


@query(
    "A5_dataset_profile",
    """SELECT c AS "column", count(*) AS n_rows, count(*) - count(v) AS nulls, round(avg(v), 6) AS mean,
         round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
         round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
         round(quantile_cont(v, 0.75), 6) AS q75
       FROM (SELECT 'price' AS c, CAST(price AS DOUBLE) AS v FROM tx
             UNION ALL SELECT 'quantity', CAST(quantity AS DOUBLE) FROM tx
             UNION ALL SELECT 'article_id', CAST(article_id AS DOUBLE) FROM tx
             UNION ALL SELECT 'age', CAST(age AS DOUBLE) FROM tx LEFT JOIN users USING (customer_id)) GROUP BY 1""",
    "tx users",
)
def a5(spark, sf):
    ages = T.users(spark, sf).select("customer_id", "age")
    tx = T.transactions(spark, sf).join(ages, "customer_id", "left")
    return reports.profile(tx, ["price", "quantity", "article_id", "age"])


@query(
    "A5_shape_and_types",
    """SELECT position::INTEGER AS position, "column", type, (SELECT count(*) FROM tx) AS n_rows, 7 AS n_columns FROM (VALUES
         (0, 'order_id', 'bigint'), (1, 'article_id', 'bigint'), (2, 'line_no', 'int'), (3, 'paid', 'double'), (4, 'quantity', 'double'),
         (5, 'price', 'double'), (6, 'customer_id', 'bigint')) t(position, "column", type)""",
    "tx",
)
def a5_shape(spark, sf):
    names = ["order_id", "article_id", "line_no", "paid", "quantity", "price", "customer_id"]
    return reports.shape_and_types(T.transactions(spark, sf).select(*names))


@query(
    "A5_head",
    """SELECT order_id, line_no, customer_id, article_id, round(paid, 6) AS paid FROM tx ORDER BY order_id, line_no, article_id, paid LIMIT 5""",
    "tx",
)
def a5_head(spark, sf):
    rows = reports.head(T.transactions(spark, sf), ["order_id", "line_no", "article_id", "paid"])
    return rows.select("order_id", "line_no", "customer_id", "article_id", F.round("paid", 6).alias("paid"))


@query("A6_split_report", REPORT_SQL, "s_train s_val s_items s_users")
def a6(spark, sf):
    return reports.split_report(samples(spark, sf))


@query(
    "A7_event_decode",
    """SELECT event_id, article_id, ts, CASE WHEN event_type = 'view' THEN 0.0 ELSE price END AS price,
         CASE WHEN event_type = 'view' THEN 'unknown' ELSE coalesce(category_l1, 'unknown') END AS category_l1,
         CASE WHEN event_type = 'view' THEN false ELSE discounted END AS discounted
       FROM clicks WHERE event_type <> 'error'""",
    "clicks",
)
def a7(spark, sf):
    # Views arrive without the optional fields, error events as broken text.
    full = F.to_json(
        F.struct(
            "article_id",
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            F.when(F.col("event_type") != "view", F.col("price")).alias("price"),
            F.when(F.col("event_type") != "view", F.col("category_l1")).alias("category_l1"),
            F.when(F.col("event_type") != "view", F.col("discounted")).alias("discounted"),
        )
    )
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), full)).otherwise(full)
    return files.decode_events(T.clicks(spark, sf).select("event_id", raw.alias("raw")))


@query(
    "A9_request_log_csv",
    """SELECT endpoint AS name, response_time_ms, CASE WHEN success THEN 'True' ELSE 'False' END AS success
       FROM requests""",
    "requests",
)
def a9(spark, sf):
    path = scratch_path(spark, "request-log")
    log = T.requests(spark, sf).select(
        F.col("endpoint").alias("name"),
        "response_time_ms",
        F.when(F.col("success"), "True").otherwise("False").alias("success"),
    )
    files.write_csv(log, path)
    return files.read_csv(spark, path, files.REQUEST_LOG_CSV)


@query("B1_age_band", "SELECT customer_id, age_band FROM banded", "banded")
def b1(spark, sf):
    return T.users(spark, sf).select("customer_id", C.age_band(F.col("age")).alias("age_band"))


@query("B2_recent_window", "SELECT customer_id, article_id, t_dat FROM tx WHERE t_dat >= (SELECT max(t_dat) FROM tx) - 112", "tx")
def b2(spark, sf):
    return sampling.recent(T.transactions(spark, sf), 16).select("customer_id", "article_id", "t_dat")


@query(
    "B3_time_split",
    """SELECT 'train' AS part, customer_id, article_id, t_dat FROM tx WHERE t_dat < (SELECT max(t_dat) FROM tx) - 6
       UNION ALL SELECT 'val', customer_id, article_id, t_dat FROM tx WHERE t_dat >= (SELECT max(t_dat) FROM tx) - 6""",
    "tx",
)
def b3(spark, sf):
    # Both parts come from one scan; sampling.split gives them apart.
    part = F.when(F.col("t_dat") < first_val_day(spark, sf, 7), "train").otherwise("val")
    return purchases(spark, sf).select(part.alias("part"), "customer_id", "article_id", "t_dat")


@query(
    "B4_item_projection",
    """SELECT article_id, substr(coalesce(prod_name, '') || ' ' || coalesce(CASE WHEN size > 10 THEN category_l2 END, ''),
         1, 200) AS title, category_l1, category_l2, colour, dept FROM articles""",
    "articles",
)
def b4(spark, sf):
    # Small articles carry no description in the test data.
    description = F.when(F.col("size") > 10, F.col("category_l2"))
    return T.articles(spark, sf).select(
        "article_id", C.title(F.col("prod_name"), description).alias("title"), "category_l1", "category_l2", "colour", "dept"
    )


@query(
    "B5_user_projection",
    """SELECT customer_id, age_band, substr(region, 1, 2) AS region, club_status FROM banded""",
    "banded",
)
def b5(spark, sf):
    return T.users(spark, sf).select(
        "customer_id", C.age_band(F.col("age")).alias("age_band"), C.region_of(F.col("region")).alias("region"), "club_status"
    )


@query(
    "B6_null_fill",
    """SELECT event_id, coalesce(category_l1, 'unknown') AS category_l1,
         coalesce(CASE WHEN discounted THEN event_type END, 'unknown') AS event_type FROM clicks""",
    "clicks",
)
def b6(spark, sf):
    sparse = F.when(F.col("discounted"), F.col("event_type"))
    return (
        T.clicks(spark, sf)
        .select("event_id", "category_l1", sparse.alias("event_type"))
        .fillna(C.UNKNOWN, ["category_l1", "event_type"])
    )


@query(
    "B7_session_key",
    """SELECT event_id, 'sess:' || coalesce(nullif(CASE WHEN event_type = 'view' THEN '' WHEN event_type <> 'error'
         THEN user_id::VARCHAR END, ''), nullif(CASE WHEN event_type = 'view' THEN 's' || user_id ELSE '' END, ''),
         'anonymous') AS session_key FROM clicks""",
    "clicks",
)
def b7(spark, sf):
    kind = F.col("event_type")
    user = F.when(kind == "view", "").when(kind != "error", F.col("user_id").cast("string"))
    session = F.when(kind == "view", F.concat(F.lit("s"), F.col("user_id"))).otherwise("")
    return T.clicks(spark, sf).select("event_id", C.session_key(user, session).alias("session_key"))


@query(
    "B8_context_default",
    """SELECT customer_id, coalesce(nullif(CASE WHEN club_status = 'MACHINERY' THEN '' ELSE region END, ''), 'unknown')
         AS region, coalesce(CASE WHEN age_band <> 'unknown' THEN age_band END, 'unknown') AS age_band FROM banded""",
    "banded",
)
def b8(spark, sf):
    region = F.when(F.col("club_status") == "MACHINERY", "").otherwise(F.col("region"))
    band = F.when(F.col("age").isNotNull(), C.age_band(F.col("age")))
    return T.users(spark, sf).select(
        "customer_id", C.or_default(region, C.UNKNOWN).alias("region"), C.or_default(band, C.UNKNOWN).alias("age_band")
    )


@query("B9_successful_requests", "SELECT request_id, response_time_ms FROM requests WHERE endpoint = 'view' AND success", "requests")
def b9(spark, sf):
    log = T.requests(spark, sf)
    return log.filter((F.col("endpoint") == "view") & F.col("success")).select("request_id", "response_time_ms")


@query(
    "H1_strings",
    """SELECT query, lower(trim(query)) AS folded, replace(query, ' ', '_') AS joined, substr(query, 1, 5) AS first_five,
         'Matches your search for ''' || query || '''' AS reason FROM search_q""",
    "search_q",
)
def h1(spark, sf):
    q = F.col("query")
    return T.search_queries(spark, sf).select(
        "query",
        F.lower(F.trim(q)).alias("folded"),
        F.replace(q, F.lit(" "), F.lit("_")).alias("joined"),
        F.substring(q, 1, 5).alias("first_five"),
        F.format_string("Matches your search for '%s'", q).alias("reason"),
    )


@query(
    "H2_tokenise",
    """SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token
       FROM documents) GROUP BY 1""",
)
def h2(spark, sf):
    docs = T.table(spark, sf, "documents")
    return docs.select(F.explode(C.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("H3_query_cache_key", "SELECT DISTINCT 'qcache:' || sha1(lower(trim(query))) AS cache_key FROM search_q", "search_q")
def h3(spark, sf):
    return T.search_queries(spark, sf).select(C.query_cache_key(F.col("query")).alias("cache_key")).distinct()


@query(
    "H4_date_difference",
    """SELECT order_id, greatest(0, (SELECT max(t_dat) FROM train) - t_dat)::INTEGER AS days_ago,
         strftime(t_dat, '%Y-%m-%dT00:00:00') AS iso, CAST(t_dat AS TIMESTAMP) AS midnight FROM tx""",
    "train",
)
def h4(spark, sf):
    train, _ = split(spark, sf)
    now = sampling.last_day(train)
    return T.transactions(spark, sf).select(
        "order_id",
        C.days_between(now, F.col("t_dat")).alias("days_ago"),
        F.date_format("t_dat", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.col("t_dat").cast("timestamp_ntz").alias("midnight"),
    )


@query(
    "H5_truncate",
    """SELECT doc_id, CASE WHEN length(t) > 40 THEN substr(t, 1, 39) || '…' ELSE t END AS shown
       FROM (SELECT doc_id, coalesce(nullif(text, ''), 'Unknown item') AS t FROM documents)""",
)
def h5(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", C.truncate(F.col("text")).alias("shown"))
