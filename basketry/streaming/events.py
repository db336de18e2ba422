"""Event streams: defaults, durable log, session state, rolling popularity and latency counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basketry.functions.columns import UNKNOWN, age_band, session_key
from basketry.operators.skew import newest
from basketry.session import scratch_path

# Fixed values
SESSION_EVENTS = 20
IDLE_SECONDS = 1800
WATERMARK = "10 minutes"
# Best sellers of the last hour are summed from panes of this length.
PANE_MINUTES = 10
LIVE_MINUTES = 60
# Folders of updates that are folded into one.
FAN = 8

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
STATE = "article_ids array<bigint>, micros array<bigint>, event_ids array<bigint>"
SESSION = "session_key string, events int, first_ts timestamp, last_ts timestamp, article_ids array<bigint>, expired boolean"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1000) -> DataFrame:
    """The events folder as a stream; the bound on files per trigger bounds what a micro-batch holds."""
    return (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("pathGlobFilter", "events*.parquet")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(sf_dir)
    )


def with_defaults(events: DataFrame) -> DataFrame:
    """Session events with price 0, category 'unknown', not discounted and the present time where missing.

    The key is the customer's, else the guest's session_id where the events carry one, else 'anonymous'.
    """
    guest = F.col("session_id") if "session_id" in events.columns else F.lit(None).cast("string")
    return events.select(
        "event_id",
        session_key(F.col("user_id").cast("string"), guest).alias("session_key"),
        F.col("article_id"),
        F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp()).alias("ts"),
        F.coalesce("price", F.lit(0.0)).alias("price"),
        F.coalesce("category_l1", F.lit(UNKNOWN)).alias("category_l1"),
        F.coalesce("discounted", F.lit(False)).alias("discounted"),
    )


def typed(events: DataFrame) -> DataFrame:
    """Views come without the optional fields."""
    full = F.col("event_type") != "view"
    return events.select(
        "event_id",
        "user_id",
        *[c for c in ("session_id",) if c in events.columns],
        "event_type",
        "ts",
        F.get_json_object("props", "$.k").cast("bigint").alias("article_id"),
        F.when(full, F.col("value")).alias("price"),
        F.when(full, F.col("event_type")).alias("category_l1"),
        F.when(full, F.col("value") < 5).alias("discounted"),
    )


def each_once(events: DataFrame) -> DataFrame:
    """Events (event_id, ts, ...) without those whose id came before, for repeats that arrive within the watermark.

    The first arrival stays; state holds the ids that the watermark has not passed. Events without an id all stay. Meant for the
    log that counts are read from; session state drops repeats by itself.
    """
    named = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)
    key = F.coalesce(F.col("event_id").cast("string"), F.concat(F.lit("-"), F.uuid()))
    return named.withColumn("_key", key).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def finish(query: StreamingQuery) -> None:
    """Wait until the stream has read all that was there; however long that takes."""
    query.awaitTermination()


def append_to(stream: DataFrame, label: str) -> str:
    """Run an append stream into a Parquet log; returns its path."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    started = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, f"{label}-progress"))
        .trigger(availableNow=True)
        .outputMode("append")
        .start(out)
    )
    finish(started)
    return out


def folds(count: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, last batch) of the tables to be made once `count` batches are in: level l holds fan**l batches."""
    return [(level, count) for level in range(1, 64) if fan**level <= count and count % fan**level == 0]


def cover(count: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, last batch) of the fewest tables that hold the first `count` batches."""
    out, upto, level = [], 0, 0
    while fan ** (level + 1) <= count:
        level += 1
    while level >= 0:
        if upto + fan**level <= count:
            upto += fan**level
            out.append((level, upto))
        else:
            level -= 1
    return out


def last_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the newest batch for each key, null keys included."""
    rest = [c for c in rows.columns if c not in keys and c != "_batch"]
    newest = F.max_by(F.struct(*rest), "_batch").alias("_last")
    return rows.groupBy(*keys).agg(newest, F.max("_batch").alias("_batch")).select(*keys, "_last.*", "_batch")


def update_to(stream: DataFrame, label: str, schema: str, keys: list[str], fan: int = FAN) -> DataFrame:
    """Run an update stream and return the last row of each key.

    A micro-batch writes its own updates alone, to a folder named by its number. Each `fan` folders are folded into one of the
    next level, which keeps the last row of each key, so a row is written once and again once per level, and a read
    meets fewer than `fan` folders of each. A replayed batch writes the same folders with the same rows. Folders that
    were folded stay until their parent folder goes.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    full = f"{schema}, _batch bigint"
    names = spark.createDataFrame([], schema).columns
    done: list[int] = []

    def read(parts: list[tuple[int, int]], session: SparkSession) -> DataFrame:
        return last_rows(session.read.schema(full).parquet(*[f"{out}/{level}/{end}" for level, end in parts]), keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        count = batch_id + 1
        rows = batch.select(*names, F.lit(batch_id).cast("bigint").alias("_batch"))
        rows.write.mode("overwrite").parquet(f"{out}/0/{count}")
        for level, end in folds(count, fan):
            size = fan ** (level - 1)
            parts = [(level - 1, end - k * size) for k in range(fan)]
            read(parts, batch.sparkSession).select(*names, "_batch").write.mode("overwrite").parquet(f"{out}/{level}/{end}")
        done.append(count)

    started = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, f"{label}-progress"))
        .trigger(availableNow=True)
        .outputMode("update")
        .start()
    )
    finish(started)
    return read(cover(done[-1], fan), spark).select(*names) if done else spark.createDataFrame([], schema)


def _newest_per_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side trim: only a key's newest events of a batch can be among its newest events of all."""
    for batch in batches:
        ordered = batch.drop_duplicates().sort_values(["ts", "event_id"])
        yield ordered.groupby("session_key", sort=False).tail(SESSION_EVENTS)


def _keep_session(idle_seconds: int):
    idle = idle_seconds * 1_000_000

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(
                {"session_key": [key[0]], "events": [0], "first_ts": [pd.NaT], "last_ts": [pd.NaT], "article_ids": [[]], "expired": [True]}
            )
            return
        held = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            micros = batch["ts"].astype("datetime64[us]").astype("int64")
            held += list(zip(batch["article_id"].tolist(), micros.tolist(), batch["event_id"].tolist()))
            held = sorted(dict.fromkeys(held), key=lambda e: (e[1], e[2]), reverse=True)[:SESSION_EVENTS]
        # The newest events are all kept, since a late one may yet join them; only what is given out is cut to the session.
        session = held[:1]
        for event in held[1:]:
            if session[-1][1] - event[1] > idle:
                break
            session.append(event)
        state.update(tuple(list(c) for c in zip(*held)))
        articles, micros, _ = (list(c) for c in zip(*session))
        state.setTimeoutTimestamp(max(micros[0] // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        stamps = pd.to_datetime([micros[-1], micros[0]], unit="us", utc=True)
        yield pd.DataFrame(
            {
                "session_key": [key[0]],
                "events": [len(session)],
                "first_ts": [stamps[0]],
                "last_ts": [stamps[1]],
                "article_ids": [articles],
                "expired": [False],
            }
        )

    return keep


def session_state(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Newest-first events of each key's current session, at most 20; ended by `idle_seconds` without an event.

    events (session_key, article_id, ts, event_id). A busy key is trimmed in every map task before the shuffle, and
    its state never holds more than its 20 newest events. An event that comes late, but within the watermark, joins what it
    lies between. One that comes again counts once, however late: it is among those held, or older than all of them.
    """
    slim = events.select("session_key", "article_id", "ts", "event_id")
    trimmed = slim.mapInPandas(_newest_per_key, slim.schema).withWatermark("ts", WATERMARK)
    return trimmed.groupBy("session_key").applyInPandasWithState(
        _keep_session(idle_seconds), SESSION, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def rolling_popularity(events: DataFrame, window: str = "1 hour") -> DataFrame:
    counted = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", window), "article_id")
    return counted.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "article_id", "n")


def segment_panes(events: DataFrame, users: DataFrame, pane_minutes: int = PANE_MINUTES) -> DataFrame:
    """Events per pane of time, region, age band and article: a stream (ts, user_id, article_id) beside a static table.

    Customers that the table lacks count under 'unknown'. Counts combine map-side, and state holds the panes that the
    watermark has not passed.
    """
    who = users.select(F.col("customer_id").alias("user_id"), "region", age_band(F.col("age")).alias("age_band"))
    placed = events.select("user_id", "article_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", WATERMARK)
    segment = [F.coalesce(c, F.lit(UNKNOWN)).alias(c) for c in ("region", "age_band")]
    counted = placed.join(who, "user_id", "left").groupBy(F.window("ts", f"{pane_minutes} minutes"), *segment, "article_id")
    return counted.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("pane"), "region", "age_band", "article_id", "n"
    )


def best_sellers(
    panes: DataFrame, limit: int, pane_minutes: int = PANE_MINUTES, live_minutes: int = LIVE_MINUTES
) -> DataFrame:
    """The `limit` best sellers of each segment at the end of every pane: (as_of, region, age_band, article_id, n, rank).

    A pane counts for `live_minutes` and is gone afterwards; a segment without a live pane has no row. ('unknown',
    'unknown') holds everybody. Exact: what is summed is one row per pane, segment and article, whatever the events. Equal
    counts go to the smaller article.
    """
    ends = [F.make_dt_interval(mins=F.lit(m)) for m in range(pane_minutes, live_minutes + 1, pane_minutes)]
    lived = panes.withColumn("as_of", F.explode(F.array(*[F.col("pane") + e for e in ends])))
    return _ranked(lived, limit)


def live_best_sellers(
    panes: DataFrame, limit: int, pane_minutes: int = PANE_MINUTES, live_minutes: int = LIVE_MINUTES
) -> DataFrame:
    """As `best_sellers`, at the end of the newest pane alone."""
    now = panes.select(F.max("pane")).scalar() + F.make_dt_interval(mins=F.lit(pane_minutes))
    lived = panes.withColumn("as_of", now)
    return _ranked(lived.filter(F.col("pane") >= F.col("as_of") - F.make_dt_interval(mins=F.lit(live_minutes))), limit)


def _ranked(lived: DataFrame, limit: int) -> DataFrame:
    counted = lived.groupBy("as_of", "region", "age_band", "article_id").agg(F.sum("n").alias("n"))
    everybody = counted.groupBy("as_of", "article_id").agg(F.sum("n").alias("n"))
    whole = everybody.select("as_of", F.lit(UNKNOWN).alias("region"), F.lit(UNKNOWN).alias("age_band"), "article_id", "n")
    named = counted.filter((F.col("region") != UNKNOWN) | (F.col("age_band") != UNKNOWN))
    return newest(
        named.unionByName(whole), ["as_of", "region", "age_band"], [F.desc("n"), F.asc("article_id")], limit, "rank"
    )


def latency_counters(requests: DataFrame) -> DataFrame:
    return requests.groupBy("stage").agg(F.count(F.lit(1)).alias("latency_count"), F.sum("millis").alias("latency_sum"))
