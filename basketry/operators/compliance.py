"""Consent history, routing, erasure and access export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import age_band
from basketry.operators.skew import HOT_ROWS, newest, ordered_window

PERSONALIZATION = "personalization"


def consent_history(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each record closes the open one of the same customer and purpose, also when it withdraws consent."""
    return ordered_window(
        events,
        ["customer_id", "purpose"],
        ["granted_at", "event_id"],
        lambda w: {"revoked_at": F.lead("granted_at").over(w)},
        after=1,
        hot_rows=hot_rows,
    ).drop("seq")


def current_consent(events: DataFrame) -> DataFrame:
    order = [F.desc("granted_at"), F.desc("event_id")]
    return newest(events, ["customer_id", "purpose"], order, 1).drop("age")


def routes(users: DataFrame, events: DataFrame, purpose: str = PERSONALIZATION) -> DataFrame:
    """'personalized' only with a standing consent for the purpose and not for minors; otherwise 'popular'."""
    agreed = current_consent(events).filter((F.col("purpose") == purpose) & F.col("granted")).select("customer_id")
    marked = users.join(agreed.withColumn("_agreed", F.lit(True)), "customer_id", "left")
    band = age_band(F.col("age"))
    return marked.select(
        "customer_id",
        band.alias("age_band"),
        F.coalesce("_agreed", F.lit(False)).alias("consented"),
        F.when(F.col("_agreed") & (band != "under_18"), "personalized").otherwise("popular").alias("route"),
    )


def erase(requests: DataFrame, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New versions of users, consent, sessions and log with the asked customers gone, the tombstones and receipts.

    Log rows stay for audit without the customer. A receipt id depends on the customer alone, so a task that runs
    again gives the same one.
    """
    gone = requests.select("customer_id").distinct()
    marked = frames["log"].join(gone.withColumn("_gone", F.lit(True)), "customer_id", "left")
    log = marked.withColumn("customer_id", F.when(F.col("_gone").isNull(), F.col("customer_id"))).drop("_gone")
    return {
        "users": frames["users"].join(gone, "customer_id", "left_anti"),
        "consent": frames["consent"].join(gone, "customer_id", "left_anti"),
        "sessions": frames["sessions"].join(gone, "customer_id", "left_anti"),
        "log": log.select(*frames["log"].columns),
        "tombstones": frames["tombstones"].select("customer_id").union(gone).distinct(),
        "receipts": gone.select("customer_id", F.md5(F.concat(F.lit("erase|"), F.col("customer_id").cast("string"))).alias("receipt_id")),
    }


def without_erased(tx: DataFrame, tombstones: DataFrame) -> DataFrame:
    return tx.join(tombstones, "customer_id", "left_anti")


def access_export(session_events: DataFrame, consent: DataFrame, log: DataFrame, latest: int = 100) -> DataFrame:
    """Everything held on each customer as rows (customer_id, section, at, detail), the newest log rows only.

    Rows rather than one nested record, since a customer's consent history has no bound.
    """

    def section(name: str, df: DataFrame, at: str, *detail: str) -> DataFrame:
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in detail])
        return df.select("customer_id", F.lit(name).alias("section"), F.col(at).alias("at"), text.alias("detail"))

    recent = newest(log, ["customer_id"], [F.desc("served_at"), F.desc("request_id"), F.asc("rank_position"), F.asc("article_id")], latest)
    return (
        section("session_events", session_events, "ts", "article_id", "category_l1")
        .unionByName(section("consent", consent, "granted_at", "purpose", "granted"))
        .unionByName(section("recommendation_log", recent, "served_at", "article_id", "rank_position", "reason_code", "model_version"))
    )
