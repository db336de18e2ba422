"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
ADULT_AGE_BANDS = ("18_25", "26_35", "36_50", "over_50")
UNKNOWN = "unknown"
TITLE_CHARS = 200
COLD_START = "cold_start"


def age_band(age: Column) -> Column:
    return (
        F.when(age.isNull(), UNKNOWN)
        .when(age < 18, "under_18")
        .when(age <= 25, "18_25")
        .when(age <= 35, "26_35")
        .when(age <= 50, "36_50")
        .otherwise("over_50")
    )


def title(name: Column, description: Column) -> Column:
    empty = F.lit("")
    return F.substring(F.concat(F.coalesce(name, empty), F.lit(" "), F.coalesce(description, empty)), 1, TITLE_CHARS)


def region_of(postal_code: Column) -> Column:
    return F.substring(postal_code, 1, 2)


def or_default(value: Column, default: str) -> Column:
    """An empty string counts as missing."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def session_key(user_id: Column, session_id: Column) -> Column:
    chosen = F.coalesce(F.nullif(user_id, F.lit("")), F.nullif(session_id, F.lit("")), F.lit("anonymous"))
    return F.concat(F.lit("sess:"), chosen)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def query_cache_key(text: Column) -> Column:
    return F.concat(F.lit("qcache:"), F.sha1(F.lower(F.trim(text))))


def truncate(text: Column, length: int = 40) -> Column:
    shown = F.coalesce(F.nullif(text, F.lit("")), F.lit("Unknown item"))
    return F.when(F.length(shown) > length, F.concat(F.substring(shown, 1, length - 1), F.lit("…"))).otherwise(shown)


def days_between(later: Column, earlier: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(later, earlier))


def uniform(*parts: Column) -> Column:
    """A repeatable draw in [0, 1) from the md5 of the joined parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def minutes_between(later: Column, earlier: Column) -> Column:
    # Through TIMESTAMP, because event columns may be read without a time zone.
    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    return (micros(later) - micros(earlier)) / F.lit(60e6)


def dcg_term(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1))


def ideal_dcg(n_relevant: Column, k: int) -> Column:
    ranks = F.sequence(F.lit(1), F.least(n_relevant.cast("int"), F.lit(k)))
    return F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + dcg_term(r))


def entropy_term(share: Column) -> Column:
    return -share * F.log2(share)


def reason_code(intent: Column, category_matches: Column) -> Column:
    return (
        F.when(intent == COLD_START, "POPULAR").when(category_matches > 0, "SESSION_AFFINITY").otherwise("INTENT_MATCH")
    )


def reason_text(intent: Column, category_matches: Column) -> Column:
    return (
        F.when(intent == COLD_START, F.lit("Trending with shoppers like you"))
        .when(category_matches > 0, F.format_string("Because you interacted with %d similar items", category_matches))
        .otherwise(F.format_string("Matches your %s intent", F.replace(intent, F.lit("_"), F.lit(" "))))
    )
