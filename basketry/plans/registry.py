"""Named queries and the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from basketry.session import durable

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, tuple[str, str]] = {}

# The canonical views in SQL; a check names the ones it reads.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "tx": (
        (),
        """SELECT l_orderkey AS order_id, l_partkey AS article_id, l_linenumber AS line_no, l_extendedprice AS paid,
             l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_discount > 0.05 AS discounted,
             o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS t_dat
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "articles": (
        (),
        """SELECT p_partkey AS article_id, p_name AS prod_name, p_type AS category_l1, p_brand AS category_l2,
             split_part(p_name, ' ', 1) AS colour, 'D' || CAST(floor(p_size / 10) AS BIGINT) AS dept, p_size AS size,
             p_retailprice AS list_price, p_size > 5 AS in_stock, p_size >= 46 AS age_restricted FROM part""",
    ),
    "items": (
        ("tx", "articles"),
        """SELECT a.*, c.n_interactions FROM articles a
           LEFT JOIN (SELECT article_id, count(*) AS n_interactions FROM tx GROUP BY 1) c USING (article_id)""",
    ),
    "users": (
        (),
        """SELECT c_custkey AS customer_id,
             CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(10 + (c_custkey * 7) % 60 AS INTEGER) END AS age,
             r_name AS region, c_mktsegment AS club_status
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "banded": (
        ("users",),
        """SELECT customer_id, region, club_status, CASE WHEN age IS NULL THEN 'unknown' WHEN age < 18 THEN 'under_18'
             WHEN age <= 25 THEN '18_25' WHEN age <= 35 THEN '26_35' WHEN age <= 50 THEN '36_50' ELSE 'over_50' END
             AS age_band FROM users""",
    ),
    "vectors": ((), "SELECT vec_id AS article_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings"),
    "clicks": (
        ("articles",),
        """SELECT e.*, a.category_l1 FROM (SELECT event_id, user_id, event_type, ts,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS article_id, value AS price, value < 5 AS discounted
             FROM events) e LEFT JOIN articles a USING (article_id)""",
    ),
    "requests": (
        (),
        """SELECT event_id AS request_id, event_type AS endpoint, value AS response_time_ms,
             event_type <> 'error' AS success, ts FROM events""",
    ),
    "search_q": ((), "SELECT DISTINCT p_name AS query FROM part"),
    "consent_ev": (
        (),
        """SELECT user_id AS customer_id, CASE WHEN event_id % 2 = 0 THEN 'personalization' ELSE 'analytics' END
             AS purpose, event_type = 'signup' AS granted, ts AS granted_at, event_id
           FROM events WHERE event_type IN ('signup', 'error')""",
    ),
}


def view(name: str, needs: tuple[str, ...], body: str) -> None:
    VIEWS[name] = (needs, body)


def _ordered(names: tuple[str, ...], done: list[str]) -> list[str]:
    for name in names:
        _ordered(VIEWS[name][0], done)
        if name not in done:
            done.append(name)
    return done


def with_views(needs: tuple[str, ...], body: str) -> str:
    if not needs:
        return body
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in _ordered(needs, [])]
    if body.lstrip().upper().startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body.lstrip()[5:]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


# What the parts of one running query share; none outside of a query.
_RUN: ContextVar[dict | None] = ContextVar("run", default=None)


def shared(name: str, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A frame that several parts of a query read: worked out and stored once per run of the query."""
    held = _RUN.get()
    if held is None:
        return make()
    if (name, sf_dir) not in held:
        held[name, sf_dir] = durable(make())
    return held[name, sf_dir]


def remembered(name: str, sf_dir: str, make: Callable[[], object]):
    """The same for small values and fitted models, which are not stored."""
    held = _RUN.get()
    if held is None:
        return make()
    if (name, sf_dir) not in held:
        held[name, sf_dir] = make()
    return held[name, sf_dir]


@contextmanager
def together() -> Iterator[None]:
    """Queries run inside share what they have in common, as the parts of one query do."""
    token = _RUN.set({}) if _RUN.get() is None else None
    try:
        yield
    finally:
        if token is not None:
            _RUN.reset(token)


def _in_one_run(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with together():
            return fn(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None, needs: str = "") -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = _in_one_run(fn)
        if sql is not None:
            CHECKS[name] = (sql, needs)
        return QUERIES[name]

    return register


def checks() -> dict[str, str]:
    return {name: with_views(tuple(needs.split()), sql) for name, (sql, needs) in CHECKS.items()}
