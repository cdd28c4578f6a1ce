"""Named queries and the SQL each one is checked against."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import SQL_VIEWS
from .session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` may be left out where SQL cannot express it."""

    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def with_views(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """``body`` after a WITH clause of the named views (and further ``extra`` ones)."""
    needed = ["ev", *[v for v in SQL_VIEWS if v in views and v != "ev"]]
    parts = [f"{v} AS ({SQL_VIEWS[v]})" for v in needed]
    parts += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def sec(ts: str) -> str:
    return f"CAST(floor(epoch({ts})) AS BIGINT)"


def in_window(ts: str, dt: str, anchor_ts: str, anchor_dt: str, days: int, gap: int, grace: int = 600) -> str:
    return (
        f"{dt} <= {anchor_dt} AND datediff('day', {dt}, {anchor_dt}) <= {gap}"
        f" AND {sec(ts)} <= {sec(anchor_ts)} + {grace} AND {sec(anchor_ts)} - {sec(ts)} <= {days} * 86400"
    )


def good_device(column: str) -> str:
    return f"length({column}) >= 35 AND {column} NOT LIKE '%00000000-0000-0000-0000-000000000000%'"
