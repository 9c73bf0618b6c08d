"""Every operator as a query over the given tables, most with a second opinion in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that must agree with it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from memloom.session import configure

            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return run

    return add


def sql_uuid5(namespace: bytes, name: str) -> str:
    """SQL text of a version-5 UUID of the SQL text ``name``."""
    h = f"sha1(unhex('{namespace.hex()}') || encode({name}))"
    return (
        f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||"
        f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)"
        f"||'-'||substr({h},21,12))"
    )


from memloom.plans.catalog import (  # noqa: E402,F401
    browser, checks, deltas, feeds, files, notes, profiles, retention, scalars, search, snapshots,
)
