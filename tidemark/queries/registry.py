"""Registry of queries and of the SQL they are checked with.

Sums of doubles differ in the last digits between plans, so check values are rounded. ``snap`` rounds on a
grid that is shifted a little off the decimal ties (a mean of cents often lies exactly on one); the check
SQL may use ``snap(expression, digits)`` too, which is expanded here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
OFF_TIE = 0.1234567


def snap(c: Column | str, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(OFF_TIE * 10.0**-digits), digits)


def expand(sql: str) -> str:
    """Replace every ``snap(expression, digits)`` by plain SQL."""
    while (at := sql.find("snap(")) >= 0:
        depth, end = 0, at + 4
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
            end += 1
        body, digits = sql[at + 5 : end].rsplit(",", 1)
        d = int(digits)
        sql = f"{sql[:at]}round(({body}) + {OFF_TIE * 10.0**-d:.17e}::DOUBLE, {d}){sql[end + 1:]}"
    return sql


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn

    return register
