"""Query registry: a Spark callable, its SQL twin, and the operators it covers."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundgrid.functions.scalar import rounded


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a query under its function name."""

    def wrap(fn):
        REGISTRY[fn.__name__] = Query(fn, expand(sql) if sql else None, tuple(covers.split()))
        return fn

    return wrap


def expand(sql: str) -> str:
    """R6(x) -> rounding to six places without a negative zero (any digit)."""
    out, i = [], 0
    while i < len(sql):
        if sql[i] == "R" and sql[i + 1 : i + 2].isdigit() and sql[i + 2 : i + 3] == "(" and not (i and (sql[i - 1].isalnum() or sql[i - 1] == "_")):
            depth, j = 1, i + 3
            while depth:
                depth += (sql[j] == "(") - (sql[j] == ")")
                j += 1
            out.append(f"(round({expand(sql[i + 3 : j - 1])}, {sql[i + 1]}) + 0.0)")
            i = j
        else:
            out.append(sql[i])
            i += 1
    return "".join(out)


def rnd(c: Column | str, digits: int = 6) -> Column:
    return rounded(F.col(c) if isinstance(c, str) else c, digits)
