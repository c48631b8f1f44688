"""Where the registered queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans import testviews as v

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Register a query with its SQL, which may use the test views; SQL that begins with + adds views of its own, with "+ recursive" ones that may refer to themselves."""
    own = sql.lstrip().removeprefix("+").lstrip()
    kind = "recursive " if own.startswith("recursive ") else ""

    def add(of: Query) -> Query:
        FOUND[name] = of
        SQL[name] = f"with {kind}{v.SQL}{',' if sql.lstrip().startswith('+') else ''} {own.removeprefix(kind)}"
        return of

    return add


def off_ties(x: Column) -> Column:
    """Rounded to 6 places, a little off: prices of 7 places end in 5, where engines and orders of summation round apart."""
    return F.round(x + 1e-9, 6)
