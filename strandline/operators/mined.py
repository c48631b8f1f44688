"""Mined factors: nested expressions over a dense panel, planned so that equal parts and equal windows are worked out once.

An expression is a field's name, a number, or a tuple (function, arguments ...), for instance
("cs_rank", ("ts_mean", "close", 5)). Spark takes no window function inside another, so expressions are cut where one
rolling or cross-sectional function stands in another, and the parts are worked out in turns: all rolling parts that are
ready, however deep, share one exchange and one sort by instrument; then all cross-sectional ones share one exchange by day.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import factors as f
from strandline.operators.signal import forward_return

Expr = str | int | float | tuple

#: Functions by where they look: along a name's rows, across a day's rows, or at one row.
ALONG: dict[str, Callable[..., Column]] = {n: getattr(f, n) for n in ("ts_mean", "ts_std", "ts_max", "ts_min", "ts_sum", "ts_delta", "ts_pctchange", "ts_rank", "ts_argmax", "ts_argmin", "ts_skew", "ts_kurt", "ts_decay_linear", "ts_corr")}
ACROSS: dict[str, Callable[..., Column]] = {n: getattr(f, n) for n in ("cs_rank", "cs_zscore", "cs_demean", "cs_winsorize")}
AT: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div_safe": f.div_safe, "coalesce": F.coalesce, "where": f.where,
    "neg": lambda x: -x, "abs": F.abs, "sign": F.signum, "log_safe": f.log_safe, "sqrt_safe": f.sqrt_safe,
}
COUNT = {**dict.fromkeys(ALONG, 2), "ts_corr": 3, **dict.fromkeys(ACROSS, 1), **dict.fromkeys(("add", "sub", "mul", "div_safe", "coalesce"), 2), "where": 3, **dict.fromkeys(("neg", "abs", "sign", "log_safe", "sqrt_safe"), 1)}


def from_json(text: str) -> Expr:
    """An expression from nested JSON lists."""

    def tuples(x: object) -> Expr:
        return tuple(tuples(y) for y in x) if isinstance(x, list) else x

    return checked(tuples(json.loads(text)))


def to_json(expr: Expr) -> str:
    return json.dumps(expr, separators=(",", ":"))


def checked(expr: Expr) -> Expr:
    """expr, if all its functions are known and have the arguments they need."""
    if isinstance(expr, tuple):
        if not expr or expr[0] not in COUNT:
            raise ValueError(f"unknown function in {expr!r}")
        if len(expr) - 1 != COUNT[expr[0]]:
            raise ValueError(f"{expr[0]} takes {COUNT[expr[0]]} arguments: {expr!r}")
        if expr[0] in ALONG and not (isinstance(expr[-1], int) and expr[-1] > 0):
            raise ValueError(f"{expr[0]} needs a positive number of rows: {expr!r}")
        for x in expr[1:]:
            checked(x)
    elif isinstance(expr, bool) or not isinstance(expr, str | int | float):
        raise ValueError(f"not an expression: {expr!r}")
    return expr


def fields_of(expr: Expr) -> set[str]:
    return {expr} if isinstance(expr, str) else set().union(*(fields_of(x) for x in expr[1:])) if isinstance(expr, tuple) else set()


def column_name(expr: Expr) -> str:
    """mf_ and 16 hex digits of the expression's hash."""
    return "mf_" + hashlib.sha256(to_json(expr).encode()).hexdigest()[:16]


def kind(part: tuple) -> str:
    return "along" if part[0] in ALONG else "across" if part[0] in ACROSS else "at"


def window_parts(exprs: Iterable[Expr]) -> dict[tuple, set[tuple]]:
    """Each distinct rolling or cross-sectional part, and the parts right inside it that must be there first."""
    found: dict[tuple, set[tuple]] = {}

    def inside(x: Expr) -> set[tuple]:
        """The outermost window parts of x, all of them noted."""
        if not isinstance(x, tuple):
            return set()
        below = set().union(*(inside(y) for y in x[1:]))
        if kind(x) == "at":
            return below
        found.setdefault(x, below)
        return {x}

    for x in exprs:
        inside(x)
    return found


def turns(exprs: Iterable[Expr]) -> list[tuple[str, list[list[tuple]]]]:
    """The order of work: turns (kind, levels), each level a list of parts that only need earlier ones. A turn is one exchange; of the two kinds to begin with, the one that needs fewer turns."""
    needs = window_parts(exprs)

    def plan(first: str) -> list[tuple[str, list[list[tuple]]]]:
        done: set[tuple] = set()
        out, now = [], first
        while len(done) < len(needs):
            levels = []
            while ready := [p for p, below in needs.items() if p not in done and kind(p) == now and below <= done]:
                levels.append(ready)
                done.update(ready)
            if levels:
                out.append((now, levels))
            now = "across" if now == "along" else "along"
        return out

    return min(plan("along"), plan("across"), key=len)


def evaluated(panel: DataFrame, exprs: Mapping[str, Expr], keep: Sequence[str] = ("datetime", "instrument")) -> DataFrame:
    """panel's columns `keep` and a double column for each named expression.

    panel is dense: a row for each day and name. A field that is missing is an error; rows with null fields stay.
    """
    for name, x in exprs.items():
        if gone := sorted(fields_of(checked(x)) - set(panel.columns)):
            raise ValueError(f"{name}: the panel has no {', '.join(gone)}")
    names: dict[tuple, str] = {}

    def column(x: Expr, own: bool = False) -> Column:
        if isinstance(x, str):
            return F.col(x)
        if not isinstance(x, tuple):
            return F.lit(float(x))
        if x in names and not own:
            return F.col(names[x])
        if x[0] in ALONG:
            return ALONG[x[0]](*[column(y) for y in x[1:-1]], x[-1])
        return (ACROSS | AT)[x[0]](*[column(y) for y in x[1:]])

    fields = sorted(set().union(*(fields_of(x) for x in exprs.values())) - set(keep))
    out = panel.select(*keep, *fields)
    for _, levels in turns(exprs.values()):
        for parts in levels:
            new = {f"_part{len(names) + i}": column(p, own=True) for i, p in enumerate(parts)}
            out = out.withColumns(new)
            names.update(zip(parts, new, strict=True))
    return out.select(*keep, *[column(x).cast("double").alias(name) for name, x in exprs.items()])


def feature_matrix(panel: DataFrame, pool: Sequence[tuple[Expr, float]], horizon: int | None = 1, price: str = "close", refused: Iterable[str] = ()) -> DataFrame:
    """(datetime, instrument, mf_..., LABEL0): all factors of a pool (expression, fitness) over a dense panel, those of higher fitness first, ties by name.

    LABEL0 is the forward return over `horizon` rows, entered a row later, and shares the rolling turn; None leaves it out.
    `refused`: fields that this panel cannot prove to be known on the day, such as statements; a factor that uses one is an
    error, as are an empty pool and the same factor twice.
    """
    if not pool:
        raise ValueError("the pool is empty")
    exprs = {column_name(checked(x)): x for x, _ in sorted(pool, key=lambda e: (-e[1], column_name(e[0])))}
    if len(exprs) < len(pool):
        raise ValueError("the pool has a factor twice")
    if bad := sorted(n for n, x in exprs.items() if fields_of(x) & set(refused)):
        raise ValueError(f"factors that use refused fields: {', '.join(bad)}")
    if horizon is None:
        return evaluated(panel, exprs)
    # The label is taken first, in the order by instrument that the rolling parts then go on with.
    labelled = panel.withColumn("LABEL0", forward_return(F.col(price), horizon))
    return evaluated(labelled, exprs, ("datetime", "instrument", "LABEL0")).select("datetime", "instrument", *exprs, "LABEL0")


def pool_of(table: DataFrame, fitness: str = "fitness") -> list[tuple[Expr, float]]:
    """The pool (expression, fitness) of a table (expr as JSON lists, fitness). A plan is built from it, so it comes to the driver: a row for each factor."""
    return [(from_json(r["expr"]), r[fitness]) for r in table.select("expr", fitness).collect()]


def with_mined(base: DataFrame, features: DataFrame) -> DataFrame:
    """base's rows and columns with the mined columns; rows that only the mined side has go, a label of the mined side too."""
    mined = [c for c in features.columns if c.startswith("mf_")]
    if both := sorted(set(mined) & set(base.columns)):
        raise ValueError(f"columns on both sides: {', '.join(both)}")
    return base.join(features.select("datetime", "instrument", *mined), ["datetime", "instrument"], "left")
