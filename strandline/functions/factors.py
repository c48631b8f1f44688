"""Factor functions: Column to Column, over a dense panel (datetime, instrument, ...).

A window reaches over rows of the dense calendar, so a suspended day (NULL) voids each window that holds it. Rolling
functions share one sort on (instrument, datetime), cross-sectional ones one exchange on datetime. NaN and
infinity never leave a function: they are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TINY = 1e-12


def by_time() -> Window:
    return Window.partitionBy("instrument").orderBy("datetime")


def last_rows(n: int) -> Window:
    return by_time().rowsBetween(1 - n, 0)


def full(x: Column, n: int, value: Column) -> Column:
    """value where all n rows of the window have x."""
    return F.when(F.count(x).over(last_rows(n)) == n, value)


def no_inf(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def div_safe(a: Column, b: Column) -> Column:
    return no_inf(F.when(F.abs(b) > TINY, a / b))


def sqrt_safe(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def log_safe(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def where(cond: Column, a: Column, b: Column) -> Column:
    return F.when(cond > 0, a).when(cond <= 0, b)


def ts_mean(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x).over(last_rows(n)))


def ts_std(x: Column, n: int) -> Column:
    return full(x, n, F.stddev_samp(x).over(last_rows(n)))


def ts_max(x: Column, n: int) -> Column:
    return full(x, n, F.max(x).over(last_rows(n)))


def ts_min(x: Column, n: int) -> Column:
    return full(x, n, F.min(x).over(last_rows(n)))


def ts_sum(x: Column, n: int) -> Column:
    return full(x, n, F.sum(x).over(last_rows(n)))


def ts_delta(x: Column, n: int) -> Column:
    return x - F.lag(x, n).over(by_time())


def ts_pctchange(x: Column, n: int) -> Column:
    return div_safe(x, F.lag(x, n).over(by_time())) - 1


def _values(x: Column, n: int) -> Column:
    return F.collect_list(x).over(last_rows(n))


def ts_rank(x: Column, n: int) -> Column:
    """(values not above the last, less one) / (n - 1); 0.5 where all are equal."""
    a = _values(x, n)
    share = (F.size(F.filter(a, lambda v: v <= F.element_at(a, -1))) - 1) / F.lit(max(1, n - 1))
    return full(x, n, F.when(F.max(x).over(last_rows(n)) == F.min(x).over(last_rows(n)), F.lit(0.5)).otherwise(share))


def ts_argmax(x: Column, n: int) -> Column:
    """Place of the first maximum, from 0 for the oldest row."""
    a = _values(x, n)
    return full(x, n, (F.array_position(a, F.array_max(a)) - 1).cast("double"))


def ts_argmin(x: Column, n: int) -> Column:
    a = _values(x, n)
    return full(x, n, (F.array_position(a, F.array_min(a)) - 1).cast("double"))


def safe_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson from sums; NULL where a side does not vary."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    flat = (vx <= F.lit(1e-9) * F.greatest(n * sxx, F.lit(TINY))) | (vy <= F.lit(1e-9) * F.greatest(n * syy, F.lit(TINY)))
    return F.when(~flat, (n * sxy - sx * sy) / (F.sqrt(F.when(~flat, vx)) * F.sqrt(F.when(~flat, vy))))


def ts_corr(x: Column, y: Column, n: int) -> Column:
    both = x + y
    x, y = F.when(both.isNotNull(), x), F.when(both.isNotNull(), y)
    sums = [F.sum(v).over(last_rows(n)) for v in (x, y, x * x, y * y, x * y)]
    return full(both, n, safe_corr(F.lit(float(n)), *sums))


def ts_skew(x: Column, n: int) -> Column:
    """Bias-corrected; 0 for a constant; NULL for n under 3."""
    if n < 3:
        return F.lit(None).cast("double")
    return full(x, n, F.coalesce(F.skewness(x).over(last_rows(n)) * F.lit((n * (n - 1)) ** 0.5 / (n - 2)), F.lit(0.0)))


def ts_kurt(x: Column, n: int) -> Column:
    """Bias-corrected excess; -3 for a constant; NULL for n under 4."""
    if n < 4:
        return F.lit(None).cast("double")
    return full(x, n, F.coalesce(F.lit((n - 1) / ((n - 2) * (n - 3))) * (F.lit(n + 1.0) * F.kurtosis(x).over(last_rows(n)) + 6), F.lit(-3.0)))


def ts_decay_linear(x: Column, n: int) -> Column:
    """Mean with weights 1..n, n on the newest row."""
    total = x * n
    for k in range(1, n):
        total = total + F.lag(x, k).over(by_time()) * (n - k)
    return total / F.lit(n * (n + 1) / 2)


def cs_rank(x: Column) -> Column:
    """Average rank as a share, less one half."""
    day = Window.partitionBy("datetime", x.isNull())
    ties = F.count(x).over(Window.partitionBy("datetime", x))
    return F.when(x.isNotNull(), (F.rank().over(day.orderBy(x)) + (ties - 1) / 2) / F.count(x).over(day) - 0.5)


def cs_zscore(x: Column) -> Column:
    """0 where the day does not vary or has one name."""
    day = Window.partitionBy("datetime")
    sd = F.stddev_samp(x).over(day)
    return F.when(x.isNotNull(), F.when(sd > TINY, (x - F.avg(x).over(day)) / sd).otherwise(0.0))


def cs_demean(x: Column) -> Column:
    return x - F.avg(x).over(Window.partitionBy("datetime"))


def cs_winsorize(x: Column, lo: float = 0.05, hi: float = 0.95) -> Column:
    day = Window.partitionBy("datetime")
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.percentile(x, F.lit(lo)).over(day)), F.percentile(x, F.lit(hi)).over(day)))
