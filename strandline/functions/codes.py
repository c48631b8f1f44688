"""Codes, dates and names, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_prefixed(code: Column) -> Column:
    """600000.SH to SH600000; other strings as they are."""
    return F.regexp_replace(code, r"^(\d{6})\.([A-Z]{2})$", "$2$1")


def to_suffixed(code: Column) -> Column:
    """SH600000 to 600000.SH; other strings as they are."""
    return F.regexp_replace(code, r"^([A-Z]{2})(\d{6})$", "$2.$1")


def compact_date(x: Column) -> Column:
    """yyyyMMdd to a date; NULL for anything else."""
    return F.when(x.rlike(r"^\d{8}$"), F.try_to_timestamp(x, F.lit("yyyyMMdd")).cast("date"))


def announcement_token(x: Column) -> Column:
    """A day as vendors write it: blank is NULL and a decimal part of zeros goes."""
    return F.regexp_replace(F.nullif(F.trim(x), F.lit("")), r"\.0+$", "")


def content_hash(*columns: str) -> Column:
    """SHA-256 of column=value in the columns' order of names, NULL as NA."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NA"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def previous_quarter_end(day: Column) -> Column:
    """NULL where day is no quarter end."""
    return F.when(day == quarter_end(day), F.last_day(F.add_months(day, -3)))


def weekdays_between(a: Column, b: Column) -> Column:
    """Mondays to Fridays in [a, b), by counting whole weeks: no sequence of days is built."""
    def upto(d: Column) -> Column:  # weekdays from Monday 1970-01-05 to d, d excluded
        n = F.datediff(d, F.to_date(F.lit("1970-01-05")))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return F.greatest(upto(b) - upto(a), F.lit(0)).cast("long")


def ceil9(x: Column) -> Column:
    return F.ceil(x * 1e9) / 1e9


def floor9(x: Column) -> Column:
    return F.floor(x * 1e9) / 1e9


#: Fixed value: names under risk warning, after full-width letters and stars are folded.
RISK_NAME = r"^N?S?\*?ST(?![A-Za-z])"


def is_risk_name(name: Column) -> Column:
    return F.coalesce(F.translate(F.trim(name), "ＳＴＮ＊", "STN*").rlike(RISK_NAME), F.lit(False))


#: Exchange and leading digits of each board.
BOARDS = {
    "bse": "^BJ[48]",
    "star": "^SH688",
    "sh_main": "^SH(600|601|603|605)",
    "chinext": "^SZ(300|301)",
    "sme": "^SZ002",
    "sz_main": "^SZ(000|001)",
}


def board(instrument: Column) -> Column:
    """The board of a prefixed code (two letters and six digits), else `other`."""
    instrument = F.when(instrument.rlike(r"^[A-Z]{2}\d{6}$"), instrument)
    out = F.lit("other")
    for name, pattern in BOARDS.items():
        out = F.when(F.coalesce(instrument.rlike(pattern), F.lit(False)), name).otherwise(out)
    return out


#: Fixed value: the cost of one round trip, as a share of the amount.
ROUND_TRIP = 0.003


def months_later(day: Column, n: int) -> Column:
    """The same day n months later (earlier if negative), the month's last day where it has no such day."""
    return F.add_months(day, n)


def net_of_cost(score: Column, cost: float = ROUND_TRIP) -> Column:
    """A score, as an expected return, less one round trip's cost."""
    return score - F.lit(cost)
