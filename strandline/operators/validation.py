"""Checks of a panel against what was known when: each returns the offending rows, none when all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.factors import ts_mean
from strandline.operators.panel import members_at


def in_range(registry: DataFrame, panel: DataFrame) -> DataFrame:
    """(_i, _d): registry rows whose delisting day lies in the panel's days."""
    ends = panel.agg(F.min("datetime").alias("_lo"), F.max("datetime").alias("_hi"))
    return registry.join(F.broadcast(ends), F.col("delist_date").between(F.col("_lo"), F.col("_hi"))).select(F.col("instrument").alias("_i"), F.col("delist_date").alias("_d"))


def closes_after_delisting(panel: DataFrame, registry: DataFrame) -> DataFrame:
    """(instrument, delist_date, n_after, last) of names that have a close after their delisting day."""
    known = in_range(registry, panel)
    rows = panel.where("close is not null").join(known, (F.col("instrument") == F.col("_i")) & (F.col("datetime") > F.col("_d")))
    return rows.groupBy("instrument", F.col("_d").alias("delist_date")).agg(F.count(F.lit(1)).alias("n_after"), F.max("datetime").alias("last"))


def delisting_boundaries(panel: DataFrame, registry: DataFrame, before: int = 30, after: int = 10, most_days: int = 7) -> DataFrame:
    """(instrument, delist_date, last_close, state) of each delisting in the panel's range: `look_ahead` with a close after it,
    `suspended` without a close in its last most_days days, else `ok`. Closes count from `before` days before to `after` days after."""
    known = in_range(registry, panel)
    near = (F.col("instrument") == F.col("_i")) & F.col("datetime").between(F.date_sub("_d", before), F.date_add("_d", after))
    rows = known.join(panel.where("close is not null").select("instrument", "datetime"), near, "left").groupBy("_i", "_d").agg(F.max("datetime").alias("last_close"))
    state = F.when(F.col("last_close") > F.col("_d"), "look_ahead").when(F.coalesce(F.datediff("_d", "last_close") > most_days, F.lit(True)), "suspended").otherwise("ok")
    return rows.select(F.col("_i").alias("instrument"), F.col("_d").alias("delist_date"), "last_close", state.alias("state"))


def members_after_delisting(days: DataFrame, spans: DataFrame, registry: DataFrame) -> DataFrame:
    """(datetime, names, gone): days whose members include delisted ones, and how many."""
    m = members_at(days, spans).join(registry.select("instrument", "delist_date"), "instrument", "left")
    return m.groupBy("datetime").agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("delist_date") < F.col("datetime")).alias("gone")).where("gone > 0")


def window_leaks(dense: DataFrame, registry: DataFrame, n: int = 20) -> DataFrame:
    """(instrument, delist_date, n_leaks): rolling means over n days that are there after the delisting day."""
    known = in_range(registry, dense)
    rolled = dense.select("datetime", "instrument", ts_mean(F.col("close"), n).alias("_mean")).where("_mean is not null")
    rows = rolled.join(known, (F.col("instrument") == F.col("_i")) & (F.col("datetime") > F.col("_d")))
    return rows.groupBy("instrument", F.col("_d").alias("delist_date")).agg(F.count(F.lit(1)).alias("n_leaks"))


def closes_around(panel: DataFrame, cases: DataFrame, days: int = 5, least: int = 4) -> DataFrame:
    """(instrument, day, n_closes, enough) for each case (instrument, day)."""
    c = cases.select(F.col("instrument").alias("_i"), "day")
    rows = c.join(panel.where("close is not null").select("instrument", "datetime"), (F.col("_i") == F.col("instrument")) & F.col("datetime").between(F.date_sub("day", days), F.date_add("day", days)), "left")
    out = rows.groupBy(F.col("_i").alias("instrument"), "day").agg(F.count("datetime").alias("n_closes"))
    return out.withColumn("enough", F.col("n_closes") >= least)


def registry_defects(registry: DataFrame) -> DataFrame:
    """(instrument, why) of a registry (instrument, list_date, delist_date): duplicate, no date, delisted before listed."""
    n = F.count(F.lit(1)).over(Window.partitionBy("instrument"))
    why = F.array_compact(F.array(
        F.when(F.col("_n") > 1, F.lit("duplicate")), F.when(F.col("instrument").isNull() | F.col("list_date").isNull() | F.col("delist_date").isNull(), F.lit("null")), F.when(F.col("delist_date") < F.col("list_date"), F.lit("order")),
    ))
    return registry.withColumn("_n", n).select("instrument", F.explode(why).alias("why")).distinct()


def calendar_defects(table: DataFrame) -> DataFrame:
    """One row of counts for a table (cal_date STRING yyyyMMdd, is_open): rows, bad dates, repeats, flags other than 0 and 1, days
    missing between the first and the last, open days."""
    digits = F.col("cal_date").rlike("^[0-9]{8}$")
    day = F.when(digits, F.try_to_timestamp("cal_date", F.lit("yyyyMMdd")).cast("date"))
    span = F.datediff(F.max("_d"), F.min("_d")) + 1
    return table.withColumn("_d", day).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_d").isNull()).alias("bad_dates"), (F.count("_d") - F.countDistinct("_d")).alias("repeats"), F.count_if(~F.coalesce(F.col("is_open").isin(0, 1), F.lit(False))).alias("bad_flags"),
        (F.coalesce(span, F.lit(0)) - F.countDistinct("_d")).cast("long").alias("missing_days"), F.count_if(F.col("is_open") == 1).alias("open_days"),
    )


def short_embargoes(segments: DataFrame, days: DataFrame, least: int) -> DataFrame:
    """(name, start, gap) of segments (name, start, end) that begin with fewer than `least` trading days strictly after the end of the one before."""
    earlier = segments.select("name", "start", F.lag("end").over(Window.orderBy("start")).alias("_e")).where("_e is not null")
    d = days.select("datetime")
    between = earlier.join(F.broadcast(d), (d["datetime"] > F.col("_e")) & (d["datetime"] < F.col("start")), "left")
    return between.groupBy("name", "start").agg(F.count("datetime").alias("gap")).where(F.col("gap") < least)


def membership_cases(spans: DataFrame, cases: DataFrame, most_days: int) -> DataFrame:
    """(index_code, instrument, action, day, nearest, gap, verdict) for each distinct case (index_code, instrument, action, day):
    the run's edge nearest to the day (starts for 'enter', ends of closed runs for 'leave'; of equally near ones the earlier) and
    its distance in days. spans: (index_code, instrument, start, end), open ones to 2099-12-31. verdict: 'match', 'too far' (also without a day), 'no run',
    'still a member' (a leave of open runs only) or 'unknown action'. cases are few and are broadcast by the optimiser where their size allows."""
    keys = ["index_code", "instrument", "action", "day"]
    runs = spans.select(F.col("index_code").alias("_x"), F.col("instrument").alias("_i"), F.col("start").alias("_a"), F.when(F.col("end") < F.to_date(F.lit("2099-12-31")), F.col("end")).alias("_b"))
    edge = F.when(F.col("action") == "enter", F.col("_a")).when(F.col("action") == "leave", F.col("_b"))
    met = cases.select(*keys).distinct().join(runs, (F.col("index_code") == F.col("_x")) & (F.col("instrument") == F.col("_i")), "left")
    best = F.min(F.when(edge.isNotNull(), F.struct(F.abs(F.datediff(edge, "day")).alias("gap"), edge.alias("nearest"))))
    out = met.groupBy(*keys).agg(F.count("_a").alias("_n"), best.alias("_best"))
    known = F.coalesce(F.col("action").isin("enter", "leave"), F.lit(False))
    verdict = F.when(F.col("_n") == 0, "no run").when(~known, "unknown action").when(F.col("_best").isNull(), "still a member").when(F.col("_best.gap") <= most_days, "match").otherwise("too far")
    return out.select(*keys, F.col("_best.nearest").alias("nearest"), F.col("_best.gap").alias("gap"), verdict.alias("verdict"))


def absent(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Expected cases that are not found."""
    return expected.join(found.select(*keys).distinct(), list(keys), "left_anti")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def score_contract(scores: DataFrame, as_of: Column) -> DataFrame:
    """One row: dates, repeats of an instrument, scores that are no numbers, days after as_of; all but dates = 1 should be 0."""
    return scores.agg(
        F.countDistinct("datetime").alias("dates"), (F.count(F.lit(1)) - F.countDistinct("instrument")).alias("repeats"),
        F.count_if(F.col("score").isNull() | F.isnan("score")).alias("no_number"), F.count_if(F.col("datetime") > as_of).alias("after"),
    )


def out_of_order(evidence: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Rows whose `column` falls behind the last one that was there: what is known may not become older."""
    before = F.last(column, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return evidence.withColumn("_before", before).where(F.col("_before") > F.col(column)).drop("_before")
