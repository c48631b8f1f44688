"""From scores to the signals that can be traded, with what each step drops counted in the same pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators import panel, schedule, statements

#: Why a signal is dropped, in the order in which it is asked.
UNSCHEDULED, PAST_END, RISK = "unscheduled", "past the end", "risk name"
REASONS = (UNSCHEDULED, PAST_END, "suspended", "one_price", RISK)


def signal_days(signals: DataFrame, days: DataFrame, cadence: int, phase: int, lag: int) -> DataFrame:
    """(datetime, due, stamp, execution) of the days with signals: whether the calendar's every cadence-th day, the signal day `lag` scheduled ones later, and the trading day after that one, on which it is filled.

    The schedule is that of the calendar, so a scheduled day without signals shifts no other."""
    own = signals.select("datetime").distinct()
    due = own.join(schedule.every_nth(days, cadence, phase).select("datetime"), "datetime", "left_semi")
    moved = due.select("datetime", F.lead("datetime", lag).over(Window.orderBy("datetime")).alias("stamp"))
    fills = days.select(F.col("datetime").alias("stamp"), F.lead("datetime").over(Window.orderBy("datetime")).alias("execution"))
    placed = moved.join(fills, "stamp", "left")
    return own.join(placed.withColumn("due", F.lit(True)), "datetime", "left").select("datetime", F.coalesce("due", F.lit(False)).alias("due"), "stamp", "execution")


def judged_signals(signals: DataFrame, dense: DataFrame, days: DataFrame, cadence: int, phase: int = 0, lag: int = 0, names: DataFrame | None = None) -> DataFrame:
    """signals (datetime, instrument, score, ...) with stamp, execution and `why`, NULL for those that stay.

    A signal goes if its day is not scheduled, if its stamp lies past the last scheduled signal, if the name is suspended or has
    one price on the execution day, or if it carries a risk name then; the first of these is told. dense: the panel (datetime,
    instrument, volume, close, high, low); names: spans (code, start, next, is_risk, name) of statements.name_spans, code
    being the instrument. A stamp on the calendar's last day has no execution and is judged by the schedule alone."""
    placed = signals.join(F.broadcast(signal_days(signals, days, cadence, phase, lag)), "datetime")
    mask = panel.unavailable(dense).select(F.col("datetime").alias("execution"), "instrument", "reason")
    out = placed.join(mask, ["execution", "instrument"], "left")
    if names is None:
        out = out.withColumn("is_risk", F.lit(False))
    else:
        asked = out.select("execution", "instrument").where("execution is not null").distinct()
        at = statements.named_at(asked.select(F.col("execution").alias("datetime"), F.col("instrument").alias("code")), names)
        out = out.join(at.select(F.col("datetime").alias("execution"), F.col("code").alias("instrument"), "is_risk"), ["execution", "instrument"], "left")
    why = F.when(~F.col("due"), UNSCHEDULED).when(F.col("stamp").isNull(), PAST_END).when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("is_risk"), RISK)
    return out.withColumn("why", why).drop("due", "reason", "is_risk")


def tradable(judged: DataFrame, counts: Observation | None = None) -> DataFrame:
    """The signals that stay, stamped (datetime = stamp). counts observes, in the pass that reads the rows, how many were given and kept and how many each reason dropped; counts.get has them after an action."""
    if counts is not None:
        metrics = [F.count(F.lit(1)).alias("given"), *(F.count_if(F.col("why") == r).alias(r) for r in REASONS), F.count_if(F.col("why").isNull()).alias("kept")]
        judged = judged.observe(counts, *metrics)
    return judged.where("why is null").drop("datetime", "why").withColumnRenamed("stamp", "datetime")


def drop_counts(judged: DataFrame) -> DataFrame:
    """One row: given, kept, and a column for each reason. For reports; the rows themselves are counted by tradable() on their way."""
    named = {r.replace(" ", "_"): r for r in REASONS}
    return judged.agg(F.count(F.lit(1)).alias("given"), F.count_if(F.col("why").isNull()).alias("kept"), *(F.count_if(F.coalesce(F.col("why") == r, F.lit(False))).alias(n) for n, r in named.items()))


def counted(rows: DataFrame, counts: Observation, conditions: Mapping[str, str]) -> DataFrame:
    """rows, with the number of rows under each SQL condition observed on the way."""
    return rows.observe(counts, *(F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()))
