"""The daily list: scored names with the day they can be bought, whether they can, and why not; guarded against stale inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators import panel, statements


def guarded(rows: DataFrame, facts: DataFrame, checks: Sequence[tuple[Column, Column]]) -> DataFrame:
    """rows, if no check fails: a check is (a condition that must not hold, its message) over the one row of facts. The job that reads the rows fails with the message; nothing is read beforehand."""
    fine = F.lit(True)
    for bad, message in checks:
        fine = fine & F.when(F.coalesce(bad, F.lit(True)), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return rows.crossJoin(F.broadcast(facts.select(fine.alias("_fine")))).where("_fine").drop("_fine")


def entry_days(scores: DataFrame, days: DataFrame) -> DataFrame:
    """scores with entry_date, the trading day after the day of the score; NULL on the calendar's last day."""
    later = days.select("datetime", F.lead("datetime").over(Window.orderBy("datetime")).alias("entry_date"))
    return scores.join(F.broadcast(later), "datetime", "left")


def daily_recommendations(
    scores: DataFrame, dense: DataFrame, days: DataFrame, names: DataFrame, k: int, today: str, limits: tuple[Column, Column] | None = None, most_age: int = 14, drop: bool = False
) -> DataFrame:
    """(as_of_date, entry_date, rank, stock_code, stock_name, predicted_score, tradable_flag, unavailable_reason) of each day's scored names, best first.

    scores: (datetime, instrument, score); dense: the panel; names: spans of statements.name_spans (code being the instrument).
    A name can be bought if on the entry day it trades, has more than one price, its move does not block buying (limits =
    panel.limit_blocked) and it carries no risk name; else the reason says which of these fails first. Where there is no
    entry day yet, the name of the score's day counts and the rest is open. rank numbers the names that can be bought, 1
    to k; others have NULL. Rows are the k best that can be bought and those above them that cannot; with `drop` the
    former alone. Ties go by instrument, null scores are left out.

    Refused, by failing the job that reads the list: a calendar whose last day is more than most_age days before `today`,
    a history of names that ends before the day of a score, scores of days that are not in the calendar.
    """
    at = F.col("entry_date")
    buy = panel.limit_blocked(0.098)[0] if limits is None else limits[0]
    reasons = dense.select(F.col("datetime").alias("entry_date"), "instrument", F.when(panel.suspended(), "suspended").when(panel.one_price(), "one price").alias("_mask"), buy.alias("_limit"))
    own = entry_days(scores.where("score is not null and not isnan(score)"), days)
    own = own.join(reasons, ["entry_date", "instrument"], "left")
    asked = own.select(F.coalesce("entry_date", "datetime").alias("datetime"), F.col("instrument").alias("code")).distinct()
    named = statements.named_at(asked, names).select(F.col("datetime").alias("_on"), F.col("code").alias("_code"), "name", "is_risk")
    own = own.join(named, (F.coalesce("entry_date", "datetime") == F.col("_on")) & (F.col("instrument") == F.col("_code")), "left")
    reason = F.when(at.isNotNull() & F.col("_mask").isNull() & F.col("_limit").isNull(), "no row").when(F.col("_mask").isNotNull(), F.col("_mask")).when(F.coalesce("_limit", F.lit(False)), "price limit").when(F.coalesce("is_risk", F.lit(False)), "risk name")
    best = Window.partitionBy("datetime").orderBy(F.desc("score"), "instrument")
    own = own.withColumn("unavailable_reason", reason).withColumn("_n", F.count(F.when(F.col("unavailable_reason").isNull(), 1)).over(best.rowsBetween(Window.unboundedPreceding, 0)))
    free = F.col("unavailable_reason").isNull()
    own = own.where((free & (F.col("_n") <= k)) | (~free & (F.col("_n") < k) & F.lit(not drop)))
    out = own.select(
        F.col("datetime").alias("as_of_date"), "entry_date", F.when(free, F.col("_n").cast("int")).alias("rank"), F.col("instrument").alias("stock_code"), F.col("name").alias("stock_name"),
        F.col("score").alias("predicted_score"), free.alias("tradable_flag"), "unavailable_reason",
    )
    asked_days = scores.select("datetime").distinct().join(F.broadcast(days.select("datetime", F.lit(1).alias("_in"))), "datetime", "left")
    facts = days.agg(F.max("datetime").alias("last")).crossJoin(names.agg(F.max("start").alias("known"))).crossJoin(asked_days.agg(F.max("datetime").alias("asked"), F.count_if(F.col("_in").isNull()).alias("off")))
    checks = [
        (F.datediff(F.to_date(F.lit(today)), "last") > most_age, F.concat(F.lit("the calendar is stale: it ends on "), F.coalesce(F.col("last").cast("string"), F.lit("no day")))),
        (F.col("known") < F.date_sub("asked", most_age), F.concat(F.lit("the history of names is stale: it ends on "), F.coalesce(F.col("known").cast("string"), F.lit("no day")))),
        (F.col("off") > 0, F.lit("scores of days that are not in the calendar")),
    ]
    return guarded(out, facts, checks)
