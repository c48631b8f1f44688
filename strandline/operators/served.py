"""What a store of disclosures serves on each day, all sources at once, and whether a panel follows the announcements.

A record has a row for each (code, period) of a source: (code, period, available_from, values ...), see statements.of_record.
Disclosures and asked days are put in one ordered stream a name; the last-known disclosure is carried along by a window,
so all sources cost one shuffle by name and no join against the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.codes import previous_quarter_end
from strandline.operators.panel import following

#: Names of what a panel has for each source, beside the fields.
EVIDENCE, PERIOD = "{}_available", "{}_period"


def stream_of(events: Sequence[DataFrame], asked: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, object]:
    """One table of all events (keys, _at, one struct column each) and the asked rows (keys, _at), and the window that carries events to asked rows of their day or later."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*(e.withColumn("_asked", F.lit(False)) for e in events), asked.withColumn("_asked", F.lit(True))])
    # False before True: what becomes known on a day is served on it.
    return rows, Window.partitionBy(*keys).orderBy("_at", "_asked").rowsBetween(Window.unboundedPreceding, 0)


def fundamental_panel(records: Mapping[str, DataFrame], fields: Mapping[str, Sequence[str]], days: DataFrame, codes: DataFrame, prior: bool = False) -> DataFrame:
    """(datetime, code, fields, and for each source <source>_available and <source>_period): what is served on each day to each code.

    Of a source's disclosures that are available the latest period is served, with the date from which it was available
    (the evidence) and the period itself; all three NULL before the first. With `prior` also <field>_prior,
    <source>_prior_available and <source>_prior_period: the quarter before the served one, where it was available too.
    days: (datetime, ...); codes: (code). Fields must be named once each; a record's rows without available_from never count.
    """
    names = [f for own in fields.values() for f in own]
    if not names or len(set(names)) != len(names):
        raise ValueError("fields: at least one, each named once")
    if set(fields) != set(records):
        raise ValueError("records and fields must have the same sources")
    events = []
    for source, record in records.items():
        own = [F.col(c) for c in fields[source]]
        known = record.where("available_from is not null")
        one = known.select("code", F.col("available_from").alias("_at"), F.struct("period", F.col("available_from").alias("available"), *own).alias("_now"))
        if prior:
            old = known.select(F.col("code").alias("_c"), F.col("period").alias("_p"), F.struct("period", F.col("available_from").alias("available"), *own).alias("_old"))
            on = (one["code"] == old["_c"]) & (previous_quarter_end(F.col("_now.period")) == old["_p"])
            one = one.join(old, on, "left").drop("_c", "_p")
        else:
            one = one.withColumn("_old", F.lit(None).cast(one.schema["_now"].dataType))
        # The period leads the struct, so the largest is the latest period.
        events.append(one.select("code", "_at", F.struct("_now", "_old").alias(f"_e_{source}")))
    asked = codes.select("code").distinct().crossJoin(F.broadcast(days.select(F.col("datetime").alias("_at")).distinct()))
    rows, before = stream_of(events, asked, ("code",))
    out = rows.withColumns({f"_w_{s}": F.max(f"_e_{s}").over(before) for s in records}).where("_asked")
    columns: list[Column] = []
    for source, own in fields.items():
        now, old = F.col(f"_w_{source}._now"), F.col(f"_w_{source}._old")
        columns += [*(now[c].alias(c) for c in own), now["available"].alias(EVIDENCE.format(source)), now["period"].alias(PERIOD.format(source))]
        if prior:
            there = old["available"] <= F.col("_at")
            columns += [*(F.when(there, old[c]).alias(f"{c}_prior") for c in own), F.when(there, old["available"]).alias(EVIDENCE.format(f"{source}_prior")), F.when(there, old["period"]).alias(PERIOD.format(f"{source}_prior"))]
    return out.select(F.col("_at").alias("datetime"), "code", *columns)


def fundamental_defects(panel: DataFrame, fields: Mapping[str, Sequence[str]], prior: bool = False) -> DataFrame:
    """(datetime, code, source, defect) of cells that cannot be shown to follow announcements; none in a sound panel.

    'no evidence': a value without the date it was available from; 'after the day': evidence later than the day, value or
    not; 'no period': evidence without a period; 'went back': evidence older than the day before's, which carrying forward
    never gives. The last is not asked of prior quarters, which change roles as the current period moves on.
    """
    by_day = Window.partitionBy("code").orderBy("datetime")
    found = []
    for source in [*fields, *(f"{s}_prior" for s in fields if prior)]:
        base = source.removesuffix("_prior") if source not in fields else source
        own = [c if base == source else f"{c}_prior" for c in fields[base]]
        evidence, period = F.col(EVIDENCE.format(source)), F.col(PERIOD.format(source))
        valued = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in own])
        back = F.lag(evidence).over(by_day) > evidence if base == source else F.lit(False)
        kinds = (("no evidence", valued & evidence.isNull()), ("after the day", evidence > F.col("datetime")), ("no period", evidence.isNotNull() & period.isNull()), ("went back", back))
        found.append(F.struct(F.lit(source).alias("source"), F.array_compact(F.array(*[F.when(c, k) for k, c in kinds])).alias("defects")))
    # The windows are worked out before rows are exploded.
    marked = panel.select("datetime", "code", F.array(*found).alias("_f"))
    return marked.select("datetime", "code", F.explode("_f").alias("x")).select("datetime", "code", "x.source", F.explode("x.defects").alias("defect"))


def delayed(record: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """The record as if each disclosure had become available n trading days later; NULL past the end of the calendar."""
    if n <= 0:
        raise ValueError("a delay must be a positive number of trading days")
    order = Window.orderBy("datetime")
    further = days.select("datetime").distinct().select(F.col("datetime").alias("_n"), F.lead("datetime", n - 1).over(order).alias("_to"))
    moved = following(record.withColumn("d", F.col("available_from")), days, "_next", 1)
    return moved.join(F.broadcast(further), F.col("_next") == F.col("_n"), "left").withColumn("available_from", F.when(F.col("d").isNotNull(), F.col("_to"))).drop("d", "_next", "_n", "_to")


def winner_moves(record: DataFrame, days: DataFrame, samples: DataFrame, n: int) -> DataFrame:
    """(source, code, datetime, base_period, shifted_period): sampled days on which the record serves another period if all disclosures come n trading days later.

    Worked out from the record alone, never from a panel, so a panel that ignores announcements cannot hide what it should
    have done. record: of record already, with `source`. samples: (datetime).
    """
    keys = ("source", "code")
    one = record.where("available_from is not null").select(*keys, F.col("available_from").alias("_at"), F.col("period").alias("_base"))
    later = delayed(record, days, n).where("available_from is not null").select(*keys, F.col("available_from").alias("_at"), F.col("period").alias("_late"))
    asked = record.select(*keys).distinct().crossJoin(F.broadcast(samples.select(F.col("datetime").alias("_at")).distinct()))
    rows, before = stream_of([one, later], asked, keys)
    best = rows.withColumns({"base_period": F.max("_base").over(before), "shifted_period": F.max("_late").over(before)}).where("_asked")
    return best.where(~F.col("base_period").eqNullSafe(F.col("shifted_period"))).select(*keys, F.col("_at").alias("datetime"), "base_period", "shifted_period")


def judged_moves(moves: DataFrame, served: DataFrame, served_later: DataFrame) -> DataFrame:
    """moves with `violations`, what two panels (source, code, datetime, period), built from the record and from the delayed record, did otherwise.

    A day that a panel has no row for is a violation, also where the expected period is NULL: else a panel could leave out
    what would convict it.
    """
    keys = ["source", "code", "datetime"]

    def told(panel: DataFrame, name: str) -> DataFrame:
        return panel.groupBy(*keys).agg(F.max("period").alias(f"_{name}"), F.lit(True).alias(f"_has_{name}"))

    both = moves.join(told(served, "base"), keys, "left").join(told(served_later, "late"), keys, "left")
    has = {k: F.coalesce(F.col(f"_has_{k}"), F.lit(False)) for k in ("base", "late")}
    compared = has["base"] & has["late"]
    wrong = F.array(
        F.when(~has["base"], "no row"), F.when(~has["late"], "no delayed row"),
        F.when(compared & ~F.col("_base").eqNullSafe(F.col("base_period")), "served another period"),
        F.when(compared & ~F.col("_late").eqNullSafe(F.col("shifted_period")), F.when(F.col("_late").eqNullSafe(F.col("_base")), "served the same in spite of the delay").otherwise("served another period after the delay")),
    )
    return both.select(*keys, "base_period", "shifted_period", F.col("_base").alias("served_period"), F.col("_late").alias("served_later"), F.array_compact(wrong).alias("violations"))


def shift_verdict(judged: DataFrame) -> DataFrame:
    """One row (n_moves, n_violations, verdict): REFUSE with any violation, INCONCLUSIVE without moves, else OK."""
    out = judged.agg(F.count(F.lit(1)).alias("n_moves"), F.coalesce(F.sum(F.size("violations")), F.lit(0)).cast("long").alias("n_violations"))
    return out.withColumn("verdict", F.when(F.col("n_moves") == 0, "INCONCLUSIVE").when(F.col("n_violations") > 0, "REFUSE").otherwise("OK"))
