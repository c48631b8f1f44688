"""Mixing sources to target weights by a Pfair schedule; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import number_rows, rows_per_bucket, settle


#: Slots of a timetable that are gathered at a time.
RUN = 100


def shares(counts: DataFrame, weights: Mapping[str, float] | None, power: float, least_period: int, most_period: int = 100_000) -> DataFrame:
    """(source, n, share, period): target weights as whole shares of a period, by largest remainder.

    The period is least_period slots (weights of as many decimals are met exactly), or as many more, most_period at most, as the
    smallest weight needs for a slot. A source of weight zero, or of less than half a slot, has share 0. Without
    weights a source's target is its number of rows to the given power (1: as it is, 0: all alike)."""
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        w = F.coalesce(F.element_at(given, F.coalesce("source", F.lit(""))), F.lit(0)).cast("double")
    every = Window.partitionBy()
    out = counts.withColumn("w", w).withColumn("w", F.col("w") / F.sum("w").over(every))
    least = F.min(F.when(F.col("w") > 0, F.col("w"))).over(every)
    out = out.withColumn("period", F.least(F.lit(most_period), F.greatest(F.lit(least_period), F.ceil(1 / least), F.count(F.lit(1)).over(every))))
    # Rounded, so that a weight that is a whole number of slots is not a hair below it.
    out = out.withColumn("ideal", F.coalesce(F.round(F.col("w") * F.col("period"), 6), F.lit(0.0))).withColumn("share", F.floor("ideal").cast("int"))
    spare = F.col("period") - F.sum("share").over(every)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("ideal") - F.floor("ideal")), "source"))
    more = F.when((rank <= F.col("spare")) & (F.col("ideal") > F.floor("ideal")), 1).otherwise(0)
    return out.withColumn("spare", spare).withColumn("share", F.col("share") + more).select("source", "n", "share", F.col("period").cast("int").alias("period"))


def timetable(plan: DataFrame) -> DataFrame:
    """(source, j, slot, release, deadline): one period of the Pfair schedule.

    Block j (from 0) of a source with share s in a period of p slots is released at floor(j p / s) and due at
    ceil((j + 1) p / s). Each slot takes, of the released blocks, the one due first (then the source's
    order). At any time a source is less than one block from its share of the slots. Sources of share 0 have no block. The period is a number of slots that depends
    on the number of sources alone, so this is one row's work, of any number of documents.
    """
    one = plan.where("share > 0").agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("s"), F.max("period").alias("p"))

    def step(state: Column, t: Column) -> Column:
        def due(i: Column) -> Column:
            done, share = F.get(state["done"], i), F.get(F.col("s"), i)["share"]
            ready = (F.floor(done * F.col("p") / share) <= t) & (done < share)
            return F.struct(F.when(ready, F.ceil((done + 1) * F.col("p") / share)).otherwise(F.lit(1 << 40)).alias("due"), i.alias("i"))

        best = F.array_min(F.transform(F.sequence(F.lit(0), F.size("s") - 1), due))
        chosen = F.element_at(F.transform(F.array(best), lambda b: F.struct(
            F.transform(state["done"], lambda d, i: d + F.when(i == b["i"], 1).otherwise(0)).alias("done"),
            F.concat(state["out"], F.array(F.struct(t.alias("slot"), b["i"].alias("i"), F.get(state["done"], b["i"]).alias("j")))).alias("out"),
        )), 1)
        return chosen

    # Slots are gathered RUN at a time, so that adding one copies few others.
    def stretch(state: Column, begin: Column) -> Column:
        slots = F.sequence(begin, F.least(begin + RUN, F.col("p")) - 1)
        end = F.aggregate(slots, F.struct(state["done"].alias("done"), none.alias("out")), step)
        return F.element_at(F.transform(F.array(end), lambda e: F.struct(e["done"].alias("done"), F.concat(state["all"], F.array(e["out"])).alias("all"))), 1)

    none = F.expr("cast(array() as array<struct<slot:int,i:int,j:int>>)")
    begin = F.struct(F.transform("s", lambda _: F.lit(0)).alias("done"), F.expr("cast(array() as array<array<struct<slot:int,i:int,j:int>>>)").alias("all"))
    run = F.aggregate(F.sequence(F.lit(0), F.col("p") - 1, F.lit(RUN)), begin, stretch, lambda x: F.flatten(x["all"]))
    slots = one.where(F.size("s") > 0).select("s", "p", F.explode(run).alias("x"))
    share = F.get(F.col("s"), F.col("x.i"))["share"]
    return slots.select(F.get(F.col("s"), F.col("x.i"))["source"].alias("source"), F.col("x.j").alias("j"), F.col("x.slot").cast("long").alias("slot"), F.floor(F.col("x.j") * F.col("p") / share).alias("release"), F.ceil((F.col("x.j") + 1) * F.col("p") / share).alias("deadline"))


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, block_rows: int = 16, least_period: int = 10_000, per_bucket: int = 4_000, id_col: str = "doc_id", source_col: str = "source", carry: bool | Sequence[Column] = False) -> DataFrame:
    """One row per document: id, source, block (number within its source), slot, release, deadline, position; and the
    whole row, or the columns given, as the struct `row` if carry.

    Rows of a source are put in a hashed order and cut in blocks of block_rows. Blocks take the slots of the
    timetable, period after period; position = slot * block_rows + place in the block, so rows sorted by
    position hold each source at its target weight, within less than one block, until its rows end; its later
    slots stay empty and the others keep their proportion. No row is dropped or repeated. Sources of share 0 (of weight zero, not
    named in weights, or of less than half a slot of the longest period) come last, in slots behind all others'. Null is a source like any other. Ids may be null or
    repeat; rows equal in all columns are in any order. Targets: weights by source, else rows ** power.
    """
    row = F.struct(*([docs[c] for c in docs.columns] if isinstance(carry, bool) else carry))
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("h"), *([row.alias("row")] if carry else []))
    counts = settle(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    plan = settle(shares(counts, weights, power, least_period), "mix-plan")
    table = settle(timetable(plan), "mix-slots")
    n = counts.agg(F.sum("n")).first()[0] or 0
    numbered = number_rows(rows, ["source"], [F.col("id"), F.col("h")], rows_per_bucket(n, per_bucket), "at")
    # Behind the last slot of all shares, the sources without one take turns.
    blocks = F.ceil(F.col("n") / block_rows)
    last = F.coalesce(F.max(F.when(F.col("share") > 0, F.ceil(blocks / F.col("share")) * F.col("period"))).over(Window.partitionBy()), F.lit(0))
    idle = F.when(F.col("share") == 0, F.row_number().over(Window.partitionBy("share").orderBy("source")) - 1)
    n_idle = F.sum(F.when(F.col("share") == 0, 1).otherwise(0)).over(Window.partitionBy())
    plan = plan.select(F.col("source").alias("_source"), "share", "period", last.alias("last"), idle.alias("idle"), n_idle.alias("n_idle"))
    # The plan has a row for each source, the timetable `period` rows; both are checked before they are broadcast.
    n_sources = counts.count()
    few, short = (F.broadcast if n_sources <= 10_000 else (lambda df: df)), (F.broadcast if n_sources <= 10_000 and table.count() <= 100_000 else (lambda df: df))
    out = numbered.withColumn("block", F.floor(F.col("at") / block_rows)).join(few(plan), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    table = table.select(F.col("source").alias("_source"), F.col("j").alias("_j"), F.col("slot").alias("_slot"), F.col("release").alias("_release"), F.col("deadline").alias("_deadline"))
    turn = F.when(F.col("share") > 0, F.floor(F.col("block") / F.col("share")))
    out = out.withColumn("turn", turn).withColumn("_place", F.when(F.col("share") > 0, F.col("block") % F.col("share")))
    out = out.join(short(table), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_place") == F.col("_j")), "left")
    moved, behind = F.col("turn") * F.col("period"), F.col("last") + F.col("block") * F.col("n_idle") + F.col("idle")
    at = {"slot": behind, "release": behind, "deadline": behind + 1}
    out = out.select("id", "source", F.col("block").cast("long").alias("block"), *[F.coalesce(moved + F.col(f"_{c}"), at[c]).cast("long").alias(c) for c in at], (F.col("at") % block_rows).alias("_in"), *(["row"] if carry else []))
    return out.withColumn("position", F.col("slot") * block_rows + F.col("_in")).drop("_in").withColumnRenamed("id", id_col)


def mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5) -> DataFrame:
    """docs, all rows and columns as they were, in the order of the schedule: written files, in order of their names, hold the mix."""
    return schedule(docs, weights, power, carry=True).orderBy("position").select("row.*")
