"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import settle

BLANKS = " \t\x0b\x0c\r"


def line_hashes(text: Column) -> tuple[Column, Column]:
    """Lines of a text, and for each that is not blank (hash, place); spaces at the ends don't count."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    full = F.filter(F.transform(lines, lambda x, i: F.struct(F.trim(F.translate(x, BLANKS, " " * len(BLANKS))).alias("t"), i.alias("i"))), lambda x: x["t"] != "")
    return lines, F.transform(full, lambda x: F.struct(F.xxhash64(x["t"]).alias("h"), x["i"].alias("i")))


def selected_places(hashes: Column, run: int) -> Column:
    """Winnowing: the places that windows of `run` lines select, each once: (k, fp, part).

    A window selects the place of its least hash, the rightmost of equals. The windows that select a place follow on
    each other; k is where the first of them begins, and part holds the hashes of all their lines, so it reaches from
    the selected line up to run - 1 lines to both sides. Equal runs of `run` lines or more select alike, whatever is around them.
    """
    # Mixed, so that a very common line is no likelier to be the least.
    order = F.transform(hashes, lambda y: F.xxhash64(y["h"], F.lit(3)))

    def of(x: Column) -> Column:
        def chosen(k: Column) -> Column:
            part = F.slice(x["order"], k + 1, F.lit(run))
            return k + run - F.array_position(F.reverse(part), F.array_min(part)).cast("int")

        return F.transform(F.sequence(F.lit(0), F.size(x["order"]) - run), lambda k: F.struct(k.alias("k"), chosen(k).alias("p")))

    def once(c: Column, x: Column) -> Column:
        # c: (first window, number of windows) by selected place, in order.
        return F.transform(c, lambda y: F.struct(y["k"].alias("k"), F.get(x["h"], y["p"]).alias("fp"), F.slice(x["h"], y["k"] + 1, y["n"] + run - 1).alias("part")))

    def starts(w: Column) -> Column:
        # Selected places never go back from one window to the next, so a place's windows are one stretch.
        heads = F.filter(w, lambda y, i: (i == 0) | (F.get(w, i - 1)["p"] != y["p"]))
        return F.transform(heads, lambda y, i: F.struct(y["k"].alias("k"), y["p"].alias("p"), (F.coalesce(F.get(heads, i + 1)["k"], F.size(w)) - y["k"]).alias("n")))

    def one(value: Column, then) -> Column:
        # Works a value out once and hands it on.
        return F.element_at(F.transform(F.array(value), then), 1)

    both = F.struct(F.transform(hashes, lambda y: y["h"]).alias("h"), order.alias("order"))
    return one(both, lambda x: one(of(x), lambda w: one(starts(w), lambda c: once(c, x))))


def repeated_runs(docs: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text hash, places): full lines inside runs of `run` or more that occur earlier, by (id, text hash, place).

    Only the places that windows select are written, about two in run + 1 lines; what repeats over `run` lines shares one of
    them for certain. Places whose line is selected at two or more places meet, and each is extended to both sides, over the
    windows that select it; windows equal in the hashes of all their lines (64 bits each) match. All but the earliest of
    equals mark their lines, and what neighbouring places mark unites to the match in full length. Groups give minima,
    never lists or pairs, and are counted before they are moved, so a line in any share of documents makes no hot task.
    """
    lines, hashes = line_hashes(docs[text_col])
    rows = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), hashes.alias("x")).where(F.size("x") >= run).distinct()
    places = settle(rows.select("id", "th", F.explode(selected_places(F.col("x"), run)).alias("s")).select("id", "th", "s.k", "s.fp", "s.part"), "line-places")
    often = places.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("fp").alias("_fp"))
    meet = places.join(often, places["fp"] == often["_fp"]).select("id", "th", "k", "part")
    key = [f"c{i}" for i in range(run)]
    windows = meet.select("id", "th", F.col("k").alias("_k"), "part", F.explode(F.sequence(F.lit(0), F.size("part") - run)).alias("_j"))
    windows = windows.select("id", "th", (F.col("_k") + F.col("_j")).alias("k"), *[F.get("part", F.col("_j") + i).alias(c) for i, c in enumerate(key)])
    place = F.struct("id", "th", "k")
    first = windows.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in key], "first")
    same = windows[key[0]] == first[f"_{key[0]}"]
    for c in key[1:]:
        same = same & (windows[c] == first[f"_{c}"])
    later = windows.join(first, same).where(place > F.col("first"))
    return later.groupBy("id", "th").agg(F.array_sort(F.collect_set("k")).alias("ks"))


def dedup_lines(docs: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines, n_removed, n_runs, kept_text.

    Later copies of runs of `run` or more lines go; lines without a word neither count for a run nor break it, and
    stay. The earliest copy, by (id, text hash, place), stays. Lines are compared without the spaces at their ends. A null text has no
    lines and gives null; an empty one has one line. Rows with a null id are kept whole and remove nothing. Rows
    equal in id and text count as one document and get the same result. Texts are never cut.
    """
    lines, hashes = line_hashes(docs[text_col])
    marks = repeated_runs(docs, run, id_col, text_col).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "ks")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("th"))
    out = rows.join(marks, (rows["id"] == marks["_id"]) & (rows["th"] == marks["_th"]), "left").drop("_id", "_th")
    lines, hashes = line_hashes(F.col("text"))
    hit = F.when(F.col("ks").isNotNull(), F.array_distinct(F.flatten(F.transform("ks", lambda k: F.sequence(k, k + run - 1)))))

    def place(x: Column) -> Column:
        return F.transform(F.col("_hit"), lambda k: F.get(x, k)["i"])

    out = out.withColumn("_hit", hit).withColumn("_gone", F.when(F.col("_hit").isNotNull(), F.element_at(F.transform(F.array(hashes), place), 1)))
    gone = F.coalesce(F.size("_gone"), F.lit(0))
    starts = F.size(F.filter(F.col("_hit"), lambda k: ~F.coalesce(F.array_contains(F.col("_hit"), k - 1), F.lit(False))))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.element_at(F.transform(F.array(F.map_from_entries(F.transform(F.col("_gone"), lambda i: F.struct(i.alias("k"), F.lit(True).alias("v"))))), lambda m: F.filter(lines, lambda x, i: m[i].isNull())), 1), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    return out.select(F.col("id").alias(id_col), n_lines.cast("long").alias("n_lines"), F.greatest(gone, F.lit(0)).cast("long").alias("n_removed"), F.greatest(F.coalesce(starts, F.lit(0)), F.lit(0)).cast("long").alias("n_runs"), kept.alias("kept_text"))
