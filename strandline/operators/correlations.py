"""Correlations of many factors at once, as sums of outer products over blocks of factors.

A wide panel's row is held as one array. A task adds up, for all pairs of factors, how many rows have both and the sums,
squares and products over these rows; the sums of all tasks are added block by block. No row is multiplied by its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factors a side of a block, and what is held of a pair (i, j): rows with both, then sums over these rows of values less their factor's centre (cx, cy).
BLOCK = 128
SUMS = ("n", "x", "y", "xx", "yy", "xy")
BLOCKS = "g int, i int, j int, " + ", ".join(f"{s} array<double>" for s in (*SUMS, "cx", "cy"))


def pair_sums(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sums of all pairs of places i <= j of the arrays v, in blocks, for each group g of rows (g, v array<double>); null and NaN are missing.

    All arrays of a group have one length. A task holds the sums of its groups: six numbers for each pair of factors,
    whatever the number of rows. Result: (g, i, j, sums ..., cx, cy), i and j numbers of blocks. A task centres each factor on the
    mean of the first batch that has it, so large offsets cost no digits and rows are read once; sums are moved to one centre as they are added.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        centres: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = batch.column("g").to_numpy()
            for g in np.unique(groups):
                own = batch.column("v").filter(pa.array(groups == g))
                if not len(own):
                    continue
                x = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                there = np.isfinite(x)
                m = there.astype(np.float64)
                x = np.where(there, x, 0.0)
                c = centres.setdefault(int(g), np.full(x.shape[1], np.nan))
                new = np.isnan(c) & there.any(axis=0)
                c[new] = x[:, new].sum(axis=0) / m[:, new].sum(axis=0)
                x = np.where(there, x - c, 0.0)
                sums = [m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x]
                total[int(g)] = [a + b for a, b in zip(total[int(g)], sums, strict=True)] if int(g) in total else sums
        for g, (n, x, xx, xy) in total.items():
            for i in range(0, len(n), block):
                for j in range(i, len(n), block):
                    at = np.s_[i : i + block, j : j + block]
                    other = np.s_[j : j + block, i : i + block]
                    parts = (n[at], x[at], x[other].T, xx[at], xx[other].T, xy[at])
                    ends = (centres[g][i : i + block], centres[g][j : j + block])
                    yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in (g, i // block, j // block)), *(pa.array([p.ravel()], pa.list_(pa.float64())) for p in (*parts, *ends))], ["g", "i", "j", *SUMS, "cx", "cy"])

    def added(table: pa.Table) -> pa.Table:
        cx, cy = (np.stack(table.column(c).to_numpy()) for c in ("cx", "cy"))
        # The first centre that there is; a task without the factor has none and nothing to move.
        to = [c[np.isfinite(c).argmax(axis=0), np.arange(c.shape[1])] for c in (cx, cy)]
        total = [0.0] * len(SUMS)
        for k in range(table.num_rows):
            n, x, y, xx, yy, xy = (table.column(s)[k].values.to_numpy().reshape(cx.shape[1], cy.shape[1]) for s in SUMS)
            dx, dy = np.nan_to_num(cx[k] - to[0])[:, None], np.nan_to_num(cy[k] - to[1])[None, :]
            moved = (n, x + n * dx, y + n * dy, xx + 2 * dx * x + n * dx * dx, yy + 2 * dy * y + n * dy * dy, xy + dx * y + dy * x + n * dx * dy)
            total = [a + b for a, b in zip(total, moved, strict=True)]
        sums = [pa.array([p.ravel()], pa.list_(pa.float64())) for p in (*total, *to)]
        return pa.table([*(table.column(k).slice(0, 1) for k in ("g", "i", "j")), *sums], names=["g", "i", "j", *SUMS, "cx", "cy"])

    return rows.select("g", "v").mapInArrow(products, BLOCKS).groupBy("g", "i", "j").applyInArrow(added, BLOCKS)


def pairs_of(sums: DataFrame, names: dict[int, Sequence[str]], least: int = 1, flat: float = 1e-12, block: int = BLOCK) -> DataFrame:
    """(g, a, b, n, corr) of the block sums, a before b in names[g]; corr NULL under `least` common rows or where a side does not vary, pairs without a common row go."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                g, bi, bj = (batch.column(c)[k].as_py() for c in ("g", "i", "j"))
                own = np.array(names[g], dtype=object)
                a, b = own[bi * block : (bi + 1) * block], own[bj * block : (bj + 1) * block]
                n, x, y, xx, yy, xy = (batch.column(c)[k].values.to_numpy().reshape(len(a), len(b)) for c in SUMS)
                vx, vy = n * xx - x * x, n * yy - y * y
                fine = (n >= least) & (vx > flat * n * xx) & (vy > flat * n * yy)
                with np.errstate(all="ignore"):
                    corr = np.where(fine, (n * xy - x * y) / (np.sqrt(vx) * np.sqrt(vy)), np.nan)
                p, q = np.nonzero((n > 0) & ((bi < bj) | (np.arange(len(a))[:, None] < np.arange(len(b)))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), g), pa.int32()), pa.array(a[p], pa.string()), pa.array(b[q], pa.string()), pa.array(n[p, q].astype(np.int64)), pa.array(corr[p, q], from_pandas=True)], ["g", "a", "b", "n", "corr"])

    return sums.mapInArrow(unpack, "g int, a string, b string, n long, corr double")


def finite(name: str) -> Column:
    """False or NULL for null, NaN (which Spark orders last) and infinity."""
    return F.abs(F.col(name).cast("double")) < F.lit(float("inf"))


def pearson(wide: DataFrame, names: Sequence[str], least: int = 3) -> DataFrame:
    """(a, b, n, corr) of all pairs of the named columns, over the rows where both are finite. wide is read once."""
    row = F.array(*[F.when(finite(c), F.col(c).cast("double")) for c in names])
    return pairs_of(pair_sums(wide.select(F.lit(0).alias("g"), row.alias("v"))), {0: list(names)}, least).drop("g")


def common_rows(wide: DataFrame, names: Sequence[str]) -> np.ndarray:
    """How many rows both columns of each pair have: a number for each pair of factors, at the driver like the plan that is made from it."""
    row = F.array(*[F.when(finite(c), F.lit(1.0)) for c in names])
    out = np.zeros((len(names), len(names)))
    for r in pair_sums(wide.select(F.lit(0).alias("g"), row.alias("v"))).select("i", "j", "n").toArrow().to_pylist():
        i, j = r["i"] * BLOCK, r["j"] * BLOCK
        n = np.array(r["n"]).reshape(min(BLOCK, len(names) - i), -1)
        out[i : i + n.shape[0], j : j + n.shape[1]] = n
        out[j : j + n.shape[1], i : i + n.shape[0]] = n.T
    return out


def rank_sets(n: np.ndarray) -> tuple[list[list[int]], dict[tuple[int, int], int], list[int]]:
    """Sets of rows over which factors are to be ranked, from the counts of common rows.

    Factors with the same rows form a class. A pair is ranked over the rows that both classes have; where one class has all
    rows of the other these are the other's own. Returns the factors of each set, the set of each pair of classes, and
    each factor's class.
    """
    own = np.diag(n)
    of, heads = [], []
    for k in range(len(n)):
        same = next((c for c, h in enumerate(heads) if n[k, h] == own[k] == own[h]), len(heads))
        if same == len(heads):
            heads.append(k)
        of.append(same)
    sets: dict[tuple[int, ...], int] = {}
    between: dict[tuple[int, int], int] = {}
    for c, h in enumerate(heads):
        for d in range(c, len(heads)):
            k = heads[d]
            # A class whose rows all lie in the other is the whole meeting.
            key = (c,) if n[h, k] == own[h] else (d,) if n[h, k] == own[k] else (c, d)
            between[c, d] = sets.setdefault(key, len(sets))
    members: list[set[int]] = [set() for _ in sets]
    for (c, d), s in between.items():
        members[s] |= {c, d}
    return [[k for k, c in enumerate(of) if c in m] for m in members], between, of


def spearman(wide: DataFrame, names: Sequence[str], keys: Sequence[str] = ("datetime", "instrument")) -> DataFrame:
    """(a, b, n, corr) of all pairs of the named columns: rank correlation over all rows that have both, all finite, ranked among these, ties by their average.

    A factor is ranked once for each distinct set of rows that it shares with others (once, if no cell is missing), not once for
    each pair. keys name a row.
    """
    from strandline.operators.evaluation import pooled_rank

    n = common_rows(wide, names)
    sets, between, of = rank_sets(n)
    # The rows of a set are those that have one factor of each of its two classes.
    ends = {s: (c, d) for (c, d), s in sorted(between.items(), reverse=True)}
    head = {c: names[of.index(c)] for c in set(of)}
    number = {c: F.col(c).cast("double") for c in names}
    there = {c: F.coalesce(finite(c), F.lit(False)) for c in names}
    cells = [
        F.when(there[head[ends[s][0]]] & there[head[ends[s][1]]], F.array(*[F.struct(F.lit(s).alias("g"), F.lit(k).alias("k"), number[names[k]].alias("x")) for k in own]))
        for s, own in enumerate(sets)
    ]
    long = wide.select(*keys, F.explode(F.flatten(F.array_compact(F.array(*cells)))).alias("c")).select(*keys, "c.*")
    ranked = pooled_rank(long, ("g", "k"), "x", "rank")
    rows = ranked.groupBy(*keys, "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "rank"))), lambda e: e["rank"].cast("double")).alias("v"))
    centre = rows.sparkSession.createDataFrame([(s, float(n[own[0], own[0]]) / 2) for s, own in enumerate(sets)], "g int, c double")
    rows = rows.join(F.broadcast(centre), "g").select("g", F.transform("v", lambda x: x - F.col("c")).alias("v"))
    found = pairs_of(pair_sums(rows), {s: [names[k] for k in own] for s, own in enumerate(sets)})
    # A set may hold pairs that have more rows in common; each pair counts in its own set.
    klass = rows.sparkSession.createDataFrame([(names[k], c) for k, c in enumerate(of)], "name string, c int")
    wanted = rows.sparkSession.createDataFrame([(c, d, s) for (c, d), s in between.items()], "c int, d int, s int")
    both = found.join(klass.withColumnsRenamed({"name": "a", "c": "_a"}), "a").join(klass.withColumnsRenamed({"name": "b", "c": "_b"}), "b")
    on = (F.least("_a", "_b") == F.col("c")) & (F.greatest("_a", "_b") == F.col("d")) & (F.col("g") == F.col("s"))
    return both.join(wanted, on).select("a", "b", "n", "corr")
