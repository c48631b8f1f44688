"""Embedding near-duplicates: tiles in the order of principal directions, compared leading dimensions first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import link_components, release, rows_per_bucket, settle

#: Leading directions that boxes of tiles are drawn in, and directions after which pairs are judged again.
BOX, STOPS = 8, (8, 16, 32, 64)
#: Rotated products differ from exact ones by rounding alone; candidates within this much of the threshold are verified too.
SLACK = 1e-9


def usable(v: Column) -> Column:
    """True for vectors with a direction: not null, components all finite, one of them not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a column, all of dims components, in double precision."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(batch: pa.RecordBatch, column: str = "embedding") -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the number of their vectors' components."""
    sizes = pc.list_value_length(batch.column(column))
    for d in pc.unique(sizes).to_pylist():
        yield d, batch.filter(pc.equal(sizes, d))


def principal_directions(reps: DataFrame, most: int) -> dict[int, np.ndarray]:
    """For each length d of vectors, up to `most` orthonormal directions (rows), those first in which vectors of one label differ most.

    The scatter is that of differences between neighbours of one label in a batch, so labels' centres do not count. It
    moves d x d sums for each task and ends as d x d numbers at the driver, whatever the number of rows. Any orthonormal
    directions give the same links: these only decide how soon a pair is given up.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for whole in batches:
            for d, batch in by_length(whole):
                labels = batch.column("label").to_numpy(zero_copy_only=False)
                order = np.argsort(labels, kind="stable")
                x, labels = unit(matrix(batch.column("embedding"), d))[order], labels[order]
                step = (x[1:] - x[:-1])[labels[1:] == labels[:-1]]
                total[d] = total.get(d, 0) + step.T @ step
        for d, s in total.items():
            for i in range(d):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([s[i]], pa.list_(pa.float64()))], ["d", "i", "row"])

    parts = reps.select("label", "embedding").mapInArrow(scatter, "d int, i int, row array<double>")
    cells = parts.select("d", "i", F.posexplode("row").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x")).toArrow().combine_chunks()
    out = {}
    for d in pc.unique(cells.column("d")).to_pylist():
        own = cells.filter(pc.equal(cells.column("d"), d))
        s = np.zeros((d, d))
        s[own.column("i").to_numpy(), own.column("j").to_numpy()] = own.column("x").to_numpy()
        out[d] = np.linalg.eigh((s + s.T) / 2)[1].T[::-1][:most].copy()
    return out


def leading(x: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors along the directions, and the norm of what is left after each of STOPS."""
    y = x @ directions.T
    left = 1 - np.cumsum(y * y, axis=1)
    ends = [min(s, y.shape[1]) for s in STOPS]
    return y, np.sqrt(np.maximum(left[:, [e - 1 for e in ends]], 0))


def linked(x: np.ndarray, y: np.ndarray, same: np.ndarray, directions: np.ndarray, threshold: float, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two tiles of unit vectors with a cosine of threshold or more, where `same` allows the pair."""
    (a, ra), (b, rb) = leading(x, directions), leading(y, directions)
    ends = list(dict.fromkeys(min(s, a.shape[1]) for s in STOPS))
    least = threshold - SLACK
    # All pairs of the tile over the first directions at once; what is left can add at most the product of the suffix norms.
    part = a[:, : ends[0]] @ b[:, : ends[0]].T
    i, j = np.nonzero(same & (part + ra[:, :1] * rb[:, 0] >= least))
    found_i, found_j = [], []
    for at in range(0, len(i), block):
        p, q = i[at : at + block], j[at : at + block]
        sums = part[p, q]
        for k in range(1, len(ends)):
            sums = sums + np.einsum("ij,ij->i", a[p, ends[k - 1] : ends[k]], b[q, ends[k - 1] : ends[k]])
            alive = sums + ra[p, k] * rb[q, k] >= least
            p, q, sums = p[alive], q[alive], sums[alive]
        sure = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
        found_i.append(p[sure])
        found_j.append(q[sure])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(found_i or [none]), np.concatenate(found_j or [none])


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for n nodes and the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def near_vectors(vectors: DataFrame, threshold: float = 0.98, tile_rows: int = 1024, most_directions: int = 64) -> DataFrame:
    """Links of vectors of one label by their cosine, and the components that the links make.

    vectors: vec_id, embedding (array of float or double), label; other columns are left out of the result, whatever their
    names. Returns vec_id, n_links (other rows linked directly), component_id (least vec_id reachable), kept (vec_id =
    component_id), a row for each row given. Null labels, and vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. Vectors of different lengths do not link. Repeated rows are rows of their own and link with
    each other; of rows with one vec_id all or none are kept. A null vec_id counts as a row, never as the least id unless
    its component has no other. An empty table gives an empty result.

    Equal vectors become one with a weight. The rest are dealt in tiles of tile_rows along the leading principal
    directions; two tiles meet if they share a label and the boxes round them come close enough. A meeting sends on a
    count and a local root for each row, never pairs, so a dense group costs no more rows than a sparse one.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0, 1 at most")
    rows = vectors.select("vec_id", "embedding", "label")
    good = rows.where(F.col("label").isNotNull() & usable(F.col("embedding")))
    reps = settle(good.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")), "vector-copies")
    spark = rows.sparkSession
    directions = spark.sparkContext.broadcast(principal_directions(reps, most_directions))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK

    # 1. Tiles: rows in the order of label, cells of the first three directions, then the fourth; cut at tile_rows rows.
    label, vector = reps.schema["label"].dataType.simpleString(), reps.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, batch in by_length(whole):
                y, _ = leading(unit(matrix(batch.column("embedding"), d)), directions.value[d])
                box = np.zeros((len(y), BOX))
                box[:, : min(BOX, y.shape[1])] = y[:, :BOX]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d] * len(y), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(box.ravel()), BOX).cast(pa.list_(pa.float64()))], [*batch.schema.names, "d", "lead"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            at = np.arange(n, n + batch.num_rows, dtype=np.int64)
            n += batch.num_rows
            base = np.int64(part) << 40
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + at), pa.array(base + at // tile_rows)], [*batch.schema.names, "node", "tile"])

    placed = reps.mapInArrow(place, f"label {label}, embedding {vector}, weight long, least {reps.schema['least'].dataType.simpleString()}, d int, lead array<double>")
    cells = [F.floor(F.col("lead")[i] / F.lit(max(reach, 1e-3))) for i in range(3)]
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows_per_bucket(reps.count(), 64 * tile_rows))
    order = ["label", "d", "_q0", "_q1", "_q2", F.col("lead")[3], F.xxhash64("embedding")]
    dealt = placed.withColumns({f"_q{i}": c for i, c in enumerate(cells)}).repartitionByRange(n_parts, *order).sortWithinPartitions(*order).drop("_q0", "_q1", "_q2")
    tiles = settle(dealt.mapInArrow(cut, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", node long, tile long"), "vector-tiles")

    # 2. Tiles that share a label and whose boxes are within reach; they find each other by cells of the first direction.
    sides = [f(F.col("lead")[i]).alias(f"{n}{i}") for i in range(BOX) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    boxes = tiles.groupBy("tile", "label", "d").agg(*sides)
    width = max(reach, 1e-3)
    cell = lambda x: F.floor(x / F.lit(width)).cast("int")
    left = boxes.withColumn("cell", F.explode(F.sequence(cell(F.col("lo0") - reach), cell(F.col("hi0") + reach)))).alias("l")
    right = boxes.withColumn("cell", F.explode(F.sequence(cell(F.col("lo0")), cell(F.col("hi0"))))).alias("r")
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"l.lo{i}") - F.col(f"r.hi{i}"), F.col(f"r.lo{i}") - F.col(f"l.hi{i}"))
    near = sum((gap(i) * gap(i) for i in range(1, BOX)), gap(0) * gap(0)) <= F.lit(reach * reach)
    on = (F.col("l.label") == F.col("r.label")) & (F.col("l.d") == F.col("r.d")) & (F.col("l.cell") == F.col("r.cell"))
    pairs = settle(left.join(right, on & (F.col("l.tile") <= F.col("r.tile")) & near).select(F.col("l.tile").alias("a"), F.col("r.tile").alias("b")).distinct(), "vector-pairs")
    meets = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"), "a", "b")

    # 3. Each meeting of two tiles: counts of links and a local root for each row that has a link.
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        own = table.filter(pc.equal(table.column("tile"), a))
        other = own if a == b else table.filter(pc.equal(table.column("tile"), b))
        out = {"node": [], "links": [], "root": []}
        for d in set(own.column("d").unique().to_pylist()) & set(other.column("d").unique().to_pylist()):
            x, y = (t.filter(pc.equal(t.column("d"), d)).combine_chunks() for t in (own, other))
            codes = pa.chunked_array([*x.column("label").chunks, *y.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            vx, vy = (unit(matrix(t.column("embedding").combine_chunks(), d)) for t in (x, y))
            same = codes[: len(vx), None] == codes[None, len(vx) :]
            if a == b:
                same &= ~np.eye(len(vx), dtype=bool)
            i, j = linked(vx, vy, same, directions.value[d], threshold)
            nodes, weights = (np.concatenate([np.asarray(t.column(c)) for t in ((x,) if a == b else (x, y))]) for c in ("node", "weight"))
            k = j if a == b else j + len(vx)
            links = np.bincount(i, weights=weights[k], minlength=len(nodes))
            if a != b:
                links += np.bincount(k, weights=weights[i], minlength=len(nodes))
            root, has = roots(len(nodes), i, k), links > 0
            out["node"].append(nodes[has])
            out["links"].append(links[has].astype(np.int64))
            out["root"].append(nodes[root[has]])
        return pa.table([pa.array(np.concatenate(v or [np.zeros(0, np.int64)]), type=pa.int64()) for v in out.values()], schema=schema)

    shared = tiles.select("tile", "node", "label", "d", "embedding", "weight")
    found = settle(shared.join(meets, "tile").groupBy("a", "b").applyInArrow(compare, "node long, links long, root long"), "vector-links")

    # 4. Components over the local roots, then back to all rows by the vector itself.
    of = link_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "vector-edges")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = tiles.select("node", "label", "embedding", "weight", "least").join(counts, "node", "left").join(of.withColumnRenamed("label", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = settle(named, "vector-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    info = named.join(least, "root").select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component")
    back = settle(info, "vector-classes")
    release(reps, tiles, pairs, found, named)
    ids = rows.join(back, (rows["label"] == back["_l"]) & (rows["embedding"] == back["_e"]) & usable(rows["embedding"]), "left")
    component = F.when(F.col("_l").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return ids.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
