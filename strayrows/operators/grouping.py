"""Grouping outliers by their importances."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strayrows.functions import planes as L
from strayrows.functions.blocks import list_array
from strayrows.spec import ID
from strayrows.staging import stage

#: From so many places of one or two dimensions on, distances are summed over boxes of a tree, of coordinates no larger than this.
MANY_PLACES, LARGEST = 1 << 15, 1e150
#: Most places of a region that a task holds, and regions a core gets at least.
REGION_ROWS, REGIONS_PER_CORE = 1 << 18, 3
#: Places that meet at a time, and most of a block. Two blocks make a tile, of which a core gets about TILES_PER_CORE.
BLOCK_ROWS = 256
OTHER_ROWS = 1 << 16
TILES_PER_CORE = 8


def embed_2d(vectors: DataFrame) -> DataFrame:
    """(row_id, x, y): centred projection of `v` on its two principal components.

    On Euclidean distances this equals classical scaling. Each axis points to
    where its largest loading is positive, so signs are reproducible.
    """
    points = vectors.select(ID, "v", array_to_vector("v").alias("features"))
    n = len(points.first()["v"])
    model = PCA(k=min(2, n), inputCol="features", outputCol="p").fit(points)
    axes = model.pc.toArray()
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1.0, 1.0)
    means = points.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(n)]).first()
    out = []
    for a, name in enumerate(("x", "y")):
        if a >= axes.shape[1]:
            out.append(F.lit(0.0).alias(name))
            continue
        total = F.lit(0.0)
        for i in range(n):
            total = total + (F.col("v")[i] - F.lit(means[f"m{i}"])) * F.lit(float(axes[i, a]))
        out.append(total.alias(name))
    return points.select(ID, *out)


def cluster_sweep(points: DataFrame, max_k: int, seed: int = 0) -> DataFrame:
    """(k, row_id, cluster_id) for k = 1..max_k-1 from the 2-D points."""
    features = points.select(ID, array_to_vector(F.array("x", "y")).alias("features"))
    result = points.select(F.lit(1).alias("k"), ID, F.lit(0).alias("cluster_id"))
    for k in range(2, max_k):
        model = KMeans(k=k, seed=seed, initMode="k-means||", predictionCol="c").fit(features)
        result = result.unionByName(
            model.transform(features).select(
                F.lit(k).alias("k"), ID, F.col("c").cast("int").alias("cluster_id")
            )
        )
    return result


def cluster_distances(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """(k, row_id, cluster_id, other_id, n, mean_distance) for every row and cluster.

    mean_distance is to the members of other_id, the row itself left out (null if there is no other). Rows with equal
    vectors are one place, met once with the number of its rows in every cluster, so copies add no pairs. All
    clusterings share one pass: a place's distances to a block of places, times their numbers of rows in the clusters of
    every k, are the sums. Many places of a plane are summed over the boxes of a tree (`region_sums`), others in pairs of
    blocks (`block_sums`).
    """
    sizes = {
        (r["k"], r["cluster_id"]): r["n"]
        for r in clusters.groupBy("k", "cluster_id").agg(F.count("*").alias("n")).collect()  # clusters of all k
    }
    every = sorted(sizes)
    number = {key: i for i, key in enumerate(every)}
    labels = clusters.groupBy(ID).agg(F.collect_list(F.struct("k", "cluster_id")).alias("own"))
    at = F.col("v").alias("at")
    joined = stage(points.select(ID, at).join(labels, ID), "cluster-points")
    places = stage(places_of(joined), "cluster-places")
    total = region_sums(places, number) if _many_in_plane(places) else block_sums(places, number)
    total = joined.join(stage(total, "cluster-sums"), "at").select(ID, "own", "s")
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("other_id"), F.lit(sizes[k, c]).alias("size")) for k, c in every])
    pairs = F.filter(
        F.zip_with("s", known, lambda s, c: F.struct(s.alias("s"), c["k"].alias("k"), c["other_id"].alias("other_id"), c["size"].alias("size"))),
        lambda p: p["k"] == F.col("o.k"),
    )
    each = total.select(ID, "s", F.explode("own").alias("o")).select(ID, F.col("o.cluster_id").alias("cluster_id"), F.inline(pairs))
    left_out = F.when(F.col("cluster_id") == F.col("other_id"), 1).otherwise(0)
    count = (F.col("size") - left_out).cast("bigint")
    return each.select(
        F.col("k").cast("int").alias("k"), ID, "cluster_id", F.col("other_id").cast("int").alias("other_id"),
        count.alias("n"), F.when(count > 0, F.col("s") / count).alias("mean_distance"),
    )


def _many_in_plane(places: DataFrame) -> bool:
    """Whether there are many places in one or two dimensions, all of them numbers whose squares are numbers."""
    odd = F.coalesce(F.exists("at", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LARGEST)), F.lit(True))
    dims = F.collect_set(F.size("at")).alias("dims")
    found = places.agg(F.count("*").alias("n"), dims, F.count_if(odd).alias("odd")).first()
    return found["n"] >= MANY_PLACES and found["dims"] in ([1], [2]) and not found["odd"]


def _members(table: pa.Table, number: dict[tuple, int]) -> np.ndarray:
    """[place, cluster]: rows of `held`, clusters as numbered by (k, cluster_id)."""
    out = np.zeros((table.num_rows, len(number)))
    held = table.column("held").combine_chunks()
    row = np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy(zero_copy_only=False))
    k, cluster, n = held.flatten().flatten()
    n = n.to_numpy(zero_copy_only=False)
    for key, i in number.items():
        here = [pc.is_null(c) if v is None else pc.fill_null(pc.equal(c, v), False) for c, v in zip((k, cluster), key)]
        at = pc.and_(*here).to_numpy(zero_copy_only=False)
        out[row[at], i] = n[at]
    return out


def block_sums(places: DataFrame, number: dict[tuple, int]) -> DataFrame:
    """(at, s): the distances of every place to the rows of every cluster, summed.

    A pair of blocks meets once and adds to the sums of both; only sums leave a task.
    """
    width = len(number)
    n = places.count()
    cores = places.sparkSession.sparkContext.defaultParallelism
    # A place is sent to as many tiles as there are blocks: a number that the cores fix until a block would hold more than OTHER_ROWS.
    blocks = max(1, -(-n // OTHER_ROWS), min(-(-n // BLOCK_ROWS), math.isqrt(TILES_PER_CORE * 2 * cores)))
    dealt = places.withColumn("b", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int"))
    left = dealt.select("at", "held", F.col("b").alias("bi"), F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("bj"))
    right = dealt.select("at", "held", F.col("b").alias("bj"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("bi"))

    def sums(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        """What the pairs of a tile add to the places of both its blocks."""
        same = key[0].as_py() == key[1].as_py()
        both = [a] if same else [a, b]
        total = [np.zeros((t.num_rows, width)) for t in both]
        if a.num_rows and b.num_rows:
            x, y, own, other = _matrix(a), _matrix(b), _members(a, number), _members(b, number)
            for i in range(0, len(x), BLOCK_ROWS):
                p = slice(i, i + BLOCK_ROWS)
                for j in range(0, len(y), BLOCK_ROWS):
                    q = slice(j, j + BLOCK_ROWS)
                    away = distances(x[p], y[q])
                    total[0][p] += away @ other[q]
                    if not same:
                        total[1][q] += away.T @ own[p]
        parts = [
            pa.table({"at": t.column("at"), **{f"s{i}": pa.array(s[:, i]) for i in range(width)}}) for t, s in zip(both, total)
        ]
        return pa.concat_tables(parts)

    schema = "at array<double>, " + ", ".join(f"s{i} double" for i in range(width))
    partial = left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj")).applyInArrow(sums, schema)
    return partial.groupBy("at").agg(F.array(*[F.sum(f"s{i}") for i in range(width)]).alias("s"))


@F.arrow_udf(LongType())
def _along_plane(x: pa.Array, y: pa.Array) -> pa.Array:
    """The bits of two whole numbers below 2^31 in turn, so that near places have near numbers."""
    out = np.zeros(len(x), np.uint64)
    for axis, column in enumerate((x, y)):
        bits = column.to_numpy(zero_copy_only=False).astype(np.uint64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            bits = (bits | (bits << np.uint64(shift))) & np.uint64(mask)
        out |= bits << np.uint64(axis)
    return pa.array(out.astype(np.int64))


def region_sums(places: DataFrame, number: dict[tuple, int]) -> DataFrame:
    """As `block_sums`, for places of one or two dimensions, in time that grows little faster than their number.

    A region is a run of places along a curve through the plane, with a tree of boxes of its own. To every region are sent the
    weights of other regions' boxes as large as their distance allows, and the places of the leaves that are near it
    (`functions/planes.py`). The driver chooses them by the corners of the boxes, two for LEAF places.
    """
    spark, width, flat = places.sparkSession, len(number), len(places.first()["at"]) == 1
    x, y = F.col("at")[0], F.lit(0.0) if flat else F.col("at")[1]
    plane = places.select(x.alias("x"), y.alias("y"), "held")
    ends = plane.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    spans = {c: (ends[f"lo_{c}"], (ends[f"hi_{c}"] - ends[f"lo_{c}"]) or 1.0) for c in "xy"}
    whole = [F.least(F.floor((F.col(c) - lo) / span * F.lit(2.0**31)), F.lit((1 << 31) - 1)) for c, (lo, span) in spans.items()]
    n_regions = max(1, -(-ends["n"] // REGION_ROWS), min(REGIONS_PER_CORE * spark.sparkContext.defaultParallelism, ends["n"] // L.LEAF))
    tasks = 2 * n_regions  # regions meet tasks by a hash
    schema = "region int, leaf int, x double, y double, " + plane.schema["held"].simpleString().replace(":", " ", 1)

    def cut(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        order, boxes = L.tree(_plane(table))
        leaf = np.empty(len(order), np.int32)
        for i, box in enumerate(boxes):
            if box.halves is None:
                leaf[box.first : box.last] = i
        region = pa.array(np.full(len(order), TaskContext.get().partitionId(), np.int32))
        out = table.take(pa.array(order))
        yield from pa.table({"region": region, "leaf": pa.array(leaf), **{c: out.column(c) for c in ("x", "y", "held")}}).to_batches(L.LEAF * 32)

    cells = stage(plane.repartitionByRange(n_regions, _along_plane(*whole), "x", "y").mapInArrow(cut, schema), "plane-cells")
    corners = ("x0", "y0", "x1", "y1")

    def weigh(key: tuple, own: pa.Table) -> pa.Table:
        at, held = _plane(own), _members(own, number)
        order, boxes = L.tree(at)
        found = L.moments(at[order], held[order], boxes)
        n = len(boxes)
        ends = np.array([(*b.lo, *b.hi) for b in boxes]).reshape(n, 4)
        halves = np.array([b.halves or (-1, -1) for b in boxes], np.int32)
        return pa.table({
            "region": pa.array(np.full(n, key[0].as_py(), np.int32)), "box": pa.array(np.arange(n, dtype=np.int32)),
            "a": pa.array(halves[:, 0]), "b": pa.array(halves[:, 1]), **{c: pa.array(ends[:, i]) for i, c in enumerate(corners)},
            "moments": pa.array([m.tobytes() for m in found], pa.binary()),
        })

    boxes = stage(
        cells.repartition(tasks, "region").groupBy("region")
        .applyInArrow(weigh, "region int, box int, a int, b int, x0 double, y0 double, x1 double, y1 double, moments binary"),
        "plane-boxes",
    )
    wanted = stage(spark.createDataFrame(_wanted(boxes.drop("moments").toArrow())), "plane-wanted")
    near = F.broadcast(wanted.where("near").select("target", "region", F.col("box").alias("leaf")))
    far = F.broadcast(wanted.where(~F.col("near")).select(F.col("target").alias("target"), "region", "box"))
    left = cells.join(near, ["region", "leaf"]).select("target", "region", "leaf", "x", "y", "held").repartition(tasks, "target")
    right = boxes.join(far, ["region", "box"]).select("target", *corners, "moments").repartition(tasks, "target")

    def sums(key: tuple, near: pa.Table, far: pa.Table) -> pa.Table:
        at, held = _plane(near), _members(near, number)
        region, leaf = (near.column(c).to_numpy() for c in ("region", "leaf"))
        own = region == key[0].as_py()
        others = [
            L.Source(L.Box((a, b), (c, d)), np.frombuffer(m, np.float64).reshape(-1, width))
            for a, b, c, d, m in zip(*[far.column(name).to_pylist() for name in (*corners, "moments")])
        ]
        away = np.flatnonzero(~own)
        away = away[np.lexsort((leaf[away], region[away]))]
        starts = np.flatnonzero(np.diff(region[away], prepend=-1) | np.diff(leaf[away], prepend=-1))
        for part in np.split(away, starts[1:]) if len(away) else ():
            others.append(L.Source(L.box(at[part]), None, at[part], held[part]))
        at, held = at[own], held[own]
        order, tree = L.tree(at)
        found = L.sums(at[order], held[order], tree, others)
        back = np.ascontiguousarray(at[order][:, :1] if flat else at[order])
        return pa.table({"at": list_array(back), "s": list_array(found)})

    return left.groupBy("target").cogroup(right.groupBy("target")).applyInArrow(sums, "at array<double>, s array<double>")


def _plane(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in ("x", "y")], axis=1)


def _wanted(boxes: pa.Table) -> pa.Table:
    """(target, region, box, near): the boxes whose weights go to a region, and, near, the leaves whose places do; its own are near."""
    column = {c: boxes.column(c).to_numpy() for c in boxes.column_names}
    region, box, lo, hi = column["region"], column["box"], *(np.stack([column["x" + i], column["y" + i]], axis=1) for i in "01")
    reach = L.APART * (hi - lo).max(axis=1) / 2
    first = {int(r): i for i, r in enumerate(region) if box[i] == 0}
    place = {(int(r), int(b)): i for i, (r, b) in enumerate(zip(region, box))}
    a, b = (np.array([place.get((int(r), int(h)), -1) for r, h in zip(region, column[c])]) for c in "ab")
    out = []
    for target, root in first.items():
        own = np.flatnonzero((region == target) & (a < 0))
        out.append((target, own, True))
        at = np.array([i for r, i in first.items() if r != target], int)
        while len(at):
            gap = np.maximum(np.maximum(lo[at] - hi[root], lo[root] - hi[at]), 0.0)
            far = np.sqrt((gap * gap).sum(axis=1)) >= reach[at]
            leaf = ~far & (a[at] < 0)
            out += [(target, at[far], False), (target, at[leaf], True)]
            at = at[~far & ~leaf]
            at = np.concatenate([a[at], b[at]])
    targets = np.concatenate([np.full(len(i), t, np.int32) for t, i, _ in out])
    index = np.concatenate([i for _, i, _ in out])
    near = np.concatenate([np.full(len(i), n) for _, i, n in out])
    return pa.table({"target": targets, "region": region[index], "box": box[index], "near": near})


def places_of(labelled: DataFrame) -> DataFrame:
    """(at, held): distinct vectors of (at, own) rows, with the number of rows in each cluster that has any there."""
    held = labelled.select("at", F.explode("own").alias("c")).groupBy("at", "c").agg(F.count("*").alias("n"))
    return held.groupBy("at").agg(F.collect_list(F.struct("c.k", "c.cluster_id", "n")).alias("held"))


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("at").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


#: From so many dimensions on, distances come from products of matrices.
PRODUCT_DIMS = 8


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances [len(a), len(b)].

    One dimension at a time if they are few. Else |a|^2 + |b|^2 - 2ab, which is off by some 1e-16 of the squared lengths; pairs
    so near that this could be seen are measured by their differences.
    """
    if a.shape[1] < PRODUCT_DIMS:
        squares = np.zeros((len(a), len(b)))
        for i in range(a.shape[1]):
            away = a[:, i, None] - b[None, :, i]
            away *= away
            squares += away
        return np.sqrt(squares, out=squares)
    middle = b.mean(axis=0) if len(b) else 0.0
    a, b = a - middle, b - middle
    own, other = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    squares = a @ b.T
    squares *= -2.0
    squares += own[:, None]
    squares += other
    scale = own.max(initial=0.0) + other.max(initial=0.0)
    i, j = np.nonzero(~(squares > NEAR * scale))
    for at in range(0, len(i), NEAR_PAIRS):
        p, q = i[at : at + NEAR_PAIRS], j[at : at + NEAR_PAIRS]
        squares[p, q] = ((a[p] - b[q]) ** 2).sum(axis=1)
    return np.sqrt(squares, out=squares)


#: Squared distances below this share of the squared lengths are taken from differences, so many pairs at a time.
NEAR, NEAR_PAIRS = 1e-6, 1 << 16


def silhouette(mean_distances: DataFrame) -> DataFrame:
    """(k, silhouette) averaged over rows, from cluster_distances; single-cluster k is left out."""
    own = F.col("other_id") == F.col("cluster_id")
    per_row = mean_distances.groupBy("k", ID).agg(
        F.max(F.when(own, F.coalesce("mean_distance", F.lit(-1.0)))).alias("a"),
        F.min(F.when(~own, F.col("mean_distance"))).alias("b"),
    )
    value = F.when(F.col("a") < 0, F.lit(0.0)).otherwise(
        F.coalesce(
            F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)
        )
    )
    return per_row.where(F.col("b").isNotNull()).groupBy("k").agg(F.avg(value).alias("silhouette"))


def best_k(silhouettes: DataFrame) -> DataFrame:
    """One row (k, silhouette): the highest silhouette, the smallest k on ties."""
    return silhouettes.orderBy(F.desc("silhouette"), F.asc("k")).limit(1)


def members(source: DataFrame, clusters: DataFrame, k: int, cluster_id: int) -> DataFrame:
    """Source rows of one cluster."""
    chosen = clusters.where((F.col("k") == k) & (F.col("cluster_id") == cluster_id))
    return source.join(chosen.select(ID), ID, "left_semi")


def cluster_options(clusters: DataFrame) -> DataFrame:
    """(k, cluster_id, n): the clusters that exist for every k and their sizes."""
    return clusters.groupBy("k", "cluster_id").agg(F.count("*").alias("n"))
