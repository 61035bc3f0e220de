"""Structural measures: spanning trees, hyperspheres, greedy covers, and measures over many resolutions."""

from __future__ import annotations

import heapq
import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.stages import cut, small
from ..sources.labelled import width
from .distance import Block, Boxes, _deal, _runs, distances, nearest_by_class, ranges, reach_join
from .graphs import spanning_forest
from .measures import _r, hypersphere_profile, local_sets

#: Nearest rows of all among which those of a cell are looked for first, and parts of blocks in cells that the driver weighs.
NEAREST, SPOTS = 64, 1 << 20


def n1(df: DataFrame, by_class: bool = False, scale: list[float] | None = None) -> DataFrame:
    """(value): share of rows on an edge of the spanning forest between classes."""
    e = spanning_forest(df, scale or ranges(df)).where("cross = 1")
    ends = e.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("hit", F.lit(1))
    x = df.select("id", "label").join(ends, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return (x.groupBy("label") if by_class else x.groupBy()).agg(_r(F.avg("hit"), "value"))


def sphere_radii(df: DataFrame) -> DataFrame:
    """(id, label, radius) of each row's ball: half the distance to its nearest enemy if they are each other's, else what the enemy's ball leaves.

    radius = d - radius(enemy) unrolls to an alternating sum along pointers, which doubling sums in log2(length) joins.
    Longer cycles need equal distances; their lowest id gets 0.
    """
    near = nearest_by_class(df).select(F.col("i").alias("id"), F.col("yi").alias("label"), F.col("other_j").alias("e"), F.col("other_dist").alias("d")).where("e is not null")
    near = cut(near)
    back = near.select(F.col("id").alias("e"), F.col("e").alias("ee"))
    start = cut(near.join(back, "e", "left").select("id", "label", "d", "e", (F.col("ee") == F.col("id")).alias("mutual")))
    zero: DataFrame | None = None
    while True:
        s = start
        if zero is not None:
            s = s.join(zero, "id", "left").withColumn("z", F.coalesce("z", F.lit(False)))
        else:
            s = s.withColumn("z", F.lit(False))
        s = s.select("id", "label", F.when(F.col("z"), 0.0).when(F.col("mutual"), F.col("d") / 2).otherwise(F.col("d")).alias("acc"), F.when(F.col("z") | F.col("mutual"), None).otherwise(F.col("e")).alias("ptr"), F.lit(-1).alias("sign"), F.col("id").alias("low"))
        s = cut(s)
        for _ in range(64):
            if s.where("ptr is not null").isEmpty():
                return s.select("id", "label", F.abs("acc").alias("radius"))
            to = s.select(F.col("id").alias("ptr"), F.col("acc").alias("acc2"), F.col("ptr").alias("ptr2"), F.col("sign").alias("sign2"), F.col("low").alias("low2"))
            new = s.join(to, "ptr", "left")
            moved = F.col("ptr").isNotNull()
            new = new.select("id", "label", F.when(moved, F.col("acc") + F.col("sign") * F.col("acc2")).otherwise(F.col("acc")).alias("acc"), F.col("ptr2").alias("ptr"), F.when(moved, F.col("sign") * F.col("sign2")).otherwise(F.col("sign")).alias("sign"), F.least("low", F.coalesce("low2", "low")).alias("low"))
            before = s.where("ptr is not null").count()
            s = cut(new)
            if s.where("ptr is not null").count() == before and 2 ** (_ + 1) > before:
                break
        # Only cycles are left: the lowest id of each ends its pointers.
        lows = s.where("ptr is not null").join(s.select(F.col("id").alias("ptr"), F.col("low").alias("cycle")), "ptr").select(F.col("cycle").alias("id")).distinct().withColumn("z", F.lit(True))
        zero = cut(lows if zero is None else zero.unionByName(lows).distinct())


def _contained(balls: DataFrame) -> DataFrame:
    """(id, inside, into): whether a later ball, in the order of (radius, id), contains each ball, and the largest that does."""

    def compare(q: Block, d: Block) -> pa.Table:
        rq, rd = (np.asarray(x.table.column("radius").to_numpy(zero_copy_only=False), float) for x in (q, d))
        into, size = np.full(len(q.id), -1), np.full(len(q.id), -1.0)
        if len(q.id) and len(d.id):
            dist = distances(q.x, d.x)
            later = (rd[None, :] > rq[:, None]) | ((rd[None, :] == rq[:, None]) & (d.id[None, :] > q.id[:, None]))
            ok = later & (np.round(dist + rq[:, None], 9) <= np.round(rd[None, :], 9))
            order = np.lexsort((d.id, rd))
            ok = ok[:, order]
            got, last = ok.any(1), order[-1 - ok[:, ::-1].argmax(1)]
            into, size = np.where(got, d.id[last], -1), np.where(got, rd[last], -1.0)
        return pa.table({"id": q.id, "size": size, "into": into})

    # A ball of a block reaches into another one if its centre is nearer than their radii may differ.
    x = Boxes(balls.select("id", "label", "features", "radius"), None, ["radius"], ["radius"])
    parts = reach_join(x, x, lambda r: x.bounds(x, r)[0] <= x.most["radius"] - x.least["radius"][r] + 2e-9, compare, "id long, size double, into long")
    return parts.groupBy("id").agg(F.max(F.struct("size", "into")).alias("m")).select("id", (F.col("m.into") >= 0).alias("inside"), F.col("m.into").alias("into"))


def t1_balls(df: DataFrame) -> DataFrame:
    """(id, label, features, radius, members): balls that no larger one absorbs, with the rows they have taken in."""
    balls = cut(df.select("id", "label", "features").join(sphere_radii(df).select("id", "radius"), "id"))
    x = cut(_contained(balls))
    # Members follow the pointers to the ball that is left.
    to = cut(x.select("id", F.when(F.col("inside"), F.col("into")).otherwise(F.col("id")).alias("root")))
    while True:
        new = cut(to.join(to.select(F.col("id").alias("root"), F.col("root").alias("up")), "root").select("id", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
        to = new.select("id", "root")
        if new.where("moved").isEmpty():
            break
    members = to.groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("members"))
    return balls.join(members, "id")


def t1(df: DataFrame, by_class: bool = False) -> DataFrame:
    """(value): balls that none absorbs, per row."""
    balls = t1_balls(df)
    n = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    b = balls.groupBy("label").agg(F.count(F.lit(1)).alias("b"))
    x = n.join(b, "label", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    return x.select("label", _r(F.col("b") / F.col("n"), "value")) if by_class else x.agg(_r(F.sum("b") / F.sum("n"), "value"))


class Within:
    """Rows of a task in the order of one feature: a ball looks only at rows that are near enough there."""

    def __init__(self, x: np.ndarray, scale: list[float]):
        self.x, self.scale = x, scale
        whole = np.flatnonzero(~np.isnan(x).any(0)) if len(x) else []
        # The feature with most different values parts the rows best.
        self.f = max(whole, key=lambda k: len(np.unique(x[:, k])), default=None)
        if self.f is not None:
            v = x[:, self.f] / scale[self.f]
            self.order = np.argsort(v, kind="stable")
            self.v = v[self.order]

    def __call__(self, k: int, radius: float, strict: bool = False) -> np.ndarray:
        """Rows in the ball around row k, itself included."""
        if not radius >= 0:
            return np.array([k])
        at = np.arange(len(self.x))
        if self.f is not None:
            c, room = self.x[k, self.f] / self.scale[self.f], radius * (1 + 1e-9) + 1e-8
            at = self.order[np.searchsorted(self.v, c - room) : np.searchsorted(self.v, c + room, "right")]
        d = distances(self.x[k : k + 1], self.x[at], self.scale)[0]
        return at[(d < radius if strict else d <= radius) | (at == k)]


def clust(df: DataFrame, by_class: bool = False) -> DataFrame:
    """(value): cluster cores per row. By falling size of its local set (then id), a row is a core unless an earlier core's local set has it."""
    ship(df.sparkSession)
    scale = ranges(df)
    near = cut(nearest_by_class(df, scale))
    sets = local_sets(df, near, scale)
    x = df.select("id", "label", "features").join(near.select(F.col("i").alias("id"), F.col("other_dist").alias("radius")), "id").join(sets.select(F.col("i").alias("id"), "size"), "id")

    def greedy(table: pa.Table) -> pa.Table:
        b = Block(table)
        r, size = np.asarray(table.column("radius").to_numpy(zero_copy_only=False), float), np.asarray(table.column("size"), np.int64)
        covered, cores, within = np.zeros(len(b.id), bool), 0, Within(b.x, scale)
        for k in np.lexsort((b.id, -size)):
            if not covered[k]:
                cores += 1
                covered[within(k, r[k], True)] = True
        return pa.table({"label": pa.array([int(b.label[0])], pa.int32()), "cores": [cores], "n": [len(b.id)]})

    out = x.groupBy("label").applyInArrow(greedy, "label int, cores long, n long")
    return out.select("label", _r(F.col("cores") / F.col("n"), "value")) if by_class else out.agg(_r(F.sum("cores") / F.sum("n"), "value"))


def onb_balls(df: DataFrame) -> DataFrame:
    """(id, label, features, radius, members): per class a greedy cover by balls that reach to the nearest other class; most new rows first, then lowest id."""
    ship(df.sparkSession)
    scale = ranges(df)
    x = df.select("id", "label", "features").join(nearest_by_class(df, scale).select(F.col("i").alias("id"), F.col("other_dist").alias("radius")), "id")

    def cover(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        b = Block(table)
        r = np.asarray(table.column("radius").to_numpy(zero_copy_only=False), float)
        left, picks, got, within = np.ones(len(b.id), bool), [], [], Within(b.x, scale)
        # What a ball adds only falls as others are picked: the first of the queue is counted anew, and picked if it stays first.
        queue = [(-len(within(k, r[k])), k) for k in range(len(b.id))]
        heapq.heapify(queue)
        n = len(b.id)
        while n:
            k = queue[0][1]
            new = within(k, r[k])
            new = new[left[new]]
            if queue[0][0] != -len(new):
                if len(new):
                    heapq.heapreplace(queue, (-len(new), k))
                else:
                    heapq.heappop(queue)
                continue
            heapq.heappop(queue)
            picks.append(k)
            got.append(len(new))
            left[new] = False
            n -= len(new)
        t = table.take(picks).select(["id", "label", "features", "radius"])
        return t.append_column("members", pa.array(got, pa.int64()))

    return x.groupBy("label").applyInArrow(cover, "id long, label int, features array<double>, radius double, members long")


def onb(df: DataFrame, total: bool = False) -> DataFrame:
    """(value): balls per row, mean over classes, or over all rows."""
    n = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    b = onb_balls(df).groupBy("label").agg(F.count(F.lit(1)).alias("b"))
    x = n.join(b, "label")
    return x.agg(_r(F.sum("b") / F.sum("n") if total else F.avg(F.col("b") / F.col("n")), "value"))


def dbc(df: DataFrame, balls: DataFrame | None = None) -> DataFrame:
    """(value): N1 over the balls' centres, with ranges of the centres."""
    b = cut((onb_balls(df) if balls is None else balls).select("id", "label", "features"))
    return n1(b)


def nsg(df: DataFrame, balls: DataFrame | None = None) -> DataFrame:
    """(value): mean number of members of a ball."""
    return (onb_balls(df) if balls is None else balls).agg(_r(F.avg("members"), "value"))


def icsv(df: DataFrame, balls: DataFrame | None = None) -> DataFrame:
    """(value): population standard deviation of members per volume, radii relative to the largest."""
    d = width(df)
    b = cut(onb_balls(df) if balls is None else balls)
    most = b.agg(F.max("radius")).first()[0] or 1.0
    unit = math.pi ** (d / 2) / math.gamma(d / 2 + 1)
    volume = F.lit(unit) * F.pow(F.col("radius") / F.lit(most), F.lit(d))
    return b.agg(_r(F.stddev_pop(F.when(volume > 0, F.col("members") / volume)), "value"))


def mrca(df: DataFrame, seed: int = 42, clusters: int = 3) -> DataFrame:
    """(cluster, n, value): mean multi-resolution index of k-means clusters of the rows' profiles in three radii."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    p = hypersphere_profile(df, ranges(df))
    v = cut(p.withColumn("v", array_to_vector(F.array("psi_0", "psi_1", "psi_2"))))
    got = KMeans(k=clusters, seed=seed, featuresCol="v", predictionCol="cluster").fit(v).transform(v)
    mri = (1 - (F.col("psi_0") + F.col("psi_1") + F.col("psi_2")) / 3) / 2
    return got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), _r(F.avg(mri), "value"))


# --- resolutions ----------------------------------------------------------------------------------------------------


def _corners(df: DataFrame) -> tuple[list, list]:
    """Least and greatest value of each feature."""
    d = width(df)
    row = df.agg(*[F.min(F.col("features")[k]) for k in range(d)], *[F.max(F.col("features")[k]) for k in range(d)]).first()
    return list(row[:d]), list(row[d:])


def _cell(res: Column, least: list, most: list) -> Column:
    part = []
    for k, (lo, hi) in enumerate(zip(least, most, strict=True)):
        step = F.lit(hi - lo) / (res + 1)
        part.append(F.lit(0).cast("long") if lo == hi else F.greatest(F.lit(0).cast("long"), F.ceil(F.round((F.col("features")[k] - lo) / step, 9)) - 1))
    return F.concat_ws("-", *[p.cast("string") for p in part])


def cells(df: DataFrame, resolutions: int = 32) -> DataFrame:
    """(id, label, features, res, cell): the grid cell of each row at each resolution, as in `0-3-1`."""
    x = df.select("id", "label", "features", F.explode(F.sequence(F.lit(0), F.lit(resolutions - 1))).alias("res"))
    return x.withColumn("cell", _cell(F.col("res"), *_corners(df)))


def _auc(values: list[float]) -> float:
    return sum((a + b) / 2 for a, b in zip(values, values[1:], strict=False)) / max(1, len(values) - 1)


def purity_curve(df: DataFrame, resolutions: int = 32) -> DataFrame:
    """(res, purity): per resolution, how far from even the classes are in a cell, weighted by rows."""
    classes = df.select("label").distinct().count()
    n = F.count(F.lit(1))
    per = cells(df, resolutions).groupBy("res", "cell", "label").agg(n.alias("c"))
    cell = per.groupBy("res", "cell").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    # sum over classes of (p - 1/C)² = sum of p² - 1/C
    value = F.sqrt(F.greatest(F.lit(0.0), F.lit(classes / max(1, classes - 1)) * (F.col("q") / (F.col("n") * F.col("n")) - 1.0 / classes)))
    return cell.groupBy("res").agg(_r(F.sum(value * F.col("n")) / F.sum("n"), "purity"))


def purity(df: DataFrame, resolutions: int = 32) -> DataFrame:
    rows = sorted((r["res"], r["purity"]) for r in purity_curve(df, resolutions).collect())
    w = [p / 2**i for i, p in rows]
    lo, hi = min(w), max(w)
    value = _auc([(x - lo) / (hi - lo) if hi > lo else 0.0 for x in w]) / 0.702
    return df.sparkSession.createDataFrame([(round(value, 6),)], "value double")


def _in_cells(q: Block, d: Block, scale: list[float], kmax: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kmax nearest rows of d in a row's own cell, for each row of q and each resolution: (rows, resolutions, kmax) places in d, -1 for none;
    and their distances in units of 1e-9, and the rows' cells."""
    get = lambda b: np.asarray(b.table.column("cells").combine_chunks().flatten(), np.int64).reshape(len(b.id), -1)
    cq, cd, n = get(q), get(d), len(d.id)
    order = np.argsort(d.id, kind="stable")
    cd, none = cd[order], np.iinfo(np.int64).max
    # One number for distance and id, so that nothing ties.
    key = np.rint(distances(q.x, d.x[order], scale) * 1e9).astype(np.int64) * n + np.arange(n)
    key[q.id[:, None] == d.id[order][None, :]] = none
    m = min(n, NEAREST)
    near = np.argpartition(key, m - 1, axis=1)[:, :m]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(key, near, 1), axis=1), 1)
    other = np.take_along_axis(key, near, 1) != none
    pick = np.full((*cq.shape, kmax), -1)
    for res in range(cq.shape[1]):
        match = (cd[near, res] == cq[:, res, None]) & other
        run = match.cumsum(1)
        r, c = np.nonzero(match & (run <= kmax))
        pick[r, res, run[r, c] - 1] = near[r, c]
        # Where the nearest of all are not enough, all of the cell.
        short = np.flatnonzero(run[:, -1] < kmax) if m < n else np.zeros(0, int)
        some, back = np.unique(cq[short, res], return_inverse=True)
        for i, cell in enumerate(some):
            rows, cols = short[back == i], np.flatnonzero(cd[:, res] == cell)
            sub = key[np.ix_(rows, cols)]
            if len(cols) > kmax:
                best = np.argpartition(sub, kmax - 1, axis=1)[:, :kmax]
                sub, cols = np.take_along_axis(sub, best, 1), cols[best]
            else:
                cols = np.broadcast_to(cols, sub.shape)
            best = np.argsort(sub, axis=1)
            pick[rows, res, : sub.shape[1]] = np.where(np.take_along_axis(sub, best, 1) == none, -1, np.take_along_axis(cols, best, 1))
    at = np.take_along_axis(key, np.maximum(pick, 0).reshape(len(q.id), -1), 1).reshape(pick.shape) // n if n else np.zeros(pick.shape, np.int64)
    return np.where(pick >= 0, order[pick], -1), at, cq


def _meeting(x: Boxes, spots, corners: tuple[list, list], kmax: int) -> list[np.ndarray]:
    """For each block those that may hold one of the kmax nearest rows of a row's cell at some resolution. spots: what of a block lies in a cell.

    A cell's rows of a block look no farther than across themselves, if they are enough, nor than to the far end of a block that lies in
    the cell as a whole.
    """
    m, d = len(x.n), x.d
    has = spots[[f"has{k}" for k in range(d)]].to_numpy(np.int64)
    box = SimpleNamespace(lo=spots[[f"lo{k}" for k in range(d)]].to_numpy(float), hi=spots[[f"hi{k}" for k in range(d)]].to_numpy(float), holes=has < spots["n"].to_numpy(np.int64)[:, None])
    least, most = (np.array(v, float) for v in corners)

    def numbers(v: np.ndarray, res: np.ndarray, room: float) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(least == most, 0, np.maximum(0, np.ceil((v - least) / ((most - least) / (res[:, None] + 1)) + room) - 1))

    res = spots["res"].to_numpy(np.int64)
    first, last = numbers(box.lo, res, -1e-6), numbers(box.hi, res, 1e-6)
    grid = [(numbers(x.lo, np.full(m, r), -1e-6), numbers(x.hi, np.full(m, r), 1e-6)) for r in range(int(res.max()) + 1)]
    whole, useful = ~x.holes.any(1), x.first_of_places(kmax + 1)
    at, size = np.searchsorted(x.names, spots["_b"].to_numpy(np.int64)), spots["n"].to_numpy(np.int64)
    out, seen = [np.zeros(m, bool) for _ in range(m)], {}
    for i, r in enumerate(at):
        name = (box.lo[i].tobytes(), box.hi[i].tobytes(), box.holes[i].tobytes())
        if name not in seen:
            own = SimpleNamespace(lo=box.lo[i : i + 1], hi=box.hi[i : i + 1], holes=box.holes[i : i + 1], scale=x.scale, d=d)
            seen[name] = (*x.bounds(box, i), Boxes.bounds(own, box, i)[1][0])
        low, high, across = seen[name]
        a, b = grid[res[i]]
        meets, reach = np.ones(m, bool), across if size[i] > kmax else np.inf
        if not box.holes[i].any():
            meets = ((a <= last[i]) & (b >= first[i])).all(1) | ~whole
            if (first[i] == last[i]).all():
                inside = whole & ((a == first[i]) & (b == first[i])).all(1) & (x.n > kmax)
                reach = min(reach, high[inside].min(initial=np.inf))
        out[r] |= meets & useful & (low <= reach)
    return out


def neighbourhood_separability(df: DataFrame, resolutions: int = 32, kmax: int = 11) -> DataFrame:
    """(value): area under the share of the own class among the nearest rows of a row's cell, over resolutions.

    Of a row's nearest, only which are of its class matters, as bits: rows of a cell, class and bits are counted as they are made.
    """
    ship(df.sparkSession)
    scale, corners = ranges(df), _corners(df)
    listed = df.select("id", "label", "features", F.transform(F.sequence(F.lit(0), F.lit(resolutions - 1)), lambda r: F.xxhash64(_cell(r, *corners))).alias("cells"))
    x = Boxes(listed, scale)
    x.df = cut(x.df)
    f = lambda k: F.when(~F.isnan(F.col("features")[k]), F.col("features")[k])
    each = x.df.select("_b", "label", "features", F.posexplode("cells").alias("res", "cell"))
    spots = cut(each.groupBy("_b", "res", "cell", "label").agg(F.count(F.lit(1)).alias("n"), *[g(f(k)).alias(f"{a}{k}") for k in range(x.d) for g, a in ((F.min, "lo"), (F.max, "hi"), (F.count, "has"))]))
    some = spots.groupBy("_b", "res", "cell").agg(F.sum("n").alias("n"), *[g(f"{a}{k}").alias(f"{a}{k}") for k in range(x.d) for g, a in ((F.min, "lo"), (F.max, "hi"), (F.sum, "has"))]).limit(SPOTS + 1).toPandas()
    meeting = _meeting(x, some, corners, kmax) if 0 < len(some) <= SPOTS else [x.first_of_places(kmax + 1)] * len(x.n)
    plans: tuple[list, list] = ([], [])
    for r, at in enumerate(meeting):
        runs = list(_runs(np.flatnonzero(at), x.n))
        plans[bool(runs and runs[-1][0])].extend((r, p, int(c)) for p, c in runs)

    def whole(q: Block, d: Block) -> pa.Table:
        pick, _, cell = _in_cells(q, d, scale, kmax)
        bits = (((pick >= 0) & (d.label[pick] == q.label[:, None, None])) << np.arange(kmax)).sum(2)
        t = pa.table({"res": np.tile(np.arange(resolutions, dtype=np.int32), len(q.id)), "cell": cell.ravel(), "label": pa.array(np.repeat(q.label, resolutions), pa.int32()), "bits": bits.ravel()})
        return t.group_by(["res", "cell", "label", "bits"]).aggregate([([], "count_all")]).rename_columns(["res", "cell", "label", "bits", "n"])

    def parts(q: Block, d: Block) -> pa.Table:
        pick, dist, cell = _in_cells(q, d, scale, kmax)
        got = pick >= 0
        ends = np.concatenate([[0], np.cumsum(got.sum(2).ravel())]).astype(np.int32)
        same = d.label[pick] == q.label[:, None, None]
        near = pa.StructArray.from_arrays([pa.array(dist[got]), pa.array(d.id[pick[got]]), pa.array(same[got].astype(np.int32))], ["dist", "j", "same"])
        return pa.table({"i": np.repeat(q.id, resolutions), "res": np.tile(np.arange(resolutions, dtype=np.int32), len(q.id)), "cell": cell.ravel(), "label": pa.array(np.repeat(q.label, resolutions), pa.int32()), "near": pa.ListArray.from_arrays(pa.array(ends), near)})

    found = None
    if plans[0]:
        found = _deal(x, x, plans[0], whole, "res int, cell long, label int, bits long, n long")
    if plans[1]:
        y = _deal(x, x, plans[1], parts, "i long, res int, cell long, label int, near array<struct<dist:long,j:long,same:int>>")
        y = y.groupBy("i", "res", "cell", "label").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, kmax).alias("near"))
        bits = F.aggregate(F.transform("near", lambda s, k: s["same"].cast("long") * F.pow(F.lit(2.0), k).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
        y = y.select("res", "cell", "label", bits.alias("bits"), F.lit(1).cast("long").alias("n"))
        found = y if found is None else found.unionByName(y)
    own = spots.groupBy("res", "cell", "label").agg(F.sum("n").alias("own"))
    everyone = spots.groupBy("res", "cell").agg(F.sum("n").alias("all"))
    base = cut(own.join(everyone, ["res", "cell"]).select("res", "cell", "label", "all", F.least(F.col("own") - 1, F.lit(kmax)).alias("m")))
    got = found.groupBy("res", "cell", "label", "bits").agg(F.sum("n").alias("n")).join(small(base), ["res", "cell", "label"])
    p = lambda k: F.bit_count(F.col("bits").bitwiseAND(F.lit((1 << k) - 1))) / k
    area = sum((F.when(F.col("m") >= k, (p(k) + p(k - 1)) / 2).otherwise(0.0) for k in range(2, kmax + 1)), F.lit(0.0))
    auc = F.when((F.col("m") == 0) & (F.col("all") > 1), 0.0).when(F.col("m") == 0, 1.0).when(F.col("m") == 1, p(1)).otherwise(area / F.col("m"))
    rows = sorted((r["res"], r["v"]) for r in got.groupBy("res").agg((F.sum(auc * F.col("n")) / F.sum("n")).alias("v")).collect())
    return df.sparkSession.createDataFrame([(round(_auc([v / 2**i for i, v in rows]), 6),)], "value double")
