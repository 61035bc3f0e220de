"""Connected components by alternating large-star and small-star steps, and minimum spanning forests by Borůvka rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.stages import BROADCAST_ROWS, cut
from .distance import CACHED, Block, Boxes, _deal, _pairwise, _runs, distances

#: Rows of a block up to which its components are joined in its own task first.
DENSE = 2048


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (node, root) of each node with an edge to another one; root is the component's smallest. No task holds a component."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        own = least.select("u", F.col("m").alias("v"))
        e = cut(e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def _roots(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """components() of a few edges."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = i = up[up[i]]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [(i, find(i)) for i in list(up)]


def spanning_forest(df: DataFrame, scale: list[float] | None = None, kinds: list[int] | None = None) -> DataFrame:
    """(a, b, dist, cross): edges of the minimum spanning forest over all pairs with a distance above zero.

    Rows at distance zero are no neighbours. Equal distances are ordered by their ends' ids. A round at least halves the
    number of components: rows meet their own block first, which bounds how far each component's least edge reaches, then
    the blocks within that reach that may hold other components. Before the rounds, each block joins in its task what no
    other block can come nearer to.
    """
    x = Boxes(df.select("id", "label", "features"), scale)
    schema = "comp long, dist double, a long, b long, other long, cross int"
    forest = None
    if len(x.n) and not (kinds and any(kinds)) and x.n.min() <= DENSE:
        joined = cut(_joined_at_home(x))
        forest = joined.where("a is not null").select("a", "b", "dist", "cross")
        x.df = joined.select("id", "label", "features", "_b", "comp")
    else:
        x.df = cut(x.df.withColumn("comp", F.col("id")))

    def compare(q: Block, d: Block) -> pa.Table:
        if "order" not in d.kept:
            order = np.argsort(d.id, kind="stable")
            d.kept.update(order=order, x=d.x[order], comp=np.asarray(d.table.column("comp"), np.int64)[order])
        order, qc, dc = d.kept["order"], np.asarray(q.table.column("comp"), np.int64), d.kept["comp"]
        col, value = np.zeros(len(q.id), np.int64), np.full(len(q.id), np.inf)
        step = max(1, CACHED // max(1, len(order)))
        for k in range(0, len(q.id) if len(order) else 0, step):
            dist = distances(q.x[k : k + step], d.kept["x"], scale, kinds)
            dist[(qc[k : k + step, None] == dc[None, :]) | (dist == 0)] = np.inf
            # Of a row's equal edges the one to the lowest id comes first.
            col[k : k + step] = dist.argmin(1)
            value[k : k + step] = np.take_along_axis(dist, col[k : k + step, None], 1)[:, 0]
        row = np.flatnonzero(np.isfinite(value))
        col, value = order[col[row]] if len(row) else np.zeros(0, np.int64), value[row]
        dc = np.asarray(d.table.column("comp"), np.int64)
        lo, hi = np.minimum(q.id[row], d.id[col]), np.maximum(q.id[row], d.id[col])
        # The least edge of each component in (dist, lower end, higher end).
        order = np.lexsort((hi, lo, value, qc[row]))
        at = order[np.unique(qc[row][order], return_index=True)[1]]
        row, col = row[at], col[at]
        return pa.table({"comp": qc[row], "dist": value[at], "a": lo[at], "b": hi[at], "other": dc[col], "cross": pa.array(q.label[row] != d.label[col]).cast(pa.int32())})

    least = lambda e: e.groupBy("comp").agg(F.min(F.struct("dist", "a", "b", "other", "cross")).alias("e")).select("comp", "e.*")
    while True:
        of = x.df.groupBy("_b").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).toPandas().sort_values("_b")
        first, one = of["first"].to_numpy(np.int64), (of["first"] == of["last"]).to_numpy()
        if not len(of) or (one & (first == first[0])).all():
            break
        mixed, near, far = np.flatnonzero(~one), None, np.full(len(of), np.inf)
        if len(mixed):
            near = cut(least(_deal(x, x, [(int(r), 0, int(r)) for r in mixed], compare, schema)))
            far = x.df.join(near.select("comp", "dist"), "comp", "left").groupBy("_b").agg(F.max(F.coalesce("dist", F.lit(np.inf))).alias("far")).toPandas().sort_values("_b")["far"].to_numpy(float)
        plan = _reaching(x, first, one, far, kinds)
        if plan:
            more = _deal(x, x, plan, compare, schema)
            best = cut(least(more if near is None else more.unionByName(near)))
        else:
            best = near
        if best is None or best.isEmpty():
            break
        new = best.select("a", "b", "dist", "cross").distinct()
        forest = new if forest is None else forest.unionByName(new).distinct()
        pairs = best.select(F.col("comp").alias("a"), F.col("other").alias("b"))
        few = pairs.limit(BROADCAST_ROWS + 1).toPandas()
        joined = components(pairs) if len(few) > BROADCAST_ROWS else F.broadcast(df.sparkSession.createDataFrame(_roots(few.to_numpy().tolist()), "node long, root long"))
        x.df = cut(x.df.join(joined.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"))
    if forest is None:
        return df.sparkSession.createDataFrame([], "a long, b long, dist double, cross int")
    return forest


def _joined_at_home(x: Boxes) -> DataFrame:
    """x.df with comp and, in some rows, an edge (a, b, dist, cross): the rounds that each block can do alone.

    A component takes its least edge within its block if it is shorter than the way of each of its rows to any other block.
    """
    lo, hi, holes, scale, names = x.lo, x.hi, x.holes, x.scale, x.names
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.df.select("id", "label", "features", "_b").schema.fields)

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["id", "label", "features", "_b"]).sort_by("id")
        b = Block(table)
        n, own = len(b.id), int(np.searchsorted(names, table.column("_b")[0].as_py()))
        comp, edges = np.arange(n), np.zeros((0, 2), np.int64)
        if n <= DENSE:
            room = np.full(n, np.inf)
            for other in np.delete(np.arange(len(names)), own):
                gap = np.maximum(0, np.maximum(lo[other] - b.x, b.x - hi[other])) / scale
                gap = np.where(holes[other] | ~np.isfinite(gap), 0, gap)
                room = np.minimum(room, np.sqrt((gap * gap).sum(1)) * (1 - 1e-12) - 2e-9)
            dist = distances(b.x, b.x, scale.tolist())
            dist[dist == 0] = np.inf
            while True:
                dist[comp[:, None] == comp[None, :]] = np.inf
                col = dist.argmin(1)
                value = dist[np.arange(n), col]
                low, high = np.minimum(np.arange(n), col), np.maximum(np.arange(n), col)
                order = np.lexsort((high, low, value, comp))
                at = order[np.unique(comp[order], return_index=True)[1]]
                least = np.full(n, np.inf)
                np.minimum.at(least, comp, room)
                at = at[np.isfinite(value[at]) & (value[at] < least[comp[at]])]
                if not len(at):
                    break
                edges = np.unique(np.vstack([edges, np.column_stack([low[at], high[at]])]), axis=0)
                root = np.arange(n)
                for i, r in _roots(list(zip(comp[low[at]].tolist(), comp[high[at]].tolist(), strict=True))):
                    root[i] = r
                comp = root[comp]
        # A block has fewer edges than rows.
        k, none = len(edges), np.arange(n) >= len(edges)
        put = lambda v, kind: pa.array(np.concatenate([v, np.zeros(n - k, v.dtype)]), kind, mask=none)
        i, j = edges.T
        d = _pairwise(b.x[i], b.x[j], scale.tolist())
        for name, column in (("comp", pa.array(b.id[comp])), ("a", put(b.id[i], pa.int64())), ("b", put(b.id[j], pa.int64())), ("dist", put(d, pa.float64())), ("cross", put((b.label[i] != b.label[j]).astype(np.int32), pa.int32()))):
            table = table.append_column(name, column)
        return table

    ship(x.df.sparkSession)
    return x.df.select("id", "label", "features", "_b").groupBy("_b").applyInArrow(run, f"{kinds}, comp long, a long, b long, dist double, cross int")


def _reaching(x: Boxes, first: np.ndarray, one: np.ndarray, far: np.ndarray, kinds: list[int] | None) -> list[tuple[int, int, int]]:
    """(block, part, other block): blocks that may hold the least edge of a component in a block; a block has one component, `first`, or many.

    A least edge is no longer than far, the longest that a component of the block has found, and no longer than the way to a
    block that surely has a row of another component at some distance; all blocks of a lone component share the best of these.
    """
    bounds = [x.bounds(x, r, kinds) for r in range(len(first))]
    foreign = lambda r: ~one | (one[r] & (first != first[r]))
    reach = np.array([min(far[r], high[(low > 0) & foreign(r)].min(initial=np.inf)) for r, (low, high) in enumerate(bounds)])
    alone = np.flatnonzero(one)
    if len(alone):
        names, at = np.unique(first[alone], return_inverse=True)
        best = np.full(len(names), np.inf)
        np.minimum.at(best, at, reach[alone])
        reach[alone] = best[at]
    plan = []
    for r, (low, high) in enumerate(bounds):
        # Blocks of one place have no distance.
        wanted = (low <= reach[r]) & (high > 2e-9) & ~(one[r] & one & (first == first[r]))
        wanted[r] = False
        plan += [(r, p, int(c)) for p, c in _runs(np.flatnonzero(wanted), x.n)]
    return plan
