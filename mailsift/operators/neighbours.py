"""Distance joins: neighbours within a radius, k nearest neighbours, distance sums.

Points are (id, x array<double>). Equal points are merged into one weighted point before anything
is shuffled, so a large group of copies counts as a single row. Points are then divided among
pivots (a seeded sample of the distinct points, hence dense regions get more pivots). The triangle
inequality tells which parts a point has to be compared with; nothing within reach is missed. A
part too large for one task is cut into blocks, and every pair of blocks becomes its own task. Only
aggregates per point leave a task (counts, k best, sums), never the pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mailsift.functions import seeded
from mailsift.operators import tiles
from mailsift.session import keep, written

BLOCK = 2048          # rows per side of a task
CELLS = 1 << 22       # entries of a distance matrix that a task holds at once
SLACK = 1e-9          # rounding allowance when parts are ruled out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, from differences (no cancellation for close points)."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        diff = a[:, k, None] - b[None, :, k]
        total += diff * diff
    return np.sqrt(total)


def _pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the given pairs, digit for digit those of ``distances``."""
    total = np.zeros(len(i))
    for k in range(a.shape[1]):
        diff = a[i, k] - b[j, k]
        total += diff * diff
    return np.sqrt(total)


def _squares(a: np.ndarray, b: np.ndarray, kind: type = np.float64) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and a bound of their rounding errors. Not finite where a point is not."""
    with np.errstate(all="ignore"):
        middle = b.mean(axis=0)
        a, b = a - middle, b - middle
        an, bn = (a * a).sum(axis=1), (b * b).sum(axis=1)
        left = np.column_stack([-2.0 * a, an, np.ones(len(a))]).astype(kind)
        right = np.column_stack([b, np.ones(len(b)), bn]).astype(kind)
        out = left @ right.T
        size = an.max() + bn.max() + (middle * middle).max()
        slack = 8 * (a.shape[1] + 8) * float(np.finfo(kind).eps) * size
    return out, slack if size < 1e30 else np.inf


def _against(a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, float]:
    """``_squares`` in single precision where its rounding errors are small beside the squared distance ``limit``."""
    sq, slack = _squares(a, b, np.float32)
    if slack > 1e-3 * limit:
        return _squares(a, b)
    return sq, slack + 1e-6 * limit


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """``distances(a, b) <= eps``: a product settles most pairs, those too close to call are compared by differences."""
    if not len(a) or not len(b) or eps < 0:
        return distances(a, b) <= eps
    sq, slack = _against(a, b, eps * eps)
    if not np.isfinite(slack):
        return distances(a, b) <= eps
    margin = slack + 1e-12 * eps * eps
    near = sq <= eps * eps - margin
    i, j = np.nonzero(near != (sq <= eps * eps + margin))
    if len(i) > near.size // 8:
        return distances(a, b) <= eps
    near[i, j] = _pair_distances(a, b, i, j) <= eps
    return near


def closest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, distances) of the ``k`` points of ``b`` nearest to each of ``a``, ties by id.

    A product leaves the few candidates that rounding cannot rule out; these are compared by differences.
    """
    sq, slack = _squares(a, b)
    if np.isfinite(slack) and k < len(b):
        kth = np.partition(sq, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(sq <= (kth + 2 * slack + 1e-12 * np.abs(kth))[:, None])
        if len(i) <= sq.size // 8:
            d = _pair_distances(a, b, i, j)
            order = np.lexsort((ids[j], d, i))
            first = np.searchsorted(i, np.arange(len(a)))  # ``i`` ascends, before and after
            take = order[first[:, None] + np.arange(k)[None]]
            return j[take], d[take]
    d = distances(a, b)
    by_id = np.argsort(ids, kind="stable")
    best = by_id[np.argsort(d[:, by_id], axis=1, kind="stable")[:, :k]]
    return best, np.take_along_axis(d, best, axis=1)


def far_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``distances`` to ten digits: pairs so close that a product would cancel are taken by differences."""
    sq, slack = _squares(a, b)
    if not np.isfinite(slack):
        return distances(a, b)
    i, j = np.nonzero(sq <= 1e10 * slack)
    if len(i) > sq.size // 8:
        return distances(a, b)
    sq[i, j] = 0.0
    out = np.sqrt(sq, out=sq)
    out[i, j] = _pair_distances(a, b, i, j)
    return out


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


@dataclass
class Parts:
    """Weighted points with their part, and the parts' centres, radii and sizes."""

    points: DataFrame       # pid, x, w, part (and any extra columns)
    pivots: np.ndarray
    radius: np.ndarray
    rows: dict[int, int]
    weight: np.ndarray


def merge_copies(points: DataFrame, *extra: str) -> DataFrame:
    """One weighted point per distinct vector; partial aggregation absorbs hot groups of copies."""
    return points.groupBy("x", *extra).agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w"))


def to_original(points: DataFrame, result: DataFrame) -> DataFrame:
    """Give every copy the result of its merged point (``result`` has x once). Spark splits large groups of copies."""
    return points.select("id", "x").join(result, "x")


def divide(merged: DataFrame) -> Parts:
    merged = keep(merged)
    n = merged.count()
    m = max(1, math.ceil(min(n / BLOCK, math.sqrt(n))))  # parts and what is collected grow with the root at most
    sample = (
        merged.select("x", seeded.digest("pivot", F.col("pid")).alias("d")).orderBy("d").limit(m).collect()
    )
    pivots = np.array([r["x"] for r in sample], dtype=float)

    def home(batches):
        for pdf in batches:
            for lot in lots(pdf, m):
                x = matrix(lot["x"])
                sq, slack = _squares(x, pivots)
                part = (sq if np.isfinite(slack) else distances(x, pivots)).argmin(axis=1)  # any part will do, with its distance
                yield lot.assign(part=part.astype("int32"), to_pivot=_pair_distances(x, pivots, np.arange(len(lot)), part))

    schema = f"{_ddl(merged)}, part int, to_pivot double"
    placed = keep(merged.mapInPandas(home, schema))
    stats = placed.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.max("to_pivot").alias("r")).collect()
    radius, weight = np.full(m, -np.inf), np.zeros(m)
    for r in stats:
        radius[r["part"]], weight[r["part"]] = r["r"], r["w"]
    return Parts(placed.drop("to_pivot"), pivots, radius, {r["part"]: r["n"] for r in stats}, weight)


def lots(pdf: pd.DataFrame, width: int):
    """The rows in lots whose distance matrix to ``width`` points stays bounded."""
    step = max(1, CELLS // max(1, width))
    for start in range(0, len(pdf), step):
        yield pdf.iloc[start:start + step]


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def route(queries: DataFrame, parts: Parts, reach: float | None = None, least_weight: float = 0.0,
          skip_own: bool = False) -> DataFrame:
    """Copies of each query for the parts that may hold a point within its reach.

    The reach is a number, or the column ``reach`` (null: unknown) tightened by the radius that
    certainly covers ``least_weight`` points.
    """
    pivots, radius, weight = parts.pivots, parts.radius, parts.weight

    def spread(batches):
        for pdf in (lot for batch in batches for lot in lots(batch, len(pivots))):
            d = distances(matrix(pdf["x"]), pivots)
            if reach is None:
                far = d + radius[None, :]
                order = np.argsort(far, axis=1)
                covered = np.cumsum(weight[order], axis=1)
                first = (covered < least_weight).sum(axis=1)
                sure = np.take_along_axis(far, order, axis=1)
                sure = np.concatenate([sure, np.full((len(pdf), 1), np.inf)], axis=1)
                limit = sure[np.arange(len(pdf)), first]
                known = pdf["reach"].to_numpy(dtype=float)
                limit = np.where(np.isnan(known), limit, np.minimum(known, limit))
            else:
                limit = np.full(len(pdf), reach)
            wanted = (d - radius[None, :] <= limit[:, None] * (1 + SLACK) + SLACK) & np.isfinite(radius)[None, :]
            if skip_own:
                wanted[np.arange(len(pdf)), pdf["part"].to_numpy()] = False
            row, part = np.nonzero(wanted)
            out = pdf.iloc[row].copy()
            out["part"] = part.astype("int32")
            yield out

    return queries.mapInPandas(spread, _ddl(queries))


def block_join(queries: DataFrame, home: DataFrame, home_rows: dict[int, int], kernel, schema: str) -> DataFrame:
    """Run ``kernel(query block, home block)`` for all block pairs of every part.

    Block numbers come from a hash of the point, their count from the part's size: a part that
    holds a third of all rows is spread over many tasks.
    """
    spark = home.sparkSession
    queries = keep(queries)
    query_rows = {r[0]: r[1] for r in queries.groupBy("part").count().collect()}
    sizes = [
        (int(p), max(1, math.ceil(n / BLOCK)), max(1, math.ceil(query_rows[p] / BLOCK)))
        for p, n in home_rows.items() if p in query_rows
    ]

    def with_blocks(df: DataFrame) -> DataFrame:
        if len(sizes) == 1:
            part, nh, nq = sizes[0]
            return df.where(F.col("part") == part).withColumns({"nh": F.lit(nh), "nq": F.lit(nq)})
        table = spark.createDataFrame(sizes, "part int, nh int, nq int")
        return df.join(F.broadcast(table), "part")  # a row for each pivot

    spot = F.xxhash64("pid")
    home = home.toDF(*home.columns)  # new column identities: both sides may be the same table
    h = with_blocks(home).withColumns({
        "j": F.pmod(spot, F.col("nh")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("nq") - 1))})
    q = with_blocks(queries).withColumns({
        "i": F.pmod(spot, F.col("nq")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("nh") - 1))})
    keys = ["part", "i", "j"]
    return q.drop("nh", "nq").groupBy(*keys).cogroup(h.drop("nh", "nq").groupBy(*keys)).applyInPandas(kernel, schema)


# --- neighbours within a radius ----------------------------------------------------------

def neighbour_counts(parts: Parts, eps: float) -> DataFrame:
    """(pid, n): weighted points within ``eps``, the point itself included."""
    def fold(q: tiles.Rows):
        n = np.zeros(q.size, dtype=np.int64)

        def step(h: tiles.Rows):
            middle, radius = tiles.ball(h.x)
            d = tiles.apart(q.x, middle)
            whole = d + radius <= eps * (1 - SLACK)
            n[whole] += h.w.sum()
            for rows in tiles.tiles(np.flatnonzero(~whole & ~(d - radius > eps * (1 + SLACK) + SLACK))):
                n[rows] += weigh(within(q.x[rows], h.x, eps), h.w)
            yield from ()

        def finish():
            yield from tiles.batches_of({"pid": pa.array(q.pid), "n": pa.array(n)})
        return step, finish

    found = tiles.stream(parts.points.select("pid", "x", "part"), parts.points.select("pid", "x", "w", "part"), parts.rows, parts.rows,
                         fold, "pid bigint, n bigint", BLOCK, point_bytes(parts))
    return found.groupBy("pid").agg(F.sum("n").alias("n"))


def weigh(near: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight of the marked points of each row."""
    return np.count_nonzero(near, axis=1) if (w == 1).all() else near @ w


def point_bytes(parts: Parts) -> int:
    return 8 * (parts.pivots.shape[1] if parts.rows else 0) + 64


def _components(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component number of each row and column of a bipartite adjacency matrix (-1: no link)."""
    rows, cols = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    label = 0
    for start in np.nonzero(near.any(axis=0))[0]:
        if cols[start] >= 0:
            continue
        cols[start], front = label, np.array([start])
        while len(front):
            new_rows = np.nonzero((rows < 0) & near[:, front].any(axis=1))[0]
            rows[new_rows] = label
            front = np.nonzero((cols < 0) & near[new_rows].any(axis=0))[0] if len(new_rows) else new_rows
            cols[front] = label
        label += 1
    return rows, cols


# --- k nearest neighbours ----------------------------------------------------------------

NEAR = "near array<struct<dist:double,id:bigint,w:bigint,x:array<double>>>"


def _best(k: int, coordinates: bool):
    def kernel(q: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(h):
            return pd.DataFrame({"pid": [], "x": [], "part": [], "near": []})
        hid, hw = h["pid"].to_numpy(), h["w"].to_numpy()
        hx = matrix(h["x"]).tolist() if coordinates else [None] * len(h)
        take = min(k, len(h))
        best, d = closest(matrix(q["x"]), matrix(h["x"]), hid, take)
        found = zip(d.tolist(), hid[best].tolist(), hw[best].tolist(), best.tolist())
        near = [[{"dist": a, "id": i, "w": w, "x": hx[c]} for a, i, w, c in zip(*row)] for row in found]
        return pd.DataFrame({"pid": q["pid"], "x": q["x"], "part": q["home_part"], "near": near})
    return kernel


def _best_fold(need: int, coordinates: bool):
    """The ``need`` nearest of all points by distance and id. The worst of those found so far rules chunks and pairs out."""
    def fold(q: tiles.Rows):
        dist, ids = np.full((q.size, need), np.inf), np.full((q.size, need), np.iinfo(np.int64).max)
        weight, place = np.zeros((q.size, need), dtype=np.int64), np.full(q.size, np.inf)
        where = np.zeros((q.size, need, q.x.shape[1])) if coordinates else None

        def take_in(rows: np.ndarray, i: np.ndarray, d: np.ndarray, j: np.ndarray, h: tiles.Rows) -> None:
            """Found points ``j`` at distance ``d`` of the queries ``rows[i]``, beside those known."""
            at, row = np.unique(i, return_inverse=True)
            old = rows[at]
            own = np.repeat(np.arange(len(at)), need)
            r, dd = np.concatenate([own, row]), np.concatenate([dist[old].ravel(), d])
            order = np.lexsort((np.concatenate([ids[old].ravel(), h.pid[j]]), dd, r))
            first = np.searchsorted(r[order], np.arange(len(at)))
            best = order[first[:, None] + np.arange(need)[None]]
            if coordinates:
                where[old] = np.concatenate([where[old].reshape(-1, h.x.shape[1]), h.x[j]])[best]
            ids[old], weight[old] = np.concatenate([ids[old].ravel(), h.pid[j]])[best], np.concatenate([weight[old].ravel(), h.w[j]])[best]
            dist[old] = dd[best]
            place[old] = np.where((weight[old, -1] > 0) & ~np.isnan(dist[old, -1]), dist[old, -1], np.inf)

        def step(h: tiles.Rows):
            far = lambda rows, x: tiles.least_apart(q.x[rows], x) > place[rows] * (1 + SLACK) + SLACK
            rows = np.arange(q.size)
            rows = rows[~far(rows, h.x)]
            new = np.isinf(place[rows])
            for some in tiles.tiles(rows[new]):
                j, exact = closest(q.x[some], h.x, h.pid, min(need, h.size))
                take_in(some, np.repeat(np.arange(len(some)), j.shape[1]), exact.ravel(), j.ravel(), h)
            rows = rows[~new]
            wanted = [rows[~far(rows, h.x[at])] for at in tiles.nests(h)]
            if 2 * sum(map(len, wanted)) > len(wanted) * len(rows):
                compare(rows, h, slice(0, h.size))
            else:
                for some, at in zip(wanted, tiles.nests(h)):
                    compare(some, h, at)
            yield from ()

        def compare(wanted: np.ndarray, h: tiles.Rows, at: slice) -> None:
            b = h.x[at]
            for rows in tiles.tiles(wanted):
                a, limit = q.x[rows], place[rows] ** 2
                sq, slack = _against(a, b, float(np.median(limit)))
                if not np.isfinite(slack):
                    j, exact = closest(a, b, h.pid[at], min(need, len(b)))
                    take_in(rows, np.repeat(np.arange(len(rows)), j.shape[1]), exact.ravel(), j.ravel() + at.start, h)
                    continue
                i, j = np.nonzero(sq <= (limit * (1 + 1e-6) + 2 * slack).astype(sq.dtype)[:, None])
                exact = _pair_distances(a, b, i, j)
                closer = ~(exact > place[rows][i])
                if closer.any():
                    take_in(rows, i[closer], exact[closer], j[closer] + at.start, h)

        def finish():
            for start in range(0, q.size, tiles.ROWS_OUT):
                cut = slice(start, start + tiles.ROWS_OUT)
                found = weight[cut] > 0
                n = int(found.sum())
                x = pa.nulls(n, pa.list_(pa.float64()))
                if coordinates:
                    x = tiles.lists(where[cut][found].ravel(), np.full(n, q.x.shape[1]))
                near = pa.StructArray.from_arrays([pa.array(dist[cut][found]), pa.array(ids[cut][found]), pa.array(weight[cut][found]), x],
                                                  names=["dist", "id", "w", "x"])
                mine = q.x[cut]
                yield pa.RecordBatch.from_pydict({
                    "pid": pa.array(q.pid[cut]), "x": tiles.lists(mine.ravel(), np.full(*mine.shape)), "near": tiles.lists(near, found.sum(axis=1))})
        return step, finish
    return fold


def nearest(points: DataFrame, k: int, with_self: bool = True, coordinates: bool = False) -> DataFrame:
    """(id, near): the ``k`` nearest points in order of distance and id, exact; their x on request.

    With ``with_self`` a point is its own first neighbour. The own part gives each point a first
    reach; of the others only what may hold something closer is compared. What is found is stored: it may be read often.
    """
    need = k if with_self else k + 1
    parts = divide(merge_copies(points))
    room = point_bytes(parts) + need * (32 + (point_bytes(parts) if coordinates else 0))
    found = tiles.stream(
        parts.points.select("pid", "x", "part"), parts.points.select("pid", "x", "w", "part"), parts.rows, parts.rows,
        _best_fold(need, coordinates), f"pid bigint, x array<double>, {NEAR}", BLOCK, room)
    return _with_copies(points, written(found, "nearest"), k, with_self)


def _with_copies(points: DataFrame, merged: DataFrame, k: int, with_self: bool) -> DataFrame:
    """(id, near) of every point from (x, pid, near) of the distinct ones, where a neighbour stands for its copies."""
    if not with_self:
        less = F.transform("near", lambda e: F.struct(
            e["dist"].alias("dist"), e["id"].alias("id"),
            F.when(e["id"] == F.col("pid"), e["w"] - 1).otherwise(e["w"]).alias("w"), e["x"].alias("x")))
        merged = merged.withColumn("near", F.filter(less, lambda e: e["w"] > 0))
    copies = F.flatten(F.transform("near", lambda e: F.array_repeat(
        F.struct(e["dist"].alias("dist"), e["id"].alias("id"), e["x"].alias("x")),
        F.least(e["w"], F.lit(k)).cast("int"))))
    return to_original(points, merged.select("x", F.slice(copies, 1, k).alias("near"))).drop("x")


def k_distances(points: DataFrame, k: int) -> DataFrame:
    """(id, kdist): distance to the k-th nearest point, counting the point itself first."""
    return nearest(points, k).select("id", F.get("near", F.lit(k - 1))["dist"].alias("kdist"))


# --- approximate neighbours by hashed projections --------------------------------------------

def by_parts(queries: DataFrame, home: DataFrame, kernel, schema: str) -> DataFrame:
    """As ``block_join``, for any number of parts of any type: their sizes stay a table."""
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = blocks(queries, "nq").join(blocks(home, "nh"), "part")
    spot = F.xxhash64("pid")
    home = home.toDF(*home.columns)  # new column identities: both sides may be the same table
    q = queries.join(sizes, "part").withColumns({
        "i": F.pmod(spot, F.col("nq")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("nh") - 1))}).drop("nq", "nh")
    h = home.join(sizes, "part").withColumns({
        "j": F.pmod(spot, F.col("nh")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("nq") - 1))}).drop("nq", "nh")
    keys = ["part", "i", "j"]
    return q.groupBy(*keys).cogroup(h.groupBy(*keys)).applyInPandas(kernel, schema)


#: Points from which the width of the hash cells is taken, unless it is given.
WIDTH_SAMPLE = 1000


def hash_width(merged: DataFrame, k: int) -> float:
    """1.4 times the median distance to the k-th neighbour within a sample of WIDTH_SAMPLE distinct points."""
    rows = merged.select("x", seeded.digest("width", F.col("pid")).alias("d")).orderBy("d").limit(WIDTH_SAMPLE).collect()
    x = np.array([r["x"] for r in rows], dtype=float)
    if len(x) < 2:
        return 1.0
    reach = np.sort(distances(x, x), axis=1)[:, min(k, len(x) - 1)]
    return float(1.4 * np.median(reach)) or 1.0


def hashed_nearest(points: DataFrame, k: int, with_self: bool = True, tables: int = 16, hashes: int = 5,
                   probes: int = 6, width: float | None = None, seed: int = 7, work=None) -> DataFrame:
    """(id, near) as ``nearest``, approximate: a choice of the caller for tables beyond exact search.

    Every table of hashes cuts space by ``hashes`` random projections, rounded to cells of ``width``. A point is stored
    once a table and looks into its own cell and the ``probes`` cells whose walls are closest. Candidates are ranked by their
    exact distances, so what is returned is right, though a near point that shares no cell is missed. Work grows with
    the points times the cells looked into; a crowded cell is cut into blocks like a part. ``work``, an accumulator,
    counts the distances computed.
    """
    need = k if with_self else k + 1
    merged = keep(merge_copies(points))
    first = merged.select(F.size("x").alias("d")).head()
    if first is None:
        return points.select("id", F.array().cast("array<struct<dist:double,id:bigint,x:array<double>>>").alias("near"))
    width = width or hash_width(merged, need)
    rng = np.random.default_rng(seed)
    lines, shift = rng.standard_normal((first["d"], tables * hashes)), rng.random(tables * hashes)

    def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = x @ lines / width + shift
        whole = np.floor(at)
        return whole.astype(np.int64).reshape(len(x), tables, hashes), (at - whole).reshape(len(x), tables, hashes)

    def keyed(pdf: pd.DataFrame, cell: np.ndarray, row: np.ndarray, table: np.ndarray) -> pd.DataFrame:
        out = pdf.iloc[row].copy()
        out["part"] = [f"{t}:{','.join(map(str, c))}" for t, c in zip(table.tolist(), cell.tolist())]
        return out

    def stored(batches):
        for pdf in batches:
            cell, _ = cells(matrix(pdf["x"]))
            row, table = (v.ravel() for v in np.meshgrid(np.arange(len(pdf)), np.arange(tables), indexing="ij"))
            yield keyed(pdf, cell[row, table], row, table)

    def asked(batches):
        for pdf in batches:
            cell, inside = cells(matrix(pdf["x"]))
            row, table = (v.ravel() for v in np.meshgrid(np.arange(len(pdf)), np.arange(tables), indexing="ij"))
            yield keyed(pdf, cell[row, table], row, table)
            # Distance to the lower walls, then to the upper ones; the nearest are stepped over.
            walls = np.concatenate([inside, 1 - inside], axis=2)
            for step in np.argsort(walls, axis=2)[:, :, :probes].transpose(2, 0, 1):
                moved = cell[row, table].copy()
                place = step[row, table]
                moved[np.arange(len(row)), place % hashes] += np.where(place < hashes, -1, 1)
                yield keyed(pdf, moved, row, table)

    home = merged.select("pid", "x", "w").mapInPandas(stored, "pid bigint, x array<double>, w bigint, part string")
    queries = merged.select("pid", "x", F.lit(0).alias("home_part")).mapInPandas(
        asked, "pid bigint, x array<double>, home_part int, part string")
    best_of = _best(need, False)

    def ranked(q: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if work is not None:
            work.add(len(q) * len(h))
        return best_of(q, h)

    found = by_parts(queries, home, ranked, f"pid bigint, x array<double>, part int, {NEAR}")
    once = found.select("pid", "x", F.explode("near").alias("e")).groupBy("pid", "e.id").agg(F.first("x").alias("x"), F.first("e").alias("e"))
    place = F.row_number().over(Window.partitionBy("pid").orderBy("e"))
    best = once.withColumn("_place", place).where(F.col("_place") <= need).groupBy("pid").agg(
        F.first("x").alias("x"), F.array_sort(F.collect_list("e")).alias("near"))
    return _with_copies(points, best, k, with_self)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """(n, recall): share of the exact neighbours' places that the other result fills with points as near."""
    both = exact.select("id", F.transform("near", lambda e: e["dist"]).alias("d")).join(
        approximate.select("id", F.transform("near", lambda e: e["dist"]).alias("a")), "id")
    reached = F.size(F.filter(F.col("a"), lambda v: v <= F.array_max("d") + 1e-9))
    return both.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.least(reached, F.size("d"))) / F.sum(F.size("d"))).alias("recall"))


# --- distance sums -----------------------------------------------------------------------

def distance_sums(points: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(pid, w, cluster, to_cluster, total, n): Euclidean distance from each point to all of each cluster.

    No closed form exists for these sums, so the work is quadratic: blocks against blocks. Copies
    within a cluster are merged first; only sums per cluster leave a task. With ``asked`` (pid, x, cluster) only
    these points are asked for, and the work is their number times that of the distinct points.
    """
    def fold(q: tiles.Rows):
        names, totals = np.zeros(0, dtype=np.int64), np.zeros((q.size, 0))

        def step(h: tiles.Rows):
            nonlocal names, totals
            mine, place = np.unique(h.cluster, return_inverse=True)
            wider = np.union1d(names, mine)
            if len(wider) > len(names):
                grown = np.zeros((q.size, len(wider)))
                grown[:, np.searchsorted(wider, names)] = totals
                names, totals = wider, grown
            weights = np.zeros((h.size, len(mine)))
            weights[np.arange(h.size), place] = h.w
            at = np.searchsorted(names, mine)
            for rows in tiles.tiles(np.arange(q.size)):
                totals[rows[:, None], at] += far_distances(q.x[rows], h.x) @ weights
            yield from ()

        def finish():
            if len(names):
                yield from tiles.batches_of({
                    "pid": pa.array(np.repeat(q.pid, len(names))), "to_cluster": pa.array(np.tile(names, q.size), pa.int32(), from_pandas=True),
                    "total": pa.array(totals.ravel())})
        return step, finish

    merged = keep(merge_copies(points, "cluster"))
    n, wide = merged.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).head()
    queries = merged.select("pid", "x", "cluster", "w") if asked is None else asked.withColumn("w", F.lit(1))
    together = F.lit(0).alias("part")
    found = tiles.stream(queries.select("pid", "x", together), merged.select("pid", "x", "w", "cluster", together), {0: n if asked is None else asked.count()},
                         {0: n}, fold, "pid bigint, to_cluster int, total double", BLOCK, 8 * wide + 256)
    sums = found.groupBy("pid", "to_cluster").agg(F.sum("total").alias("total"))
    return queries.select("pid", "w", "cluster").join(sums, "pid")


__all__ = ["divide", "merge_copies", "to_original", "neighbour_counts", "nearest",
           "k_distances", "hashed_nearest", "by_parts", "distance_sums", "distances", "within", "closest"]
