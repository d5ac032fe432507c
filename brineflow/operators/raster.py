"""Gridded terrain as rows of ``y``, ``x`` and bands; four neighbours.

Work that spreads over the grid is done within square tiles by numpy and then
between tiles by joins, so a task holds one tile and what crosses tiles is a
small table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brineflow import config as C
from brineflow import runtime
from brineflow.operators.graph import connected_components

#: Rows of the grid are numbered ``y * ROW + x``.
ROW = 1 << 32
TILE = 128


def cell_id(y: Column | str = "y", x: Column | str = "x") -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return col(y).cast("long") * ROW + col(x).cast("long")


def from_arrays(df: DataFrame, y: str, array: str, out: str = "v") -> DataFrame:
    return df.select(F.col(y).alias("y"), F.posexplode(array).alias("x", out))


def quantize(v: Column, scale: int = 10, limit: int = 300) -> Column:
    """Tenths, half away from zero, within the limits; null for what is no number."""
    return F.when(~F.isnan(v), F.greatest(F.lit(-limit), F.least(F.lit(limit), (F.signum(v) * F.floor(F.abs(v) * scale + 0.5)).cast("int"))))


def strided(df: DataFrame, step: int = 5, offset: int = 2) -> DataFrame:
    return df.where((F.pmod("x", F.lit(step)) == offset) & (F.pmod("y", F.lit(step)) == offset))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two rasters cell by cell; a cell that one of them lacks is left out."""
    return a.join(b, ["y", "x"])


def condition(elev: Column, mask: Column, floor: int | float) -> Column:
    """At least ``floor`` inside the mask; a masked cell without elevation is an error."""
    checked = F.when(mask & elev.isNull(), F.raise_error("a masked cell has no elevation")).otherwise(elev)
    return F.when(mask, F.greatest(checked, F.lit(floor))).otherwise(elev)


def _haloed(df: DataFrame, radius: int, tile: int) -> DataFrame:
    """Each cell in its own tile (``ty``, ``tx``) and in those whose cells it may reach; a cell inside a tile is there once."""
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile)))
    return df.withColumn("ty", spread("y")).withColumn("tx", spread("x"))


def _windows(a: np.ndarray, radius: int, size: int):
    """The array of a tile with its halo, shifted to each offset along the first axis."""
    return (a[radius + d : radius + d + size] for d in range(-radius, radius + 1))


def dilate(cells: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Cells whose centre is within ``radius`` of a cell's centre; a tile with its halo at a time."""
    size = tile + 2 * radius

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(key[0]) * tile, int(key[1]) * tile
        wet = np.zeros((size, size), bool)
        wet[g["y"].to_numpy(np.int64) - y0 + radius, g["x"].to_numpy(np.int64) - x0 + radius] = True
        near = np.zeros((tile, tile), bool)
        for dy in range(-radius, radius + 1):
            reach = int((radius * radius - dy * dy) ** 0.5)
            rows = wet[radius + dy : radius + dy + tile]
            # Cells of the row set within the reach: a difference of running counts.
            run = np.concatenate([np.zeros((tile, 1), np.int32), np.cumsum(rows, axis=1, dtype=np.int32)], axis=1)
            lo = radius - reach
            near |= run[:, lo + 2 * reach + 1 : lo + 2 * reach + 1 + tile] > run[:, lo : lo + tile]
        y, x = np.nonzero(near)
        return pd.DataFrame({"y": y + y0, "x": x + x0})

    return _haloed(cells.select("y", "x"), radius, tile).groupBy("ty", "tx").applyInPandas(one, "y bigint, x bigint")


def or_pool(df: DataFrame, flag: str, size: int = 5) -> DataFrame:
    return df.groupBy(F.expr(f"cast(y div {size} as int)").alias("by"), F.expr(f"cast(x div {size} as int)").alias("bx")).agg(F.bool_or(flag).alias(flag))


def neighbour_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each cell with its right and its lower neighbour, where there is one; the neighbour's columns end in ``_2``.

    An offset and an equal join, so that one long row or column of the grid is no group.
    """
    other = df.select("y", "x", *(F.col(c).alias(f"{c}_2") for c in cols))
    sides = F.array(F.struct(F.lit(0).alias("dy"), F.lit(1).alias("dx")), F.struct(F.lit(1).alias("dy"), F.lit(0).alias("dx")))
    one = df.select(F.col("y").alias("y_1"), F.col("x").alias("x_1"), *(F.col(c).alias(f"{c}_1") for c in cols), F.explode(sides).alias("o"))
    one = one.select("*", (F.col("y_1") + F.col("o.dy")).alias("y"), (F.col("x_1") + F.col("o.dx")).alias("x")).drop("o")
    return one.join(other, ["y", "x"]).withColumnsRenamed({"y": "y_2", "x": "x_2"})


def edges(df: DataFrame, zone: str, elev: str) -> DataFrame:
    """Shared sides of neighbouring zones: one row for each pair and crest, with the number of sides."""
    pairs = neighbour_pairs(df, [zone, elev]).where(F.col(f"{zone}_1") != F.col(f"{zone}_2"))
    return pairs.groupBy(F.least(f"{zone}_1", f"{zone}_2").alias("zone_a"), F.greatest(f"{zone}_1", f"{zone}_2").alias("zone_b"), F.greatest(f"{elev}_1", f"{elev}_2").alias("crest")).agg(F.count("*").alias("width"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            return root


def _pairs_in(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of right and lower neighbours among the cells given."""
    key = y.astype(np.int64) * ROW + x
    order = np.argsort(key)
    out = []
    for step in (1, ROW):
        at = np.searchsorted(key[order], key + step)
        ok = (at < len(key)) & (key[order[np.minimum(at, len(key) - 1)]] == key + step)
        out.append((np.flatnonzero(ok), order[at[ok]]))
    return np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])


def _tiles(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})


def local_labels(df: DataFrame, tile: int = TILE, same: list[str] | None = None) -> DataFrame:
    """Label cells by the smallest cell id of their component within their tile (and equal ``same`` columns); small tiles are labelled several at a time."""
    same = same or []
    rows = _tiles(df, tile * max(1, TILE // tile))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema.fields)}, label bigint"

    names = df.columns

    def one(g: pd.DataFrame) -> pd.DataFrame:
        y, x = g["y"].to_numpy(np.int64), g["x"].to_numpy(np.int64)
        a, b = _pairs_in(y, x)
        ok = (y[a] // tile == y[b] // tile) & (x[a] // tile == x[b] // tile)
        a, b = a[ok], b[ok]
        for c in same:
            v = pd.factorize(g[c], use_na_sentinel=False)[0]
            ok = v[a] == v[b]
            a, b = a[ok], b[ok]
        root = _roots(len(g), a, b)
        key = y * ROW + x
        low = np.full(len(g), np.iinfo(np.int64).max)
        np.minimum.at(low, root, key)
        return g[names].assign(label=low[root])

    return rows.groupBy("ty", "tx").applyInPandas(one, schema)


def components(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Add ``label``: the smallest cell id of each cell's component over the whole grid."""
    local = runtime.save(local_labels(cells, tile), "tile-labels")
    rim = local.where(F.col("y").isNotNull() & ((F.pmod("y", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("x", F.lit(tile)).isin(0, tile - 1)))).select("y", "x", "label")
    links = neighbour_pairs(rim, ["label"]).where("label_1 <> label_2").select(F.col("label_1").alias("a"), F.col("label_2").alias("b")).distinct()
    names = connected_components(links)
    return local.join(names.withColumnRenamed("node", "label"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")


def qualified(cells: DataFrame, flag: str, min_cells: int = C.SOURCE_MIN_CELLS, tile: int = TILE) -> DataFrame:
    """Cells of the components that are large enough and touch the flag."""
    named = components(cells, tile)
    good = named.groupBy("label").agg(F.count("*").alias("n"), F.bool_or(flag).alias("any")).where((F.col("n") >= min_cells) & F.col("any")).select("label")
    return named.join(good, "label", "left_semi")


def _bottlenecks(a: np.ndarray, b: np.ndarray, w: np.ndarray, terminal: np.ndarray, touched: np.ndarray, level: np.ndarray) -> list[tuple[int, int, int]]:
    """Sides (node, node or -1 for the source, height) of a tree that keeps every bottleneck between terminals and the source.

    ``touched``: nodes that reach the source over ``level``.
    """
    n = len(terminal)
    parent = list(range(n + 1))
    rep = [i if t else -2 for i, t in enumerate(terminal.tolist())] + [-1]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ea, eb, height = np.concatenate([a, touched]), np.concatenate([b, np.full(len(touched), n)]), np.concatenate([w, level])
    order = np.argsort(height, kind="stable")
    out = []
    for i, j, h in zip(ea[order].tolist(), eb[order].tolist(), height[order].tolist(), strict=True):
        i, j = find(i), find(j)
        if i == j:
            continue
        if rep[i] != -2 and rep[j] != -2:
            out.append((rep[i], rep[j], int(h)))
        parent[i] = j
        # The source stays the name of its part: its stage is known.
        rep[j] = -1 if -1 in (rep[i], rep[j]) else rep[j] if rep[j] != -2 else rep[i]
    return out


def _minimax(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The least, over paths to a node with a known level, of the larger of that level and the path's highest side."""
    order = np.argsort(np.concatenate([a, b]), kind="stable")
    to, level = np.concatenate([b, a])[order].tolist(), np.concatenate([w, w])[order].tolist()
    first = np.searchsorted(np.concatenate([a, b])[order], np.arange(n + 1)).tolist()
    best = best.tolist()
    heap = [(v, i) for i, v in enumerate(best) if v < np.inf]
    heapq.heapify(heap)
    while heap:
        v, i = heapq.heappop(heap)
        if v > best[i]:
            continue
        for k in range(first[i], first[i + 1]):
            j, up = to[k], max(v, level[k])
            if up < best[j]:
                best[j] = up
                heapq.heappush(heap, (up, j))
    return np.asarray(best)


def _nullable(best: np.ndarray):
    none = np.isinf(best)
    return pd.arrays.IntegerArray(np.where(none, 0, best).astype(np.int32), none)


#: Tiles along an axis that the next level takes together.
STEP = 8


def _of_tile(c: str, tile: int) -> Column:
    """The tile of a cell id, as one number."""
    return F.floor(F.expr(f"{c} div {ROW}") / tile) * ROW + F.floor(F.expr(f"{c} % {ROW}") / tile)


def connection_stage(cells: DataFrame, elev: str = "elev", source: str = "source", max_elev: int = C.MODEL_MAX_D, tile: int = TILE) -> DataFrame:
    """Add ``connection``: the least, over paths to a source, of the highest cell on the path; null if there is none.

    Tiles are contracted to trees that keep every bottleneck between their rim cells and the source, then tiles of tiles,
    until one is left: as many steps as the grid's width has digits. The stages are then filled in on the way back.
    """
    own = cells.where(F.col(elev).isNotNull() & (F.col(elev) <= max_elev)).select("y", "x", F.col(elev).cast("int").alias("e"), F.coalesce(F.col(source), F.lit(False)).alias("s"))
    own = runtime.save(own, "terrain")
    tiled = _tiles(own, tile)

    def rim(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (y % tile == 0) | (y % tile == tile - 1) | (x % tile == 0) | (x % tile == tile - 1)

    def contract(g: pd.DataFrame) -> pd.DataFrame:
        y, x, e, s = g["y"].to_numpy(np.int64), g["x"].to_numpy(np.int64), g["e"].to_numpy(np.int64), g["s"].to_numpy(bool)
        a, b = _pairs_in(y, x)
        return named(_bottlenecks(a, b, np.maximum(e[a], e[b]), rim(y, x), np.flatnonzero(s), e[s]), y * ROW + x)

    def named(found: list[tuple[int, int, int]], key: np.ndarray) -> pd.DataFrame:
        key = np.append(key, -1)
        return pd.DataFrame({"a": [int(key[i]) for i, _, _ in found], "b": [int(key[j]) for _, j, _ in found], "w": [w for _, _, w in found]}, columns=["a", "b", "w"]).astype({"a": "int64", "b": "int64", "w": "int32"})

    def nodes_of(g: pd.DataFrame):
        """Numbers of a group's nodes: ids, and for each side its ends (the source is no node) and height."""
        a, b, w = g["a"].to_numpy(np.int64), g["b"].to_numpy(np.int64), g["w"].to_numpy(np.int64)
        to_source = (a < 0) | (b < 0)
        key = np.unique(np.concatenate([a, b]))
        key = key[key >= 0]
        at = lambda c: np.searchsorted(key, c)
        return key, at(a[~to_source]), at(b[~to_source]), w[~to_source], at(np.maximum(a, b)[to_source]), w[to_source]

    trees = tiled.groupBy("ty", "tx").applyInPandas(contract, "a bigint, b bigint, w int")
    rims = own.where(F.pmod("y", F.lit(tile)).isin(0, tile - 1) | F.pmod("x", F.lit(tile)).isin(0, tile - 1)).select("y", "x", "e")
    across = neighbour_pairs(rims, ["e"]).where(f"floor(y_1 / {tile}) <> floor(y_2 / {tile}) or floor(x_1 / {tile}) <> floor(x_2 / {tile})")
    sides = across.select(cell_id("y_1", "x_1").alias("a"), cell_id("y_2", "x_2").alias("b"), F.greatest("e_1", "e_2").cast("int").alias("w"))
    graph = runtime.save(trees.unionByName(sides), "rim-graph")
    extent = own.agg(*(f(c).alias(f"{n}_{c}") for c in ("y", "x") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if extent["lo_y"] is not None and min(extent["lo_y"], extent["lo_x"]) < 0:
        raise ValueError("rows and columns count from zero")
    levels, width = [], tile
    while True:
        width *= STEP
        ends = {c: F.when(F.col(c) >= 0, _of_tile(c, width)) for c in ("a", "b")}
        home = F.when(F.coalesce(ends["a"], ends["b"]) == F.coalesce(ends["b"], ends["a"]), F.coalesce(ends["a"], ends["b"]))
        placed = graph.withColumn("home", home)
        top = extent["lo_y"] is None or all(extent[f"lo_{c}"] // width == extent[f"hi_{c}"] // width for c in ("y", "x"))
        levels.append(placed.where("home is not null"))
        if top:
            break
        passed = placed.where("home is null").drop("home")
        ends_up = passed.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
        marked = levels[-1].join(ends_up.select(F.col("cell").alias("a"), F.lit(True).alias("out_a")), "a", "left").join(ends_up.select(F.col("cell").alias("b"), F.lit(True).alias("out_b")), "b", "left")

        def again(g: pd.DataFrame) -> pd.DataFrame:
            key, a, b, w, touched, level = nodes_of(g)
            out = np.concatenate([g.loc[g["out_a"].notna(), "a"], g.loc[g["out_b"].notna(), "b"]]).astype(np.int64)
            return named(_bottlenecks(a, b, w, np.isin(key, out), touched, level), key)

        up = marked.select("home", "a", "b", "w", "out_a", "out_b").groupBy("home").applyInPandas(again, "a bigint, b bigint, w int")
        graph = runtime.save(up.unionByName(passed), "rim-graph")

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        known = g.loc[g["stage"].notna() & g["w"].isna(), ["a", "stage"]]
        key, a, b, w, touched, level = nodes_of(g.loc[g["w"].notna()])
        best = np.full(len(key), np.inf)
        np.minimum.at(best, touched, level.astype(np.float64))
        there = known[known["a"].isin(key)]
        np.minimum.at(best, np.searchsorted(key, there["a"].to_numpy(np.int64)), there["stage"].to_numpy(np.float64))
        best = _minimax(len(key), a, b, w, best)
        found = np.isfinite(best)
        return pd.DataFrame({"cell": key[found], "stage": best[found].astype(np.int32)})

    stage = None
    for k in reversed(range(len(levels))):
        width = tile * STEP ** (k + 1)
        rows = levels[k].select("home", "a", "b", "w", F.lit(None).cast("int").alias("stage"))
        if stage is not None:
            rows = rows.unionByName(stage.select(_of_tile("cell", width).alias("home"), F.col("cell").alias("a"), F.col("cell").alias("b"), F.lit(None).cast("int").alias("w"), "stage"))
        got = rows.groupBy("home").applyInPandas(settle, "cell bigint, stage int")
        stage = runtime.save(got if stage is None else got.unionByName(stage).groupBy("cell").agg(F.min("stage").alias("stage")), "rim-stage")

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        y, x, e, s = g["y"].to_numpy(np.int64), g["x"].to_numpy(np.int64), g["e"].to_numpy(np.int64), g["s"].to_numpy(bool)
        known = g["stage"].to_numpy(np.float64)
        a, b = _pairs_in(y, x)
        best = _minimax(len(g), a, b, np.maximum(e[a], e[b]), np.where(s, e, np.where(np.isnan(known), np.inf, known)))
        return pd.DataFrame({"y": y, "x": x, "connection": _nullable(best)})

    known = tiled.withColumn("cell", cell_id()).join(stage, "cell", "left").drop("cell")
    filled = known.groupBy("ty", "tx").applyInPandas(fill, "y bigint, x bigint, connection int")
    return cells.join(filled, ["y", "x"], "left")


def zones(cells: DataFrame, bin_col: str, hard: str, tile: int = C.TILE) -> DataFrame:
    """Add ``zone_label``: components within (tile, connection bin, hard flag); they never cross a tile."""
    return local_labels(cells, tile, [bin_col, hard]).withColumnRenamed("label", "zone_label")


def numbered(zoned: DataFrame, tile: int = C.TILE) -> DataFrame:
    """Dense ids in scan order of tiles, then of each zone's first cell: a count of labels before each tile, and a rank within it."""
    first = zoned.groupBy("zone_label").agg(F.first(F.floor(F.col("y") / tile)).alias("ty"), F.first(F.floor(F.col("x") / tile)).alias("tx"))
    per = first.groupBy("ty", "tx").count()
    # One row for each row of tiles, then one for each tile within it.
    rows = per.groupBy("ty").agg(F.sum("count").alias("in_row"))
    before_row = rows.select("ty", F.coalesce(F.sum("in_row").over(Window.orderBy("ty").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b0"))
    before = per.select("ty", "tx", F.coalesce(F.sum("count").over(Window.partitionBy("ty").orderBy("tx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b1")).join(before_row, "ty")
    rank = F.row_number().over(Window.partitionBy("ty", "tx").orderBy("zone_label")) - 1
    return first.withColumn("rank", rank).join(before, ["ty", "tx"]).select("zone_label", (F.col("b0") + F.col("b1") + F.col("rank")).cast("long").alias("zone_id"))


def zone_summary(cells: DataFrame, zone: str, elev: str, conn: str, flags: list[str]) -> DataFrame:
    """Largest connection, cells, flagged cells and the histogram of elevations (tenths, clamped), as a map of filled bins."""
    clamped = F.greatest(F.lit(C.HIST_MIN_D), F.least(F.lit(C.HIST_MAX_D), F.col(elev))) - C.HIST_MIN_D
    bins = cells.groupBy(zone, clamped.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.max(conn).alias("conn"), *(F.count_if(F.col(f)).alias(f) for f in flags))
    return bins.groupBy(zone).agg(
        F.max("conn").alias("connection"),
        F.sum("n").alias("cell_count"),
        *(F.sum(f).alias(f"{f}_cells") for f in flags),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "n")))).alias("hist"),
    )


def source_connected(wet: DataFrame, source: str, min_cells: int = 2, tile: int = TILE) -> DataFrame:
    return qualified(wet, source, min_cells, tile)


def touching(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of ``a`` with a four-neighbour in ``b``."""
    cross = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))))
    halo = b.select("y", "x", F.explode(cross).alias("o")).select((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return a.join(halo, ["y", "x"], "left_semi")


def extent(grid: DataFrame) -> tuple[int, int, int, int] | None:
    """First and last row, first and last column; None for an empty grid."""
    found = grid.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    return None if found[0] is None else tuple(found)


def masked_gaussian(cells: DataFrame, value: str, grid: tuple[int, int, int, int] | None, sigma: float = 2.0, truncate: float = 4.0, tile: int = TILE) -> DataFrame:
    """Smooth a value over its own cells only: the kernel's weights over missing cells are left out; a tile with its halo at a time.

    ``grid``: the raster's :func:`extent`, at which its edge is repeated outwards; None: no edge.
    """
    radius = int(truncate * sigma + 0.5)
    weights = [float(np.exp(-0.5 * (k / sigma) ** 2)) for k in range(-radius, radius + 1)]
    size = tile + 2 * radius
    names = cells.columns
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in cells.schema.fields)}, smooth double"

    def repeated(a: np.ndarray, axis: int, first: int, lo: int, hi: int) -> np.ndarray:
        """Lines of the tile beyond the grid's edge, as the edge has them."""
        at = np.clip(np.clip(np.arange(first, first + size), lo, hi) - first, 0, size - 1)
        return np.take(a, at, axis)

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(key[0]) * tile, int(key[1]) * tile
        y, x = g["y"].to_numpy(np.int64) - y0, g["x"].to_numpy(np.int64) - x0
        both = np.zeros((2, size, size))
        both[0, y + radius, x + radius] = g[value].to_numpy(np.float64)
        both[1, y + radius, x + radius] = 1.0
        if grid is not None:
            both = repeated(repeated(both, 1, y0 - radius, grid[0], grid[1]), 2, x0 - radius, grid[2], grid[3])
        sums = []
        for a in both:
            down = sum(w * s for w, s in zip(weights, _windows(a, radius, tile), strict=True))
            sums.append(sum(w * s for w, s in zip(weights, _windows(down.T, radius, tile), strict=True)).T)
        own = (y >= 0) & (y < tile) & (x >= 0) & (x < tile)
        return g.loc[own, names].assign(smooth=sums[0][y[own], x[own]] / sums[1][y[own], x[own]])

    return _haloed(cells, radius, tile).groupBy("ty", "tx").applyInPandas(one, schema)


def _runs(valid: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps along ``axis`` to the next valid cell backwards and forwards, 0 on one; far off where there is none."""
    n, far = valid.shape[axis], 1 << 40
    at = np.arange(n).reshape((-1, 1) if axis == 0 else (1, -1))
    last = np.maximum.accumulate(np.where(valid, at, -far), axis)
    flip = np.flip(valid, axis)
    following = n - 1 - np.flip(np.maximum.accumulate(np.where(flip, at, -far), axis), axis)
    return at - last, following - at


def ring_nearest(points: DataFrame, cells: DataFrame, key: str, max_radius: int = 10, tile: int | None = None) -> DataFrame:
    """For each point (py, px) the valid cell of the first square ring that has one, nearest within it, first by row; ``key``, ``radius``, ``d2``, ``y``, ``x``.

    A tile at a time with a halo of ``max_radius``. The ring of every cell comes from the steps to the next valid cell
    along its rows, and on that ring only the nearest cells of its four sides can be nearest, so a cell's work is
    bounded by the radius, not by the cells within it, and each valid cell goes to 9/4 tiles on average at most. A cell
    is asked once, however many points it has, so that a tile's work is bounded by its size.
    """
    tile = tile or max(TILE, 4 * max_radius)
    size = tile + 2 * max_radius

    def one(at: tuple, asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"py": [], "px": [], "radius": [], "d2": [], "y": [], "x": []})
        if not len(asked) or not len(there):
            return empty
        y0, x0 = int(at[0]) * tile - max_radius, int(at[1]) * tile - max_radius
        valid = np.zeros((size, size), bool)
        valid[there["y"].to_numpy(np.int64) - y0, there["x"].to_numpy(np.int64) - x0] = True
        left, right = _runs(valid, 1)
        up, down = _runs(valid, 0)
        beside = np.minimum(left, right)
        y, x = asked["py"].to_numpy(np.int64) - y0, asked["px"].to_numpy(np.int64) - x0
        ring = np.full(len(y), max_radius + 1)
        for d in range(max_radius + 1):
            ring = np.minimum(ring, np.maximum(d, np.minimum(beside[y - d, x], beside[y + d, x])))
        found = ring <= max_radius
        y, x, r = y[found], x[found], ring[found]
        # The nearest cell of each side of the ring in both directions: its row or column, and the steps along it.
        sides = [(-r, -left[y - r, x]), (-r, right[y - r, x]), (r, -left[y + r, x]), (r, right[y + r, x])]
        sides += [(-up[y, x - r], -r), (down[y, x - r], -r), (-up[y, x + r], r), (down[y, x + r], r)]
        best = None
        for dy, dx in sides:
            on = (np.abs(dy) <= r) & (np.abs(dx) <= r)
            d2 = np.where(on, np.where(on, dy, 0) ** 2 + np.where(on, dx, 0) ** 2, 1 << 40)
            if best is None:
                best = d2, dy, dx
                continue
            nearer = (d2 < best[0]) | ((d2 == best[0]) & ((dy < best[1]) | ((dy == best[1]) & (dx < best[2]))))
            best = tuple(np.where(nearer, a, b) for a, b in zip((d2, dy, dx), best, strict=True))
        return pd.DataFrame({"py": y + y0, "px": x + x0, "radius": r, "d2": best[0], "y": y + best[1] + y0, "x": x + best[2] + x0})

    tiled = points.select(F.col("py").cast("long").alias("py"), F.col("px").cast("long").alias("px")).distinct().select("py", "px", F.floor(F.col("py") / tile).alias("ty"), F.floor(F.col("px") / tile).alias("tx"))
    near = _haloed(cells.select("y", "x"), max_radius, tile)
    # Points in tiles that no cell reaches have none.
    tiled = tiled.join(near.select("ty", "tx").distinct(), ["ty", "tx"], "left_semi")
    found = tiled.groupBy("ty", "tx").cogroup(near.groupBy("ty", "tx")).applyInPandas(one, "py bigint, px bigint, radius int, d2 int, y bigint, x bigint")
    return points.select(key, "py", "px").join(found, ["py", "px"]).select(key, "radius", "d2", "y", "x")
