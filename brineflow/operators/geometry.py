"""Polygons as closed rings of (x, y) structs, and their way onto a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segments(df: DataFrame, key: str, ring: str) -> DataFrame:
    """The boundary: one row for each side of each ring."""
    n = F.size(ring)
    sides = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get(ring, i)["x"].alias("x0"), F.get(ring, i)["y"].alias("y0"), F.get(ring, i + 1)["x"].alias("x1"), F.get(ring, i + 1)["y"].alias("y1")))
    return df.where(n >= 2).select(key, F.posexplode(sides).alias("side", "s")).select(key, "side", "s.*")


def _ring_sums(ring, origin):
    """Twice the signed area of a ring and its first moments about ``origin``, by the shoelace sums, within the row.

    About a point of the polygon, since far from zero the sums of a small ring would cancel.
    """
    zero = F.struct(F.lit(0.0).alias("a2"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))

    def add(acc, i):
        p, q = F.get(ring, i), F.get(ring, i + 1)
        px, py, qx, qy = p["x"] - origin["x"], p["y"] - origin["y"], q["x"] - origin["x"], q["y"] - origin["y"]
        cross = px * qy - qx * py
        return F.struct((acc["a2"] + cross).alias("a2"), (acc["sx"] + (px + qx) * cross).alias("sx"), (acc["sy"] + (py + qy) * cross).alias("sy"))

    # A ring of fewer than two points has no side.
    sides = F.when(F.size(ring) >= 2, F.sequence(F.lit(0), F.size(ring) - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(sides, zero, add)


def centroids(df: DataFrame, key: str, ring: str) -> DataFrame:
    """Centroid and area of one ring; a ring without area gives null."""
    return polygon_centroids(df.select(key, F.array(F.array(ring)).alias("__parts")), key, "__parts")


def polygon_centroids(df: DataFrame, key: str, parts: str) -> DataFrame:
    """Centroid and area of polygons of several parts, each an outer ring and the rings of its holes, whatever their turn; without area null."""

    bind = lambda value, body: F.get(F.transform(F.array(value), body), 0)  # noqa: E731  made once, however often ``body`` names it

    def of_part(rings, origin):
        """An outer ring counts with its own sign made positive, a hole with its sign made negative."""
        signed = F.transform(rings, lambda r, i: F.struct(_ring_sums(r, origin).alias("m"), F.when(i == 0, 1.0).otherwise(-1.0).alias("w")))
        return F.transform(signed, lambda x: F.struct(*((x["w"] * F.signum(x["m"]["a2"]) * x["m"][c]).alias(c) for c in ("a2", "sx", "sy"))))

    def of_polygon(b):
        total = lambda sums, c: F.aggregate(sums, F.lit(0.0), lambda s, x: s + x[c]).alias(c)
        sums = F.flatten(F.transform(b["p"], lambda rings: of_part(rings, b["o"])))
        return bind(sums, lambda each: F.struct(*(total(each, c) for c in ("a2", "sx", "sy")), b["o"].alias("o")))

    whole = F.struct(F.col(parts).alias("p"), F.get(F.get(F.get(parts, 0), 0), 0).alias("o"))
    rows = df.select(key, bind(whole, of_polygon).alias("m")).select(key, "m.*")
    ok = F.col("a2") != 0
    return rows.select(key, F.when(ok, F.col("o.x") + F.col("sx") / (3 * F.col("a2"))).alias("cx"), F.when(ok, F.col("o.y") + F.col("sy") / (3 * F.col("a2"))).alias("cy"), (F.abs("a2") / 2).alias("area"))


def to_grid(x: F.Column, y: F.Column, origin_x: float, origin_y: float, cell: float) -> tuple[F.Column, F.Column]:
    """Column and row of a point on a grid whose rows run down from the origin."""
    return F.floor((x - origin_x) / cell).cast("long"), F.floor((origin_y - y) / cell).cast("long")


def rasterize_lines(sides: DataFrame) -> DataFrame:
    """The distinct cells (y, x) that segments in grid units touch: their ends' cells, and that of the middle of each piece between two grid lines."""

    def cuts(a: str, b: str):
        lines = F.sequence(F.ceil(F.least(a, b)), F.floor(F.greatest(a, b)))
        inside = (F.col(a) != F.col(b)) & (F.ceil(F.least(a, b)) <= F.floor(F.greatest(a, b)))
        return F.when(inside, F.transform(lines, lambda k: (k - F.col(a)) / (F.col(b) - F.col(a)))).otherwise(F.array().cast("array<double>"))

    ends = F.array(F.lit(0.0), F.lit(1.0))
    t = F.array_sort(F.array_distinct(F.concat(ends, cuts("x0", "x1"), cuts("y0", "y1"))))
    cut = sides.select("x0", "y0", "x1", "y1", t.alias("t"))
    middle = F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: (F.get("t", i) + F.get("t", i + 1)) / 2)
    at = cut.select("x0", "y0", "x1", "y1", F.explode(F.concat(middle, ends)).alias("t"))
    place = lambda a, b: F.floor(F.col(a) + F.col("t") * (F.col(b) - F.col(a))).cast("long")
    return at.select(place("y0", "y1").alias("y"), place("x0", "x1").alias("x")).distinct()


def rasterize_fill(df: DataFrame, key: str, ring: str) -> DataFrame:
    """Cells whose centre is inside a ring in grid units: sides cross each row's centre line, and every other gap is inside."""
    s = segments(df, key, ring).where("y0 <> y1")
    s = s.withColumns({"lo": F.ceil(F.least("y0", "y1") - 0.5), "hi": F.ceil(F.greatest("y0", "y1") - 0.5) - 1}).where("lo <= hi")
    rows = s.select(key, "x0", "y0", "x1", "y1", F.explode(F.sequence("lo", "hi")).alias("y"))
    at = F.col("x0") + (F.col("y") + 0.5 - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    lines = rows.select(key, "y", at.alias("at")).groupBy(key, "y").agg(F.array_sort(F.collect_list("at")).alias("at"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda i: F.struct(F.get("at", i).alias("a"), F.get("at", i + 1).alias("b")))
    spans = lines.select(key, "y", F.explode(pairs).alias("s")).select(key, "y", F.ceil(F.col("s.a") - 0.5).alias("lo"), (F.ceil(F.col("s.b") - 0.5) - 1).alias("hi")).where("lo <= hi")
    return spans.select(key, "y", F.explode(F.sequence("lo", "hi")).alias("x"))


def simplify(df: DataFrame, key: str, ring: str, tolerance: float) -> DataFrame:
    """Rings with fewer points, none farther than ``tolerance`` from the outline; at least four points stay, and a ring whose sides do not cross gets none that do."""

    def crosses(p: np.ndarray) -> bool:
        """Whether two sides that are no neighbours have a point in common."""
        a, b = p[:-1], p[1:]
        turn = lambda o, q, r: np.sign((q[..., 0] - o[..., 0]) * (r[..., 1] - o[..., 1]) - (q[..., 1] - o[..., 1]) * (r[..., 0] - o[..., 0]))
        n = len(a)
        for i in range(n - 2):
            c, d = a[i + 2 : n - (i == 0)], b[i + 2 : n - (i == 0)]
            if np.any((turn(a[i], b[i], c) * turn(a[i], b[i], d) <= 0) & (turn(c, d, a[i]) * turn(c, d, b[i]) <= 0)):
                return True
        return False

    def kept(p: np.ndarray) -> np.ndarray:
        off = tolerance
        while len(p) > 4:
            q = thin(p, off)
            if len(q) == len(p) or not crosses(q) or crosses(p):
                return q
            off /= 2
        return p

    def thin(p: np.ndarray, tolerance: float) -> np.ndarray:
        keep = np.zeros(len(p), bool)
        # A closed ring is split at the point farthest from its start.
        far = int(np.argmax(((p - p[0]) ** 2).sum(axis=1)))
        keep[[0, far, len(p) - 1]] = True
        stack = [(0, far), (far, len(p) - 1)]
        while stack:
            i, j = stack.pop()
            if j - i < 2:
                continue
            d, q = p[j] - p[i], p[i + 1 : j] - p[i]
            length = np.hypot(*d)
            off = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / length if length else np.hypot(q[:, 0], q[:, 1])
            k = int(np.argmax(off))
            if off[k] > tolerance:
                keep[i + 1 + k] = True
                stack += [(i, i + 1 + k), (i + 1 + k, j)]
        return p[keep] if keep.sum() >= 4 else p

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rings = [kept(np.asarray([(q["x"], q["y"]) for q in r])) for r in part["ring"]]
            yield pd.DataFrame({key: part[key], "ring": [[{"x": float(a), "y": float(b)} for a, b in r] for r in rings]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(ring).alias("ring")).mapInPandas(run, f"{key} {kind}, ring array<struct<x:double,y:double>>")
