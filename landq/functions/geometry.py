"""Polygon measures. Rings are array<struct<x,y>> in lon/lat degrees, first point repeated last."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landq.functions.text import round_to

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])
SANITY = T.StructType(
    [
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("aspect_ratio", T.DoubleType()),
    ]
)
#: Points of a ring up to which every two of them are tried as an edge of its hull.
FEW = 12
CLIP = T.StructType([T.StructField(n, T.DoubleType()) for n in ("area", "cx", "cy")])


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """(metres per degree of latitude, of longitude) at a latitude in degrees."""
    phi = F.radians(lat)
    per_lat = F.lit(111132.954) - 559.822 * F.cos(2 * phi) + 1.175 * F.cos(4 * phi)
    per_lon = F.lit(111412.84) * F.cos(phi) - 93.5 * F.cos(3 * phi)
    return per_lat, per_lon


def _edges(ring: Column) -> Column:
    return F.when(F.size(ring) > 1, F.sequence(F.lit(1), F.size(ring) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def _at(ring: Column, i: Column, axis: str) -> Column:
    return F.get(ring, i)[axis]


def ring_moments(ring: Column) -> Column:
    """struct<a2, sx, sy>: twice the signed area and the first moments, relative to the first point."""
    ox, oy = _at(ring, F.lit(0), "x"), _at(ring, F.lit(0), "y")
    zero = F.struct(F.lit(0.0).alias("a2"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))

    def step(acc: Column, i: Column) -> Column:
        xa, ya = _at(ring, i - 1, "x") - ox, _at(ring, i - 1, "y") - oy
        xb, yb = _at(ring, i, "x") - ox, _at(ring, i, "y") - oy
        cross = xa * yb - xb * ya
        return F.struct(
            (acc["a2"] + cross).alias("a2"),
            (acc["sx"] + (xa + xb) * cross).alias("sx"),
            (acc["sy"] + (ya + yb) * cross).alias("sy"),
        )

    return F.aggregate(_edges(ring), zero, step)


def ring_area(ring: Column) -> Column:
    """Planar area in squared ring units."""
    return F.abs(ring_moments(ring)["a2"]) / 2.0


def with_measures(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds planar_area, centroid_lat, per_lat, per_lon.

    The pass over the ring is a projection of its own, so that it happens once per row however often its
    result is used.
    """
    m = F.col("_moments")
    lat = _at(F.col(ring), F.lit(0), "y") + F.coalesce(F.try_divide(m["sy"], 3.0 * m["a2"]), F.lit(0.0))
    measured = df.withColumn("_moments", ring_moments(F.col(ring))).withColumns(
        {"planar_area": F.abs(m["a2"]) / 2.0, "centroid_lat": lat}
    )
    per_lat, per_lon = metres_per_degree(F.col("centroid_lat"))
    return measured.withColumns({"per_lat": per_lat, "per_lon": per_lon}).drop("_moments")


def square_metres(ring: Column) -> Column:
    """Area from the columns of with_measures, not rounded, for those who round it themselves; empty -> 0."""
    area = F.col("planar_area") * F.col("per_lat") * F.col("per_lon")
    return F.when(F.size(ring) > 3, area).otherwise(F.lit(0.0))


def metric_area(ring: Column) -> Column:
    """Square metres to two digits."""
    return round_to(square_metres(ring), 2)


def ring_perimeter(ring: Column, scale_x: Column | float = 1.0, scale_y: Column | float = 1.0) -> Column:
    sx = scale_x if isinstance(scale_x, Column) else F.lit(scale_x)
    sy = scale_y if isinstance(scale_y, Column) else F.lit(scale_y)

    def step(acc: Column, i: Column) -> Column:
        dx = (_at(ring, i, "x") - _at(ring, i - 1, "x")) * sx
        dy = (_at(ring, i, "y") - _at(ring, i - 1, "y")) * sy
        return acc + F.sqrt(dx * dx + dy * dy)

    return F.aggregate(_edges(ring), F.lit(0.0), step)


def compactness(ring: Column) -> Column:
    """4 pi A / P^2 in metres, from the columns of with_measures; 0 for a degenerate ring."""
    area = F.col("planar_area") * F.col("per_lat") * F.col("per_lon")
    length = ring_perimeter(ring, F.col("per_lon"), F.col("per_lat"))
    return F.coalesce(F.try_divide(4.0 * math.pi * area, F.pow(length, F.lit(2.0))), F.lit(0.0))


def bounding_box(ring: Column) -> Column:
    xs, ys = ring["x"], ring["y"]
    return F.struct(
        F.array_min(xs).alias("x0"),
        F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"),
        F.array_max(ys).alias("y1"),
    )


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return F.array(
        *[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners]
    )


def is_box(ring: Column, box: Column) -> Column:
    """True for an axis-aligned rectangle, whose overlap has a closed form. ``box`` is its bounding box."""
    on_corner = F.forall(
        ring,
        lambda p: ((p["x"] == box["x0"]) | (p["x"] == box["x1"]))
        & ((p["y"] == box["y0"]) | (p["y"] == box["y1"])),
    )
    # five points on the corners, first and last the same, each step along one side only
    steps = F.forall(
        _edges(ring),
        lambda i: (_at(ring, i, "x") == _at(ring, i - 1, "x")) != (_at(ring, i, "y") == _at(ring, i - 1, "y")),
    )
    turns = (_at(ring, F.lit(0), "x") != _at(ring, F.lit(2), "x")) & (_at(ring, F.lit(0), "y") != _at(ring, F.lit(2), "y"))
    return (F.size(ring) == 5) & on_corner & steps & turns


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Ray cast: strictly inside; a point on the boundary is outside."""

    def step(acc: Column, i: Column) -> Column:
        xa, ya = _at(ring, i - 1, "x"), _at(ring, i - 1, "y")
        xb, yb = _at(ring, i, "x"), _at(ring, i, "y")
        cross = (xb - xa) * (y - ya) - (x - xa) * (yb - ya)
        on_edge = (
            (cross == 0)
            & (x >= F.least(xa, xb))
            & (x <= F.greatest(xa, xb))
            & (y >= F.least(ya, yb))
            & (y <= F.greatest(ya, yb))
        )
        spans = (ya > y) != (yb > y)
        hit = spans & (x < (xb - xa) * F.try_divide(y - ya, yb - ya) + xa)
        return F.struct(
            F.when(F.coalesce(hit, F.lit(False)), ~acc["inside"]).otherwise(acc["inside"]).alias("inside"),
            (acc["edge"] | on_edge).alias("edge"),
        )

    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("edge"))
    return F.aggregate(_edges(ring), start, step, lambda acc: acc["inside"] & ~acc["edge"])


# ------------------------------------------------------------------ per-ring helpers inside Arrow batches


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _hull(p: np.ndarray) -> np.ndarray:
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p
    halves = []
    for run in (p, p[::-1]):
        side: list = []
        for q in run:
            while len(side) > 1 and _turn(side[-2], side[-1], q) <= 0:
                side.pop()
            side.append(q)
        halves += side[:-1]
    return np.array(halves)


def _aspect(p: np.ndarray) -> float:
    """Side ratio of the smallest rotated rectangle: one side lies on a hull edge."""
    hull = _hull(p)
    best = None
    edges = np.roll(hull, -1, axis=0) - hull
    for dx, dy in edges:
        norm = math.hypot(dx, dy)
        if norm == 0:
            continue
        along = hull @ np.array([dx, dy]) / norm
        across = hull @ np.array([-dy, dx]) / norm
        w, h = np.ptp(along), np.ptp(across)
        if best is None or w * h < best[0]:
            best = (w * h, w, h)
    if best is None:
        return 1.0
    return max(best[1], best[2]) / max(1e-9, min(best[1], best[2]))


def _crosses(p: np.ndarray) -> np.ndarray:
    """True for rings in which two edges that are not neighbours meet; one edge of each against all later ones at a time."""
    a, b = p[:, :-1], p[:, 1:]
    n = a.shape[1]
    found = np.zeros(len(p), dtype=bool)

    def side(o, q, r):
        return np.sign((q[..., 0] - o[..., 0]) * (r[..., 1] - o[..., 1]) - (q[..., 1] - o[..., 1]) * (r[..., 0] - o[..., 0]))

    def between(o, q, r):
        return (np.minimum(o, q) <= r).all(-1) & (r <= np.maximum(o, q)).all(-1)

    for i in range(n - 2):
        stop = n - 1 if i == 0 else n
        o, q, c, d = a[:, i : i + 1], b[:, i : i + 1], a[:, i + 2 : stop], b[:, i + 2 : stop]
        s1, s2, s3, s4 = side(o, q, c), side(o, q, d), side(c, d, o), side(c, d, q)
        hit = (s1 * s2 < 0) & (s3 * s4 < 0)
        hit |= (s1 == 0) & between(o, q, c) | (s2 == 0) & between(o, q, d)
        hit |= (s3 == 0) & between(c, d, o) | (s4 == 0) & between(c, d, q)
        found |= hit.any(axis=1)
        if found.all():
            break
    return found


def _sane_one(p: np.ndarray) -> tuple[bool, float]:
    distinct = p[np.r_[True, (np.diff(p, axis=0) != 0).any(axis=1)]]
    return len(distinct) >= 4 and not _crosses(distinct[None])[0], _aspect(p)


def _sane_many(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(valid, aspect, decided) for rings of one length, all rings at a time.

    Decided are the convex rings without repeated points, whose hull edges are the ring's own edges, and others of few points.
    """
    dx, dy = np.diff(x, axis=1), np.diff(y, axis=1)
    turn = dx * np.roll(dy, -1, axis=1) - dy * np.roll(dx, -1, axis=1)
    dot = dx * np.roll(dx, -1, axis=1) + dy * np.roll(dy, -1, axis=1)
    once = np.isclose(np.abs(np.arctan2(turn, dot).sum(axis=1)), 2 * np.pi)
    decided = once & ((turn > 0).all(axis=1) | (turn < 0).all(axis=1))
    aspect = _aspects(x, y, dx.T, dy.T)
    valid = decided.copy()
    # rings of few points that are not convex: a hull edge joins two of the points, and no direction does better
    rest = ~decided & ((dx != 0) | (dy != 0)).all(axis=1) if x.shape[1] <= FEW else np.zeros(len(x), dtype=bool)
    if rest.any():
        u, v = x[rest], y[rest]
        first, second = np.triu_indices(x.shape[1] - 1, 1)
        aspect[rest] = _aspects(u, v, (u[:, second] - u[:, first]).T, (v[:, second] - v[:, first]).T)
        valid[rest] = ~_crosses(np.stack([u, v], axis=2))
    return valid, aspect, decided | rest


def _aspects(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Side ratio of each ring's smallest rectangle along the given directions, rows of which have one for each ring."""
    best, aspect = np.full(len(x), np.inf), np.ones(len(x))
    for kx, ky in zip(dx, dy):
        norm = np.hypot(kx, ky)
        along = norm > 0
        norm[~along] = 1.0
        ux, uy = (kx / norm)[:, None], (ky / norm)[:, None]
        w, h = np.ptp(x * ux + y * uy, axis=1), np.ptp(y * ux - x * uy, axis=1)
        smaller = along & (w * h < best)
        best = np.where(smaller, w * h, best)
        aspect = np.where(smaller, np.maximum(w, h) / np.maximum(1e-9, np.minimum(w, h)), aspect)
    return aspect


@F.pandas_udf(SANITY)
def _sanity_udf(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    sizes = np.array([0 if v is None else len(v) for v in xs])
    valid, aspect = np.zeros(len(xs), dtype=bool), np.ones(len(xs))
    for size in np.unique(sizes[sizes >= 4]):
        at = np.flatnonzero(sizes == size)
        x, y = np.stack(xs.iloc[at].to_numpy()), np.stack(ys.iloc[at].to_numpy())
        ok, ratio, decided = _sane_many(x, y)
        for i in np.flatnonzero(~decided):
            ok[i], ratio[i] = _sane_one(np.column_stack([x[i], y[i]]))
        valid[at], aspect[at] = ok, ratio
    reason = np.where(
        valid, "Valid geometry", np.where(sizes < 4, "Too few points in geometry component", "Self-intersection")
    )
    return pd.DataFrame({"is_valid": valid, "reason": reason, "aspect_ratio": aspect})


def ring_sanity(ring: Column) -> Column:
    """struct<is_valid, reason, aspect_ratio>, the aspect in metres, from the columns of with_measures."""
    scaled = lambda axis, by: F.transform(ring[axis], lambda v: v * F.col(by))
    return _sanity_udf.asNondeterministic()(scaled("x", "per_lon"), scaled("y", "per_lat"))


def _clip(p: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of convex polygons to the left of the lines a -> b, one line each; the first ``n`` points of a row count."""
    at = np.arange(p.shape[1])
    valid, before = at < n[:, None], np.where(at > 0, at - 1, n[:, None] - 1)
    dx, dy = (b - a)[:, :1], (b - a)[:, 1:]
    sq = dx * (p[..., 1] - a[:, 1:]) - dy * (p[..., 0] - a[:, :1])
    sp, last = np.take_along_axis(sq, before, 1), np.take_along_axis(p, before[..., None], 1)
    cut = valid & ((sp < 0) & (sq > 0) | (sq < 0) & (sp > 0))
    t = np.divide(sp, sp - sq, out=np.zeros_like(sp), where=cut)[..., None]
    kept = np.stack([cut, valid & (sq >= 0)], axis=2).reshape(len(p), 2 * len(at))
    points = np.stack([last + t * (p - last), p], axis=2).reshape(len(p), 2 * len(at), 2)
    count = kept.sum(axis=1)
    out = np.zeros((len(p), max(1, count.max(initial=0)), 2))
    row, column = np.nonzero(kept)
    out[row, np.cumsum(kept, axis=1)[row, column] - 1] = points[row, column]
    return out, count


def _moments(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Signed area and first moments of polygons whose first ``n`` points count."""
    at = np.arange(p.shape[1])
    before = np.where(at > 0, at - 1, n[:, None] - 1)
    last = np.take_along_axis(p, before[..., None], 1)
    cross = np.where(at < n[:, None], last[..., 0] * p[..., 1] - p[..., 0] * last[..., 1], 0.0)
    sums = [cross / 2.0, (last[..., 0] + p[..., 0]) * cross / 6.0, (last[..., 1] + p[..., 1]) * cross / 6.0]
    return np.stack([v.sum(axis=1) for v in sums], axis=1)


def _fan(p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Signs and triangles from the first vertex; their sums are the polygons, convex or not."""
    fan = []
    for i in range(1, p.shape[1] - 2):
        t = np.stack([p[:, 0], p[:, i], p[:, i + 1]], axis=1)
        sign = np.sign(_moments(t, np.full(len(t), 3))[:, 0])
        fan.append((sign, np.where((sign < 0)[:, None, None], t[:, ::-1], t)))
    return fan


def polygon_overlaps(pa: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Area and centroid of the common parts of pairs of simple polygons, by signed triangle pairs.

    ``pa`` and ``pb`` hold a ring for each pair, all rings of a side with equally many points.
    """
    origin = pa[:, :1]
    total = np.zeros((len(pa), 3))
    fans_b = _fan(pb - origin)
    for sa, ta in _fan(pa - origin):
        for sb, tb in fans_b:
            at = np.flatnonzero(sa * sb)
            piece, n = ta[at], np.full(len(at), 3)
            for k in range(3):
                piece, n = _clip(piece, n, tb[at, k - 1], tb[at, k])
                at, piece, n = at[n > 2], piece[n > 2], n[n > 2]
            total[at] += (sa * sb)[at, None] * _moments(piece, n)
    centre = np.divide(total[:, 1:], total[:, :1], out=np.zeros((len(pa), 2)), where=total[:, :1] != 0)
    return np.column_stack([np.abs(total[:, 0]), origin[:, 0] + centre])


def polygon_overlap(pa: np.ndarray, pb: np.ndarray) -> tuple[float, float, float]:
    """Area and centroid of the common part of two simple polygons."""
    return tuple(polygon_overlaps(pa[None], pb[None])[0].tolist())


@F.pandas_udf(CLIP)
def _overlap_udf(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.DataFrame:
    out = np.full((len(ax), 3), np.nan)
    asked = ax.notna().to_numpy() & bx.notna().to_numpy()
    sizes = np.array([(len(a), len(b)) if ok else (0, 0) for a, b, ok in zip(ax, bx, asked)]).reshape(-1, 2)
    for size in np.unique(sizes[asked], axis=0):
        at = np.flatnonzero(asked & (sizes == size).all(axis=1))
        xs, ys, us, vs = (np.stack(side.iloc[at].to_numpy()).astype(float) for side in (ax, ay, bx, by))
        out[at] = polygon_overlaps(np.stack([xs, ys], axis=2), np.stack([us, vs], axis=2))
    return pd.DataFrame(out, columns=["area", "cx", "cy"])


def ring_overlap(a: Column, b: Column) -> Column:
    """struct<area, cx, cy> of the common part of two rings of any simple shape; null rings give nulls."""
    return _overlap_udf.asNondeterministic()(a["x"], a["y"], b["x"], b["y"])
