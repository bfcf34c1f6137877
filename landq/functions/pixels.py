"""Stencil measures over decoded grey tiles (array<int> of h * w pixels, row-major), a batch of tiles at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("blur", "noise", "residual")])
SIGNATURE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("mean", "std", "dy", "dx")])


# fixed values: what tiles too small for a measure count as, and how small that is
SHARP, FLAT = 200.0, 0.0
BLUR_SIDE, NOISE_SIDE, RESIDUAL_SIDE = 5, 10, 5
NOISE_SCALE = 150.0


def stacks(pixels: pd.Series, h: pd.Series, w: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their tiles as one n x h x w array of integers) for each shape of tiles in a batch."""
    if not len(pixels):
        return
    shapes = np.stack([h.to_numpy(np.int64), w.to_numpy(np.int64)], axis=1)
    kinds, kind = np.unique(shapes, axis=0, return_inverse=True)
    tiles = pixels.to_numpy()
    for number, (height, width) in enumerate(kinds.tolist()):
        rows = np.flatnonzero(kind.reshape(-1) == number)
        yield rows, np.concatenate(tiles[rows]).astype(np.int64).reshape(len(rows), height, width)


def area_table(g: np.ndarray) -> np.ndarray:
    """Sums over all pixels above and left of a corner, for a stack of tiles: any window's sum is four of them."""
    table = np.zeros((g.shape[0], g.shape[1] + 1, g.shape[2] + 1), dtype=np.int64)
    np.cumsum(np.cumsum(g, axis=1), axis=2, out=table[:, 1:, 1:])
    return table


def window_sums(table: np.ndarray, height: int, width: int) -> np.ndarray:
    """Sums of all windows of this size."""
    return table[:, height:, width:] - table[:, :-height, width:] - table[:, height:, :-width] + table[:, :-height, :-width]


def spread(values: np.ndarray) -> np.ndarray:
    """Population variance of each tile's integers, from exact sums."""
    n = values.shape[1] * values.shape[2]
    total, squares = values.sum(axis=(1, 2)), (values * values).sum(axis=(1, 2))
    return (n * squares - total * total) / float(n * n)


def running_spread(values: np.ndarray) -> np.ndarray:
    """Population variance of each tile's numbers from a running mean, column by column.

    Exact sums tell ties from what a variance in floating point makes of them; the SQL that checks the residual rounds
    the latter, and so do its readers.
    """
    mean, squares = np.zeros(len(values)), np.zeros(len(values))
    numbers = values.transpose(2, 1, 0).reshape(-1, len(values))
    for n, v in enumerate(numbers, start=1):
        ahead = mean + (v - mean) / n
        squares += (v - mean) * (v - ahead)
        mean = ahead
    return squares / len(numbers)


def cross_difference(table: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The four neighbours of each inner pixel less four times the pixel."""
    across, down = window_sums(table, 1, 3)[:, 1:-1], window_sums(table, 3, 1)[:, :, 1:-1]
    return across + down - 6 * g[:, 1:-1, 1:-1]


@F.pandas_udf(METRICS)
def _metrics_udf(pixels: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    """Blur and noise look at every second pixel: spread of the cross difference, and of what a 3 x 3 mean leaves.
    The residual is the spread of pixels less the mean of their four neighbours, at full size."""
    out = np.tile([SHARP, FLAT, FLAT], (len(pixels), 1))
    for rows, g in stacks(pixels, h, w):
        side, half = min(g.shape[1:]), g[:, ::2, ::2]
        table = area_table(half)
        if side >= BLUR_SIDE:
            out[rows, 0] = spread(cross_difference(table, half))
        if side >= NOISE_SIDE:
            left = 9 * half[:, 1:-1, 1:-1] - window_sums(table, 3, 3)
            out[rows, 1] = np.minimum(1.0, spread(left) / 81.0 / NOISE_SCALE)
        if side >= RESIDUAL_SIDE:
            out[rows, 2] = running_spread(cross_difference(area_table(g), g) / -4.0)
    return pd.DataFrame(out, columns=["blur", "noise", "residual"])


def stencil_metrics(pixels: Column, h: Column, w: Column) -> Column:
    """struct<blur, noise, residual>; marked so that later filters do not compute it again."""
    return _metrics_udf.asNondeterministic()(pixels, h, w)


@F.pandas_udf(SIGNATURE)
def _signature_udf(pixels: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    out = np.zeros((len(pixels), 4))
    for rows, g in stacks(pixels, h, w):
        out[rows, 0] = g.mean(axis=(1, 2))
        out[rows, 1] = np.sqrt(spread(g))
        for column, axis in ((2, 1), (3, 2)):
            if g.shape[axis] > 1:
                out[rows, column] = np.abs(np.diff(g, axis=axis)).mean(axis=(1, 2))
    return pd.DataFrame(out, columns=["mean", "std", "dy", "dx"])


def block_signature(pixels: Column, h: Column, w: Column) -> Column:
    """struct<mean, std, dy, dx>: what two cloned blocks have in common."""
    return _signature_udf.asNondeterministic()(pixels, h, w)


def share_between(pixels: Column, low: int, high: int) -> Column:
    inside = F.size(F.filter(pixels, lambda p: (p >= low) & (p <= high)))
    return inside / F.greatest(F.lit(1), F.size(pixels))


def fade_ratio(pixels: Column) -> Column:
    """Washed-out strokes [150, 215] against crisp ones (< 100)."""
    dark = F.size(F.filter(pixels, lambda p: p < 100))
    faded = F.size(F.filter(pixels, lambda p: (p >= 150) & (p <= 215)))
    return F.when(dark + faded == 0, F.lit(0.0)).otherwise(faded / (dark + faded + 1e-5))


def pixel_mean(pixels: Column) -> Column:
    total = F.aggregate(pixels, F.lit(0).cast("long"), lambda a, p: a + p)
    return total / F.greatest(F.lit(1), F.size(pixels))


def pixel_variance(pixels: Column) -> Column:
    """Population variance from integer sums."""
    n = F.greatest(F.lit(1), F.size(pixels)).cast("long")
    total = F.aggregate(pixels, F.lit(0).cast("long"), lambda a, p: a + p)
    squares = F.aggregate(pixels, F.lit(0).cast("long"), lambda a, p: a + p * p)
    return (n * squares - total * total) / (n * n)
