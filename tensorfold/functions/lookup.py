"""Functions given by samples at even steps, read between them: column expressions, constant beyond the ends."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _place(x: Column, low: float, high: float, n: int) -> tuple[Column, Column]:
    """(index of the sample below, fraction towards the next) of a position, kept within the samples."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (x - low) * ((n - 1) / (high - low))))
    below = F.least(F.floor(at), F.lit(n - 2)).cast("int")
    return below, at - below


def interpolated(f: Callable[[float], float], low: float, high: float, samples: int = 256) -> Callable[[Column], Column]:
    """A function of one variable, sampled on [low, high] once."""
    table = F.array(*[F.lit(float(f(x))) for x in np.linspace(low, high, samples)])

    def look(x: Column) -> Column:
        i, part = _place(x, low, high, samples)
        a, b = F.element_at(table, i + 1), F.element_at(table, i + 2)
        return a + part * (b - a)

    return look


def interpolated2(f: Callable[[float, float], float], low: tuple[float, float], high: tuple[float, float], samples: int = 32) -> Callable[[Column, Column], Column]:
    """A function of two variables, sampled on a square grid once, read bilinearly."""
    xs, ys = (np.linspace(a, b, samples) for a, b in zip(low, high))
    table = F.array(*[F.lit(float(f(x, y))) for x in xs for y in ys])

    def look(x: Column, y: Column) -> Column:
        i, p = _place(x, low[0], high[0], samples)
        j, q = _place(y, low[1], high[1], samples)
        at = lambda di, dj: F.element_at(table, (i + di) * samples + j + dj + 1)
        near, far = at(0, 0) + q * (at(0, 1) - at(0, 0)), at(1, 0) + q * (at(1, 1) - at(1, 0))
        return near + p * (far - near)

    return look
