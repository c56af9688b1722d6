"""Neighbourhood operators: convolution and its relatives, local extremes, gradients, warps.

One engine serves nearly all. Every point sends its value, with the number of the tap, to the points whose
neighbour it is; an aggregation by target combines them. Borders are resolved at the sender: a point on the edge
also stands in for the virtual points beyond. Points are first dealt into square tiles of targets, those near a tile's
edge into each tile that reads them. Taps are sent, and sums made, within tiles: what is shuffled is one row
for each point and a few for the edges, whatever the number of taps, and there is no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product as combinations
from math import pi, prod, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..field import COORDS, Field, aligned, const, cplx, dealt, grid
from ..types import CLAMP, COLOR, COMPLEX, CYCLIC, FULL, NO_SAMPLING, VALID, ZERO, FieldType, Sampling, check
from .shape import fill
from .tensor import _whole

Taps = Sequence[tuple[int, int, int]]
#: A filter has at most so many points: each is sent with every point of the field.
MOST_TAPS = 1 << 14


#: Targets along the side of a tile.
TILE = 128
#: Taps that a target has room for in a task's share of targets; with more of them, it has a smaller share.
TAPS = 8


def contributions(df: DataFrame, taps: Taps, sizes, out_sizes, border: str, up: int = 1, down: int = 1) -> tuple[DataFrame, list[str]]:
    """Rows with (layer, row, col) of the target and ``k``, the tap, besides the columns of ``df``, for every value that a
    target reads at ``down * target + tap`` of the input with ``up - 1`` zeros after each point; and the columns to group
    by: the coordinates, and the tiles the rows are already dealt by."""
    for axis, c in enumerate(COORDS):
        n, m = sizes[axis] * up if sizes[axis] > 1 else 1, out_sizes[axis]
        low, high = min(t[axis] for t in taps), down * (m - 1) + max(t[axis] for t in taps) + 1
        x = F.col(c) * up if sizes[axis] > 1 else F.col(c)
        if border == CLAMP and (low < 0 or high > n):
            before = F.sequence(F.lit(low), F.lit(-1)) if low < 0 else F.array().cast("array<int>")
            after = F.sequence(F.lit(n), F.lit(high - 1)) if high > n else F.array().cast("array<int>")
            none = F.array().cast("array<int>")
            places = F.concat(F.when(x == 0, before).otherwise(none), F.array(x), F.when(x == n - 1, after).otherwise(none))
            df = df.withColumn("_at", places).withColumn(c, F.explode("_at")).drop("_at")
        elif border == CYCLIC and (low < 0 or high > n):
            start = low + F.pmod(x - low, F.lit(n))
            df = df.withColumn("_at", F.sequence(start, F.greatest(start, F.lit(high - 1)), F.lit(n))).withColumn(c, F.explode("_at")).drop("_at")
        elif up > 1:
            df = df.withColumn(c, x)
    tiles = []
    for axis, c in enumerate(COORDS):
        if axis and out_sizes[axis] > TILE:
            step = down if sizes[axis] > 1 else 1
            first = F.greatest(F.lit(0), F.floor((F.col(c) - max(t[axis] for t in taps)) / (step * TILE))).cast("int")
            last = F.least(F.lit((out_sizes[axis] - 1) // TILE), F.floor((F.col(c) - min(t[axis] for t in taps)) / (step * TILE))).cast("int")
            df = df.withColumn(f"_tile_{c}", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
            tiles.append(f"_tile_{c}")
    if tiles:
        df = dealt(df, prod(out_sizes) * max(TAPS, len(taps)) // TAPS, *tiles)
    steps = F.array(*[F.struct(*[F.lit(int(v)).alias(f"d{i}") for i, v in enumerate(t)], F.lit(k).alias("k")) for k, t in enumerate(taps)])
    df = df.withColumn("_t", F.explode(steps))
    inside = F.lit(True)
    for axis, c in enumerate(COORDS):
        at = F.col(c) - F.col(f"_t.d{axis}")
        if down > 1 and sizes[axis] > 1:
            inside = inside & (F.pmod(at, F.lit(down)) == 0)
            at = F.floor(at / down).cast("int")
        df = df.withColumn(f"_{c}", at)
        inside = inside & F.col(f"_{c}").between(0, out_sizes[axis] - 1)
        if f"_tile_{c}" in tiles:
            inside = inside & (F.floor(F.col(f"_{c}") / TILE) == F.col(f"_tile_{c}"))
    others = [c for c in df.columns if c not in (*COORDS, "_t", *(f"_{c}" for c in COORDS))]
    return df.where(inside).select(*[F.col(f"_{c}").alias(c) for c in COORDS], F.col("_t.k").alias("k"), *others), [*tiles, *COORDS]


def _gathered(f: Field, taps: Taps, border: str, agg: Callable[[Column, Column], Column], type: FieldType | None = None) -> Field:
    """A field of the same shape: at each point an aggregate of (value, tap) of its neighbours."""
    rows, keys = contributions(f.df(), taps, f.type.sizes, f.type.sizes, border)
    return Field.from_df(rows.groupBy(*keys).agg(agg(F.col("v"), F.col("k")).alias("v")), type or f.type)


# ---- convolution -----------------------------------------------------------------------------------------------

PLANE_BY_PLANE, PROJECT, PROJECT_SUM, BACK_PROJECT, BACK_PROJECT_SUM, ADJOINT, ADJOINT_SUM = "plane", "project", "project_sum", "back_project", "back_project_sum", "adjoint", "adjoint_sum"


def _planes(mode: str, image: FieldType, kernel: FieldType, batch: int) -> tuple[list[list[tuple[int, int]]], tuple[int, ...]]:
    """For each output plane, the (image plane, filter plane) pairs it sums, and the output's tensor shape."""
    a, b = image.elements, kernel.elements
    if mode == PLANE_BY_PLANE:
        check(not image.tensor or not kernel.tensor or image.tensor == kernel.tensor, "tensor shapes differ")
        tensor = image.tensor or kernel.tensor
        return [[(i if image.tensor else 0, i if kernel.tensor else 0)] for i in range(max(a, b))], tensor
    check(len(image.tensor) < 2 and len(kernel.tensor) < 2, "frames are scalar or vector fields")
    check(a % batch == 0, "the planes are a multiple of the batch")
    n = a // batch
    if mode in (ADJOINT, ADJOINT_SUM):
        check(b % batch == 0, "the filter's planes are a multiple of the batch")
        k = b // batch
        single = [[(i % batch * n + i // batch % n, i % batch * k + i // batch // n)] for i in range(n * k * batch)]
        out = single if mode == ADJOINT else [[p for x in single[j * batch : (j + 1) * batch] for p in x] for j in range(n * k)]
        return out, (len(out),) if len(out) > 1 else ()
    check(b % n == 0, "the filter's planes are a multiple of the image's")
    k, out = b // n, []
    for i in range(b * batch):
        im, w = divmod(i, b)
        out.append([(im * n + w % n, w if mode in (PROJECT, PROJECT_SUM) else k * (w % n) + w // n)])
    if mode in (PROJECT_SUM, BACK_PROJECT_SUM):
        out = [[p for x in out[j * n : (j + 1) * n] for p in x] for j in range(k * batch)]
        return out, () if len(out) == 1 and a <= 4 else (len(out),)
    return out, (len(out),)


def _convolve(f: Field, kernel: Field, border: str, flip: bool, sampling: Sampling = NO_SAMPLING, mode: str = PLANE_BY_PLANE, batch: int = 1) -> Field:
    check(len(f.shape) == len(kernel.shape) > 0, "field and filter have the same dimensions")
    check(kernel.type.points <= MOST_TAPS, f"a filter has at most {MOST_TAPS} points")
    check(border != FULL or all(n % 2 for n in kernel.shape), "a full convolution needs an odd filter")
    adjoint = mode in (ADJOINT, ADJOINT_SUM)
    up_image, up_filter = (1, sampling.up) if adjoint else (sampling.up, 1)
    grown = [n * up_image for n in f.shape]
    size = [n * up_filter for n in kernel.shape]
    low = [m - 1 if border == FULL else 0 if border == VALID else (m - 1) // 2 for m in size]
    out = [n + m - 1 if border == FULL else n - m + 1 if border == VALID else n for n, m in zip(grown, size)]
    out = [-(-n // sampling.down) for n in out]
    check(all(n > 0 for n in out), "the filter is larger than the field")
    pad = 3 - len(f.shape)
    taps, at = [], []
    for point in np.ndindex(*kernel.shape):
        place = [p * up_filter for p in point]
        place = [m - 1 - p for p, m in zip(place, size)] if flip else place
        taps.append((*[0] * pad, *[p - h for p, h in zip(place, low)]))
        at.append(point)
    pairs, tensor = _planes(mode, f.type, kernel.type, batch)
    kind = COMPLEX if COMPLEX in (f.type.kind, kernel.type.kind) else "real"
    literal = kernel.literal
    if literal is not None:
        # The taps of a literal filter that are zero in all planes send nothing.
        w = literal.reshape(kernel.type.points, kernel.type.elements)
        keep = [i for i in range(len(taps)) if w[i].any()] or [0]
        taps, w = [taps[i] for i in keep], w[keep]
        number = lambda z: cplx(const(z.real), const(z.imag)) if kernel.type.kind == COMPLEX else const(z)
        weights = F.array(*[F.array(*[number(z) for z in row]) for row in w])
    else:
        whole = _whole(kernel, MOST_TAPS)
        df0 = f.df().withColumn("_w", whole)
        weights = F.col("_w") if kernel.tensor else F.transform(F.col("_w"), lambda x: F.array(x))
    df = f.df() if literal is not None else df0
    # A target that no value reaches, as between upsampled points, is zero: the point before it sends a tap without a weight.
    empty = [range(min(0, g - 1 - sampling.down * (m - 1)) - up_image + 1, 1) for g, m in zip(grown, out)] if up_image > 1 or border in (ZERO, FULL) else []
    taps = list(dict.fromkeys([*taps, *((*[0] * pad, *t) for t in combinations(*empty) if empty)]))
    rows, keys = contributions(df, taps, f.type.sizes, (1,) * pad + tuple(out), ZERO if border in (VALID, FULL) else border, up_image, sampling.down)
    rows = rows.withColumn("_w", F.get(weights, F.col("k")))
    x = (lambda p: F.get("v", F.lit(p))) if f.tensor else (lambda p: F.col("v"))
    y = lambda q: F.get("_w", F.lit(q))

    def product(p: int, q: int, part: str) -> Column:
        a, b = x(p), y(q)
        if kind != COMPLEX:
            return a * b
        if f.type.kind != COMPLEX:
            return a * b[part]
        if kernel.type.kind != COMPLEX:
            return a[part] * b
        return a.re * b.re - a.im * b.im if part == "re" else a.re * b.im + a.im * b.re

    def total(of: list[tuple[int, int]]) -> Column:
        parts = [F.coalesce(F.sum(sum((product(p, q, part) for p, q in of[1:]), product(*of[0], part))), const(0)).alias(part) for part in (("re", "im") if kind == COMPLEX else ("re",))]
        return F.struct(*parts) if kind == COMPLEX else parts[0]

    sums = [total(of) for of in pairs]
    value = (F.array(*sums) if tensor else sums[0]).alias("v")
    return Field.from_df(rows.groupBy(*keys).agg(value), FieldType(tuple(out), tensor, kind))


def convolve(f: Field, kernel: Field, border: str = CLAMP, sampling: Sampling = NO_SAMPLING) -> Field:
    """Convolution, the filter flipped; matrices of a matrix field as filters of a scalar field give vectors."""
    if f.type.kind == COLOR:
        from .pointwise import blue, color_field, green, red

        return color_field(*[convolve(g(f), kernel, border, sampling) for g in (red, green, blue)])
    if len(kernel.tensor) == 2 and not f.tensor:
        return _matrix_filters(f, kernel, border)
    return _convolve(f, kernel, border, True, sampling)


def cross_correlate(f: Field, kernel: Field, border: str = CLAMP, sampling: Sampling = NO_SAMPLING) -> Field:
    if len(kernel.tensor) == 2 and not f.tensor:
        return _matrix_filters(f, kernel, border)
    return _convolve(f, kernel, border, False, sampling)


def _matrix_filters(f: Field, kernel: Field, border: str) -> Field:
    """Each matrix of a 1D matrix field as a filter: cross-correlations as the planes of a vector field."""
    check(len(kernel.shape) == 1, "the filters are a 1D field of matrices")
    (n,), (r, c) = kernel.shape, kernel.tensor
    from .shape import reshape

    flat = reshape(kernel, (n, r * c), ())
    from .shape import transpose

    bank = reshape(transpose(flat), (r, c), (n,))
    if kernel.literal is not None:
        bank.literal = np.moveaxis(kernel.literal, 0, -1).reshape(r, c, n)
    return _convolve(f, bank, border, False)


def _separable(f: Field, rows: Field, columns: Field, border: str, flip: bool) -> Field:
    check(len(rows.shape) == len(columns.shape) == 1 and rows.shape[0] % 2 == columns.shape[0] % 2 == 1, "the filters are odd and 1D")
    check(border in (CLAMP, ZERO, CYCLIC) and len(f.shape) == 2, "a 2D field whose border is clamped, zero or cyclic")
    from .shape import reshape

    def turned(k: Field, shape) -> Field:
        out = reshape(k, shape)
        out.literal = None if k.literal is None else k.literal.reshape(shape)
        return out

    across = _convolve(f, turned(rows, (1, rows.shape[0])), border, flip)
    return _convolve(across, turned(columns, (columns.shape[0], 1)), border, flip)


def convolve_separable(f: Field, row_filter: Field, column_filter: Field, border: str = CLAMP) -> Field:
    return _separable(f, row_filter, column_filter, border, True)


def cross_correlate_separable(f: Field, row_filter: Field, column_filter: Field, border: str = CLAMP) -> Field:
    return _separable(f, row_filter, column_filter, border, False)


def _frames(mode: str, flip: bool):
    def op(f: Field, kernel: Field, border: str = CLAMP, sampling: Sampling = NO_SAMPLING, batch: int = 1) -> Field:
        return _convolve(f, kernel, border, flip, sampling, mode, batch)

    return op


project_frame, project_frame_block_reduce_sum = _frames(PROJECT, False), _frames(PROJECT_SUM, False)
back_project_frame, back_project_frame_block_reduce_sum = _frames(BACK_PROJECT, True), _frames(BACK_PROJECT_SUM, True)
convolve_filter_adjoint, convolve_filter_adjoint_block_reduce_sum = _frames(ADJOINT, True), _frames(ADJOINT_SUM, True)
cross_correlate_filter_adjoint = _frames(ADJOINT, False)


# ---- nonlinear neighbourhoods ----------------------------------------------------------------------------------


def _square(mask: np.ndarray) -> list[tuple[int, int, int]]:
    h, w = mask.shape
    return [(0, r - h // 2, c - w // 2) for r in range(h) for c in range(w) if mask[r, c]]


def _scalar2d(f: Field) -> None:
    check(len(f.shape) == 2 and not f.tensor and f.type.kind == "real", "a 2D scalar field")


def median_filter(f: Field) -> Field:
    """The median of 3x3 neighbours, borders clamped."""
    _scalar2d(f)
    return _gathered(f, _square(np.ones((3, 3))), CLAMP, lambda v, k: F.get(F.sort_array(F.collect_list(v)), F.lit(4)))


def local_max(f: Field, neighborhood) -> Field:
    _scalar2d(f)
    return _gathered(f, _square(np.asarray(neighborhood)), CLAMP, lambda v, k: F.max(v))


def local_min(f: Field, neighborhood) -> Field:
    _scalar2d(f)
    return _gathered(f, _square(np.asarray(neighborhood)), CLAMP, lambda v, k: F.min(v))


def _position(sign: int):
    def op(f: Field, neighborhood) -> Field:
        """The offset (rows, columns) of the first extreme, in scan order, among neighbours within the field."""
        _scalar2d(f)
        taps = _square(np.asarray(neighborhood))
        offsets = F.array(*[F.array(const(r), const(c)) for _, r, c in taps])
        return _gathered(f, taps, ZERO, lambda v, k: F.element_at(offsets, F.min_by(k, F.struct((sign * v).alias("v"), k.alias("k"))) + 1), f.type.with_(tensor=(2,)))

    return op


local_max_position, local_min_position = _position(-1), _position(1)


def non_maximum_suppression(f: Field) -> Field:
    """The value where none of the 8 neighbours is larger, else 0."""
    _scalar2d(f)
    taps = _square(np.ones((3, 3)))
    return _gathered(f, taps, ZERO, lambda v, k: F.when(F.max(F.when(k == 4, v)) >= F.coalesce(F.max(F.when(k != 4, v)), const(float("-inf"))), F.max(F.when(k == 4, v))).otherwise(const(0)))


def _pivot(v: Column, k: Column, i: int) -> Column:
    """The value that tap i sent."""
    return F.max(F.when(k == i, v))


#: How far, in points, oriented suppression looks to either side.
ORIENTED_RADIUS = 1.3


def oriented_non_maximum_suppression(f: Field, orientation: Field) -> Field:
    """The value where it is larger than both values at radius 1.3 along the orientation, read between the points."""
    _scalar2d(f)
    check(orientation.type == f.type, "an orientation for each point")
    taps = [(0, r, c) for r in range(-2, 3) for c in range(-2, 3)]
    around = _gathered(f, taps, CLAMP, lambda v, k: F.array(*[_pivot(v, k, i) for i in range(25)]), f.type.with_(tensor=(25,)))
    frame, (n, o, x) = aligned(around, orientation, f)
    n = frame.add(n)
    angle = pi - o
    dx, dy = frame.add(ORIENTED_RADIUS * F.cos(angle)), frame.add(ORIENTED_RADIUS * F.sin(angle))
    across, down = dx - F.floor(dx), dy - F.floor(dy)

    def at(y: Column, x: Column) -> Column:
        return F.element_at(n, ((y + 2) * 5 + x + 3).cast("int"))

    def side(x: Column, y: Column) -> Column:
        top = at(F.floor(y), F.floor(x)) + across * (at(F.floor(y), F.ceil(x)) - at(F.floor(y), F.floor(x)))
        bottom = at(F.ceil(y), F.floor(x)) + across * (at(F.ceil(y), F.ceil(x)) - at(F.ceil(y), F.floor(x)))
        return top + down * (bottom - top)

    larger = (x > side(dx, -dy)) & (x > side(-dx, dy))
    return Field(f.type, frame, F.when(larger, x).otherwise(const(0)))


def bilateral_filter(f: Field, spatial, range_sigma: float) -> Field:
    """Neighbours weighted by the spatial filter and by how near their values are; borders clamped."""
    s = np.asarray(spatial, float)
    check(len(f.shape) == 2 and s.ndim == 2 and s.shape[0] == s.shape[1] and s.shape[0] % 2 == 1, "a 2D field and an odd square filter")
    taps = [(0, r - s.shape[0] // 2, c - s.shape[1] // 2) for r in range(s.shape[0]) for c in range(s.shape[1])]
    weights = F.array(*[const(w) for w in s.ravel()])
    middle = s.size // 2
    scale = 1 / (range_sigma * sqrt(2 * pi))

    def agg(v: Column, k: Column) -> Column:
        return F.struct(_pivot(v, k, middle).alias("x"), F.collect_list(F.struct(k.alias("k"), v.alias("v"))).alias("n"))

    sent, keys = contributions(f.df(), taps, f.type.sizes, f.type.sizes, CLAMP)
    rows = sent.groupBy(*keys).agg(agg(F.col("v"), F.col("k")).alias("a"))
    center = F.col("a.x")
    term = lambda e: F.element_at(weights, e.k + 1) * F.exp((center - e.v) * (center - e.v) * (-1 / range_sigma**2)) * scale
    sums = F.aggregate("a.n", F.struct(const(0).alias("w"), const(0).alias("x")), lambda acc, e: F.struct((acc.w + term(e)).alias("w"), (acc.x + term(e) * e.v).alias("x")))
    return Field.from_df(rows.select(*COORDS, sums.alias("s")).select(*COORDS, (F.col("s.x") / F.greatest(F.col("s.w"), const(1e-10))).alias("v")), f.type)


# ---- gradients -------------------------------------------------------------------------------------------------


def _combination(f: Field, taps: Taps, border: str, weights: Sequence[Sequence[float]], cover: Column | None = None) -> Field:
    """Vectors of weighted sums of the taps; ``cover`` says where, elsewhere they are 0."""
    sums = [F.sum(F.element_at(F.array(*[const(w) for w in ws]), F.col("k") + 1) * F.col("v")) for ws in weights]
    sent, keys = contributions(f.df(), taps, f.type.sizes, f.type.sizes, border)
    rows = sent.groupBy(*keys).agg(F.array(*sums).alias("v"))
    if cover is not None:
        rows = rows.withColumn("v", F.when(cover, F.col("v")).otherwise(fill(f.type.with_(tensor=(len(weights),)))))
    return Field.from_df(rows, f.type.with_(tensor=(len(weights),)))


def forward_gradient(f: Field) -> Field:
    """(next row - here, next column - here); 0 on the last row and column."""
    _scalar2d(f)
    inner = (F.col("row") < f.shape[0] - 1) & (F.col("col") < f.shape[1] - 1)
    return _combination(f, [(0, 0, 0), (0, 1, 0), (0, 0, 1)], ZERO, [(-1, 1, 0), (-1, 0, 1)], inner)


def backward_gradient(f: Field) -> Field:
    """(here - previous row, here - previous column); 0 on the first row and column."""
    _scalar2d(f)
    inner = (F.col("row") > 0) & (F.col("col") > 0)
    return _combination(f, [(0, 0, 0), (0, -1, 0), (0, 0, -1)], ZERO, [(1, -1, 0), (1, 0, -1)], inner)


def central_gradient(f: Field) -> Field:
    """Half the differences of the neighbours, borders clamped."""
    _scalar2d(f)
    return _combination(f, [(0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)], CLAMP, [(-0.5, 0.5, 0, 0), (0, 0, -0.5, 0.5)])


def backward_divergence(f: Field) -> Field:
    """Of vectors (rows, columns): what backward differences sum to, without the terms beyond the last row and column."""
    check(len(f.shape) == 2 and f.tensor == (2,), "a 2D field of vectors of length 2")
    taps = [(0, 0, 0), (0, -1, 0), (0, 0, -1)]
    v, k = F.col("v"), F.col("k")
    last_row, last_col = F.col("row") == f.shape[0] - 1, F.col("col") == f.shape[1] - 1
    sent, keys = contributions(f.df(), taps, f.type.sizes, f.type.sizes, ZERO)
    rows = sent.groupBy(*keys).agg(
        F.sum(F.when(k == 0, F.get(v, F.lit(0)) + F.get(v, F.lit(1)))).alias("here"),
        F.sum(F.when(k == 1, F.get(v, F.lit(0))).otherwise(0)).alias("up"),
        F.sum(F.when(k == 2, F.get(v, F.lit(1))).otherwise(0)).alias("left"),
    )
    zero = const(0)
    total = F.when(last_row | last_col, zero).otherwise(F.col("here")) - F.when(last_col, zero).otherwise(F.col("up")) - F.when(last_row, zero).otherwise(F.col("left"))
    return Field.from_df(rows.select(*COORDS, total.alias("v")), f.type.with_(tensor=()))


def canny(f: Field) -> Field:
    """Sobel magnitudes of each channel, borders clamped."""
    if f.type.kind == COLOR:
        from .pointwise import blue, color_field, green, red

        return color_field(*[canny(g(f)) for g in (red, green, blue)])
    _scalar2d(f)
    taps = [(0, r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    g = _combination(f, taps, CLAMP, [(-1, 0, 1, -2, 0, 2, -1, 0, 1), (-1, -2, -1, 0, 0, 0, 1, 2, 1)])
    return g.of_frame(F.hypot(F.get(g.expr, F.lit(0)), F.get(g.expr, F.lit(1))), tensor=())


# ---- edge-aware filters ----------------------------------------------------------------------------------------


def domain_transform_rows(f: Field, space_sigma: float, range_sigma: float) -> Field:
    """Along each row, the running sum of 1 + (space / range) * |difference to the column before|; colors sum their
    channels' differences."""
    check(len(f.shape) == 2 and f.type.kind != COMPLEX, "a 2D real or color field")
    w = W.partitionBy("layer", "row").orderBy("col")
    scale = space_sigma / range_sigma
    step = lambda x: F.abs(x - F.coalesce(F.lag(x).over(w), x))
    df = f.df("x")
    if f.type.kind == COLOR:
        parts, t = [sum((step(F.col(f"x.{c}")) for c in "gb"), step(F.col("x.r")))], FieldType(f.shape)
    else:
        parts, t = [step(F.get("x", F.lit(i)) if f.tensor else F.col("x")) for i in range(f.type.elements)], f.type
    df = df.select(*COORDS, *[(p * scale + 1).alias(f"s{i}") for i, p in enumerate(parts)])
    sums = [F.sum(f"s{i}").over(w) for i in range(len(parts))]
    return Field.from_df(df.select(*COORDS, (F.array(*sums) if t.tensor else sums[0]).alias("v")), t)


def domain_filter_rows(f: Field, domain: Field, radius: float) -> Field:
    """The mean over the columns whose transform is within the radius of one's own."""
    check(len(f.shape) == 2 and domain.shape == f.shape and (not domain.tensor or domain.tensor == f.tensor), "a transform of the field's shape")
    frame, (x, d) = aligned(f, domain)
    if f.type.kind == COLOR:
        values = [x[c] for c in "rgb"]
    else:
        values = [F.get(x, F.lit(i)) for i in range(f.type.elements)] if f.tensor else [x]
    at = [F.get(d, F.lit(i)) for i in range(f.type.elements)] if domain.tensor else [d] * len(values)
    df = frame.df.select(*COORDS, *[v.alias(f"x{i}") for i, v in enumerate(values)], *[v.alias(f"d{i}") for i, v in enumerate(at)])
    # A range frame of doubles is only to be had in SQL text.
    near = f"RANGE BETWEEN {float(radius)!r}D PRECEDING AND {float(radius)!r}D FOLLOWING"
    means = [F.expr(f"avg(x{i}) OVER (PARTITION BY layer, row ORDER BY d{i} {near})") for i in range(len(values))]
    value = F.struct(*[m.alias(c) for m, c in zip(means, "rgb")]) if f.type.kind == COLOR else F.array(*means) if f.tensor else means[0]
    return Field.from_df(df.select(*COORDS, value.alias("v")), f.type)


def domain_filter_columns(f: Field, domain: Field, radius: float) -> Field:
    """Along columns; the transform is that of the transposed field's rows."""
    from .shape import transpose

    check(domain.shape == f.shape[::-1], "the transform is given transposed")
    return transpose(domain_filter_rows(transpose(f), domain, radius))


# ---- reading between points ------------------------------------------------------------------------------------


def _bilinear(f: Field, target: DataFrame, rows: Column, cols: Column, t: FieldType, border: str) -> Field:
    """Values of a field at fractional places, one for each row of ``target``: a join of four taps."""
    check(f.type.kind == "real", "real fields are interpolated")
    r0, c0 = F.floor(F.col("_y")).cast("int"), F.floor(F.col("_x")).cast("int")
    fr, fc = F.col("_y") - r0, F.col("_x") - c0
    corners = F.array(*[F.struct((r0 + dr).alias("r"), (c0 + dc).alias("c"), ((fr if dr else 1 - fr) * (fc if dc else 1 - fc)).alias("w")) for dr in (0, 1) for dc in (0, 1)])
    taps = target.withColumn("_y", rows.cast("double")).withColumn("_x", cols.cast("double")).select(*COORDS, F.explode(corners).alias("t"))
    _, n, m = f.type.sizes
    place = {CLAMP: lambda x, k: F.greatest(F.lit(0), F.least(F.lit(k - 1), x)), CYCLIC: lambda x, k: F.pmod(x, F.lit(k)), ZERO: lambda x, _: x}[border]
    taps = taps.select(*COORDS, place(F.col("t.r"), n).alias("_r"), place(F.col("t.c"), m).alias("_c"), F.col("t.w").alias("w"))
    source = f.frame.df.select(F.col("row").alias("_r"), F.col("col").alias("_c"), f.expr.alias("x"))
    joined = taps.join(source, ["_r", "_c"], "left")
    if f.tensor:
        value = F.array(*[F.coalesce(F.sum(F.col("w") * F.get("x", F.lit(i))), const(0)) for i in range(f.type.elements)])
    else:
        value = F.coalesce(F.sum(F.col("w") * F.col("x")), const(0))
    return Field.from_df(joined.groupBy(*COORDS).agg(value.alias("v")), t)


def _guide(f: Field, g: Field) -> None:
    check(len(f.shape) in (1, 2) and (g.tensor == (len(f.shape),) or len(f.shape) == 1 and not g.tensor), "a guide of one component for each dimension")


def warp(f: Field, guide: Field, border: str = CLAMP) -> Field:
    """The value at (row - first, column - second component of the guide), a vector for all points or for each."""
    _guide(f, guide)
    check(guide.shape in ((), f.shape), "one guide, or one for each point")
    frame, (_, g) = aligned(f, guide)
    v = lambda i: F.get("_g", F.lit(i)) if guide.tensor else F.col("_g")
    target = frame.df.select(*COORDS, g.alias("_g"))
    rows = F.col("row") - v(0) if len(f.shape) == 2 else F.lit(0)
    return _bilinear(f, target, rows, F.col("col") - v(len(f.shape) - 1), f.type, border)


def subfield(f: Field, guide: Field, shape: Sequence[int], border: str = CLAMP) -> Field:
    """A window of the given shape at a 0D guide: the value at (row + first, column + second component)."""
    _guide(f, guide)
    check(not guide.shape, "the guide is 0D")
    t = f.type.with_(shape=tuple(shape))
    target = grid(f.frame.df.sparkSession, t.sizes).withColumn("_g", guide.scalar())
    v = lambda i: F.get("_g", F.lit(i)) if guide.tensor else F.col("_g")
    rows = F.col("row") + v(0) if len(f.shape) == 2 else F.lit(0)
    return _bilinear(f, target, rows, F.col("col") + v(len(f.shape) - 1), t, border)


def subfields(f: Field, diameter: int) -> Field:
    """All windows of an odd diameter as the planes, by origin row by row, of a field of the windows' shape."""
    _scalar2d(f)
    check(diameter % 2 == 1 and diameter <= 15 and max(f.shape) <= 64, "fields of up to 64 and windows of up to 15 a side")
    rows, cols = (n - diameter + 1 for n in f.shape)
    windows = [(0, r, c) for r in range(rows) for c in range(cols)]
    sent, keys = contributions(f.df(), windows, f.type.sizes, (1, diameter, diameter), ZERO)
    planes = F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x.v)
    return Field.from_df(sent.groupBy(*keys).agg(planes.alias("v")), FieldType((diameter, diameter), (rows * cols,)))


# ---- random numbers --------------------------------------------------------------------------------------------

#: The rule of a cellular automaton whose cells see those at -7, 0, 11 and 17.
AUTOMATON_RULE, AUTOMATON_CELLS = 25946, (-7, 0, 11, 17)


def random(f: Field, bits: int) -> Field:
    """One step of a cellular automaton in each of ``bits`` bits of the elements, which are in [0, 1]."""
    check(len(f.tensor) == 1 and f.type.kind == "real" and 1 <= bits <= 24, "a vector field and up to 24 bits")
    n = f.type.points * f.type.elements
    check(n >= 64, "an automaton has at least 64 cells")
    layers, rows, cols = f.type.sizes
    top = 2**bits - 1
    index = ((F.col("row").cast("bigint") * cols + F.col("col")) * layers + F.col("layer")) * f.type.elements + F.col("_e")
    cells = f.df().select(*COORDS, F.posexplode("v").alias("_e", "_x")).select(index.alias("_i"), (F.col("_x") * top).cast("bigint").alias("_b"))
    sees = F.array(*[F.struct(F.lit(-o).alias("o"), F.lit(k).alias("k")) for k, o in enumerate(AUTOMATON_CELLS)])
    sent = cells.withColumn("_s", F.explode(sees)).select(F.pmod(F.col("_i") + F.col("_s.o"), F.lit(n)).alias("_i"), F.col("_s.k").alias("k"), "_b")
    seen = sent.groupBy("_i").agg(*[F.max(F.when(F.col("k") == k, F.col("_b"))).alias(f"b{k}") for k in range(4)])
    bit = lambda k, i: F.shiftright(F.col(f"b{k}"), i).bitwiseAND(F.lit(1))
    rule = [AUTOMATON_RULE >> i & 1 for i in range(16)]
    state = sum((F.when(F.element_at(F.array(*map(F.lit, rule)), (8 * bit(0, i) + 4 * bit(1, i) + 2 * bit(2, i) + bit(3, i) + 1).cast("int")) == 1, F.lit(1 << i)).otherwise(0) for i in range(bits)), F.lit(0))
    e = f.type.elements
    cell = f"(_i div {e})"
    out = seen.select(F.expr(f"cast({cell} % {layers} as int)").alias("layer"), F.expr(f"cast({cell} div {layers * cols} as int)").alias("row"), F.expr(f"cast(({cell} div {layers}) % {cols} as int)").alias("col"), F.expr(f"_i % {e}").alias("_e"), (state / top).alias("_x"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("_e", "_x"))), lambda x: x["_x"])
    return Field.from_df(out.groupBy(*COORDS).agg(whole.alias("v")), f.type)
