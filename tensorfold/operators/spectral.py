"""Fourier and cosine transforms: one pass along each dimension, blocks of whole lines, numpy in Arrow batches.

A task holds a block of lines, of a bounded number of points, or one line where that is longer: its memory grows with the
line, not with the field. A field of any size is transformed by its lines, with one shuffle for each dimension.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
from pyspark.sql import functions as F

from ..field import COORDS, Field, cplx, dealt, to_complex
from ..types import COMPLEX, check
from .pointwise import imaginary_part, real_part
from .shape import transpose

#: Numbers in the block of lines that is transformed at once.
BLOCK = 1 << 17


def _lines(f: Field, axis: str, g) -> Field:
    """Apply ``g(lines by points by planes)`` to arrays of whole lines along one axis, complex ones of complex fields."""
    import pyarrow as pa

    t, planes = f.type, f.type.elements
    size = dict(zip(COORDS, t.sizes))
    a, b = (c for c in COORDS if c != axis)
    n, total = size[axis], size[a] * size[b]
    per = max(1, BLOCK // (n * planes))
    parts = ("re", "im") if t.kind == COMPLEX else ("v",)
    element = lambda p: F.col("v") if p == "v" else F.transform("v", lambda z: z[p]) if t.tensor else F.col(f"v.{p}")
    line = F.col(a).cast("bigint") * size[b] + F.col(b)
    flat = f.df().select(line.alias("_l"), F.col(axis).alias("_x"), *[element(p).alias(p) for p in parts])
    flat = flat.select(F.expr(f"_l div {per}").alias("_b"), F.expr(f"_l % {per}").alias("_l"), "_x", *parts)

    def run(table: pa.Table) -> pa.Table:
        first = table["_b"][0].as_py() * per
        lines = min(per, total - first)
        at = np.asarray(table["_l"]) * n + np.asarray(table["_x"])
        x = np.zeros((lines * n, planes), np.complex128 if t.kind == COMPLEX else np.float64)
        for p, to in zip(parts, (x.real, x.imag)):
            column = table[p].combine_chunks()
            to[at] = np.asarray(column.flatten() if t.tensor else column).reshape(-1, planes)
        y = g(x.reshape(lines, n, planes)).reshape(-1, planes)
        where = {axis: np.tile(np.arange(n, dtype=np.int32), lines)}
        where[a], where[b] = (np.repeat(c.astype(np.int32), n) for c in np.divmod(np.arange(first, first + lines), size[b]))
        values = [np.ascontiguousarray(v).ravel() for v in ((y.real, y.imag) if t.kind == COMPLEX else (y,))]
        if t.tensor:
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * planes)
            values = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]
        return pa.table([*(pa.array(where[c]) for c in COORDS), *map(pa.array, values)], names=[*COORDS, *parts])

    one = "array<double>" if t.tensor else "double"
    out = dealt(flat, t.points * planes, "_b").groupBy("_b").applyInArrow(run, ", ".join([*(f"{c} int" for c in COORDS), *(f"{p} {one}" for p in parts)]))
    value = F.col("v") if t.kind != COMPLEX else F.zip_with("re", "im", cplx) if t.tensor else cplx(F.col("re"), F.col("im"))
    return Field.from_df(out.select(*COORDS, value.alias("v")), t)


def _power_of_two(n: int) -> bool:
    return n & (n - 1) == 0


def _fft(f: Field, axes, inverse: bool, scale=None) -> Field:
    check(f.type.kind in ("real", COMPLEX), "not a real or complex field")
    f = to_complex(f)
    for axis in axes:
        n = f.type.sizes[COORDS.index(axis)]
        check(_power_of_two(n), "sizes are powers of 2")
        if n > 1 or scale:
            k = n / scale if scale and inverse else 1.0
            f = _lines(f, axis, (lambda x, k=k: np.fft.ifft(x, axis=1) * k) if inverse else (lambda x: np.fft.fft(x, axis=1)))
    return f


def _axes(f: Field):
    return COORDS[3 - len(f.shape) :]


def fft(f: Field) -> Field:
    """Forward, unscaled, over all dimensions, plane by plane."""
    return _fft(f, _axes(f), False)


def fft_inverse(f: Field) -> Field:
    """Inverse, divided by the number of points."""
    check(f.type.kind == COMPLEX, "the inverse is of complex fields")
    return _fft(f, _axes(f), True)


def fft_ri(re: Field, im: Field | None = None) -> tuple[Field, Field]:
    """Forward, real and imaginary part apart; without an imaginary part it is 0."""
    from .pointwise import complex_field

    out = fft(complex_field(re, im))
    return real_part(out), imaginary_part(out)


def fft_inverse_ri(re: Field, im: Field) -> tuple[Field, Field]:
    from .pointwise import complex_field

    out = fft_inverse(complex_field(re, im))
    return real_part(out), imaginary_part(out)


def fft_rows(f: Field) -> Field:
    check(len(f.shape) == 2, "a 2D field")
    return _fft(f, ("col",), False)


def fft_columns(f: Field) -> Field:
    check(len(f.shape) == 2, "a 2D field")
    return _fft(f, ("row",), False)


def fft_inverse_rows(f: Field) -> Field:
    """The inverse along rows, divided by the number of rows, so that with ``fft_inverse_columns`` it is the inverse."""
    check(len(f.shape) == 2 and f.type.kind == COMPLEX, "a complex 2D field")
    return _fft(f, ("col",), True, f.shape[0])


def fft_inverse_columns(f: Field) -> Field:
    """The inverse along columns, divided by the number of columns."""
    check(len(f.shape) == 2 and f.type.kind == COMPLEX, "a complex 2D field")
    return _fft(f, ("row",), True, f.shape[1])


def _cosines(x: np.ndarray) -> np.ndarray:
    """Orthonormal, by a Fourier transform of the even points followed by the odd ones turned around."""
    n = x.shape[1]
    w = np.exp(-0.5j * np.pi * np.arange(n) / n) * sqrt(2 / n)
    w[0] = sqrt(1 / n)
    return (np.fft.fft(np.concatenate([x[:, ::2], x[:, 1::2][:, ::-1]], axis=1), axis=1) * w[:, None]).real


def _cosines_inverse(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    w = np.exp(0.5j * np.pi * np.arange(n) / n) / sqrt(2 / n)
    z = x.astype(np.complex128)
    z[:, 1:] -= 1j * x[:, :0:-1]
    z *= w[:, None]
    z[:, 0] = x[:, 0] * sqrt(n)
    v, y = np.fft.ifft(z, axis=1).real, np.empty_like(x)
    half = (n + 1) // 2
    y[:, ::2], y[:, 1::2] = v[:, :half], v[:, half:][:, ::-1]
    return y


def _dct(f: Field, inverse: bool) -> Field:
    check(len(f.shape) == 2 and not f.tensor and f.type.kind == "real" and f.shape[0] == f.shape[1], "a square 2D scalar field")
    check(_power_of_two(f.shape[0]), "sizes are powers of 2")
    for axis in ("col", "row"):
        f = _lines(f, axis, _cosines_inverse if inverse else _cosines)
    return f


def dct(f: Field) -> Field:
    """The orthonormal two-dimensional cosine transform (type II)."""
    return _dct(f, False)


def dct_inverse(f: Field) -> Field:
    return _dct(f, True)


def dct_transposed(f: Field) -> Field:
    return transpose(_dct(f, False))


def dct_inverse_transposed(f: Field) -> Field:
    return transpose(_dct(f, True))
