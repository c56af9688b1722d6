"""Reductions of whole fields to 0D ones, arg-max and normalisation: partial sums before any shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..field import COORDS, Field, each
from ..types import COMPLEX, FieldType, check
from .pointwise import mask, nan


def _to_point(df, type: FieldType) -> Field:
    return Field.from_df(df, type)


def _reduced(f: Field, agg) -> Field:
    """Each tensor element reduced over all points: one row whatever the field's size."""
    df = f.frame.df
    if f.type.kind == COMPLEX and not f.tensor:
        out = df.agg(agg(f.expr.re).alias("re"), agg(f.expr.im).alias("im")).select(F.struct("re", "im").alias("v"))
    elif f.type.kind == "color":
        out = df.agg(*[agg(f.expr[c]).alias(c) for c in "rgb"]).select(F.struct(*"rgb").alias("v"))
    elif not f.tensor:
        out = df.agg(agg(f.expr).alias("v"))
    elif f.type.kind == COMPLEX:
        out = df.agg(F.array(*[F.struct(agg(F.get(f.expr, F.lit(i)).re).alias("re"), agg(F.get(f.expr, F.lit(i)).im).alias("im")) for i in range(f.type.elements)]).alias("v"))
    else:
        out = df.agg(F.array(*[agg(F.get(f.expr, F.lit(i))) for i in range(f.type.elements)]).alias("v"))
    return _to_point(out, f.type.with_(shape=()))


def field_reduce_sum(f: Field) -> Field:
    return _reduced(f, F.sum)


def field_reduce_min(f: Field) -> Field:
    check(f.type.kind != COMPLEX, "complex numbers have no order")
    return _reduced(f, lambda x: F.coalesce(F.min(F.when(~F.isnan(x), x)), nan()))


def field_reduce_max(f: Field) -> Field:
    check(f.type.kind != COMPLEX, "complex numbers have no order")
    return _reduced(f, lambda x: F.coalesce(F.max(F.when(~F.isnan(x), x)), nan()))


def field_reduce_median(f: Field, accuracy: int | None = None) -> Field:
    """The median, of an even number the mean of the middle two; exact, or a quantile sketch given an accuracy."""
    check(f.type.kind == "real" and not f.tensor, "medians are of scalar fields")
    agg = F.median(f.expr) if accuracy is None else F.approx_percentile(f.expr, 0.5, accuracy)
    return _to_point(f.frame.df.agg(agg.alias("v")), FieldType())


def max_position(f: Field) -> Field:
    """The coordinates, in the field's dimensions, of the first largest value."""
    check(f.type.kind == "real" and not f.tensor and bool(f.shape), "positions are of scalar fields")
    dims = COORDS[3 - len(f.shape) :]
    first = F.min_by(F.struct(*COORDS), F.struct((-f.expr).alias("n"), *COORDS))
    out = f.frame.df.where(~F.isnan(f.expr)).agg(first.alias("p")).select(F.array(*[F.col(f"p.{c}").cast("double") for c in dims]).alias("v"))
    return _to_point(out, FieldType((), (len(dims),)))


def winner_take_all(f: Field) -> Field:
    """1 at the largest value and 0 elsewhere, for each tensor element; of ties the first point wins."""
    check(f.type.kind == "real" and bool(f.shape), "not a real field")
    coords = F.struct(*COORDS)
    at = [f.expr] if not f.tensor else [F.get(f.expr, F.lit(i)) for i in range(f.type.elements)]
    won = f.frame.df.agg(F.array(*[F.min_by(coords, F.struct((-x).alias("n"), *COORDS)) for x in at]).alias("w"))
    w = f.frame.add(won.scalar())
    cells = [mask(F.get(w, F.lit(i)) == coords) for i in range(len(at))]
    return f.of_frame(cells[0] if not f.tensor else F.array(*cells))


def normalize_l1(f: Field) -> Field:
    """Divided by the sum of all values, signs included."""
    return f / _sum_of(f, lambda x: x)


def normalize_l2(f: Field) -> Field:
    """Divided by the sum of squares, without a root."""
    return f / _sum_of(f, lambda x: x * x)


def _sum_of(f: Field, g) -> Field:
    check(f.type.kind == "real", "not a real field")
    from .tensor import reduce_sum

    summed = field_reduce_sum(each(f, g))
    return reduce_sum(summed) if f.tensor else summed


