"""Slicing, reshaping and resampling: coordinates are computed, points are moved, and never joined to a grid.

What a border or gap is filled with is generated as points of its own and unioned to the points that moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..field import COORDS, Field, aligned, const, grid, value_ddl
from ..types import CLAMP, COLOR, COMPLEX, CYCLIC, ZERO, FieldType, check


def fill(t: FieldType, value: float = 0.0) -> Column:
    """The value of one point of a type with all elements alike."""
    if t.kind == COLOR:
        return F.struct(*[const(value).alias(c) for c in "rgb"])
    one = F.struct(const(value).alias("re"), const(0 if value == 0 else value).alias("im")) if t.kind == COMPLEX else const(value)
    return F.array_repeat(one, t.elements) if t.tensor else one


def moved(f: Field, type: FieldType, where: Column | None = None, **to: Column) -> Field:
    """Points at new coordinates; those for which ``where`` doesn't hold are left out."""
    df = f.frame.df if where is None else f.frame.df.where(where)
    return Field.from_df(df.select(*[to.get(c, F.col(c)).cast("int").alias(c) for c in COORDS], f.expr.alias("v")), type)


def with_gaps(f: Field, type: FieldType, gap: Column) -> Field:
    """The field with zeros at the points of its new grid for which ``gap`` holds."""
    holes = grid(f.frame.df.sparkSession, type.sizes).where(gap).select(*COORDS, fill(type).cast(value_ddl(type)).alias("v"))
    return Field.from_df(f.df().unionByName(holes), type)


def _dims(f: Field) -> tuple[str, ...]:
    return COORDS[3 - len(f.shape) :]


def window(f: Field, *ranges: range) -> Field:
    """A contiguous window of each dimension, of the same dimensions; coordinates start anew at 0."""
    check(len(ranges) == len(f.shape) and all(r.step == 1 and 0 <= r.start < r.stop <= n for r, n in zip(ranges, f.shape)), "a window is within the field")
    inside = F.lit(True)
    for c, r in zip(_dims(f), ranges):
        inside = inside & F.col(c).between(r.start, r.stop - 1)
    return moved(f, f.type.with_(shape=tuple(map(len, ranges))), inside, **{c: F.col(c) - r.start for c, r in zip(_dims(f), ranges)})


def trim(f: Field, shape: Sequence[int]) -> Field:
    return window(f, *[range(n) for n in shape])


def _drop_first(f: Field, at: Column) -> Field:
    first = _dims(f)[0]
    return moved(f, f.type.with_(shape=f.shape[1:]), F.col(first) == at, **{first: F.lit(0)})


def slice_at(f: Field, k: int) -> Field:
    """The k-th slice of the first dimension, which goes."""
    check(bool(f.shape) and 0 <= k < f.shape[0], "no such slice")
    return _drop_first(f, F.lit(k))


def slice_point(f: Field, index: Field) -> Field:
    """The slice at a 0D index, cut to an integer and then to the field's bounds."""
    check(bool(f.shape) and index.type == FieldType(), "the index is a 0D scalar")
    return _drop_first(f, F.greatest(F.lit(0), F.least(F.lit(f.shape[0] - 1), index.scalar().cast("int"))))


def flip(f: Field) -> Field:
    return moved(f, f.type, **{c: n - 1 - F.col(c) for c, n in zip(_dims(f), f.shape)})


def _shifts(f: Field, by: Sequence[int]) -> dict[str, tuple[int, int]]:
    check(len(by) == len(f.shape) <= 2 and bool(by), "one shift for each of 1 or 2 dimensions")
    return {c: (s, n) for c, s, n in zip(_dims(f), by, f.shape)}


def shift(f: Field, *by: int) -> Field:
    """Moved by (columns) or (rows, columns), zeros coming in."""
    to = _shifts(f, by)
    kept, gap = F.lit(True), F.lit(False)
    for c, (s, n) in to.items():
        kept = kept & (F.col(c) + s).between(0, n - 1)
        gap = gap | ~(F.col(c) - s).between(0, n - 1)
    return with_gaps(moved(f, f.type, kept, **{c: F.col(c) + s for c, (s, _) in to.items()}), f.type, gap)


def shift_cyclic(f: Field, *by: int) -> Field:
    return moved(f, f.type, **{c: F.pmod(F.col(c) + s, F.lit(n)) for c, (s, n) in _shifts(f, by).items()})


def transpose(f: Field) -> Field:
    check(len(f.shape) == 2, "only 2D fields are transposed")
    return moved(f, f.type.with_(shape=f.shape[::-1]), row=F.col("col"), col=F.col("row"))


def _linear(sizes: Sequence[int]) -> Column:
    return (F.col("layer").cast("bigint") * sizes[1] + F.col("row")) * sizes[2] + F.col("col")


def reshape(f: Field, shape: Sequence[int], tensor: Sequence[int] | None = None) -> Field:
    """The same values, row by row, in another shape; with a tensor shape, also between points and tensors."""
    tensor = f.tensor if tensor is None else tuple(tensor)
    t = f.type.with_(shape=tuple(shape), tensor=tensor)
    check(t.points * t.elements == f.type.points * f.type.elements, "a reshape keeps the number of values")
    _, rows, cols = t.sizes
    at = lambda i: [F.expr(f"cast({i} div {rows * cols} as int)").alias("layer"), F.expr(f"cast(({i} div {cols}) % {rows} as int)").alias("row"), F.expr(f"cast({i} % {cols} as int)").alias("col")]
    df = f.frame.df.select(_linear(f.type.sizes).alias("_i"), f.expr.alias("v"))
    if t.elements != f.type.elements:
        if f.type.elements % t.elements == 0:
            n, parts = t.elements, f.type.elements // t.elements
            piece = F.slice("v", F.col("_k") * n + 1, n) if t.tensor else F.get("v", F.col("_k"))
            df = df.select("_i", "v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_k")).select((F.col("_i") * parts + F.col("_k")).alias("_i"), piece.alias("v"))
        else:
            check(t.elements % f.type.elements == 0, "points are merged or split evenly")
            n = t.elements // f.type.elements
            group = F.sort_array(F.collect_list(F.struct((F.col("_i") % n).alias("k"), "v")))
            df = df.groupBy(F.expr(f"_i div {n}").alias("_i")).agg(group.alias("g")).select("_i", F.transform("g", lambda x: x.v).alias("v"))
            if f.tensor:
                df = df.withColumn("v", F.flatten("v"))
    return Field.from_df(df.select(*at("_i"), "v"), t)


def downsample(f: Field, factor: int = 2, phase: int = 0) -> Field:
    """Every factor-th point of each dimension, from ``phase``."""
    check(0 <= phase < factor, "the phase is below the factor")
    sizes = tuple(-(-(n - phase) // factor) for n in f.shape)
    kept = F.lit(True)
    for c in _dims(f):
        kept = kept & (F.pmod(F.col(c) - phase, F.lit(factor)) == 0) & (F.col(c) >= phase)
    return moved(f, f.type.with_(shape=sizes), kept, **{c: F.expr(f"({c} - {phase}) div {factor}") for c in _dims(f)})


def _spread(f: Field, factor: int, value) -> Field:
    """Each point as ``factor`` points along each dimension; ``value(offsets)`` is what they hold."""
    df, offsets = f.frame.df.select(*COORDS, f.expr.alias("v")), {}
    for c in _dims(f):
        df = df.withColumn(f"_{c}", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
        offsets[c] = F.col(f"_{c}")
    to = [(F.col(c) * factor + offsets[c]).alias(c) if c in offsets else F.col(c) for c in COORDS]
    return Field.from_df(df.select(*to, value(offsets).alias("v")), f.type.with_(shape=tuple(n * factor for n in f.shape)))


def upsample(f: Field, factor: int = 2, phase: int = 0) -> Field:
    """Zeros between the points, which land on ``phase``."""
    check(0 <= phase < factor, "the phase is below the factor")

    def value(offsets):
        here = F.lit(True)
        for o in offsets.values():
            here = here & (o == phase)
        return F.when(here, F.col("v")).otherwise(fill(f.type))

    return _spread(f, factor, value)


def supersample(f: Field) -> Field:
    """Twice the points of each dimension, each point repeated."""
    return _spread(f, 2, lambda _: F.col("v"))


def expand(f: Field, border: str, shape: Sequence[int]) -> Field:
    """Padded to a larger shape at the far ends. Clamped borders meet half-way, as if the result were a torus; cyclic
    ones continue the field from both sides."""
    shape = tuple(shape)
    check(len(shape) == len(f.shape) and all(m >= n for m, n in zip(shape, f.shape)), "a field expands to a larger shape")
    t = f.type.with_(shape=shape)
    if border == ZERO:
        gap = F.lit(False)
        for c, n in zip(_dims(f), f.shape):
            gap = gap | (F.col(c) >= n)
        return with_gaps(f, t, gap)
    check(border in (CLAMP, CYCLIC), "borders of an expansion are zero, clamped or cyclic")
    df = f.df()
    for c, n, m in zip(_dims(f), f.shape, shape):
        x, half = F.col(c), n + (m - n) // 2
        if border == CLAMP:
            low = F.sequence(F.lit(half), F.lit(m - 1)) if half < m else F.array().cast("array<int>")
            own = F.when(x == n - 1, F.sequence(F.lit(n - 1), F.lit(half - 1))).otherwise(F.array(x))
            places = F.concat(own, F.when(x == 0, low).otherwise(F.array().cast("array<int>")))
        else:
            first = half + F.pmod(x - (half - m), F.lit(n))
            places = F.concat(F.sequence(x, F.lit(half - 1), F.lit(n)), F.when(first < m, F.sequence(first, F.greatest(first, F.lit(m - 1)), F.lit(n))).otherwise(F.array().cast("array<int>")))
        df = df.withColumn("_to", places).withColumn(c, F.explode("_to")).drop("_to")
    return Field.from_df(df, t)


def stack(*fields: Field) -> Field:
    """Fields of one type along a new first dimension."""
    check(len({f.type for f in fields}) == 1 and len(fields[0].shape) < 3, "fields of one type, of up to 2 dimensions")
    n = len(fields[0].shape)
    first = COORDS[2 - n]
    parts = [f.df().withColumn(first, F.lit(k)) for k, f in enumerate(fields)]
    return Field.from_df(_union(parts), fields[0].type.with_(shape=(len(fields), *fields[0].shape)))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def join(a: Field, b: Field) -> Field:
    """Concatenated along the first dimension."""
    check(bool(a.shape) and a.shape[1:] == b.shape[1:] and a.type.with_(shape=()) == b.type.with_(shape=()), "fields that differ in their first size only")
    first = _dims(a)[0]
    return Field.from_df(a.df().unionByName(b.df().withColumn(first, F.col(first) + a.shape[0])), a.type.with_(shape=(a.shape[0] + b.shape[0], *a.shape[1:])))


def push(f: Field, top: Field) -> Field:
    """A stack of fixed depth along the first dimension: the new slice comes first, the last goes."""
    check(top.type == f.type.with_(shape=f.shape[1:]), "the slice fits the stack")
    first = _dims(f)[0]
    rest = f.df().where(F.col(first) < f.shape[0] - 1).withColumn(first, F.col(first) + 1)
    return Field.from_df(rest.unionByName(top.df().withColumn(first, F.lit(0))), f.type)


def outer(a: Field, b: Field, most: int = 1 << 16) -> Field:
    """All products of two scalar fields; the second, which every point of the first meets, is small."""
    check(not a.tensor and not b.tensor and len(a.shape) + len(b.shape) <= 3, "scalar fields of up to 3 dimensions together")
    check(b.type.points <= most, f"the second operand has more than {most} points")
    values = F.collect_list(F.struct(*[F.col(c).alias(f"b_{c}") for c in COORDS], b.expr.alias("y")))
    df = a.frame.df.withColumn("_all", b.frame.df.agg(values.alias("a")).scalar())
    df = df.select(*COORDS, a.expr.alias("x"), F.explode("_all").alias("o")).select(*COORDS, "x", "o.*")
    from_ = [*_dims(a), *(f"b_{c}" for c in _dims(b))]
    to = COORDS[3 - len(from_) :]
    coords = [F.col(dict(zip(to, from_))[c]).alias(c) if c in to else F.lit(0).alias(c) for c in COORDS]
    return Field.from_df(df.select(*coords, (F.col("x") * F.col("y")).alias("v")), FieldType(a.shape + b.shape))


def select(fields: Sequence[Field], index: Field) -> Field:
    """The field that a 0D index names; a field of NaN if it names none."""
    check(len({f.type for f in fields}) == 1 and index.type == FieldType(), "fields of one type, and a 0D scalar")
    frame, exprs = aligned(*fields)
    i = index.scalar()
    out = fill(fields[0].type, float("nan"))
    for k, e in reversed(list(enumerate(exprs))):
        out = F.when((i >= k) & (i < k + 1), e).otherwise(out)
    return Field(fields[0].type, frame, out.cast(value_ddl(fields[0].type)))


