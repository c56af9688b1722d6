"""Fields: a type and a lazy value over a frame of coordinates.

A frame is a DataFrame with one row for each point, in ``layer``, ``row`` and ``col`` (0 for absent dimensions), and
columns of values. A field is an expression over its frame, so chains of pointwise operators, and operators
that combine fields of one frame, are one projection: no join, no shuffle. Fields of different frames meet in one
equi-join on the coordinates, whose result is a frame again and is remembered. A 0D operand is a scalar
subquery, not a join. Values are doubles, arrays of doubles (vectors, and matrices row by row), structs (re, im)
and (r, g, b).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .types import COLOR, COMPLEX, REAL, FieldType, SemanticError, check, result_type

COORDS = ("layer", "row", "col")
_names = itertools.count()


def fresh(prefix: str = "_v") -> str:
    return f"{prefix}{next(_names)}"


class Frame:
    """Points and named values; columns are added in place and pruned by Catalyst where nothing reads them."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._joined: dict[int, tuple[Frame, Frame, tuple[int, int]]] = {}

    def add(self, expr: Column) -> Column:
        name = fresh()
        self.df = self.df.withColumn(name, expr)
        return F.col(name)


def const(value: float) -> Column:
    return F.lit(float(value))


class Field:
    def __init__(self, type: FieldType, frame: Frame, expr: Column, literal: np.ndarray | None = None):
        self.type, self.frame, self.expr, self.literal = type, frame, expr, literal

    # ---- making fields -------------------------------------------------------------------------------------

    @staticmethod
    def from_df(df: DataFrame, type: FieldType, value: str = "v") -> Field:
        """A field of the rows (layer, row, col, value); rows are trusted to be dense."""
        missing = [c for c in COORDS if c not in df.columns]
        for c in missing:
            df = df.withColumn(c, F.lit(0))
        name = fresh()
        return Field(type, Frame(df.select(*COORDS, F.col(value).alias(name))), F.col(name))

    @staticmethod
    def of(spark: SparkSession, values, tensor_dims: int = 0, kind: str = REAL) -> Field:
        """A constant field of a literal array; its last ``tensor_dims`` dimensions are the tensor's. Colors have a
        last dimension of 3."""
        a = np.asarray(values, np.complex128 if kind == COMPLEX else np.float64)
        dims = 1 if kind == COLOR else tensor_dims
        shape, tensor = a.shape[: a.ndim - dims], a.shape[a.ndim - dims :]
        type = FieldType(shape, () if kind == COLOR else tensor, kind)
        rows = []
        for at in np.ndindex(*type.sizes):
            x = a[at[3 - len(shape) :]]
            if kind == COMPLEX:
                v = [(float(z.real), float(z.imag)) for z in np.ravel(x)]
            else:
                v = [float(z) for z in np.ravel(x)]
            rows.append((*map(int, at), tuple(v) if kind == COLOR else v if tensor else v[0]))
        df = spark.createDataFrame(rows, f"layer int, row int, col int, v {value_ddl(type)}")
        f = Field.from_df(df, type)
        f.literal = a
        return f

    @staticmethod
    def generate(spark: SparkSession, shape: Sequence[int], f: Callable[[Column, Column, Column], Column], tensor: Sequence[int] = (), kind: str = REAL) -> Field:
        """The field whose value at each point is an expression of its layer, row and column."""
        type = FieldType(tuple(shape), tuple(tensor), kind)
        df = grid(spark, type.sizes)
        name = fresh()
        value = f(F.col("layer"), F.col("row"), F.col("col"))
        return Field(type, Frame(df.select(*COORDS, value.cast(value_ddl(type)).alias(name))), F.col(name))

    @staticmethod
    def constant(spark: SparkSession, shape: Sequence[int], value: float) -> Field:
        return Field.generate(spark, shape, lambda *_: const(value))

    # ---- looking at fields ---------------------------------------------------------------------------------

    @property
    def shape(self):
        return self.type.shape

    @property
    def tensor(self):
        return self.type.tensor

    def df(self, name: str = "v") -> DataFrame:
        """(layer, row, col, value)."""
        return self.frame.df.select(*COORDS, self.expr.alias(name))

    def read(self) -> np.ndarray:
        """The values as a dense array: for probes, and fields that fit the driver."""
        t = self.type
        out = np.zeros((*t.sizes, t.elements if t.kind != COLOR else 3), np.complex128 if t.kind == COMPLEX else np.float64)
        for layer, row, col, v in self.df().collect():
            if t.kind == COMPLEX:
                v = [complex(z.re, z.im) for z in (v if t.tensor else [v])]
            out[layer, row, col] = list(v) if t.kind == COLOR else v
        last = (3,) if t.kind == COLOR else t.tensor
        return out.reshape((*t.shape, *last))

    def probe(self) -> Field:
        """Keep the computed values: a cached frame of their own."""
        return Field.from_df(self.df().cache(), self.type)

    # ---- combining -----------------------------------------------------------------------------------------

    def of_frame(self, expr: Column, **changes) -> Field:
        return Field(self.type.with_(**changes), self.frame, expr)

    def scalar(self) -> Column:
        """The value of a 0D field as a scalar subquery."""
        check(not self.shape, "only 0D fields are scalars")
        return self.frame.df.select(self.expr.alias("s")).scalar()

    def on(self, frame: Frame) -> Column:
        """This 0D field's value as a column of another frame."""
        return self.expr if frame is self.frame else frame.add(self.scalar())


def value_ddl(t: FieldType) -> str:
    if t.kind == COLOR:
        return "struct<r:double,g:double,b:double>"
    one = "struct<re:double,im:double>" if t.kind == COMPLEX else "double"
    return f"array<{one}>" if t.tensor else one


def grid(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    """All coordinates of a field of these layers, rows and columns."""
    _, rows, cols = sizes
    i = F.col("id")
    n = sizes[0] * rows * cols
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // (1 << 20)))
    return spark.range(0, n, 1, tasks).select((i / (rows * cols)).cast("int").alias("layer") if sizes[0] > 1 else F.lit(0).alias("layer"), F.expr(f"cast((id div {cols}) % {rows} as int)").alias("row"), F.expr(f"cast(id % {cols} as int)").alias("col"))


#: Rows of one task, where rows are dealt by a key and held in memory.
TASK_ROWS = 1 << 19


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows by keys over as many tasks as their number asks for: what a task holds doesn't grow with a field's size,
    whatever the session's number of partitions, or how small rows are when they are shuffled."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > 1 else df.repartition(*keys)


def aligned(*fields: Field) -> tuple[Frame, list[Column]]:
    """One frame that has all the fields' values, and their expressions there.

    Fields of the same frame stay on it; 0D fields become scalar subqueries; others are joined on the coordinates.
    """
    large = [f for f in fields if f.shape]
    if not large:
        base = fields[0].frame
        return base, [f.on(base) for f in fields]
    check(len({f.shape for f in large}) == 1, f"field shapes differ: {[f.shape for f in large]}")
    frames: list[Frame] = []
    for f in large:
        if f.frame not in frames:
            frames.append(f.frame)
    # A frame that came from joining another already has that one's columns.
    columns = [set(f.df.columns) for f in frames]
    frames = [f for i, f in enumerate(frames) if not any(columns[i] < c or columns[i] == c and j < i for j, c in enumerate(columns))]
    base = frames[0]
    for other in frames[1:]:
        base = _join(base, other)
    # Columns have names of their own, so an expression holds on every frame that has its columns.
    return base, [f.expr if f.shape else f.on(base) for f in fields]


def _join(a: Frame, b: Frame) -> Frame:
    """A frame with both frames' values, made once for the two as they are."""
    width = len(a.df.columns), len(b.df.columns)
    known = a._joined.get(id(b))
    if known is None or known[2] != width:
        keep = [c for c in b.df.columns if c not in COORDS and c not in a.df.columns]
        known = a._joined[id(b)] = Frame(a.df.join(b.df.select(*COORDS, *keep), list(COORDS))), b, width
    return known[0]


def each(f: Field, g: Callable[[Column], Column], **changes) -> Field:
    """Apply a function to every real element: of scalars, tensors and color channels."""
    check(f.type.kind != COMPLEX, "complex elements aren't real")
    if f.type.kind == COLOR:
        return f.of_frame(F.struct(*[g(f.expr[c]).alias(c) for c in "rgb"]), **changes)
    return f.of_frame(F.transform(f.expr, g) if f.tensor else g(f.expr), **changes)


def each_complex(f: Field, g: Callable[[Column], Column], **changes) -> Field:
    """Apply a function of (re, im) structs to every complex element."""
    return f.of_frame(F.transform(f.expr, g) if f.tensor else g(f.expr), **changes)


def cplx(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def to_complex(f: Field) -> Field:
    """A real field with imaginary part 0."""
    if f.type.kind == COMPLEX:
        return f
    check(f.type.kind == REAL, "only real fields become complex")
    g = lambda x: cplx(x, const(0))
    return f.of_frame(F.transform(f.expr, g) if f.tensor else g(f.expr), kind=COMPLEX)


def combine(a: Field, b: Field, real: Callable[[Column, Column], Column], complex_: Callable[[Column, Column], Column] | None = None) -> Field:
    """A binary operator: element by element, with a scalar against each element of a tensor or color."""
    t = result_type(a.type, b.type)
    if t.kind == COMPLEX:
        check(complex_ is not None, "not an operator of complex fields")
        a, b, g = to_complex(a), to_complex(b), complex_
    else:
        g = real
    frame, (x, y) = aligned(a, b)
    if t.kind == COLOR:
        ca, cb = (lambda e, f: (lambda c: e[c] if f.type.kind == COLOR else e))(x, a), (lambda e, f: (lambda c: e[c] if f.type.kind == COLOR else e))(y, b)
        return Field(t, frame, F.struct(*[g(ca(c), cb(c)).alias(c) for c in "rgb"]))
    if a.tensor and b.tensor:
        expr = F.zip_with(x, y, g)
    elif a.tensor:
        expr = F.transform(x, lambda e: g(e, y))
    elif b.tensor:
        expr = F.transform(y, lambda e: g(x, e))
    else:
        expr = g(x, y)
    return Field(t, frame, expr)


__all__ = ["COLOR", "COMPLEX", "COORDS", "REAL", "Field", "Frame", "SemanticError", "aligned", "combine", "const", "cplx", "each", "each_complex", "fresh", "grid", "to_complex", "value_ddl"]
