"""Operators on the tensors at the points: array functions of one projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import functions as F

from ..field import COORDS, Field, aligned, const, cplx
from ..types import COMPLEX, FieldType, check
from .pointwise import c_add, divide, maximum, minimum, nan


def _fold(expr, kind, how):
    """All elements of an array reduced to one."""
    if how == "sum":
        if kind == COMPLEX:
            return F.aggregate(expr, cplx(const(0), const(0)), c_add)
        return F.aggregate(expr, const(0), lambda s, x: s + x)
    g = maximum if how == "max" else minimum
    return F.aggregate(expr, nan(), g)


def _reduce(how):
    def op(f: Field) -> Field:
        check(bool(f.tensor), "not a tensor field")
        check(f.type.kind == "real" or how == "sum", "complex numbers have no order")
        return f.of_frame(_fold(f.expr, f.type.kind, how), tensor=())

    return op


def _block_reduce(how):
    def op(f: Field, factor: int) -> Field:
        check(len(f.tensor) == 1 and f.tensor[0] % factor == 0, "the block size divides the vectors' length")
        n = f.tensor[0] // factor
        blocks = [_fold(F.slice(f.expr, i * factor + 1, factor), f.type.kind, how) for i in range(n)]
        return f.of_frame(blocks[0] if n == 1 else F.array(*blocks), tensor=() if n == 1 else (n,))

    return op


reduce_sum, reduce_min, reduce_max = _reduce("sum"), _reduce("min"), _reduce("max")
block_reduce_sum, block_reduce_min, block_reduce_max = _block_reduce("sum"), _block_reduce("min"), _block_reduce("max")


def vector_element(f: Field, k: int) -> Field:
    check(len(f.tensor) == 1 and 0 <= k < f.tensor[0], "no such element")
    return f.of_frame(F.get(f.expr, F.lit(k)), tensor=())


def matrix_row(f: Field, k: int) -> Field:
    check(len(f.tensor) == 2 and 0 <= k < f.tensor[0], "no such row")
    return f.of_frame(F.slice(f.expr, k * f.tensor[1] + 1, f.tensor[1]), tensor=(f.tensor[1],))


def vector_elements(f: Field, indices: Field) -> Field:
    """Gather by a vector of indices, of each point or of all; NaN where there is no such element."""
    check(len(f.tensor) == 1 and len(indices.tensor) == 1, "vectors are gathered by vectors")
    frame, (v, at) = aligned(f, indices)
    v = frame.add(v)
    expr = F.transform(at, lambda i: F.coalesce(F.get(v, F.when(F.isnan(i) | (i <= -1), F.lit(-1)).otherwise(i.cast("int"))), nan()))
    return Field(FieldType(f.shape or indices.shape, indices.tensor), frame, expr)


def _packed(fields: Sequence[Field], tensor, flat: bool) -> Field:
    check(len({f.type for f in fields}) == 1, "fields to be packed have one type")
    frame, exprs = aligned(*fields)
    return Field(fields[0].type.with_(tensor=tensor), frame, F.flatten(F.array(*exprs)) if flat else F.array(*exprs))


def vector_field(*fields: Field) -> Field:
    """Scalars, real or complex, as the elements of vectors."""
    check(not fields[0].tensor, "only scalars are packed to vectors")
    return _packed(fields, (len(fields),), False)


complex_vector_field = vector_field


def matrix_field(*fields: Field, rows: int | None = None) -> Field:
    """Vectors as the rows of matrices; or scalars, row by row, given the number of rows."""
    if fields[0].tensor:
        return _packed(fields, (len(fields), *fields[0].tensor), True)
    check(rows is not None and len(fields) % rows == 0, "the scalars fill whole rows")
    return _packed(fields, (rows, len(fields) // rows), False)


def transpose_matrices(f: Field) -> Field:
    check(len(f.tensor) == 2, "not a matrix field")
    r, c = f.tensor
    return f.of_frame(F.array(*[F.get(f.expr, F.lit(i * c + j)) for j in range(c) for i in range(r)]), tensor=(c, r))


def transpose_vectors(f: Field) -> Field:
    check(len(f.tensor) == 1, "not a vector field")
    return f.of_frame(f.expr, tensor=(1, f.tensor[0]))


def dot(a: Field, b: Field) -> Field:
    """The sum of the products of elements; ``b`` has the same type or is 0D."""
    check(a.tensor == b.tensor and bool(a.tensor), "tensor shapes differ")
    product = a * b
    return product.of_frame(_fold(product.expr, product.type.kind, "sum"), tensor=())


def _whole(f: Field, most: int = 1 << 16):
    """All values of a small field, row by row, as an array in a scalar subquery."""
    check(f.type.points <= most, f"a field of {f.type.points} points is too large to be an operand of every point")
    row = F.sort_array(F.collect_list(F.struct(*COORDS, f.expr.alias("v"))))
    return f.frame.df.agg(row.alias("a")).select(F.transform("a", lambda x: x.v).alias("a")).scalar()


def cross_dot(f: Field, weights: Field) -> Field:
    """The tensor at each point times a scalar field of the tensor's shape."""
    check(f.tensor == weights.shape and not weights.tensor, "the scalar field has the tensors' shape")
    w = f.frame.add(_whole(weights))
    return f.of_frame(F.aggregate(F.zip_with(f.expr, w, lambda x, y: x * y), const(0), lambda s, x: s + x), tensor=())


def reverse_cross_dot(f: Field, weights: Field) -> Field:
    """The sum over all points of the tensor times a scalar: a 0D-like field of the tensor's shape."""
    check(f.shape == weights.shape and not weights.tensor and bool(f.tensor), "a tensor field and scalars of its shape")
    frame, (t, w) = aligned(f, weights)
    rows = frame.df.select(F.posexplode(t).alias("i", "x"), w.alias("w")).groupBy("i").agg(F.sum(F.col("x") * F.col("w")).alias("v"))
    shape = f.tensor
    coords = {"layer": F.lit(0), "row": (F.col("i") / shape[-1]).cast("int") if len(shape) == 2 else F.lit(0), "col": (F.col("i") % shape[-1]).cast("int")}
    return Field.from_df(rows.select(*[e.alias(c) for c, e in coords.items()], "v"), FieldType(shape))


def transform(a: Field, b: Field, transpose_a: bool = False, transpose_b: bool = False) -> Field:
    """Matrix times vector or matrix, at each point; either side may be 0D."""
    check(len(a.tensor) == 2 and len(b.tensor) in (1, 2), "a matrix transforms vectors and matrices")
    m, k = a.tensor[::-1] if transpose_a else a.tensor
    frame, (x, y) = aligned(a, b)
    x, y = frame.add(x), frame.add(y)
    left = lambda i, j: F.get(x, F.lit(j * m + i if transpose_a else i * k + j))
    if len(b.tensor) == 1:
        check(b.tensor[0] == k, "inner sizes differ")
        right, n = (lambda j, _: F.get(y, F.lit(j))), 1
    else:
        kb, n = b.tensor[::-1] if transpose_b else b.tensor
        check(kb == k, "inner sizes differ")
        right = lambda j, c: F.get(y, F.lit(c * k + j if transpose_b else j * n + c))
    cells = [sum((left(i, j) * right(j, c) for j in range(1, k)), left(i, 0) * right(0, c)) for i in range(m) for c in range(n)]
    return Field(FieldType(a.shape or b.shape, (m,) if len(b.tensor) == 1 else (m, n)), frame, F.array(*cells))


def invert_matrices(f: Field) -> Field:
    """Inverses; singular matrices give NaN. 2x2 in closed form, others in Arrow batches."""
    check(len(f.tensor) == 2 and f.tensor[0] == f.tensor[1], "only square matrices have inverses")
    n = f.tensor[0]
    if n == 2:
        a, b, c, d = (F.get(f.expr, F.lit(i)) for i in range(4))
        det = a * d - b * c
        return f.of_frame(F.array(*[F.when(det != 0, divide(x, det)).otherwise(nan()) for x in (d, -b, -c, a)]))
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(3).flatten().to_numpy(zero_copy_only=False)).reshape(-1, n, n)
            try:
                y = np.linalg.inv(x)
            except np.linalg.LinAlgError:
                y = np.stack([np.linalg.inv(m) if np.linalg.matrix_rank(m) == n else np.full((n, n), np.nan) for m in x])
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * n * n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=[*COORDS, "v"])

    return Field.from_df(f.df().mapInArrow(run, "layer int, row int, col int, v array<double>"), f.type)


#: Added to the determinant, so that singular systems have an answer.
SOLVE_FUDGE = 0.00000001


def solve(a: Field, b: Field) -> Field:
    check(a.tensor == (2, 2) and b.tensor == (2,), "systems are 2x2")
    frame, (m, y) = aligned(a, b)
    m, y = frame.add(m), frame.add(y)
    e = [F.get(m, F.lit(i)) for i in range(4)]
    y0, y1 = F.get(y, F.lit(0)), F.get(y, F.lit(1))
    inv = divide(const(1), e[0] * e[3] - e[1] * e[2] + SOLVE_FUDGE)
    return Field(b.type, frame, F.array((e[3] * y0 - e[1] * y1) * inv, (e[0] * y1 - e[2] * y0) * inv))


def determinant(f: Field) -> Field:
    check(f.tensor == (2, 2), "determinants are of 2x2 matrices")
    e = [F.get(f.expr, F.lit(i)) for i in range(4)]
    return f.of_frame(e[0] * e[3] - e[1] * e[2], tensor=())


def condition_number(f: Field) -> Field:
    """|l1 / (l2 + 1e-7)|, l = (trace +- sqrt(trace^2 + 4 det)) / 2: the sign under the root is the definition's."""
    check(f.tensor == (2, 2), "condition numbers are of 2x2 matrices")
    e = [F.get(f.expr, F.lit(i)) for i in range(4)]
    trace, det = e[0] + e[3], e[0] * e[3] - e[1] * e[2]
    root = F.sqrt(trace * trace + 4 * det)
    return f.of_frame(F.abs(divide((trace + root) / 2, (trace - root) / 2 + 0.0000001)), tensor=())


def replicate(f: Field, shape: Sequence[int]) -> Field:
    """A small scalar field as the tensor at every point of a new field."""
    check(len(f.shape) in (1, 2) and not f.tensor, "a 1D or 2D scalar field becomes the tensor")
    spark = f.frame.df.sparkSession
    from ..field import Frame, grid

    frame = Frame(grid(spark, FieldType(tuple(shape)).sizes))
    return Field(FieldType(tuple(shape), f.shape), frame, frame.add(_whole(f)))


