"""Operators of the user's own: expressions at points with reads of neighbours, scatters, and whole-field functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..field import COORDS, Field, aligned, dealt, value_ddl
from ..operators.stencil import contributions
from ..types import CLAMP, FieldType, check


def point_operator(fields: Sequence[Field], compute: Callable[..., Column | Sequence[Column]], *types: FieldType) -> Field | tuple[Field, ...]:
    """Up to 10 outputs, each an expression of the fields' values at a point and of ``layer``, ``row``, ``col``.

    ``compute`` is called once, with columns; all outputs share one frame, and so one pass over the points.
    """
    check(1 <= len(types) <= 10, "an operator has 1 to 10 outputs")
    frame, exprs = aligned(*fields)
    out = compute(*exprs)
    out = list(out) if isinstance(out, (list, tuple)) else [out]
    check(len(out) == len(types), "as many expressions as output types")
    made = tuple(Field(t, frame, e.cast(value_ddl(t))) for t, e in zip(types, out))
    return made[0] if len(made) == 1 else made


def neighbors(f: Field, offsets: Sequence[tuple[int, int, int]], border: str = CLAMP) -> Field:
    """For each point, the values at (layer, row, col) offsets as a vector: neighbour reads for ``point_operator``."""
    check(not f.tensor and f.type.kind == "real", "a scalar field")
    taps = list(offsets)
    sent, keys = contributions(f.df(), taps, f.type.sizes, f.type.sizes, border)
    read = [F.coalesce(F.max(F.when(F.col("k") == i, F.col("v"))), F.lit(0.0)) for i in range(len(taps))]
    return Field.from_df(sent.groupBy(*keys).agg(F.array(*read).alias("v")), f.type.with_(tensor=(len(taps),)))


def scatter(f: Field, to: Callable[[Column], Column | Sequence[Column]], how: str, shape: Sequence[int]) -> Field:
    """Send each value to a point of a new field, by what ``to`` makes of it, and accumulate there: histograms and sums
    by key. Points that receive nothing are 0; values sent outside are left out."""
    from ..functions.math import ATOMIC

    t = FieldType(tuple(shape))
    dims = COORDS[3 - len(t.shape) :]
    at = to(f.expr)
    at = list(at) if isinstance(at, (list, tuple)) else [at]
    check(len(at) == len(dims), "a coordinate for each dimension")
    value = f.expr.cast("bigint") if how in ("and", "or", "xor") else f.expr
    df = f.frame.df.select(*[(at[dims.index(c)].cast("int") if c in dims else F.lit(0)).alias(c) for c in COORDS], value.alias("x"))
    inside = F.lit(True)
    for c, n in zip(COORDS, t.sizes):
        inside = inside & F.col(c).between(0, n - 1)
    sums = df.where(inside).groupBy(*COORDS).agg(ATOMIC[how](F.col("x")).cast("double").alias("v"))
    from ..field import grid

    full = grid(df.sparkSession, t.sizes).join(sums, list(COORDS), "left").select(*COORDS, F.coalesce("v", F.lit(0.0)).alias("v"))
    return Field.from_df(full, t)


#: Numbers in the block of lines that a function gets at once, and points in a batch of what it returns.
BLOCK, BATCH = 1 << 18, 1 << 16


def field_operator(fields: Sequence[Field], compute: Callable[..., np.ndarray], type: FieldType, most: int = 1 << 26, along: int | None = None) -> Field:
    """A function of whole fields as arrays, in one task: for fields of up to ``most`` values together.

    ``along`` is a dimension whose lines the function treats each on its own, as a running sum does. It is then called with
    blocks of whole lines, arrays of fewer points in the other dimensions, by many tasks, and only a line has up to ``most``
    values. The result's type is declared, and compared with what the function returns.
    """
    import pyarrow as pa

    check(all(f.type.kind == "real" for f in fields) and type.kind == "real", "real fields")
    types, scalars = [f.type for f in fields], not any(f.tensor for f in fields)
    if along is None:
        check(sum(t.points * t.elements for t in types) <= most, f"a whole-field function takes up to {most} values")
        box = lambda block, t: ((0, 0, 0), t.sizes)
        block = F.lit(0)
    else:
        check(0 <= along < len(type.shape) and all(len(t.shape) == len(type.shape) for t in types), "fields of the same dimensions, and one of these")
        axis = 3 - len(type.shape) + along
        a, b = (i for i in range(3) if i != axis)
        check(all(t.sizes[i] == type.sizes[i] for t in types for i in (a, b)), "sizes differ besides the lines'")
        line = sum(t.sizes[axis] * t.elements for t in (*types, type))
        check(line <= 2 * most, f"lines have more than {most} values")
        lines = type.sizes[b]
        per = max(1, min(lines, BLOCK // line))
        blocks = -(-lines // per)

        def box(block: int, t: FieldType) -> tuple[tuple[int, ...], tuple[int, ...]]:
            """The first point of a block and its sizes in a field."""
            low, size = [0, 0, 0], [1, 1, 1]
            low[a], low[b] = block // blocks, block % blocks * per
            size[axis], size[b] = t.sizes[axis], min(per, lines - low[b])
            return tuple(low), tuple(size)

        block = F.expr(f"cast({COORDS[a]} as bigint) * {blocks} + {COORDS[b]} div {per}")
    parts = [f.df().select(block.alias("_b"), F.lit(i).alias("f"), *COORDS, (F.col("v") if f.tensor or scalars else F.array("v")).alias("v")) for i, f in enumerate(fields)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def run(batches):
        arrays, k = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if not arrays:
                k = batch["_b"][0].as_py()
                arrays = [np.zeros((*box(k, t)[1], t.elements)) for t in types]
            for i, t in enumerate(types):
                own = batch.filter(pa.array(np.asarray(batch["f"]) == i)) if len(types) > 1 else batch
                at = tuple(np.asarray(own[c]) - low for c, low in zip(COORDS, box(k, t)[0]))
                arrays[i][at] = (own["v"] if scalars else own["v"].flatten()).to_numpy(zero_copy_only=False).reshape(-1, t.elements)
        dims = lambda t: box(k, t)[1][3 - len(t.shape) :]
        y = np.asarray(compute(*(x.reshape((*dims(t), *t.tensor)) for x, t in zip(arrays, types))), np.float64)
        if y.shape != (*dims(type), *type.tensor):
            raise ValueError(f"the operator returned shape {y.shape}, not {(*dims(type), *type.tensor)}")
        arrays.clear()
        low, size = box(k, type)
        flat = y.reshape(-1, type.elements)
        for start in range(0, len(flat), BATCH):
            v = flat[start : start + BATCH]
            at = [pa.array((x + o).astype(np.int32)) for x, o in zip(np.unravel_index(np.arange(start, start + len(v)), size), low)]
            values = pa.array(v.ravel())
            if type.tensor:
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * type.elements), values)
            yield pa.RecordBatch.from_arrays([*at, values], names=[*COORDS, "v"])

    schema = f"layer int, row int, col int, v {'array<double>' if type.tensor else 'double'}"
    if along is None:
        return Field.from_df(rows.repartition(1).mapInArrow(run, schema), type)
    dealt_rows = dealt(rows, sum(t.points * t.elements for t in types), "_b")
    return Field.from_df(dealt_rows.groupBy("_b").applyInArrow(lambda table: pa.Table.from_batches(run(table.to_batches())), schema), type)
