"""What the vector operators share: valid vectors as matrices, and block-wise comparison by key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def dimension(df: DataFrame, vector: str) -> int:
    """The commonest length of the vectors; vectors of another length take no part. 0 for an empty table."""
    row = df.where(df[vector].isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row.d if row else 0


def unique_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v), one row for each id that isn't null: of rows that share an id the least vector counts.

    Only if some id occurs twice are vectors shuffled for this.
    """
    rows = df.select(df[vec_id].cast("bigint").alias("id"), df[vector].alias("v")).where("id is not null")
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the rows with a usable vector, those vectors in double precision) of an Arrow list column.

    Null, zero, wrongly sized vectors and those with null or non-finite components aren't usable.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    mask = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), d), False))
    if d == 0 or not mask.any():
        return np.zeros(len(column), bool), np.zeros((0, d))
    flat = column.filter(pa.array(mask)).flatten().cast(pa.float64())
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    mask = mask.copy()
    mask[np.flatnonzero(mask)[~good]] = False
    return mask, x[good]


def bounded_sample(rows: DataFrame, vec_id: str, vector: str, d: int, most_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors in double precision) of the usable vectors among the first rows by the hash of their id, of at
    most ``most_bytes`` on the driver (but 64 rows at least)."""
    if not d:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    picked = rows.orderBy(F.xxhash64(vec_id), vec_id).select(vec_id, vector).limit(max(64, most_bytes // (8 * d))).toArrow()
    mask, x = matrix(picked[vector], d)
    return np.asarray(picked[vec_id])[mask], x


def lists(x: np.ndarray, kind):
    """An Arrow list column of the rows of a matrix."""
    import pyarrow as pa

    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _parts(side: DataFrame, keys: Sequence[str], block: int) -> DataFrame | None:
    """(keys, parts) of the keys that have more rows than a block holds; None if none has."""
    hot = side.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    hot = staged(hot, "parts")
    return None if hot.isEmpty() else hot


def in_blocks(left: DataFrame, right: DataFrame, keys: Sequence[str], run: Callable, schema: str, block: int = 512) -> DataFrame:
    """``run(left table, right table)`` for all rows of ``left`` and ``right`` that share the keys, a block at a time.

    Keys with more than about ``block`` rows on a side are dealt into parts by the hash of ``id``, and each part of
    one side meets each part of the other, so no task holds an unbounded group and no pair is left out. Both
    sides should be staged: they are counted before they are dealt.
    """
    hot = _parts(left, keys, block), _parts(right, keys, block)

    def dealt(side: DataFrame, own: DataFrame | None, other: DataFrame | None, mine: str, theirs: str) -> DataFrame:
        for table, name in ((own, "_own"), (other, "_other")):
            side = side.withColumn(name, F.lit(1)) if table is None else side.join(table.withColumnRenamed("parts", name), list(keys), "left").fillna(1, [name])
        side = side.withColumn(mine, F.pmod(F.xxhash64("id"), F.col("_own")).cast("int"))
        side = side.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col("_other") - 1)) if other is not None else F.lit(0))
        return side.drop("_own", "_other")

    a, b = dealt(left, *hot, "_l", "_r"), dealt(right, *hot[::-1], "_r", "_l")
    by = [*keys, "_l", "_r"]
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(run, schema)
