"""Fields from tables and files, and back."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..field import COORDS, TASK_ROWS, Field, Frame, dealt, fresh, grid, value_ddl
from ..types import FieldType, check


def from_table(df: DataFrame, index: Column, value: Column, shape: Sequence[int]) -> Field:
    """A dense scalar field of a table: values are summed by row-by-row index, points without rows are 0.

    The grid is generated and the sums are joined to it; rows whose index is outside the shape are left out. Large fields'
    rows and points are dealt alike by index, over tasks of a bounded number of points.
    """
    t = FieldType(tuple(shape))
    _, rows, cols = t.sizes
    i = (F.col("layer").cast("bigint") * rows + F.col("row")) * cols + F.col("col")
    given = df.select(index.cast("bigint").alias("_i"), value.cast("double").alias("_x")).where(F.col("_i").between(0, t.points - 1))
    points = grid(df.sparkSession, t.sizes).withColumn("_i", i)
    if t.points > TASK_ROWS:
        given, points = (dealt(x, t.points, "_i") for x in (given, points))
    points = points.join(given.groupBy("_i").agg(F.sum("_x").alias("_x")), "_i", "left")
    name = fresh()
    return Field(t, Frame(points.select(*COORDS, F.coalesce("_x", F.lit(0.0)).alias(name))), F.col(name))


def from_vectors(df: DataFrame, index: Column, vector: str, shape: Sequence[int], length: int) -> Field:
    """A vector field of a table that has a row for each point."""
    t = FieldType(tuple(shape), (length,))
    _, rows, cols = t.sizes
    df = df.select(index.cast("bigint").alias("_i"), F.col(vector).cast("array<double>").alias("v"))
    return Field.from_df(df.select(F.expr(f"cast(_i div {rows * cols} as int)").alias("layer"), F.expr(f"cast((_i div {cols}) % {rows} as int)").alias("row"), F.expr(f"cast(_i % {cols} as int)").alias("col"), "v"), t)


def write_field(f: Field, path: str) -> None:
    """A Parquet table of the points, and the type as JSON beside it."""
    f.df().write.mode("overwrite").parquet(f"{path}/points")
    spark = f.frame.df.sparkSession
    spark.createDataFrame([(json.dumps({"shape": f.shape, "tensor": f.tensor, "kind": f.type.kind}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/type")


def read_field(spark: SparkSession, path: str) -> Field:
    own = json.loads(spark.read.text(f"{path}/type").first()[0])
    t = FieldType(tuple(own["shape"]), tuple(own["tensor"]), own["kind"])
    df = spark.read.schema(f"layer int, row int, col int, v {value_ddl(t)}").parquet(f"{path}/points")
    return Field.from_df(df, t)


def read_pgm(spark: SparkSession, path: str) -> Field:
    """A binary PGM image (P5, 8 bits) as a 2D scalar field; the file is one row of ``binaryFile``."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    parts, at = [], 0
    while len(parts) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        parts.append(data[at:end])
        at = end
    check(parts[0] == b"P5" and int(parts[3]) < 256, "not an 8-bit binary PGM image")
    cols, rows = int(parts[1]), int(parts[2])
    return Field.of(spark, np.frombuffer(data, np.uint8, rows * cols, at + 1).reshape(rows, cols).astype(float))


def pgm_bytes(f: Field) -> bytes:
    """A small 2D scalar field as a binary PGM image; values are rounded and kept within 0 and 255."""
    check(len(f.shape) == 2 and not f.tensor, "images are 2D scalar fields")
    x = np.clip(np.rint(f.read()), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + x.tobytes()
