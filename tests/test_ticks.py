"""Feedback, sensors, actuators, checkpoints, user operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorfold.field import Field
from tensorfold.functions import math as fm
from tensorfold.functions import user
from tensorfold.sources import tables
from tensorfold.streaming.ticks import Actuator, Sensor, TickGraph, hold_last_stream
from tensorfold.types import FieldType


def test_counter_and_swap(spark):
    start = np.add.outer(np.arange(2.0), np.arange(3.0))
    a, b = Field.of(spark, start), Field.of(spark, -start)
    g = TickGraph(spark, lambda v, _: {"a": v["b"], "b": v["a"], "c": v["c"] + 1.0}, {"a": a, "b": b, "c": Field.of(spark, 1.234)})
    g.reset()
    assert np.isclose(g.registers["c"].read(), 1.234)
    g.step()
    assert np.isclose(g.registers["c"].read(), 2.234) and np.allclose(g.registers["a"].read(), -start)
    g.step()
    assert np.allclose(g.registers["a"].read(), start) and g.time == 2
    assert np.isclose(g.reset().registers["c"].read(), 1.234)


def test_sensors_and_actuators(spark):
    frames, asked, seen, lagged = [[1.0], None, [3.0], [4.0]], [], [], []

    def following():
        asked.append(len(asked))
        return frames[len(asked) - 1] if len(asked) <= len(frames) else None

    sensor = Sensor(FieldType((1,)), following)
    out = lambda kept: (lambda f: kept.append(float(f.read()[0])))
    g = TickGraph(spark, lambda v, _: {"x": v["in"] * 2.0}, sensors={"in": sensor}, actuators=[Actuator("x", out(seen), pipelined=False), Actuator("x", out(lagged), init=Field.of(spark, [4.567]))])
    g.reset()
    assert len(asked) == 2
    g.step(3)
    assert seen == [2.0, 2.0, 6.0, 8.0]
    assert lagged == [4.567, 2.0, 2.0, 6.0]


def test_save_and_restore(spark, tmp_path):
    body = lambda v, _: {"x": v["x"] * 2.0}
    g = TickGraph(spark, body, {"x": Field.of(spark, [1.0, 2.0])}).step(2)
    g.save(f"file://{tmp_path}/g")
    h = TickGraph(spark, body).restore(f"file://{tmp_path}/g").step()
    assert h.time == 3 and h.registers["x"].read().tolist() == [8.0, 16.0]


def test_stream_holds_last(spark, tmp_path):
    spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 1, None)], "k string, t bigint, x double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, t bigint, x double").parquet(f"{tmp_path}/in")
    q = hold_last_stream(stream, "k", "t", "x").writeStream.format("memory").queryName("held").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("held").collect())) == [("a", 1, 5.0), ("a", 2, 5.0), ("b", 1, 0.0)]


def test_user_operators(spark, tmp_path):
    w = np.arange(6.0).reshape(2, 3)
    f = Field.of(spark, w)
    low, high = user.point_operator([f, f], lambda x, y: (x - 1, y + 1), f.type, f.type)
    assert low.frame is high.frame and np.allclose(low.read() + 2, high.read())
    assert user.scatter(f, lambda x: x % 2, "add", (2,)).read().tolist() == [6.0, 9.0]
    assert np.allclose(user.field_operator([f], lambda x: x.T, FieldType((3, 2))).read(), w.T)
    tables.write_field(f, f"file://{tmp_path}/f")
    assert np.allclose(tables.read_field(spark, f"file://{tmp_path}/f").read(), w)
    (tmp_path / "x.pgm").write_bytes(tables.pgm_bytes(f))
    assert np.allclose(tables.read_pgm(spark, f"file://{tmp_path}/x.pgm").read(), w)


@pytest.mark.parametrize("name, args, expected", [("erf", [0.5], 0.5204998778), ("tgamma", [5.0], 24.0), ("round", [-2.5], -3.0), ("rint", [2.5], 2.0), ("remainder", [5.0, 3.0], -1.0), ("cbrt", [27.0], 3.0), ("logb", [10.0], 3.0), ("rootn", [-8.0, 3.0], -2.0), ("log2", [8.0], 3.0)])
def test_math(spark, name, args, expected):
    row = spark.createDataFrame([tuple(args)], [f"a{i}" for i in range(len(args))])
    assert abs(row.select(fm.MATH[name](*[F.col(c) for c in row.columns])).first()[0] - expected) < 1e-9


def test_integers(spark):
    row = spark.range(1)
    one = lambda name, *a: row.select(fm.INTEGER[name](*[F.lit(x).cast("bigint") for x in a])).first()[0]
    assert one("add_sat", 2**31 - 1, 5) == 2**31 - 1
    assert one("hadd", 3, 4) == 3 and one("rhadd", 3, 4) == 4
    assert one("clz", 1) == 31 and one("rotate", 1, 33) == 2 and one("mul_hi", 2**31, 4) == 2


def test_run_stops_and_reads_by_name(spark):
    g = TickGraph(spark, lambda v, _: {"x": v["x"] + 1.0, "y": v["x"] * 2.0}, {"x": Field.of(spark, 0.0)})
    g.actuators.append(Actuator("y", lambda f: g.stop() if float(f.read()) >= 6.0 else None, pipelined=False))
    assert g.run().time == 3 and g.names() == ["x", "y"]
    assert float(g.read("y")) == 6.0 and {k: float(v) for k, v in g.read_all().items()} == {"x": 4.0, "y": 6.0}
    assert g.run(2).time in (4, 5)
    with pytest.raises(Exception, match="no field is named"):
        g.read("z")


def test_functions_of_large_fields(spark, monkeypatch):
    large = FieldType((1 << 17, 64))
    f = Field.constant(spark, large.shape, 1.0)
    user.field_operator([f], lambda x: np.cumsum(x, axis=0), large)
    monkeypatch.setattr(user, "BLOCK", 1 << 14)
    sums = user.field_operator([Field.constant(spark, (512, 64), 1.0)], lambda x: np.cumsum(x, axis=0) / (x.size <= 1 << 13), FieldType((512, 64)), along=0)
    assert np.array_equal(sums.read(), np.arange(1, 513.0)[:, None] * np.ones(64))


def test_functions_of_lines(spark):
    w = np.arange(6.0).reshape(2, 3)
    f = Field.of(spark, w)
    v = np.arange(120.0).reshape(2, 5, 4, 3)
    for along in range(3):
        got = user.field_operator([Field.of(spark, v, 1), Field.of(spark, v[..., 0])], lambda x, y: np.cumsum(x.sum(-1) * y, axis=along), FieldType(v.shape[:3]), along=along)
        assert np.allclose(got.read(), np.cumsum(v.sum(-1) * v[..., 0], axis=along))
    assert np.allclose(user.field_operator([f], lambda x: x[1:, :, None] * np.ones(2), FieldType((1, 3), (2,)), along=0).read(), w[1:, :, None] * np.ones(2))
