"""The operators as methods, indexing, lookups, and what plans cost."""

import numpy as np
from pyspark.sql import functions as F

from tensorfold import api
from tensorfold.functions.lookup import interpolated, interpolated2
from tensorfold.plans.inspect import plan_counts
from tensorfold.sources.tables import from_table

W = np.arange(20.0).reshape(4, 5)


def test_methods_and_indexing(spark):
    f = api.Field.of(spark, W)
    assert np.allclose(f[2].read(), W[2]) and np.allclose(f[1:3, 0:4].read(), W[1:3, :4])
    assert np.allclose(f[api.Field.of(spark, 1.9)].read(), W[1])
    assert np.allclose(f.flip().transpose().read(), W[::-1, ::-1].T)
    assert np.allclose(api.trim_to_real(api.real_to_complex_expand(f, api.ZERO, (8, 8)), (4, 5)).read(), W)
    assert api.is_small_tensor_field(f) and len(api.OPERATORS) > 150


def test_lookups(spark):
    row = spark.createDataFrame([(0.5, 2.5), (-9.0, 9.0)], "x double, y double")
    one, two = interpolated(lambda x: x * x, 0, 4, 401), interpolated2(lambda x, y: x * y, (0, 0), (4, 4))
    got = row.select(one(F.col("y")), two(F.col("x"), F.col("y"))).collect()
    assert abs(got[0][0] - 6.25) < 1e-4 and abs(got[0][1] - 1.25) < 1e-9 and got[1][0] == 16 and got[1][1] == 0


def test_plans(spark):
    f = api.Field.of(spark, W)
    chain = plan_counts(api.sqrt((f * 2.0 + f) * (f > 3.0)))
    assert not [k for k in chain if "Join" in k or "Exchange" in k]
    blurred = plan_counts(api.convolve(f, api.Field.of(spark, np.ones((3, 3))), api.CLAMP))
    assert blurred["HashAggregate"] == 2 and not [k for k in blurred if "Join" in k]
    table = spark.range(10).withColumn("x", F.lit(1.0))
    g = from_table(table, F.col("id"), F.col("x"), (4, 5))
    assert sum(n for k, n in plan_counts(g + g * g).items() if "Join" in k) == 1


def test_large_tables_are_dealt_by_their_number(spark):
    rows = spark.range(1 << 21).select((F.col("id") * 7).alias("k"), F.lit(1.0).alias("x"))
    g = from_table(rows, F.col("k") % (1 << 20), F.col("x"), (1 << 14, 64))
    plan = g.df()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange") == 2
    assert g.df().groupBy("v").count().collect() == [(2.0, 1 << 20)]
