"""A query for each field operator over the test tables, and the SQL that computes the same from the tables.

The fields: ``s`` order prices, rounded to whole numbers, on a grid 64 wide by order key; ``q`` line quantities summed
on the same grid; ``n`` and ``m`` these scaled by powers of two to around [-1/4, 3/4]; ``e`` embeddings by id. Sums
of ``s`` and ``q`` are whole numbers, the same in any order; other results are rounded to 6 digits. NaN comes
out as null. Tensors come out one row for each element, complex numbers as two columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .field import COORDS, Field
from .functions import math as fm
from .functions import user
from .operators import pointwise as p
from .operators import reduce as r
from .operators import shape as sh
from .operators import spectral as sp
from .operators import stencil as st
from .operators import tensor as t
from .sources.tables import from_table, from_vectors
from .streaming import ticks
from .types import CLAMP, COMPLEX, CYCLIC, FULL, VALID, ZERO, FieldType, downsample_output, upsample_input

WIDTH = 64
#: Divides what is transformed: no sum of its values then ends on the half of a digit that results are rounded to.
ODD = 0.7103
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The fields of one folder of tables, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def _keyed(self, table: str, key: str, value: Column) -> Field:
        def shape():
            return (self.table("orders").agg(F.max("o_orderkey")).first()[0] // WIDTH + 1, WIDTH)

        return from_table(self.table(table), F.col(key), value, self._once("shape", shape))

    @property
    def s(self) -> Field:
        return self._once("s", lambda: self._keyed("orders", "o_orderkey", F.rint("o_totalprice")))

    @property
    def q(self) -> Field:
        return self._once("q", lambda: self._keyed("lineitem", "l_orderkey", F.col("l_quantity")))

    @property
    def n(self) -> Field:
        return self._once("n", lambda: self.s / 2.0**19 - 0.25)

    @property
    def m(self) -> Field:
        return self._once("m", lambda: self.q / 2.0**9 - 0.25)

    @property
    def c(self) -> Field:
        return self._once("c", lambda: p.complex_field(self.n, self.m))

    @property
    def e(self) -> Field:
        rows = self._once("vectors", lambda: self.table("embeddings").agg(F.max("vec_id"), F.max(F.size("embedding"))).first())
        return self._once("e", lambda: from_vectors(self.table("embeddings"), F.col("vec_id"), "embedding", (rows[0] + 1,), rows[1]))

    @property
    def pair(self) -> Field:
        """Vectors (s, q)."""
        return self._once("pair", lambda: t.vector_field(self.s, self.q))

    @property
    def square(self) -> Field:
        """2x2 matrices."""
        return self._once("square", lambda: t.matrix_field(self.n, self.m, self.m, self.n + 1.0, rows=2))

    @property
    def color(self) -> Field:
        return self._once("color", lambda: p.color_field(self.s, self.q, self.s + self.q))

    def _wide(self, table: str, key: str, value: Column) -> Field:
        """All keys on a square whose sides are a power of two, the least that holds them; its rest is zero."""

        def side():
            keys = self.table("orders").agg(F.max("o_orderkey")).first()[0] + 1
            return 1 << -(-(keys - 1).bit_length() // 2)

        return from_table(self.table(table), F.col(key), value, (self._once("side", side),) * 2)

    @property
    def wide_n(self) -> Field:
        return self._once("wide_n", lambda: (self._wide("orders", "o_orderkey", F.rint("o_totalprice")) / 2.0**19 - 0.25) / ODD)

    @property
    def wide_m(self) -> Field:
        return self._once("wide_m", lambda: (self._wide("lineitem", "l_orderkey", F.col("l_quantity")) / 2.0**9 - 0.25) / ODD)

    @property
    def wide_c(self) -> Field:
        return self._once("wide_c", lambda: p.complex_field(self.wide_n, self.wide_m))

    @property
    def folded(self) -> Field:
        """All order prices summed onto 32 x 32 points, for operators that take small fields only."""
        return self._once("folded", lambda: from_table(self.table("orders"), F.col("o_orderkey") % 1024, F.rint("o_totalprice"), (32, 32)))


def number(x: Column, digits: int | None) -> Column:
    x = F.when(F.isnan(x), None).otherwise(x)
    return (F.round(x, digits) if digits is not None else x) + 0.0


def rows(f: Field, digits: int | None = 6) -> DataFrame:
    """A field as a table of numbers."""
    df = f.df()
    if f.type.kind == COMPLEX:
        if f.tensor:
            df = df.select(*COORDS, F.posexplode("v").alias("e", "v"))
        return df.select(*[c for c in df.columns if c != "v"], number(F.col("v.re"), digits).alias("re"), number(F.col("v.im"), digits).alias("im"))
    if f.type.kind == "color":
        return df.select(*COORDS, *[number(F.col(f"v.{c}"), digits).alias(c) for c in "rgb"])
    if f.tensor:
        df = df.select(*COORDS, F.posexplode("v").alias("e", "v"))
    return df.withColumn("v", number(F.col("v"), digits))


# ---- SQL of the fields -----------------------------------------------------------------------------------------

_N = f"((SELECT max(o_orderkey) FROM orders) // {WIDTH} + 1)"


def _grid_sql(name: str, table: str, key: str, value: str) -> str:
    return f"""{name} AS (SELECT 0 AS layer, (k // {WIDTH})::INT AS row, (k % {WIDTH})::INT AS col, coalesce(x, 0)::DOUBLE AS v
    FROM (SELECT range AS k FROM range({_N} * {WIDTH})) LEFT JOIN (SELECT {key} AS k, sum({value}) AS x FROM {table} GROUP BY 1) USING (k))"""


FIELDS_SQL = "WITH " + ",\n".join(
    [
        _grid_sql("s", "orders", "o_orderkey", "round_even(o_totalprice, 0)"),
        _grid_sql("q", "lineitem", "l_orderkey", "l_quantity"),
        "n AS (SELECT layer, row, col, v / 524288 - 0.25 AS v FROM s)",
        "m AS (SELECT layer, row, col, v / 512 - 0.25 AS v FROM q)",
        "b AS (SELECT layer, row, col, s.v AS x, q.v AS y FROM s JOIN q USING (layer, row, col))",
        "c AS (SELECT layer, row, col, n.v AS x, m.v AS y FROM n JOIN m USING (layer, row, col))",
        "e AS (SELECT 0 AS layer, 0 AS row, vec_id::INT AS col, embedding::DOUBLE[] AS v FROM embeddings)",
        "el AS (SELECT layer, row, col, i::INT AS e, v[i + 1] AS v, len(v) AS len FROM (SELECT *, unnest(range(len(v))) AS i FROM e))",
        "size AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM s)",
    ]
)
AT = "layer, row, col"


def _round(x: str, digits: int | None) -> str:
    return f"(CASE WHEN isnan(({x})::DOUBLE) THEN NULL ELSE {f'round(({x})::DOUBLE, {digits})' if digits is not None else f'({x})::DOUBLE'} END + 0.0)"


def query(name: str, make: Callable[[Tables], Field | DataFrame], sql: str | None = None, digits: int | None = 6) -> None:
    """Register a query; ``sql`` follows the fields' definitions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(Tables(spark, sf_dir))
        return rows(out, digits) if isinstance(out, Field) else out

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = f"{FIELDS_SQL}\n{sql}"


def scalar(name: str, make, expr: str, source: str = "c", digits: int | None = 6) -> None:
    query(name, make, f"SELECT {AT}, {_round(expr, digits)} AS v FROM {source}", digits)


# ---- pointwise -------------------------------------------------------------------------------------------------

for _name, _make, _sql in (
    ("abs", lambda f: p.abs_(f.n), "abs(x)"),
    ("acos", lambda f: p.acos(f.n), "acos(x)"),
    ("asin", lambda f: p.asin(f.n), "asin(x)"),
    ("acosh", lambda f: p.acosh(f.n + 2.0), "acosh(x + 2)"),
    ("cos", lambda f: p.cos(f.n), "cos(x)"),
    ("cosh", lambda f: p.cosh(f.n), "(exp(x) + exp(-x)) / 2"),
    ("sin", lambda f: p.sin(f.n), "sin(x)"),
    ("sinh", lambda f: p.sinh(f.n), "(exp(x) - exp(-x)) / 2"),
    ("tan", lambda f: p.tan(f.n), "tan(x)"),
    ("tanh", lambda f: p.tanh(f.n), "(exp(2 * x) - 1) / (exp(2 * x) + 1)"),
    ("exp", lambda f: p.exp(f.n), "exp(x)"),
    ("log", lambda f: p.log(f.n), "CASE WHEN x > 0 THEN ln(x) WHEN x = 0 THEN '-inf'::DOUBLE END"),
    ("floor", lambda f: p.floor(f.n * 16.0), "floor(x * 16)"),
    ("signum", lambda f: p.signum(f.n), "sign(x)"),
    ("sq", lambda f: p.sq(f.n), "x * x"),
    ("sqrt", lambda f: p.sqrt(f.n), "CASE WHEN x >= 0 THEN sqrt(x) END"),
    ("reciprocal", lambda f: p.reciprocal(f.n + 2.0), "1 / (x + 2)"),
    ("rectify", lambda f: p.rectify(f.n), "greatest(x, 0)"),
    ("negate", lambda f: -f.n, "-x"),
    ("copy", lambda f: p.copy(f.n), "x"),
    ("pow_int", lambda f: p.power(f.n, 3), "x * x * x"),
    ("pow_float", lambda f: p.power(f.n, 2.5), "CASE WHEN x >= 0 THEN pow(x, 2.5) END"),
    ("max_const", lambda f: p.max_(f.n, 0.1), "greatest(x, 0.1)"),
    ("min_const", lambda f: p.min_(f.n, 0.1), "least(x, 0.1)"),
    ("filter_nan", lambda f: p.filter_nan(p.sqrt(f.n)), "CASE WHEN x >= 0 THEN sqrt(x) ELSE 0 END"),
    ("max_field", lambda f: p.max_(f.n, f.m), "greatest(x, y)"),
    ("min_field", lambda f: p.min_(f.n, f.m), "least(x, y)"),
    ("atan2", lambda f: p.atan2(f.n, f.m), "atan2(x, y)"),
    ("add_field", lambda f: f.n + f.m, "x + y"),
    ("subtract_field", lambda f: f.n - f.m, "x - y"),
    ("multiply_field", lambda f: f.n * f.m, "x * y"),
    ("divide_field", lambda f: f.n / (f.m + 2.0), "x / (y + 2)"),
    ("modulo_field", lambda f: f.n % (f.m + 2.0), "x - (y + 2) * trunc(x / (y + 2))"),
    ("greater_field", lambda f: f.n > f.m, "(x > y)::INT"),
    ("greater_equal_field", lambda f: f.n >= f.m, "(x >= y)::INT"),
    ("less_field", lambda f: f.n < f.m, "(x < y)::INT"),
    ("less_equal_field", lambda f: f.n <= f.m, "(x <= y)::INT"),
    ("equal_field", lambda f: f.n.eq(f.m), "(x = y)::INT"),
    ("not_equal_field", lambda f: f.n.ne(f.m), "(x <> y)::INT"),
    ("add_const", lambda f: f.n + 0.5, "x + 0.5"),
    ("subtract_const", lambda f: f.n - 0.5, "x - 0.5"),
    ("multiply_const", lambda f: f.n * 3.0, "x * 3"),
    ("divide_const", lambda f: f.n / 3.0, "x / 3"),
    ("reverse_divide", lambda f: 3.0 / (f.n + 2.0), "3 / (x + 2)"),
    ("reverse_subtract", lambda f: 3.0 - f.n, "3 - x"),
    ("modulo_const", lambda f: f.n % 0.125, "x - 0.125 * trunc(x / 0.125)"),
    ("greater_const", lambda f: f.n > 0.0, "(x > 0)::INT"),
    ("greater_equal_const", lambda f: f.n >= 0.0, "(x >= 0)::INT"),
    ("less_const", lambda f: f.n < 0.0, "(x < 0)::INT"),
    ("less_equal_const", lambda f: f.n <= 0.0, "(x <= 0)::INT"),
    ("equal_const", lambda f: f.n.eq(-0.25), "(x = -0.25)::INT"),
    ("not_equal_const", lambda f: f.n.ne(-0.25), "(x <> -0.25)::INT"),
    ("real_part", lambda f: p.real_part(f.c), "x"),
    ("imaginary_part", lambda f: p.imaginary_part(f.c), "y"),
    ("phase", lambda f: p.phase(f.c), "atan2(y, x)"),
    ("magnitude", lambda f: p.magnitude(f.c), "sqrt(x * x + y * y)"),
    ("orientation", lambda f: p.orientation(f.c), "CASE WHEN atan2(y, x) > pi() / 2 THEN atan2(y, x) - pi() WHEN atan2(y, x) <= -pi() / 2 THEN atan2(y, x) + pi() ELSE atan2(y, x) END"),
    ("stickness", lambda f: p.stickness(f.c), "sqrt(x * x + y * y)"),
    ("stick_orientation", lambda f: p.stick_orientation(f.c), "atan2(y, x) / 2 + CASE WHEN atan2(y, x) <= 0 THEN pi() ELSE 0 END"),
    ("ballness", lambda f: p.stickness_ballness_orientation(t.vector_field(f.n + 4.0, f.m, f.n))[1], "(2 * x + 4 - CASE WHEN (2 * x + 4) * (2 * x + 4) >= 4 * ((x + 4) * x + y * y) THEN sqrt((2 * x + 4) * (2 * x + 4) - 4 * ((x + 4) * x + y * y)) END) / 2"),
    ("user_point_operator", lambda f: user.point_operator([f.n, f.m], lambda x, y: F.when(x > y, x * 2).otherwise(y), FieldType(f.n.shape)), "CASE WHEN x > y THEN x * 2 ELSE y END"),
    ("math_functions", lambda f: user.point_operator([f.n, f.m], lambda x, y: fm.MATH["fma"](x, y, F.lit(1.0)) + fm.MATH["copysign"](x, y) + fm.MATH["trunc"](x * 8) + fm.RELATIONAL["islessgreater"](x, y), FieldType(f.n.shape)), "x * y + 1 + CASE WHEN y < 0 THEN -abs(x) ELSE abs(x) END + trunc(x * 8) + (x <> y)::INT"),
):
    scalar(_name, _make, _sql)


def complex_query(name: str, make, re: str, im: str, source: str = "c") -> None:
    query(name, make, f"SELECT {AT}, {_round(re, 6)} AS re, {_round(im, 6)} AS im FROM {source}")


for _name, _make, _re, _im in (
    ("real_to_complex", lambda f: p.complex_field(f.n), "x", "0"),
    ("complex", lambda f: p.complex_field(f.n, f.m), "x", "y"),
    ("polar_complex", lambda f: p.polar_complex(f.n, f.m), "x * cos(y)", "x * sin(y)"),
    ("conjugate", lambda f: p.conjugate(f.c), "x", "-y"),
    ("complex_exp", lambda f: p.exp(f.c), "exp(x) * cos(y)", "exp(x) * sin(y)"),
    ("complex_reciprocal", lambda f: p.reciprocal(f.c + 2.0), "(x + 2) / ((x + 2) * (x + 2) + y * y)", "-y / ((x + 2) * (x + 2) + y * y)"),
    ("complex_negate", lambda f: -f.c, "-x", "-y"),
    ("add_complex", lambda f: f.n + (1 + 2j), "x + 1", "2"),
    ("subtract_complex", lambda f: f.n - (1 + 2j), "x - 1", "-2"),
    ("multiply_complex", lambda f: f.c * (1 + 2j), "x - 2 * y", "2 * x + y"),
    ("divide_complex", lambda f: f.c / (1 + 2j), "(x + 2 * y) / 5", "(y - 2 * x) / 5"),
    ("multiply_complex_fields", lambda f: f.c * f.c, "x * x - y * y", "2 * x * y"),
):
    complex_query(_name, _make, _re, _im)

# ---- reductions ------------------------------------------------------------------------------------------------

_ZERO_AT = "0 AS layer, 0 AS row, 0 AS col"
query("field_reduce_sum", lambda f: r.field_reduce_sum(f.s), f"SELECT {_ZERO_AT}, sum(v) + 0.0 AS v FROM s", None)
query("field_reduce_min", lambda f: r.field_reduce_min(f.s), f"SELECT {_ZERO_AT}, min(v) + 0.0 AS v FROM s", None)
query("field_reduce_max", lambda f: r.field_reduce_max(f.s), f"SELECT {_ZERO_AT}, max(v) + 0.0 AS v FROM s", None)
query("field_reduce_median", lambda f: r.field_reduce_median(f.s), f"SELECT {_ZERO_AT}, median(v) + 0.0 AS v FROM s", None)
query("max_position", lambda f: r.max_position(f.s), f"SELECT {_ZERO_AT}, e, (CASE e WHEN 0 THEN row ELSE col END) + 0.0::DOUBLE AS v FROM (SELECT * FROM s ORDER BY v DESC, row, col LIMIT 1), (VALUES (0), (1)) t(e)", None)
query("winner_take_all", lambda f: r.winner_take_all(f.s), f"SELECT {AT}, (row_number() OVER (ORDER BY v DESC, row, col) = 1)::INT + 0.0::DOUBLE AS v FROM s", None)
query("normalize_l1", lambda f: r.normalize_l1(f.s) * 1e6, f"SELECT {AT}, {_round('v / (SELECT sum(v) FROM s) * 1e6', 6)} AS v FROM s")
query("normalize_l2", lambda f: r.normalize_l2(f.s) * 1e9, f"SELECT {AT}, {_round('v / (SELECT sum(v * v) FROM s) * 1e9', 6)} AS v FROM s")
query("minus_mean", lambda f: f.s - r.field_reduce_sum(f.s) / float(f.s.type.points), f"SELECT {AT}, {_round('v - (SELECT sum(v) / count(*) FROM s)', 4)} AS v FROM s", 4)

# ---- shape -----------------------------------------------------------------------------------------------------


def shaped(name: str, make, sql: str) -> None:
    query(name, make, f"SELECT layer::INT AS layer, row::INT AS row, col::INT AS col, v + 0.0 AS v FROM ({sql})", None)


shaped("window", lambda f: sh.window(f.s, range(2, 9), range(3, 50)), "SELECT layer, row - 2 AS row, col - 3 AS col, v FROM s WHERE row BETWEEN 2 AND 8 AND col BETWEEN 3 AND 49")
shaped("slice", lambda f: sh.slice_at(f.s, 3), "SELECT layer, 0 AS row, col, v FROM s WHERE row = 3")
shaped("slice_point", lambda f: sh.slice_point(f.s, r.field_reduce_max(f.q) / 100.0), "SELECT layer, 0 AS row, col, v FROM s WHERE row = (SELECT least(trunc(max(v) / 100), (SELECT h - 1 FROM size)) FROM q)")
shaped("trim", lambda f: sh.trim(f.s, (5, 7)), "SELECT * FROM s WHERE row < 5 AND col < 7")
shaped("flip", lambda f: sh.flip(f.s), "SELECT layer, h - 1 - row AS row, w - 1 - col AS col, v FROM s, size")
shaped("shift", lambda f: sh.shift(f.s, 2, -3), "SELECT o.layer, o.row, o.col, coalesce(x.v, 0) AS v FROM s o LEFT JOIN s x ON x.row = o.row - 2 AND x.col = o.col + 3")
shaped("shift_cyclic", lambda f: sh.shift_cyclic(f.s, 2, -3), "SELECT layer, (row + 2) % h AS row, (col - 3 + w) % w AS col, v FROM s, size")
shaped("transpose", lambda f: sh.transpose(f.s), "SELECT layer, col AS row, row AS col, v FROM s")
shaped("reshape", lambda f: sh.reshape(f.s, (f.s.shape[0] * 4, 4, 4)), f"SELECT i // 16 AS layer, i // 4 % 4 AS row, i % 4 AS col, v FROM (SELECT row * {WIDTH} + col AS i, v FROM s)")
shaped("downsample", lambda f: sh.downsample(f.s, 3, 1), "SELECT layer, (row - 1) // 3 AS row, (col - 1) // 3 AS col, v FROM s WHERE row % 3 = 1 AND col % 3 = 1")
shaped("upsample", lambda f: sh.upsample(f.s, 2, 1), "SELECT layer, row * 2 + i AS row, col * 2 + j AS col, CASE WHEN i = 1 AND j = 1 THEN v ELSE 0 END AS v FROM s, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)")
shaped("supersample", lambda f: sh.supersample(f.s), "SELECT layer, row * 2 + i AS row, col * 2 + j AS col, v FROM s, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)")
_BIG = "(SELECT a.range AS row, b.range AS col FROM range((SELECT h + 5 FROM size)) a, range((SELECT w + 7 FROM size)) b)"
shaped("expand_zero", lambda f: sh.expand(f.s, ZERO, (f.s.shape[0] + 5, f.s.shape[1] + 7)), f"SELECT 0 AS layer, o.row, o.col, coalesce(s.v, 0) AS v FROM {_BIG} o LEFT JOIN s USING (row, col)")
shaped("expand_clamp", lambda f: sh.expand(f.s, CLAMP, (f.s.shape[0] + 5, f.s.shape[1] + 7)), f"SELECT 0 AS layer, o.row, o.col, s.v FROM {_BIG} o, size, s WHERE s.row = CASE WHEN o.row >= h + 2 THEN 0 ELSE least(o.row, h - 1) END AND s.col = CASE WHEN o.col >= w + 3 THEN 0 ELSE least(o.col, w - 1) END")
shaped("expand_cyclic", lambda f: sh.expand(f.s, CYCLIC, (f.s.shape[0] + 5, f.s.shape[1] + 7)), f"SELECT 0 AS layer, o.row, o.col, s.v FROM {_BIG} o, size, s WHERE s.row = CASE WHEN o.row >= h + 2 THEN (o.row - 5 + h - h) % h ELSE o.row % h END AND s.col = CASE WHEN o.col >= w + 3 THEN (o.col - 7 + w - w) % w ELSE o.col % w END")
shaped("stack", lambda f: sh.stack(f.s, f.q), "SELECT 0 AS layer, row, col, v FROM s UNION ALL SELECT 1, row, col, v FROM q")
shaped("join_fields", lambda f: sh.join(f.s, f.q), "SELECT layer, row, col, v FROM s UNION ALL SELECT layer, row + h, col, v FROM q, size")
shaped("push", lambda f: sh.push(f.s, sh.slice_at(f.q, 0)), "SELECT layer, row + 1 AS row, col, v FROM s, size WHERE row < h - 1 UNION ALL SELECT layer, 0, col, v FROM q WHERE row = 0")
shaped("outer_product", lambda f: sh.outer(sh.slice_at(f.s, 1), sh.slice_at(f.q, 2)), "SELECT 0 AS layer, a.col AS row, b.col AS col, a.v * b.v AS v FROM s a, q b WHERE a.row = 1 AND b.row = 2")
shaped("select_first", lambda f: sh.select([f.s, f.q], r.field_reduce_max(f.q) * 0.0), "SELECT * FROM s")
shaped("select", lambda f: sh.select([f.s, f.q], r.field_reduce_max(f.q) * 0.0 + 1.0), "SELECT * FROM q")
shaped("warp", lambda f: st.warp(f.s, Field.of(f.spark, [1.5, 0.5], 1), CLAMP), "SELECT o.layer, o.row, o.col, sum(x.v * 0.25) AS v FROM s o, size, (VALUES (-2), (-1)) a(i), (VALUES (-1), (0)) b(j), s x WHERE x.row = least(greatest(o.row + i, 0), h - 1) AND x.col = least(greatest(o.col + j, 0), w - 1) GROUP BY o.layer, o.row, o.col")
shaped("subfield", lambda f: st.subfield(f.s, Field.of(f.spark, [1.5, -0.5], 1), (6, 9), ZERO), "SELECT 0 AS layer, o.row, o.col, coalesce(sum(x.v * 0.25), 0) AS v FROM (SELECT row, col FROM s WHERE row < 6 AND col < 9) o CROSS JOIN (VALUES (1), (2)) a(i) CROSS JOIN (VALUES (-1), (0)) b(j) LEFT JOIN s x ON x.row = o.row + i AND x.col = o.col + j GROUP BY o.row, o.col")
_FOLDED = ", folded AS (SELECT (k // 32)::INT AS row, (k % 32)::INT AS col, coalesce(x, 0)::DOUBLE AS v FROM (SELECT range AS k FROM range(1024)) LEFT JOIN (SELECT o_orderkey % 1024 AS k, sum(round_even(o_totalprice, 0)) AS x FROM orders GROUP BY 1) USING (k))"
query("subfields", lambda f: st.subfields(f.folded, 3), f"{_FOLDED} SELECT 0 AS layer, (x.row - i)::INT AS row, (x.col - j)::INT AS col, (i * 30 + j)::INT AS e, v + 0.0 AS v FROM folded x, (SELECT range AS i FROM range(30)), (SELECT range AS j FROM range(30)) WHERE x.row - i BETWEEN 0 AND 2 AND x.col - j BETWEEN 0 AND 2", None)
query("replicate", lambda f: t.replicate(f.folded, (4, 5)), f"{_FOLDED} SELECT 0 AS layer, a.range::INT AS row, b.range::INT AS col, (x.row * 32 + x.col)::INT AS e, v + 0.0 AS v FROM range(4) a, range(5) b, folded x", None)
query("casts", lambda f: p.to_vector_field(p.to_color_field(f.color)), f"SELECT {AT}, e, (CASE e WHEN 0 THEN x WHEN 1 THEN y ELSE x + y END) + 0.0 AS v FROM b, (VALUES (0), (1), (2)) t(e)", None)

# ---- tensors ---------------------------------------------------------------------------------------------------

for _name, _make, _agg in (("sum", t.reduce_sum, "list_sum(v)"), ("min", t.reduce_min, "list_min(v)"), ("max", t.reduce_max, "list_max(v)")):
    query(f"reduce_{_name}", lambda f, g=_make: g(f.e), f"SELECT {AT}, {_round(_agg, 6)} AS v FROM e")
for _name, _make in (("sum", t.block_reduce_sum), ("min", t.block_reduce_min), ("max", t.block_reduce_max)):
    query(f"block_reduce_{_name}", lambda f, g=_make: g(f.e, 8), f"SELECT {AT}, (e // 8)::INT AS e, {_round(f'{_name}(v)', 6)} AS v FROM el GROUP BY {AT}, e // 8")
query("vector_element", lambda f: t.vector_element(f.e, 5), f"SELECT {AT}, {_round('v[6]', 6)} AS v FROM e")
query("vector_elements", lambda f: t.vector_elements(f.e, Field.of(f.spark, [3.0, 99.0, 0.0], 1)), f"SELECT {AT}, i AS e, {_round('coalesce(v[k + 1], CAST(NULL AS DOUBLE))', 6)} AS v FROM e, (VALUES (0, 3), (1, 99), (2, 0)) t(i, k)")
query("vector_field", lambda f: f.pair, f"SELECT {AT}, e, (CASE e WHEN 0 THEN x ELSE y END) + 0.0 AS v FROM b, (VALUES (0), (1)) t(e)", None)
query("complex_vector_field", lambda f: t.complex_vector_field(f.c, p.conjugate(f.c)), f"SELECT {AT}, e, {_round('x', 6)} AS re, {_round('CASE e WHEN 0 THEN y ELSE -y END', 6)} AS im FROM c, (VALUES (0), (1)) t(e)")
query("matrix_field", lambda f: t.matrix_field(f.pair, f.pair), f"SELECT {AT}, e, (CASE WHEN e % 2 = 0 THEN x ELSE y END) + 0.0 AS v FROM b, (VALUES (0), (1), (2), (3)) t(e)", None)
query("matrix_row", lambda f: t.matrix_row(f.square, 1), f"SELECT {AT}, e, {_round('CASE e WHEN 0 THEN y ELSE x + 1 END', 6)} AS v FROM c, (VALUES (0), (1)) t(e)")
query("transpose_matrices", lambda f: t.transpose_matrices(t.matrix_field(f.n, f.m, f.n, f.n, f.n, f.m, rows=2)), f"SELECT {AT}, e, {_round('CASE WHEN e IN (2, 5) THEN y ELSE x END', 6)} AS v FROM c, (VALUES (0), (1), (2), (3), (4), (5)) t(e)")
query("transpose_vectors", lambda f: t.transpose_vectors(f.pair), f"SELECT {AT}, e, (CASE e WHEN 0 THEN x ELSE y END) + 0.0 AS v FROM b, (VALUES (0), (1)) t(e)", None)
query("dot", lambda f: t.dot(f.e, f.e), f"SELECT {AT}, {_round('sum(v * v)', 6)} AS v FROM el GROUP BY {AT}")
query("cross_dot", lambda f: t.cross_dot(f.e, sh.slice_at(sh.window(f.q, range(1), range(f.e.tensor[0])), 0)), f"SELECT el.layer, el.row, el.col, {_round('sum(el.v * q.v)', 6)} AS v FROM el JOIN q ON q.row = 0 AND q.col = el.e GROUP BY el.layer, el.row, el.col")
query("reverse_cross_dot", lambda f: t.reverse_cross_dot(f.pair, f.q), f"SELECT 0 AS layer, 0 AS row, e AS col, sum(CASE e WHEN 0 THEN x * y ELSE y * y END) + 0.0 AS v FROM b, (VALUES (0), (1)) t(e) GROUP BY e", None)
query("transform_vector", lambda f: t.transform(f.square, t.vector_field(f.n, f.m)), f"SELECT {AT}, e, {_round('CASE e WHEN 0 THEN x * x + y * y ELSE y * x + (x + 1) * y END', 6)} AS v FROM c, (VALUES (0), (1)) t(e)")
query("transform_matrix", lambda f: t.transform(f.square, f.square, transpose_b=True), f"SELECT {AT}, e, {_round('CASE e WHEN 0 THEN x * x + y * y WHEN 3 THEN y * y + (x + 1) * (x + 1) ELSE x * y + y * (x + 1) END', 6)} AS v FROM c, (VALUES (0), (1), (2), (3)) t(e)")
query("invert_matrices", lambda f: t.invert_matrices(t.matrix_field(f.n + 3.0, f.m, f.m, f.n + 3.0, rows=2)), f"SELECT {AT}, e, {_round('CASE WHEN e IN (0, 3) THEN x + 3 ELSE -y END / ((x + 3) * (x + 3) - y * y)', 6)} AS v FROM c, (VALUES (0), (1), (2), (3)) t(e)")
query("invert_matrices_3x3", lambda f: t.invert_matrices(t.matrix_field(f.n + 3.0, f.m, f.m, f.m, f.n + 3.0, f.m, f.m, f.m, f.n + 3.0, rows=3)), f"SELECT {AT}, e, {_round('CASE WHEN e % 4 = 0 THEN x + 3 + y ELSE -y END / ((x + 3 - y) * (x + 3 + 2 * y))', 6)} AS v FROM c, (SELECT range::INT AS e FROM range(9)) t")
query("solve", lambda f: t.solve(t.matrix_field(f.n + 3.0, f.m, f.m, f.n + 3.0, rows=2), t.vector_field(f.n, f.m)), f"SELECT {AT}, e, {_round('CASE e WHEN 0 THEN (x + 3) * x - y * y ELSE (x + 3) * y - y * x END / ((x + 3) * (x + 3) - y * y + 0.00000001)', 6)} AS v FROM c, (VALUES (0), (1)) t(e)")
scalar("determinant", lambda f: t.determinant(f.square), "x * (x + 1) - y * y")
scalar("condition_number", lambda f: t.condition_number(t.matrix_field(f.n + 3.0, f.m, f.m, f.n + 3.0, rows=2)), "abs(((2 * x + 6) + sqrt((2 * x + 6) * (2 * x + 6) + 4 * ((x + 3) * (x + 3) - y * y))) / 2 / (((2 * x + 6) - sqrt((2 * x + 6) * (2 * x + 6) + 4 * ((x + 3) * (x + 3) - y * y))) / 2 + 0.0000001))", digits=4)
query("vector_reduce_sum_field", lambda f: r.field_reduce_sum(f.pair), f"SELECT {_ZERO_AT}, e, sum(CASE e WHEN 0 THEN x ELSE y END) + 0.0 AS v FROM b, (VALUES (0), (1)) t(e) GROUP BY e", None)

# ---- color -----------------------------------------------------------------------------------------------------

for _name, _make, _sql in (("red", p.red, "x"), ("green", p.green, "y"), ("blue", p.blue, "x + y"), ("luminance", p.luminance, "0.3811 * x + 0.5783 * y + 0.0402 * (x + y)")):
    scalar(_name, lambda f, g=_make: g(f.color), _sql, "b", 4)
query("color_field", lambda f: f.color, f"SELECT {AT}, x + 0.0 AS r, y + 0.0 AS g, x + y + 0.0 AS b FROM b", None)
query("color_arithmetic", lambda f: f.color * 2.0 + f.color, f"SELECT {AT}, x * 3 + 0.0 AS r, y * 3 + 0.0 AS g, (x + y) * 3 + 0.0 AS b FROM b", None)
query("vector_to_color", lambda f: p.color_field(t.vector_field(f.s, f.q, f.s)), f"SELECT {AT}, x + 0.0 AS r, y + 0.0 AS g, x + 0.0 AS b FROM b", None)

# ---- neighbourhoods --------------------------------------------------------------------------------------------

KERNEL = np.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 10.0]])
_BORDERS = {
    CLAMP: ("least(greatest({x}, 0), {n} - 1)", "JOIN"),
    CYCLIC: ("({x} + {n}) % {n}", "JOIN"),
    ZERO: ("{x}", "LEFT JOIN"),
}


def taps_sql(taps: list[tuple[int, int, float]], border: str, agg: str, source: str = "s", rows_sql: str | None = None) -> str:
    """The aggregate ``agg`` of x.v, tap t.k and weight t.wt over each point's neighbours."""
    place, join = _BORDERS[border]
    at = f"x.row = {place.format(x='o.row + t.dr', n='h')} AND x.col = {place.format(x='o.col + t.dc', n='w')}"
    values = ", ".join(f"({k}, {dr}, {dc}, {float(w)}::DOUBLE)" for k, (dr, dc, w) in enumerate(taps))
    return f"SELECT o.layer, o.row, o.col, {agg} AS v FROM {rows_sql or source} o CROSS JOIN size CROSS JOIN (VALUES {values}) t(k, dr, dc, wt) {join} {source} x ON {at} GROUP BY o.layer, o.row, o.col"


def square(weights, flip: bool = False) -> list[tuple[int, int, float]]:
    w = np.asarray(weights)
    h = [n // 2 for n in w.shape]
    return [(a - h[0], b - h[1], w[::-1, ::-1][a, b] if flip else w[a, b]) for a in range(w.shape[0]) for b in range(w.shape[1])]


_SUM = "coalesce(sum(x.v * t.wt), 0)"
_ONES = np.ones((3, 3))
for _border in (CLAMP, CYCLIC, ZERO):
    shaped(f"convolve_{_border}", lambda f, b=_border: st.convolve(f.s, Field.of(f.spark, KERNEL), b), taps_sql(square(KERNEL, True), _border, _SUM))
    shaped(f"cross_correlate_{_border}", lambda f, b=_border: st.cross_correlate(f.s, Field.of(f.spark, KERNEL), b), taps_sql(square(KERNEL), _border, _SUM))
shaped("convolve_valid", lambda f: st.convolve(f.s, Field.of(f.spark, KERNEL), VALID), f"SELECT layer, row - 1 AS row, col - 1 AS col, v FROM ({taps_sql(square(KERNEL, True), ZERO, _SUM)}), size WHERE row BETWEEN 1 AND h - 2 AND col BETWEEN 1 AND w - 2")
shaped("convolve_full", lambda f: st.convolve(f.s, Field.of(f.spark, KERNEL), FULL), taps_sql([(a - 2, b - 2, w) for (a, b, w) in [(x + 1, y + 1, z) for x, y, z in square(KERNEL, True)]], ZERO, _SUM, rows_sql="(SELECT 0 AS layer, a.range AS row, b.range AS col FROM range((SELECT h + 2 FROM size)) a, range((SELECT w + 2 FROM size)) b)"))
shaped("convolve_downsampled", lambda f: st.convolve(f.s, Field.of(f.spark, KERNEL), ZERO, downsample_output(2)), f"SELECT layer, row // 2 AS row, col // 2 AS col, v FROM ({taps_sql(square(KERNEL, True), ZERO, _SUM)}) WHERE row % 2 = 0 AND col % 2 = 0")
shaped("convolve_upsampled", lambda f: st.convolve(f.s, Field.of(f.spark, KERNEL), ZERO, upsample_input(2)), "SELECT o.layer, o.row, o.col, coalesce(sum(x.v * t.w), 0) AS v FROM (SELECT layer, row * 2 + i AS row, col * 2 + j AS col FROM s, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) o CROSS JOIN (VALUES " + ", ".join(f"({a}, {b}, {w}::DOUBLE)" for a, b, w in square(KERNEL, True)) + ") t(dr, dc, w) LEFT JOIN s x ON x.row * 2 = o.row + t.dr AND x.col * 2 = o.col + t.dc GROUP BY o.layer, o.row, o.col")
shaped("convolve_dynamic", lambda f: st.convolve(f.s, sh.trim(f.q, (3, 3)), CLAMP), "SELECT o.layer, o.row, o.col, sum(x.v * t.v) AS v FROM s o, size, q t, s x WHERE t.row < 3 AND t.col < 3 AND x.row = least(greatest(o.row + 1 - t.row, 0), h - 1) AND x.col = least(greatest(o.col + 1 - t.col, 0), w - 1) GROUP BY o.layer, o.row, o.col")
_ROWS, _COLS = np.array([1.0, 2.0, 3.0]), np.array([4.0, 5.0, 7.0])
shaped("convolve_separable", lambda f: st.convolve_separable(f.s, Field.of(f.spark, _ROWS), Field.of(f.spark, _COLS), CLAMP), taps_sql(square(np.outer(_COLS, _ROWS), True), CLAMP, _SUM))
shaped("cross_correlate_separable", lambda f: st.cross_correlate_separable(f.s, Field.of(f.spark, _ROWS), Field.of(f.spark, _COLS), CYCLIC), taps_sql(square(np.outer(_COLS, _ROWS)), CYCLIC, _SUM))


def planes(name: str, make, sums: list[str]) -> None:
    """A vector convolution with 1x1 filters: each plane's sum in terms of x and y."""
    cases = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(sums))
    query(name, make, f"SELECT {AT}, e, (CASE e {cases} END) + 0.0 AS v FROM b, (VALUES {', '.join(f'({i})' for i in range(len(sums)))}) t(e)", None)


def planes_3x3(name: str, make, used: list[list[tuple[int, np.ndarray, bool]]]) -> None:
    """A vector convolution with 3x3 filters and a zero border: for each plane, which of x and y is summed with which
    filter, and whether that is turned around."""
    taps = [(e, image, a, b, w) for e, parts in enumerate(used) for image, filter_, flip in parts for a, b, w in square(filter_, flip)]
    values = ", ".join(f"({e}, {image}, {a}, {b}, {w}::DOUBLE)" for e, image, a, b, w in taps)
    query(name, make, f"SELECT o.layer, o.row, o.col, t.e, coalesce(sum(CASE t.p WHEN 0 THEN x.x ELSE x.y END * t.w), 0) + 0.0 AS v FROM b o CROSS JOIN (VALUES {values}) t(e, p, dr, dc, w) LEFT JOIN b x ON x.row = o.row + t.dr AND x.col = o.col + t.dc GROUP BY ALL", None)


_F = [np.arange(1.0, 10).reshape(3, 3) * k + np.eye(3) for k in (1, 2, 3, 5)]
_pair_of = lambda f, *filters: Field.of(f.spark, np.stack(filters, axis=-1), 1)
planes_3x3("convolve_vectors_3x3", lambda f: st.convolve(f.pair, _pair_of(f, _F[0], _F[1]), ZERO), [[(0, _F[0], True)], [(1, _F[1], True)]])
planes_3x3("project_frame_3x3", lambda f: st.project_frame(f.pair, _pair_of(f, *_F), ZERO), [[(i % 2, _F[i], False)] for i in range(4)])
planes_3x3("project_frame_sum_3x3", lambda f: st.project_frame_block_reduce_sum(f.pair, _pair_of(f, *_F), ZERO), [[(0, _F[0], False), (1, _F[1], False)], [(0, _F[2], False), (1, _F[3], False)]])
planes_3x3("back_project_frame_3x3", lambda f: st.back_project_frame(f.pair, _pair_of(f, *_F), ZERO), [[(0, _F[0], True)], [(1, _F[2], True)], [(0, _F[1], True)], [(1, _F[3], True)]])
planes_3x3("back_project_frame_sum_3x3", lambda f: st.back_project_frame_block_reduce_sum(f.pair, _pair_of(f, *_F), ZERO), [[(0, _F[0], True), (1, _F[2], True)], [(0, _F[1], True), (1, _F[3], True)]])
_BANK = np.array([[[2.0, 3.0, 5.0, 7.0]]])
planes("convolve_vectors", lambda f: st.convolve(f.pair, Field.of(f.spark, [[[2.0, 3.0]]], 1), ZERO), ["2 * x", "3 * y"])
planes("project_frame", lambda f: st.project_frame(f.pair, Field.of(f.spark, _BANK, 1)), ["2 * x", "3 * y", "5 * x", "7 * y"])
planes("project_frame_sum", lambda f: st.project_frame_block_reduce_sum(f.pair, Field.of(f.spark, _BANK, 1)), ["2 * x + 3 * y", "5 * x + 7 * y"])
planes("back_project_frame", lambda f: st.back_project_frame(f.pair, Field.of(f.spark, _BANK, 1)), ["2 * x", "5 * y", "3 * x", "7 * y"])
planes("back_project_frame_sum", lambda f: st.back_project_frame_block_reduce_sum(f.pair, Field.of(f.spark, _BANK, 1)), ["2 * x + 5 * y", "3 * x + 7 * y"])
planes("convolve_filter_adjoint", lambda f: st.convolve_filter_adjoint(f.pair, Field.of(f.spark, [[[2.0, 3.0]]], 1)), ["2 * x", "2 * y", "3 * x", "3 * y"])
planes("cross_correlate_filter_adjoint", lambda f: st.cross_correlate_filter_adjoint(f.pair, Field.of(f.spark, [[[2.0, 3.0]]], 1), batch=2), ["2 * x", "3 * y"])
planes("matrix_filters", lambda f: st.cross_correlate(f.s, Field.of(f.spark, [[[2.0]], [[3.0]]], 2)), ["2 * x", "3 * x"])
shaped("median_filter", lambda f: st.median_filter(f.s), taps_sql(square(_ONES), CLAMP, "median(x.v)"))
query("convolve_color", lambda f: st.convolve(f.color, Field.of(f.spark, KERNEL), CLAMP), f"SELECT layer, row, col, v.r + 0.0 AS r, v.g + 0.0 AS g, v.b + 0.0 AS b FROM ({taps_sql(square(KERNEL, True), CLAMP, '{r: sum(x.x * t.wt), g: sum(x.y * t.wt), b: sum((x.x + x.y) * t.wt)}', 'b')})", None)
_MASK = np.array([[1, 1, 0], [1, 1, 1], [0, 1, 1]])
_MASKED = [x for x in square(_MASK) if x[2]]
shaped("local_max", lambda f: st.local_max(f.s, _MASK), taps_sql(_MASKED, CLAMP, "max(x.v)"))
shaped("local_min", lambda f: st.local_min(f.s, _MASK), taps_sql(_MASKED, CLAMP, "min(x.v)"))
for _name, _make, _order in (("max", st.local_max_position, "-x.v"), ("min", st.local_min_position, "x.v")):
    query(f"local_{_name}_position", lambda f, g=_make: g(f.s, _MASK), f"SELECT layer, row, col, e, (CASE e WHEN 0 THEN v.dr ELSE v.dc END) + 0.0::DOUBLE AS v FROM ({taps_sql(_MASKED, ZERO, f'min_by({{dr: t.dr, dc: t.dc}}, ({_order}, t.k)) FILTER (x.v IS NOT NULL)')}), (VALUES (0), (1)) t(e)", None)
shaped("non_maximum_suppression", lambda f: st.non_maximum_suppression(f.s), taps_sql(square(_ONES), ZERO, "CASE WHEN max(CASE WHEN t.k = 4 THEN x.v END) >= max(CASE WHEN t.k <> 4 THEN x.v END) THEN max(CASE WHEN t.k = 4 THEN x.v END) ELSE 0 END"))
query("oriented_non_maximum_suppression", lambda f: st.oriented_non_maximum_suppression(f.n, f.m))
for _name, _make, _taps, _row, _col, _cover in (
    ("forward_gradient", st.forward_gradient, [(0, 0, 1), (1, 0, 1), (0, 1, 1)], (-1, 1, 0), (-1, 0, 1), "row < h - 1 AND col < w - 1"),
    ("backward_gradient", st.backward_gradient, [(0, 0, 1), (-1, 0, 1), (0, -1, 1)], (1, -1, 0), (1, 0, -1), "row > 0 AND col > 0"),
    ("central_gradient", st.central_gradient, [(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1)], (-0.5, 0.5, 0, 0), (0, 0, -0.5, 0.5), "true"),
):
    _lists = [f"sum(x.v * [{', '.join(f'{w}::DOUBLE' for w in ws)}][t.k + 1])" for ws in (_row, _col)]
    query(_name, lambda f, g=_make: g(f.s), f"SELECT layer, row, col, e, CASE WHEN {_cover} THEN CASE e WHEN 0 THEN v.a ELSE v.b END ELSE 0 END + 0.0 AS v FROM ({taps_sql(_taps, CLAMP if _cover == 'true' else ZERO, f'{{a: {_lists[0]}, b: {_lists[1]}}}')}), size, (VALUES (0), (1)) t(e)", None)
shaped("backward_divergence", lambda f: st.backward_divergence(f.pair), "SELECT o.layer, o.row, o.col, CASE WHEN o.row = h - 1 OR o.col = w - 1 THEN 0 ELSE o.x + o.y END - CASE WHEN o.col = w - 1 THEN 0 ELSE coalesce(u.x, 0) END - CASE WHEN o.row = h - 1 THEN 0 ELSE coalesce(l.y, 0) END AS v FROM b o CROSS JOIN size LEFT JOIN b u ON u.row = o.row - 1 AND u.col = o.col LEFT JOIN b l ON l.row = o.row AND l.col = o.col - 1")
query("bilateral_filter", lambda f: st.bilateral_filter(f.n, _ONES, 0.5), f"SELECT layer, row, col, {_round('v', 6)} AS v FROM (SELECT o.layer, o.row, o.col, sum(exp(-(o.v - x.v) * (o.v - x.v) / 0.25) * x.v) / sum(exp(-(o.v - x.v) * (o.v - x.v) / 0.25)) AS v FROM n o, size, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j), n x WHERE x.row = least(greatest(o.row + i, 0), h - 1) AND x.col = least(greatest(o.col + j, 0), w - 1) GROUP BY o.layer, o.row, o.col)")
_SPATIAL = np.array([[1.0, 2.0, 3.0], [4.0, 8.0, 5.0], [2.0, 6.0, 1.0]])
query("bilateral_filter_spatial", lambda f: st.bilateral_filter(f.n, _SPATIAL, 0.5), f"SELECT layer, row, col, {_round('v.x / v.w', 6)} AS v FROM ({taps_sql(square(_SPATIAL), CLAMP, '{x: sum(t.wt * exp(-(o.v - x.v) * (o.v - x.v) / 0.25) * x.v), w: sum(t.wt * exp(-(o.v - x.v) * (o.v - x.v) / 0.25))}', 'n')})")
shaped("domain_transform_rows", lambda f: st.domain_transform_rows(f.s, 2.0, 1.0), "SELECT layer, row, col, sum(1 + 2 * abs(v - p)) OVER (PARTITION BY row ORDER BY col) AS v FROM (SELECT *, coalesce(lag(v) OVER (PARTITION BY row ORDER BY col), v) AS p FROM s)")
_DOMAIN = "d AS (SELECT layer, row, col, sum(1 + abs(v - p)) OVER (PARTITION BY row ORDER BY col) AS d FROM (SELECT *, coalesce(lag(v) OVER (PARTITION BY row ORDER BY col), v) AS p FROM q))"
query("domain_filter_rows", lambda f: st.domain_filter_rows(f.s, st.domain_transform_rows(f.q, 1.0, 1.0), 50.0), f", {_DOMAIN} SELECT layer, row, col, {_round('avg(v) OVER (PARTITION BY row ORDER BY d RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING)', 4)} AS v FROM s JOIN d USING (layer, row, col)", 4)
query("domain_filter_columns", lambda f: st.domain_filter_columns(f.s, st.domain_transform_rows(sh.transpose(f.q), 1.0, 1.0), 50.0), f", {_DOMAIN.replace('PARTITION BY row ORDER BY col', 'PARTITION BY col ORDER BY row')} SELECT layer, row, col, {_round('avg(v) OVER (PARTITION BY col ORDER BY d RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING)', 4)} AS v FROM s JOIN d USING (layer, row, col)", 4)
query("canny", lambda f: st.canny(f.s), f"SELECT layer, row, col, {_round('sqrt(v.a * v.a + v.b * v.b)', 4)} AS v FROM ({taps_sql(square(_ONES), CLAMP, '{a: sum(x.v * [-1, 0, 1, -2, 0, 2, -1, 0, 1][t.k + 1]), b: sum(x.v * [-1, -2, -1, 0, 0, 0, 1, 2, 1][t.k + 1])}')})", 4)


def _bits(f: Tables) -> Field:
    return t.vector_field(f.s % 16.0 / 15.0)


query("random", lambda f: st.random(_bits(f), 4), """, cells AS (SELECT row * 64 + col AS i, (v % 16)::BIGINT AS b, (SELECT count(*) FROM s) AS n FROM s),
 seen AS (SELECT a.i, x.b AS b0, a.b AS b1, y.b AS b2, z.b AS b3 FROM cells a JOIN cells x ON x.i = (a.i - 7 + a.n) % a.n JOIN cells y ON y.i = (a.i + 11) % a.n JOIN cells z ON z.i = (a.i + 17) % a.n)
 SELECT 0 AS layer, (i // 64)::INT AS row, (i % 64)::INT AS col, 0 AS e, round(sum(((25946 >> (8 * (b0 >> k & 1) + 4 * (b1 >> k & 1) + 2 * (b2 >> k & 1) + (b3 >> k & 1))) & 1) << k)::DOUBLE / 15, 6) + 0.0 AS v
 FROM seen, (VALUES (0), (1), (2), (3)) t(k) GROUP BY i""")

# ---- transforms, of all keys on a square ------------------------------------------------------------------------

_WIDE = f""", side AS (SELECT (2 ** ceil(ceil(log2(max(o_orderkey) + 1)) / 2))::BIGINT AS n FROM orders),
points AS (SELECT range AS k FROM range((SELECT n * n FROM side))),
wide AS (SELECT k // n AS row, k % n AS col, (coalesce(x, 0)::DOUBLE / 524288 - 0.25) / {ODD}::DOUBLE AS re, (coalesce(y, 0)::DOUBLE / 512 - 0.25) / {ODD}::DOUBLE AS im FROM points CROSS JOIN side
    LEFT JOIN (SELECT o_orderkey AS k, sum(round_even(o_totalprice, 0)) AS x FROM orders GROUP BY 1) USING (k) LEFT JOIN (SELECT l_orderkey AS k, sum(l_quantity) AS y FROM lineitem GROUP BY 1) USING (k)),
plain AS (SELECT row, col, re, 0.0::DOUBLE AS im FROM wide),
along AS (SELECT range AS k FROM range((SELECT n FROM side)))"""


def _dft(source: str, axis: str, sign: int) -> str:
    """The sums of one axis; the angles' whole turns are left out before they are divided."""
    other = "col" if axis == "row" else "row"
    return f"SELECT {other}, k AS {axis}, sum(re * cos(t) - ({sign}) * im * sin(t)) AS re, sum(im * cos(t) + ({sign}) * re * sin(t)) AS im FROM (SELECT z.row, z.col, z.re, z.im, k, 2 * pi() * ((k * z.{axis}) % n) / n AS t FROM ({source}) z, side, along) GROUP BY {other}, k"


def _cosines(source: str, axis: str, inverse: bool) -> str:
    other = "col" if axis == "row" else "row"
    x, freq = ("k", f"z.{axis}") if inverse else (f"z.{axis}", "k")
    return f"SELECT {other}, k AS {axis}, sum(re * w) AS re FROM (SELECT z.row, z.col, z.re, k, sqrt(2.0 / n) * cos(pi() * (((2 * {x} + 1) * {freq}) % (4 * n)) / (2 * n)) * CASE WHEN {freq} = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END AS w FROM ({source}) z, side, along) GROUP BY {other}, k"


def _complex_sql(source: str, scale: str = "1", digits: int = 4) -> str:
    return f"{_WIDE} SELECT 0 AS layer, row::INT AS row, col::INT AS col, {_round(f're / ({scale})', digits)} AS re, {_round(f'im / ({scale})', digits)} AS im FROM ({source}), side"


def _real_sql(source: str, row: str = "row", col: str = "col") -> str:
    return f"{_WIDE} SELECT 0 AS layer, {row}::INT AS row, {col}::INT AS col, {_round('re', 4)} AS v FROM ({source})"


_FORWARD = _dft(_dft("SELECT * FROM wide", "col", -1), "row", -1)
_INVERSE = _dft(_dft("SELECT * FROM wide", "col", 1), "row", 1)
query("fft", lambda f: sp.fft(f.wide_n), _complex_sql(_dft(_dft("SELECT * FROM plain", "col", -1), "row", -1)), 4)
query("fft_complex", lambda f: sp.fft(f.wide_c), _complex_sql(_FORWARD), 4)
query("fft_rows", lambda f: sp.fft_rows(f.wide_c), _complex_sql(_dft("SELECT * FROM wide", "col", -1), digits=6), 6)
query("fft_columns", lambda f: sp.fft_columns(f.wide_c), _complex_sql(_dft("SELECT * FROM wide", "row", -1), digits=6), 6)
query("fft_inverse", lambda f: sp.fft_inverse(f.wide_c), _complex_sql(_INVERSE, "n * n"), 4)
query("fft_inverse_rows", lambda f: sp.fft_inverse_rows(f.wide_c), _complex_sql(_dft("SELECT * FROM wide", "col", 1), "n"), 4)
query("fft_inverse_columns", lambda f: sp.fft_inverse_columns(f.wide_c), _complex_sql(_dft("SELECT * FROM wide", "row", 1), "n"), 4)
query("fft_inverse_rows_columns", lambda f: sp.fft_inverse_columns(sp.fft_inverse_rows(f.wide_c)), _complex_sql(_INVERSE, "n * n"), 4)
query("fft_ri", lambda f: p.complex_field(*sp.fft_ri(f.wide_n, f.wide_m)), _complex_sql(_FORWARD), 4)
query("fft_ri_real", lambda f: p.complex_field(*sp.fft_ri(f.wide_n)), _complex_sql(_dft(_dft("SELECT * FROM plain", "col", -1), "row", -1)), 4)
query("fft_inverse_ri", lambda f: p.complex_field(*sp.fft_inverse_ri(f.wide_n, f.wide_m)), _complex_sql(_INVERSE, "n * n"), 4)
_COSINES = _cosines(_cosines("SELECT row, col, re FROM wide", "col", False), "row", False)
_UNCOSINES = _cosines(_cosines("SELECT row, col, re FROM wide", "col", True), "row", True)
query("dct", lambda f: sp.dct(f.wide_n), _real_sql(_COSINES), 4)
query("dct_inverse", lambda f: sp.dct_inverse(f.wide_n), _real_sql(_UNCOSINES), 4)
query("dct_transposed", lambda f: sp.dct_transposed(f.wide_n), _real_sql(_COSINES, "col", "row"), 4)
query("dct_inverse_transposed", lambda f: sp.dct_inverse_transposed(f.wide_n), _real_sql(_UNCOSINES, "col", "row"), 4)

# ---- ticks, scatters, user functions ---------------------------------------------------------------------------


def _events(f: Tables) -> DataFrame:
    e = f.table("events")
    return e.select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.rint("value")).alias("v"), F.rint("value").alias("w"))


_EVENTS = "ev AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN round_even(value, 0) END AS v, round_even(value, 0) AS w FROM events)"
query("sensor_hold_last", lambda f: _events(f).select("event_id", (ticks.hold_last(None, "event_id", "v", ("user_id",)) + 0.0).alias("v")), f", {_EVENTS} SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 0) + 0.0 AS v FROM ev")
query("actuator_lag", lambda f: _events(f).select("event_id", (ticks.delay("w", "event_id", ("user_id",), 1, 4.5) + 0.0).alias("v")), f", {_EVENTS} SELECT event_id, lag(w, 1, 4.5) OVER (PARTITION BY user_id ORDER BY event_id) + 0.0 AS v FROM ev")
query("feedback_accumulate", lambda f: _events(f).select("event_id", (ticks.accumulate("w", "event_id", ("user_id",), 1.0) + 0.0).alias("v")), f", {_EVENTS} SELECT event_id, 1 + coalesce(sum(w) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.0 AS v FROM ev")


def _counter(f: Tables) -> Field:
    g = ticks.TickGraph(f.spark, lambda v, _: {"x": v["x"] + f.q}, {"x": f.s})
    return g.step(3).registers["x"]


def _sensed(f: Tables, frames: list, steps: int, pipelined: bool = True) -> ticks.TickGraph:
    """A graph that passes a sensor's frames on, after so many steps."""
    left = iter(frames)
    sensor = ticks.Sensor(next(x for x in frames if x is not None).type, lambda: next(left, None), pipelined)
    return ticks.TickGraph(f.spark, lambda v, _: {"x": v["in"]}, sensors={"in": sensor}).reset().step(steps)


def _acted(f: Tables, values: list, steps: int, pipelined: bool, init=None) -> Field:
    """What an actuator was given last; the graph's output at time t is ``values[t]``."""
    given: list[Field] = []
    ticks.TickGraph(f.spark, lambda v, time: {"x": values[time]}, actuators=[ticks.Actuator("x", given.append, pipelined, init)]).reset().step(steps)
    return given[-1]


_PAIR_SQL = f"SELECT {AT}, e, (CASE e WHEN 0 THEN x ELSE y END) + 0.0 AS v FROM b, (VALUES (0), (1)) t(e)"
_COLOR_SQL = f"SELECT {AT}, x + 0.0 AS r, y + 0.0 AS g, x + y + 0.0 AS b FROM b"
shaped("sensor_pipelined", lambda f: _sensed(f, [f.s, None, f.q], 2).field("x"), "SELECT * FROM q")
shaped("sensor_holds", lambda f: _sensed(f, [f.s, None, f.q], 1).field("x"), "SELECT * FROM s")
shaped("sensor_unpipelined", lambda f: _sensed(f, [f.s, f.q, f.s + f.q], 2, False).field("x"), "SELECT layer, row, col, x + y AS v FROM b")
query("vector_sensor", lambda f: _sensed(f, [f.pair * 2.0, f.pair], 1).field("x"), _PAIR_SQL, None)
query("vector_sensor_unpipelined", lambda f: _sensed(f, [f.pair * 2.0, f.pair], 1, False).field("x"), _PAIR_SQL, None)
query("color_sensor", lambda f: _sensed(f, [f.color * 2.0, f.color], 1).field("x"), _COLOR_SQL, None)
query("color_sensor_unpipelined", lambda f: _sensed(f, [f.color * 2.0, f.color], 1, False).field("x"), _COLOR_SQL, None)
shaped("actuator_pipelined", lambda f: _acted(f, [f.s, f.q], 1, True), "SELECT * FROM s")
shaped("actuator_initial", lambda f: _acted(f, [f.s], 0, True, f.q), "SELECT * FROM q")
shaped("actuator_unpipelined", lambda f: _acted(f, [f.s, f.q], 1, False), "SELECT * FROM q")
query("vector_actuator", lambda f: _acted(f, [f.pair, f.pair * 2.0], 1, True), _PAIR_SQL, None)
query("vector_actuator_unpipelined", lambda f: _acted(f, [f.pair * 2.0, f.pair], 1, False), _PAIR_SQL, None)
query("color_actuator", lambda f: _acted(f, [f.color, f.color * 2.0], 1, True), _COLOR_SQL, None)
query("color_actuator_unpipelined", lambda f: _acted(f, [f.color * 2.0, f.color], 1, False), _COLOR_SQL, None)
shaped("feedback_reset", lambda f: ticks.TickGraph(f.spark, lambda v, _: {"x": v["x"] + f.q}, {"x": f.s}).step(2).reset().step(1).field("x"), "SELECT layer, row, col, x + 2 * y AS v FROM b")
shaped("feedback_run", lambda f: ticks.TickGraph(f.spark, lambda v, _: {"x": v["x"] + f.q}, {"x": f.s}).run(2).registers["x"], "SELECT layer, row, col, x + 2 * y AS v FROM b")
query("delay_of_three", lambda f: _events(f).select("event_id", (ticks.delay("w", "event_id", ("user_id",), 3, 4.5) + 0.0).alias("v")), f", {_EVENTS} SELECT event_id, lag(w, 3, 4.5) OVER (PARTITION BY user_id ORDER BY event_id) + 0.0 AS v FROM ev")
shaped("feedback_steps", _counter, "SELECT layer, row, col, x + 3 * y AS v FROM b")
shaped("scatter_add", lambda f: user.scatter(f.q, lambda x: x % 16, "add", (16,)), "SELECT 0 AS layer, 0 AS row, range AS col, coalesce(v, 0) AS v FROM range(16) LEFT JOIN (SELECT (v % 16)::BIGINT AS k, sum(v) AS v FROM q GROUP BY 1) ON k = range")
shaped("histogram", lambda f: user.scatter(f.s, lambda x: F.floor(x / 32768), "inc", (20,)), "SELECT 0 AS layer, 0 AS row, range AS col, coalesce(v, 0) AS v FROM range(20) LEFT JOIN (SELECT floor(v / 32768)::BIGINT AS k, count(*) AS v FROM s GROUP BY 1) ON k = range")
shaped("neighbor_reads", lambda f: user.point_operator([user.neighbors(f.s, [(0, -1, 0), (0, 0, 1)])], lambda n: F.get(n, F.lit(0)) - F.get(n, F.lit(1)), FieldType(f.s.shape)), taps_sql([(-1, 0, 1), (0, 1, -1)], CLAMP, _SUM))
shaped("whole_field_operator", lambda f: user.field_operator([f.s], lambda x: np.cumsum(x, axis=0), f.s.type, along=0), "SELECT layer, row, col, sum(v) OVER (PARTITION BY col ORDER BY row) AS v FROM s")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices above their mean, as a mask, and how far: a source, a broadcast 0D mean, a predicate, a stencil."""
    f = Tables(spark, sf_dir)
    centered = f.s - r.field_reduce_sum(f.s) / float(f.s.type.points)
    return rows(st.convolve(p.abs_(centered) * (centered > 0.0), Field.of(spark, _ONES / 9), CLAMP), 4)
