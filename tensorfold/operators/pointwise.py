"""Elementwise arithmetic, comparison and math: projections, fused by living on one frame.

Comparisons give masks of 1 and 0. Spark's ANSI errors and null results are replaced by IEEE values: division by
zero gives an infinity or NaN, the logarithm of zero minus infinity, a NaN equals nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..field import COLOR, COMPLEX, Field, combine, const, cplx, each, each_complex, to_complex
from ..types import FieldType, check

def nan() -> Column:
    return const(float("nan"))


def inf() -> Column:
    return const(float("inf"))


def mask(holds: Column) -> Column:
    return F.when(holds, const(1)).otherwise(const(0))


def divide(x: Column, y: Column) -> Column:
    """IEEE division; a zero of either sign counts as positive."""
    return F.when(y != 0, x / F.when(y != 0, y)).when(F.isnan(x) | (x == 0), nan()).when(x > 0, inf()).otherwise(-inf())


def remainder(x: Column, y: Column) -> Column:
    """The remainder with the dividend's sign; of division by zero, NaN."""
    return F.when(y != 0, x % F.when(y != 0, y)).otherwise(nan())


def maximum(x: Column, y: Column) -> Column:
    """The larger; a NaN yields to a number."""
    return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.greatest(x, y))


def minimum(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.least(x, y))


def logarithm(x: Column) -> Column:
    return F.when(x > 0, F.ln(F.when(x > 0, x))).when(x == 0, -inf()).otherwise(nan())


def sign(x: Column) -> Column:
    return F.when(x > 0, F.when(F.isnan(x), const(0)).otherwise(const(1))).when(x < 0, const(-1)).otherwise(const(0))


# Complex arithmetic on (re, im) structs.
def c_add(a, b):
    return cplx(a.re + b.re, a.im + b.im)


def c_sub(a, b):
    return cplx(a.re - b.re, a.im - b.im)


def c_mul(a, b):
    return cplx(a.re * b.re - a.im * b.im, a.re * b.im + a.im * b.re)


def c_div(a, b):
    n = b.re * b.re + b.im * b.im
    return cplx(divide(a.re * b.re + a.im * b.im, n), divide(a.im * b.re - a.re * b.im, n))


def c_exp(a):
    return cplx(F.exp(a.re) * F.cos(a.im), F.exp(a.re) * F.sin(a.im))


def _real(g):
    return lambda f: each(f, g)


def _either(real, complex_):
    return lambda f: each_complex(f, complex_) if f.type.kind == COMPLEX else each(f, real)


abs_ = _real(F.abs)
acos, asin, acosh = _real(F.acos), _real(F.asin), _real(F.acosh)
cos, cosh, sin, sinh, tan, tanh = (_real(g) for g in (F.cos, F.cosh, F.sin, F.sinh, F.tan, F.tanh))
exp = _either(F.exp, c_exp)
log = _real(logarithm)
floor = _real(lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), x).otherwise(F.floor(x).cast("double")))
signum = _real(sign)
sq = _real(lambda x: x * x)
sqrt = _real(F.sqrt)
reciprocal = _either(lambda x: divide(const(1), x), lambda a: c_div(cplx(const(1), const(0)), a))
rectify = _real(lambda x: maximum(x, const(0)))
negate = _either(lambda x: -x, lambda a: cplx(-a.re, -a.im))
filter_nan = _real(lambda x: F.nanvl(x, const(0)))


def copy(f: Field) -> Field:
    return f.of_frame(f.expr)


def power(f: Field, n: float) -> Field:
    """To an integer power, or to a real one, of which negative bases give NaN."""
    return each(f, lambda x: F.pow(x, const(n)))


def _number(spark_field: Field, value: float | complex) -> Field:
    """A 0D constant next to a field: a literal, not a frame."""
    if isinstance(value, complex):
        expr = cplx(const(value.real), const(value.imag))
        return Field(FieldType(kind=COMPLEX), spark_field.frame, expr)
    return Field(FieldType(), spark_field.frame, const(value))


def _binary(real, complex_=None):
    def op(a, b):
        if not isinstance(a, Field):
            a = _number(b, a)
        if not isinstance(b, Field):
            b = _number(a, b)
        return combine(a, b, real, complex_)

    return op


add = _binary(lambda x, y: x + y, c_add)
subtract = _binary(lambda x, y: x - y, c_sub)
multiply = _binary(lambda x, y: x * y, c_mul)
divided = _binary(divide, c_div)
modulo = _binary(remainder)
greater = _binary(lambda x, y: mask((x > y) & ~F.isnan(x)))
greater_equal = _binary(lambda x, y: mask((x >= y) & ~F.isnan(x) & ~F.isnan(y)))
less = _binary(lambda x, y: mask((x < y) & ~F.isnan(y)))
less_equal = _binary(lambda x, y: mask((x <= y) & ~F.isnan(x) & ~F.isnan(y)))
equal = _binary(lambda x, y: mask((x == y) & ~F.isnan(x)))
not_equal = _binary(lambda x, y: mask((x != y) | F.isnan(x)))
max_, min_ = _binary(maximum), _binary(minimum)
atan2 = _binary(F.atan2)


# ---- complex parts ---------------------------------------------------------------------------------------------


def _part(g):
    def op(f: Field) -> Field:
        check(f.type.kind == COMPLEX, "not a complex field")
        return each_complex(f, g, kind="real")

    return op


real_part, imaginary_part = _part(lambda a: a.re), _part(lambda a: a.im)
phase = _part(lambda a: F.atan2(a.im, a.re))
magnitude = _part(lambda a: F.hypot(a.re, a.im))


def _folded(p: Column) -> Column:
    half = const(3.141592653589793 / 2)
    return F.when(p > half, p - 2 * half).when(p <= -half, p + 2 * half).otherwise(p)


orientation = _part(lambda a: _folded(F.atan2(a.im, a.re)))


def conjugate(f: Field) -> Field:
    return each_complex(f, lambda a: cplx(a.re, -a.im))


def complex_field(re: Field, im: Field | None = None) -> Field:
    """A complex field of a real and an imaginary part of the same type; without the latter it is 0."""
    if im is None:
        return to_complex(re)
    check(re.type == im.type, "the parts' types differ")
    return _paired(re, im, cplx)


def polar_complex(size: Field, angle: Field) -> Field:
    check(size.type == angle.type, "the parts' types differ")
    return _paired(size, angle, lambda m, p: cplx(m * F.cos(p), m * F.sin(p)))


def _paired(a: Field, b: Field, g) -> Field:
    out = combine(a, b, g)
    return Field(out.type.with_(kind=COMPLEX), out.frame, out.expr)


# ---- color -----------------------------------------------------------------------------------------------------

#: Weights of red, green and blue in luminance.
LUMINANCE = (0.3811, 0.5783, 0.0402)


def _channel(c: str):
    def op(f: Field) -> Field:
        check(f.type.kind == COLOR, "not a color field")
        return f.of_frame(f.expr[c], kind="real")

    return op


red, green, blue = _channel("r"), _channel("g"), _channel("b")


def luminance(f: Field) -> Field:
    check(f.type.kind == COLOR, "not a color field")
    return f.of_frame(sum((f.expr[c] * w for c, w in zip("gb", LUMINANCE[1:])), f.expr["r"] * LUMINANCE[0]), kind="real")


def color_field(r: Field, g: Field | None = None, b: Field | None = None) -> Field:
    """Three planes, one plane for all channels, or a field of vectors of length 3."""
    if g is None and r.tensor:
        check(r.tensor == (3,), "a color has 3 channels")
        return r.of_frame(F.struct(*[r.expr[i].alias(c) for i, c in enumerate("rgb")]), kind=COLOR, tensor=())
    from ..field import aligned

    planes = [r, g or r, b or r]
    check(all(p.type == r.type for p in planes) and not r.tensor and r.type.kind == "real", "planes are scalar fields of one shape")
    frame, exprs = aligned(*planes)
    return Field(r.type.with_(kind=COLOR), frame, F.struct(*[e.alias(c) for e, c in zip(exprs, "rgb")]))


def color_to_vector(f: Field) -> Field:
    check(f.type.kind == COLOR, "not a color field")
    return f.of_frame(F.array(*[f.expr[c] for c in "rgb"]), kind="real", tensor=(3,))


# ---- checked casts ---------------------------------------------------------------------------------------------


def to_scalar_field(f: Field) -> Field:
    check(f.type.kind == "real" and not f.tensor, "not a scalar field")
    return f


def to_vector_field(f: Field) -> Field:
    if f.type.kind == COLOR:
        return color_to_vector(f)
    check(f.type.kind == "real" and len(f.tensor) == 1, "not a vector field")
    return f


def to_matrix_field(f: Field) -> Field:
    check(f.type.kind == "real" and len(f.tensor) == 2, "not a matrix field")
    return f


def to_complex_field(f: Field) -> Field:
    check(f.type.kind == COMPLEX and not f.tensor, "not a complex field")
    return f


def to_complex_vector_field(f: Field) -> Field:
    check(f.type.kind == COMPLEX and len(f.tensor) == 1, "not a complex vector field")
    return f


def to_color_field(f: Field) -> Field:
    return f if f.type.kind == COLOR else color_field(f)


# ---- stick and symmetric tensors -------------------------------------------------------------------------------


def stick_tensor(stickness: Field, angle: Field) -> Field:
    return polar_complex(stickness, multiply(angle, 2.0))


stickness = magnitude


def stick_orientation(f: Field) -> Field:
    """Half the phase, in (0, pi]."""
    half = multiply(phase(f), 0.5)
    return add(half, multiply(less_equal(half, 0.0), 3.141592653589793))


def stickness_ballness_orientation(f: Field) -> tuple[Field, Field, Field]:
    """Of symmetric tensors (xx, xy, yy); the determinant has xx*yy + xy*xy, as users of the fields know it."""
    check(f.tensor == (3,), "a symmetric tensor has 3 components")
    xx, xy, yy = (f.of_frame(f.expr[i], tensor=()) for i in range(3))
    trace = add(xx, yy)
    determinant = add(multiply(xx, yy), multiply(xy, xy))
    stick = sqrt(subtract(multiply(trace, trace), multiply(determinant, 4.0)))
    ball = multiply(subtract(trace, stick), 0.5)
    angle = multiply(phase(complex_field(subtract(xx, yy), multiply(xy, 2.0))), 0.5)
    return stick, ball, angle


# ---- Field's operators -----------------------------------------------------------------------------------------

for _name, _op in (("add", add), ("sub", subtract), ("mul", multiply), ("truediv", divided), ("mod", modulo)):
    setattr(Field, f"__{_name}__", _op)
    setattr(Field, f"__r{_name}__", lambda a, b, op=_op: op(b, a))
for _name, _op in (("gt", greater), ("ge", greater_equal), ("lt", less), ("le", less_equal)):
    setattr(Field, f"__{_name}__", _op)
Field.eq, Field.ne, Field.__neg__ = equal, not_equal, negate
