"""All operators under one roof: ``from tensorfold.api import *``; each is also a method of ``Field``.

``f[2]`` is a slice, ``f[1:3, 0:4]`` a window, ``f[index]`` with a 0D field a dynamic slice.
"""

from __future__ import annotations

import inspect

from .field import Field
from .functions.user import field_operator, neighbors, point_operator, scatter
from .operators import pointwise, reduce, shape, spectral, stencil, tensor
from .types import CLAMP, COMPLEX, CYCLIC, FULL, NO_SAMPLING, VALID, ZERO, FieldType, Sampling, SemanticError, check, downsample_output, upsample_input

#: Values at a point up to which a tensor counts as small.
SMALL = 4


def is_small_tensor_field(f: Field) -> bool:
    return f.type.elements <= SMALL


def is_big_tensor_field(f: Field) -> bool:
    return not is_small_tensor_field(f)


def trim_to_real(f: Field, sizes) -> Field:
    """The real part of the origin corner of a complex field."""
    return pointwise.real_part(shape.trim(f, sizes))


def real_to_complex_expand(f: Field, border: str, sizes) -> Field:
    """A real field padded and made complex, as before a transform."""
    return pointwise.to_complex(shape.expand(f, border, sizes))


#: Tuning variants have the same meaning; Spark picks the physical plan.
transform_tiled, convolve_tiled = tensor.transform, stencil.convolve

_OWN = {name: f for name, f in vars().items() if inspect.isfunction(f) and f.__module__ == __name__}
_MORE = {"field_operator": field_operator, "neighbors": neighbors, "point_operator": point_operator, "scatter": scatter, "transform_tiled": transform_tiled, "convolve_tiled": convolve_tiled}
OPERATORS = {}
for _module in (pointwise, tensor, reduce, shape, spectral, stencil):
    OPERATORS |= {name: f for name, f in vars(_module).items() if inspect.isfunction(f) and f.__module__ == _module.__name__ and not name.startswith("_")}
#: Column helpers of the modules, not operators.
for _name in ("nan", "inf", "mask", "divide", "remainder", "maximum", "minimum", "logarithm", "sign", "c_add", "c_sub", "c_mul", "c_div", "c_exp", "fill", "moved", "with_gaps", "contributions"):
    OPERATORS.pop(_name, None)
OPERATORS |= _OWN | _MORE
globals().update(OPERATORS)

#: Operators whose first argument isn't one field.
_NOT_METHODS = {"field_operator", "point_operator", "select", "window"}
for _name, _f in OPERATORS.items():
    if _name not in _NOT_METHODS and not hasattr(Field, _name):
        setattr(Field, _name, _f)


def _getitem(f: Field, at):
    if isinstance(at, Field):
        return shape.slice_point(f, at)
    if isinstance(at, int):
        return shape.slice_at(f, at)
    parts = at if isinstance(at, tuple) else (at,)
    check(len(parts) == len(f.shape) and all(isinstance(p, slice) for p in parts), "an index, a 0D field, or a range of each dimension")
    return shape.window(f, *[range(*p.indices(n)) for p, n in zip(parts, f.shape)])


Field.__getitem__ = _getitem
__all__ = [*OPERATORS, "CLAMP", "COMPLEX", "CYCLIC", "FULL", "NO_SAMPLING", "VALID", "ZERO", "Field", "FieldType", "Sampling", "SemanticError", "downsample_output", "upsample_input"]
