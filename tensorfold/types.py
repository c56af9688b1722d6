"""Field types, border and sampling policies, and the typing rules that are checked before Spark sees anything."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

REAL, COMPLEX, COLOR = "real", "complex", "color"
CLAMP, ZERO, CYCLIC, VALID, FULL = "clamp", "zero", "cyclic", "valid", "full"


class SemanticError(ValueError):
    """Operands whose types don't fit an operator."""


def check(holds: bool, message: str) -> None:
    if not holds:
        raise SemanticError(message)


@dataclass(frozen=True)
class FieldType:
    """Sizes of a field of 0 to 3 dimensions (layers, rows, columns), tensor sizes at each point, and element kind."""

    shape: tuple[int, ...] = ()
    tensor: tuple[int, ...] = ()
    kind: str = REAL

    def __post_init__(self):
        check(len(self.shape) <= 3 and len(self.tensor) <= 2, "fields have up to 3 dimensions, tensors up to 2")
        check(all(n > 0 for n in (*self.shape, *self.tensor)), "sizes are positive")
        check(self.kind in (REAL, COMPLEX, COLOR), f"unknown element kind {self.kind}")
        check(self.kind != COLOR or not self.tensor, "color fields have no tensor shape")

    @property
    def points(self) -> int:
        return prod(self.shape)

    @property
    def elements(self) -> int:
        return prod(self.tensor)

    @property
    def sizes(self) -> tuple[int, int, int]:
        """Layers, rows and columns; 1 where the field lacks the dimension."""
        return (1,) * (3 - len(self.shape)) + self.shape  # type: ignore[return-value]

    def with_(self, **changes) -> FieldType:
        return FieldType(**({"shape": self.shape, "tensor": self.tensor, "kind": self.kind} | changes))


def result_type(a: FieldType, b: FieldType) -> FieldType:
    """The type of a binary operator: equal types; a 0D operand of the same tensor shape; a scalar operand of the same
    field shape; a 0D scalar. Real operands are promoted if the other is complex."""
    if COMPLEX in (a.kind, b.kind):
        check(COLOR not in (a.kind, b.kind), "color and complex fields don't mix")
        a, b = a.with_(kind=COMPLEX), b.with_(kind=COMPLEX)
    if a == b:
        return a
    if COLOR in (a.kind, b.kind) and a.kind != b.kind:
        other, color = (b, a) if a.kind == COLOR else (a, b)
        check(not other.tensor and other.shape in ((), color.shape), "a color field combines with colors and scalars")
        return color
    if a.tensor == b.tensor and () in (a.shape, b.shape):
        return b if not a.shape else a
    if a.shape == b.shape and () in (a.tensor, b.tensor):
        return b if not a.tensor else a
    for x, y in ((a, b), (b, a)):
        if not x.shape and not x.tensor:
            return y
    raise SemanticError(f"types don't fit: {a} and {b}")


@dataclass(frozen=True)
class Sampling:
    """How a convolution samples: zeros between inputs, or every step-th output."""

    up: int = 1
    down: int = 1


NO_SAMPLING = Sampling()


def upsample_input(step: int) -> Sampling:
    return Sampling(up=step)


def downsample_output(step: int) -> Sampling:
    return Sampling(down=step)
