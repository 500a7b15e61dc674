"""Column arithmetic on vectors and unit quaternions (w, x, y, z), given as tuples of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]
POSE = ("tx", "ty", "tz", "qw", "qx", "qy", "qz")


def cols(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def lits(*values: float) -> tuple[Column, ...]:
    return tuple(F.lit(float(v)) for v in values)


def dot(a, b) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def add(a, b):
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a, b):
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a, s):
    return tuple(x * s for x in a)


def unit(a, otherwise=None, least: float = 1e-9):
    """``a`` over its length; ``otherwise`` (default: as it is) where that is below ``least``."""
    n = norm(a)
    return tuple(F.when(n > least, x / n).otherwise(o) for x, o in zip(a, otherwise or a, strict=True))


def conj(q: Quat) -> Quat:
    return (q[0], -q[1], -q[2], -q[3])


def qmul(a: Quat, b: Quat) -> Quat:
    return (
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def rotate(q: Quat, v: Vec) -> Vec:
    t = scale(cross(q[1:], v), F.lit(2.0))
    return add(add(v, scale(t, q[0])), cross(q[1:], t))


def upright(q: Quat) -> Quat:
    """The same rotation with w >= 0."""
    return tuple(F.when(q[0] < 0, -x).otherwise(x) for x in q)


def from_axes(x: Vec, y: Vec, z: Vec) -> Quat:
    """Quaternion of the rotation whose columns are the axes."""

    def part(s: Column, sign: Column | None = None) -> Column:
        root = F.sqrt(F.greatest(s, F.lit(0.0))) / 2
        return root if sign is None else F.when(sign < 0, -root).otherwise(root)

    return (
        part(1 + x[0] + y[1] + z[2]),
        part(1 + x[0] - y[1] - z[2], y[2] - z[1]),
        part(1 - x[0] + y[1] - z[2], z[0] - x[2]),
        part(1 - x[0] - y[1] + z[2], x[1] - y[0]),
    )


def angle_deg(a: Quat, b: Quat) -> Column:
    """Geodesic angle between two rotations."""
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)))))


def slerp_weights(d: Column, u: Column) -> tuple[Column, Column]:
    """What of two quaternions with dot product ``d`` makes the one at ``u``; linear where they nearly agree."""
    c = F.least(F.abs(d), F.lit(1.0))
    near = c > 0.9995
    theta = F.acos(c)
    s = F.sin(theta)
    wb = F.when(near, u).otherwise(F.sin(u * theta) / s)
    return F.when(near, 1 - u).otherwise(F.sin((1 - u) * theta) / s), F.when(d < 0, -wb).otherwise(wb)


def slerp(a: Quat, b: Quat, u: Column) -> Quat:
    """Shortest-arc interpolation; linear and normalised where the two nearly agree."""
    wa, wb = slerp_weights(dot(a, b), u)
    mixed = tuple(x * wa + y * wb for x, y in zip(a, b, strict=True))
    return unit(mixed, least=0.0)


def lerp(a, b, u: Column):
    return tuple(x + (y - x) * u for x, y in zip(a, b, strict=True))


def named(values, names) -> list[Column]:
    return [v.alias(n) for v, n in zip(values, names, strict=True)]
