"""Column expressions of the codec and of the view; all are built-in expressions inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = (1 << 31) - 1


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def quantize(v: Column, step) -> Column:
    """Half away from zero; clamped to 32 bits before the cast."""
    return F.least(F.greatest(F.round(v / lit(step)), F.lit(-float(INT_MAX) - 1)), F.lit(float(INT_MAX))).cast("bigint")


def quantize_int(v: Column, step: int) -> Column:
    return F.floor((v + step // 2) / F.lit(float(step))).cast("bigint")


def zigzag(n: Column) -> Column:
    return F.when(n >= 0, 2 * n).otherwise(-2 * n - 1)


def unzigzag(z: Column) -> Column:
    return F.when(z % 2 == 0, F.floor(z / 2)).otherwise(-F.floor((z + 1) / 2)).cast("bigint")


#: Shifts and masks that spread 21 bits over every third bit.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
ORDER_BITS = 58


def _further(shift: int, mask: int):
    return lambda v: v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))


def spread(values: Column) -> Column:
    """An array of numbers with the 21 low bits of each spread out; every step names its number once, so the expression stays small."""
    values = F.transform(values, lambda v: v.bitwiseAND(F.lit(0x1FFFFF).cast("bigint")))
    for shift, mask in SPREAD:
        values = F.transform(values, _further(shift, mask))
    return values


def morton(x: Column, y: Column, z: Column) -> Column:
    return F.aggregate(spread(F.array(z, y, x)), F.lit(0).cast("bigint"), lambda code, v: F.shiftleft(code, 1).bitwiseOR(v))


def cell(v: Column, least: Column, step) -> Column:
    """A place on the grid of the ordering: truncated, within 21 bits."""
    return F.least(F.floor((v - least) / lit(step)).cast("bigint"), F.lit(0x1FFFFF).cast("bigint"))


def sort_key(mask: Column, code: Column) -> Column:
    return F.shiftleft(mask.cast("bigint"), ORDER_BITS).bitwiseOR(code.bitwiseAND(F.lit((1 << ORDER_BITS) - 1).cast("bigint")))


def mask_bits(*dynamic: Column) -> Column:
    """Bit k is set where the k-th attribute is dynamic."""
    return reduce(lambda a, b: a + b, (F.when(d, 1 << k).otherwise(0) for k, d in enumerate(dynamic))).cast("bigint")


def log_scale(s: Column) -> Column:
    return F.ln(F.greatest(s, F.lit(1e-9)))


def recentre(q: Column) -> Column:
    return q - 128


def clamp8(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(255))


def clamp_rot(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(-128)), F.lit(127))


def symbol_width(most: Column) -> Column:
    return F.when(most < 256, 1).when(most < 65536, 2).otherwise(4)


def texel_row(i: Column) -> Column:
    return F.shiftright(2 * i, 11)


def depth(x: Column, y: Column, z: Column, row) -> Column:
    """Truncated fixed-point depth along a view's third row."""
    d = (row[0] * x + row[1] * y + row[2] * z) * 4096
    return F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("bigint")


def covariance(q: list[Column], s: list[Column]) -> list[Column]:
    """The six terms of (R diag s)(R diag s)^T, row by row, for a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    r = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]
    m = [[r[i][k] * s[k] for k in range(3)] for i in range(3)]
    return [sum((m[i][k] * m[j][k] for k in range(1, 3)), m[i][0] * m[j][0]) for i in range(3) for j in range(i, 3)]


def motion(x0: Column, v: list[Column], dt: Column) -> Column:
    """A cubic in dt, by Horner's rule."""
    return x0 + dt * (v[0] + dt * (v[1] + dt * v[2]))


def opacity_over_time(alpha: Column, dt: Column, width: Column, cull: float = 0.02) -> Column:
    top = F.exp(-F.pow(dt / F.greatest(width, F.lit(1e-6)), 2))
    return F.when(top < cull, F.lit(0.0)).otherwise(alpha * top)


def ycocg(r: Column, g: Column, b: Column) -> list[Column]:
    """Lossless integer luma and two chromas."""
    co = r - b
    t = b + F.shiftright(co, 1)
    cg = g - t
    return [t + F.shiftright(cg, 1), co, cg]


def un_ycocg(y: Column, co: Column, cg: Column) -> list[Column]:
    t = y - F.shiftright(cg, 1)
    b = t - F.shiftright(co, 1)
    return [b + co, cg + t, b]


def weighted_bound(bound: int, beta: float, alpha: Column, cap: int = 64) -> Column:
    """A bound that grows where opacity is low."""
    return F.least(F.greatest(F.lit(bound), F.floor(F.lit(beta) / F.greatest(alpha, F.lit(1e-6))).cast("bigint")), F.lit(cap)).cast("bigint")


#: Fixed value: the constant of the zeroth spherical harmonic.
SH_C0 = 0.28209479


def sh_level(dc: Column) -> Column:
    return (0.5 + SH_C0 * dc) * 255


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def visible(px: Column, py: Column, pz: Column, pw: Column, margin: float = 1.2) -> Column:
    """Inside the clip volume widened by the margin; nothing is cut at the far end."""
    edge = margin * pw
    return (pz >= -edge) & (px >= -edge) & (px <= edge) & (py >= -edge) & (py <= edge)


def axes(a: Column, b: Column, d: Column, most: float = 1024.0) -> list[Column]:
    """(lambda2, major, minor) of the symmetric 2 x 2 matrix (a b; b d), lengths capped."""
    mid = (a + d) / 2
    radius = F.sqrt(F.pow((a - d) / 2, 2) + b * b)
    return [mid - radius, F.least(F.sqrt(2 * (mid + radius)), F.lit(most)), F.least(F.sqrt(2 * F.greatest(mid - radius, F.lit(0.0))), F.lit(most))]
