"""Integer codes and colour transforms as column expressions. Integers are 64-bit; shifts are arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 ... to 0, 1, 2, 3 ..."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 0, F.shiftright(u, 1)).otherwise(-F.shiftright(u + 1, 1))


def bit_length(u: Column) -> Column:
    """Bits of a number from 0 on; 0 has none."""
    return F.when(u == 0, 0).otherwise(F.length(F.bin(u)))


def hybrid_uint(u: Column, split: int = 4, msb: int = 2, lsb: int = 0) -> tuple[Column, Column, Column]:
    """(token, extra bits, their number): literal below 2**split, else exponent with msb and lsb kept bits."""
    n = F.length(F.bin(u)) - 1
    count = n - msb - lsb
    high = F.expr("1L") * F.pmod(F.floor(u / F.pow(F.lit(2.0), n - msb)), F.lit(1 << msb))
    token = (1 << split) + (n - split) * (1 << (msb + lsb)) + high * (1 << lsb) + u.bitwiseAND((1 << lsb) - 1)
    rest = F.pmod(F.shiftright(u, lsb), F.pow(F.lit(2.0), count).cast("long"))
    small = u < (1 << split)
    return F.when(small, u).otherwise(token).cast("long"), F.when(small, 0).otherwise(rest).cast("long"), F.when(small, 0).otherwise(count).cast("int")


def unhybrid_uint(token: Column, extra: Column, split: int = 4, msb: int = 2, lsb: int = 0) -> Column:
    over = token - (1 << split)
    n = F.shiftright(over, msb + lsb) + split
    kept = F.pmod(F.shiftright(over, lsb), F.lit(1 << msb)) + (1 << msb)
    high = kept * F.pow(F.lit(2.0), n - msb - lsb).cast("long") + extra
    return F.when(token < (1 << split), token).otherwise(high * (1 << lsb) + over.bitwiseAND((1 << lsb) - 1))


def wrap32(v: Column) -> Column:
    """To the range of a signed 32-bit integer, as wrapping arithmetic leaves it."""
    return F.pmod(v + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def ycocg_forward(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    co = r - b
    t = b + F.shiftright(co, 1)
    cg = g - t
    return t + F.shiftright(cg, 1), co, cg


def ycocg_inverse(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    t = y - F.shiftright(cg, 1)
    b = t - F.shiftright(co, 1)
    return b + co, cg + t, b


def rct_inverse(kind: int, a: Column, b: Column, c: Column) -> tuple[Column, ...]:
    """One of the 42 reversible colour transforms, undone: permutation kind // 7 after mode kind % 7."""
    order, mode = divmod(kind, 7)
    if mode == 6:
        d, e, f = ycocg_inverse(a, b, c)
    else:
        d, f = a, c + a if mode % 2 else c
        e = b + {0: F.lit(0), 1: a, 2: F.shiftright(a + f, 1)}[mode // 2]
    out: list[Column | None] = [None] * 3
    out[order % 3], out[(order + 1 + order // 3) % 3], out[(order + 2 - order // 3) % 3] = d, e, f
    return tuple(wrap32(x) for x in out if x is not None)


def smooth_tendency(b: Column, a: Column, n: Column) -> Column:
    """Slope that the inverse squeeze adds: a twelfth of 4b - 3n - a, rounded toward its sign and clamped to stay monotone."""

    def odd(d: Column) -> Column:
        return F.pmod(d, F.lit(2))

    def div(v: Column) -> Column:  # truncating
        return F.signum(v).cast("long") * F.floor(F.abs(v) / 12)

    falls = div(4 * b - 3 * n - a + 6)
    falls = F.when(falls - odd(falls) > 2 * (b - a), 2 * (b - a) + 1).otherwise(falls)
    falls = F.when(falls + odd(falls) > 2 * (a - n), 2 * (a - n)).otherwise(falls)
    rises = div(4 * b - 3 * n - a - 6)
    rises = F.when(rises + odd(rises) < 2 * (b - a), 2 * (b - a) - 1).otherwise(rises)
    rises = F.when(rises - odd(rises) < 2 * (a - n), 2 * (a - n)).otherwise(rises)
    return F.when((b >= a) & (a >= n), falls).when((b <= a) & (a <= n), rises).otherwise(0)


#: Opsin absorbance of linear sRGB, rows for long, middle and short; bias of each.
OPSIN = ((0.30, 0.622, 0.078), (0.23, 0.692, 0.078), (0.24342268924547819, 0.20476744424496821, 0.5518098665095536))
OPSIN_BIAS = 0.0037930732552754493


def linear_to_xyb(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    long, mid, short = (F.cbrt(w[0] * r + w[1] * g + w[2] * b + OPSIN_BIAS) - F.cbrt(F.lit(OPSIN_BIAS)) for w in OPSIN)
    return (long - mid) * 0.5, (long + mid) * 0.5, short


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))


def linear_to_srgb(v: Column) -> Column:
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, 1 / 2.4) - 0.055)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """BT.601 of 8-bit samples, rounded half away from zero and clipped."""

    def clip(v: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(255), F.round(v))).cast("long")

    return clip(y + 1.402 * (cr - 128)), clip(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)), clip(y + 1.772 * (cb - 128))


def icc_context(pos: Column, before: Column, before2: Column) -> Column:
    """One of 41 classes of an ICC profile's byte, by the two bytes before it; 0 for the first 129."""

    def letter(b: Column) -> Column:
        return b.between(65, 90) | b.between(97, 122)

    def digit(b: Column) -> Column:
        return b.between(48, 57) | b.isin(46, 44)

    near = F.when(letter(before), 0).when(digit(before), 1).when(before <= 1, 2 + before).when(before < 16, 4).when(before.between(241, 254), 5).when(before == 255, 6).otherwise(7)
    far = F.when(letter(before2), 0).when(digit(before2), 1).when(before2 < 16, 2).when(before2 > 240, 3).otherwise(4)
    return F.when(pos <= 128, 0).otherwise(1 + near + far * 8)


def magnitude(v: Column) -> tuple[Column, Column]:
    """(category, bits) of a JPEG coefficient: bits of its size, and itself or, if negative, itself less one in them."""
    category = bit_length(F.abs(v)).cast("int")
    return category, F.when(v >= 0, v).otherwise(v + F.pow(F.lit(2.0), category).cast("long") - 1)


def extend(category: Column, bits: Column) -> Column:
    """A JPEG coefficient from its category and bits."""
    half = F.pow(F.lit(2.0), category - 1).cast("long")
    return F.when(category == 0, 0).when(bits < half, bits - (2 * half - 1)).otherwise(bits)


def threshold_bucket(v: Column, thresholds: list[int]) -> Column:
    """How many thresholds a value exceeds."""
    return sum((F.when(v > t, 1).otherwise(0) for t in thresholds), F.lit(0))


def distance_context(length: Column) -> Column:
    """The context of a copy's distance by its length: 2, 3, 4, or more."""
    return F.least(F.lit(3), F.greatest(F.lit(0), length - 2))


def mcu_layout(width: Column, height: Column, h: Column, v: Column, h_max: Column, v_max: Column) -> tuple[Column, Column, Column, Column]:
    """Blocks of a JPEG component across and down: those visible, and those stored to fill whole units."""
    across, down = F.ceil(width / (8 * h_max)), F.ceil(height / (8 * v_max))
    return F.ceil(F.ceil(width * h / h_max) / 8), F.ceil(F.ceil(height * v / v_max) / 8), across * h, down * v


def reciprocal_estimate(q: Column) -> Column:
    """An estimate of 1 / q to eight bits, as an arithmetic unit's table gives it: from the top eight bits of the fraction.

    q: whole numbers of up to 24 bits, which single precision holds. Zero has infinity.
    """
    size = F.abs(q).cast("double")
    exponent = F.floor(F.log2(size) + 1e-12)
    d = 256 + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * 256)
    estimate = F.floor((F.floor(F.lit(524288) / (2 * d + 1)) + 1) / 2) - 256
    return F.when(q == 0, F.lit(float("inf"))).otherwise(F.signum(q.cast("double")) * (1 + estimate / 256) * F.pow(F.lit(2.0), -1 - exponent))


def count_kept(count: Column, shift: int, bits: int = 12) -> Column:
    """The nearest count below that is told by its size in bits and as many of its next bits as ``shift`` leaves."""
    top = bit_length(count) - 1
    told = F.greatest(F.lit(0), F.least(top, F.lit(shift) - F.shiftright(F.lit(bits) - top, 1)))
    step = F.pow(F.lit(2.0), top - told).cast("long")
    base = F.pow(F.lit(2.0), top).cast("long")
    return F.when(count <= 1, F.greatest(count, F.lit(0))).otherwise(base + F.floor((count - base) / step) * step).cast("long")
