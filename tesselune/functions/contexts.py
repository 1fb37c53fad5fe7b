"""Contexts of coefficients and bytes, block strategies and small number formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselune.functions.codes import hybrid_uint, threshold_bucket

#: Cells across and down of the block strategies 0 to 26.
STRATEGY_CELLS = (
    (1, 1), (1, 1), (1, 1), (1, 1), (2, 2), (4, 4), (1, 2), (2, 1), (1, 4), (4, 1), (2, 4), (4, 2), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1),
    (8, 8), (4, 8), (8, 4), (16, 16), (8, 16), (16, 8), (32, 32), (16, 32), (32, 16),
)
#: Scan-order bucket of the strategies 0 to 26.
STRATEGY_ORDER = (0, 0, 0, 0, 2, 3, 4, 4, 5, 5, 6, 6, 0, 0, 1, 1, 1, 1, 7, 8, 8, 9, 10, 10, 11, 12, 12)
#: Default block contexts by order bucket, of luma (channel 1) and of the other two channels.
LUMA_CONTEXTS, CHROMA_CONTEXTS = (0, 1, 2, 2, 3, 3, 4, 5, 6, 6, 6, 6, 6), (7, 8, 9, 9, 10, 11, 12, 13, 14, 14, 14, 14, 14)
#: Part of the density context by the number of non-zeros left, 0 to 63, and by the place, 0 to 63.
NONZERO_PARTS = (
    0, 0, 31, 62, 62, 93, 93, 93, 93, 123, 123, 123, 123, 152, 152, 152, 152, 152, 152, 152, 152, 180, 180, 180, 180, 180, 180, 180, 180, 180, 180, 180,
    180, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206, 206,
)
PLACE_PARTS = (
    0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 15, 16, 16, 17, 17, 18, 18, 19, 19, 20, 20, 21, 21, 22, 22,
    23, 23, 23, 23, 24, 24, 24, 24, 25, 25, 25, 25, 26, 26, 26, 26, 27, 27, 27, 27, 28, 28, 28, 28, 29, 29, 29, 29, 30, 30, 30, 30,
)


def _of(values: tuple[int, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def strategy_cells(strategy: Column) -> tuple[Column, Column]:
    """Cells of 8 x 8 across and down that a block of the strategy covers; null for an unknown one."""
    return _of(tuple(x for x, _ in STRATEGY_CELLS), strategy), _of(tuple(y for _, y in STRATEGY_CELLS), strategy)


def strategy_order(strategy: Column) -> Column:
    """The scan-order bucket of a strategy; 0 for an unknown one."""
    return F.coalesce(_of(STRATEGY_ORDER, strategy), F.lit(0))


def block_context(channel: Column, bucket: Column, contexts: tuple[int, ...] | None = None) -> Column:
    """The context of a block by its channel (1 is luma) and its strategy's order bucket, in a map of 3 x 13 or the default one."""
    if contexts is not None:
        return _of(contexts, F.when(channel == 1, 0).when(channel == 0, 1).otherwise(2) * 13 + bucket)
    return F.when(channel == 1, _of(LUMA_CONTEXTS, bucket)).otherwise(_of(CHROMA_CONTEXTS, bucket))


def block_cluster(
    channel: Column, bucket: Column, quantisation: Column, cells: tuple[Column, Column, Column], quant_thresholds: list[int], cell_thresholds: tuple[list[int], list[int], list[int]]
) -> tuple[Column, int]:
    """(place, size) of a block in the map of clusters: by channel, bucket, how many thresholds its quantiser exceeds, and how
    many each channel's cell does. size is the map's."""
    place, size = F.when(channel == 1, 0).when(channel == 0, 1).otherwise(2) * 13 + bucket, 39
    for value, thresholds in ((quantisation, quant_thresholds), *zip(cells, cell_thresholds, strict=True)):
        place, size = place * (len(thresholds) + 1) + threshold_bucket(value, thresholds), size * (len(thresholds) + 1)
    return place, size


def zero_density_context(left: Column, k: Column, log2_covered: int, before: Column, block: Column, clusters: int = 15) -> Column:
    """The context of coefficient k, by the non-zeros left from it on and whether the one before was not zero (1 or 0).

    Both numbers are brought to the size of one cell.
    """

    def cell(v: Column) -> Column:
        return F.least(F.lit(63), F.greatest(F.lit(1), F.shiftright(v, log2_covered)))

    dense, place = _of(NONZERO_PARTS, cell(left + (1 << log2_covered) - 1)), _of(PLACE_PARTS, cell(k))
    return clusters * 37 + block * 458 + 2 * (dense + place) + before


def order_context(v: Column) -> Column:
    """The context of an entry of a coefficient order's code: its bits, 7 at most."""
    return F.least(F.lit(7), hybrid_uint(v, 0, 0, 0)[0])


def activity_bin(v: Column, thresholds: tuple[int, ...]) -> Column:
    """The leaf of a balanced tree over 1, 3 or 7 ascending thresholds, 0 for the highest values: how many of them v does not exceed."""
    if len(thresholds) not in (1, 3, 7) or list(thresholds) != sorted(thresholds):
        raise ValueError("1, 3 or 7 ascending thresholds")
    return sum((F.when(v <= t, 1).otherwise(0) for t in thresholds), F.lit(0))


def literal_context(mode: str, last: Column, before: Column) -> Column:
    """The context of a literal by the byte before it and the one before that; modes lsb6, msb6, utf8 and signed."""

    def among(b: Column, chars: str) -> Column:
        return b.isin([ord(c) for c in chars])

    def kind(b: Column) -> Column:
        ascii = F.when(among(b, "\t\n\r"), 4).when((b < 32) | (b == 127), 0).when(b == 32, 8)
        for chars, value in (("\"'", 16), ("%", 20), ("([<{", 24), (")]>}", 28), (",:;", 32), (".", 36), ("=", 40), ("0123456789", 44), ("AEIOU", 48), ("aeiou", 56)):
            ascii = ascii.when(among(b, chars), value)
        ascii = ascii.when(b.between(65, 90), 52).when(b.between(97, 122), 60).otherwise(12)
        return F.when(b >= 128, 2 * F.shiftright(b - 128, 6) + b % 2).otherwise(ascii)

    def script(b: Column) -> Column:
        none = (b <= 32) | b.between(127, 223)
        return F.when(none, 0).when(b.between(97, 122), 3).when((b >= 224) | b.between(48, 57) | b.between(65, 90), 2).otherwise(1)

    def size(b: Column) -> Column:
        return sum((F.when(b >= t, 1).otherwise(0) for t in (1, 16, 64, 128, 192, 240, 255)), F.lit(0))

    return {"lsb6": lambda: last % 64, "msb6": lambda: F.shiftright(last, 2), "utf8": lambda: kind(last).bitwiseOR(script(before)), "signed": lambda: 8 * size(last) + size(before)}[mode]()


#: The inverse of the opsin absorbance; rows for red, green and blue.
OPSIN_INVERSE = (
    (11.031566901960783, -9.866943921568629, -0.16462299647058826),
    (-3.254147380392157, 4.418770392156863, -0.16462299647058826),
    (-3.6588512862745097, 2.7129230470588235, 1.9459282392156863),
)


def xyb_to_linear(x: Column, y: Column, b: Column, bias: float) -> tuple[Column, ...]:
    """Linear red, green and blue, not clipped."""
    lms = [v * v * v - bias for v in (c + F.cbrt(F.lit(bias)) for c in (y + x, y - x, b))]
    return tuple(w[0] * lms[0] + w[1] * lms[1] + w[2] * lms[2] for w in OPSIN_INVERSE)


def half_to_double(h: Column) -> Column:
    """The value of the 16 bits of a half-precision number."""
    exponent, part = F.shiftright(h, 10).bitwiseAND(31), h.bitwiseAND(1023)
    size = F.when(exponent == 0, part * F.pow(F.lit(2.0), F.lit(-24))).when(exponent < 31, (1 + part / 1024) * F.pow(F.lit(2.0), exponent - 15))
    size = size.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(h.bitwiseAND(32768) == 0, size).otherwise(-size)


def storage_index(ordinal: Column, visible_wide: Column, visible_high: Column, stored_wide: Column) -> Column:
    """Where the block of a scan of one JPEG component lies in the padded grid; null outside the visible blocks."""
    inside = (ordinal >= 0) & (ordinal < visible_wide * visible_high)
    return F.when(inside, F.floor(ordinal / visible_wide) * stored_wide + ordinal % visible_wide)
