"""Morton codes, packed vertex keys, and other bit arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shifts and masks that spread 21 bits to every third place. Fixed values.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
AXIS_BITS = 21


def spread(v: Column) -> Column:
    """Bit i goes to bit 3i."""
    x = v.cast("long").bitwiseAND(F.lit((1 << AXIS_BITS) - 1))
    for by, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def gather(v: Column) -> Column:
    """Every third bit, from bit 0 on."""
    x = v.bitwiseAND(F.lit(SPREAD[-1][1]))
    for (by, _), mask in zip(reversed(SPREAD), [m for _, m in reversed(SPREAD[:-1])] + [(1 << AXIS_BITS) - 1], strict=True):
        x = x.bitwiseOR(F.shiftright(x, by)).bitwiseAND(F.lit(mask))
    return x


def morton(x: Column, y: Column, z: Column) -> Column:
    """Interleaved bits, z the most significant."""
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def unmorton(code: Column) -> tuple[Column, Column, Column]:
    return gather(code), gather(F.shiftright(code, 1)), gather(F.shiftright(code, 2))


def pack_key(x: Column, y: Column, z: Column) -> Column:
    """63-bit key of doubled vertex coordinates, z the most significant."""
    return F.shiftleft(z.cast("long"), 42).bitwiseOR(F.shiftleft(y.cast("long"), 21)).bitwiseOR(x.cast("long"))


def unpack_key(key: Column) -> tuple[Column, Column, Column]:
    low = F.lit((1 << AXIS_BITS) - 1)
    return key.bitwiseAND(low), F.shiftright(key, 21).bitwiseAND(low), F.shiftright(key, 42).bitwiseAND(low)


def external(x: Column, y: Column, z: Column, top: tuple[int, int, int]) -> Column:
    """Whether a vertex lies on the border of a block: at zero in x or y, or at the top of any axis."""
    return (x == 0) | (y == 0) | (x == top[0]) | (y == top[1]) | (z == top[2])


def signed_field(v: Column, low: int, bits: int) -> Column:
    """A two's-complement field of a word."""
    return F.shiftright(F.shiftleft(v, 64 - low - bits), 64 - bits)


def unsigned_field(v: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(v, low).bitwiseAND(F.lit((1 << bits) - 1))


def leading_zeros(v: Column, bits: int = 32) -> Column:
    """Of a number that is not negative."""
    return F.lit(bits) - F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def float_bits(v: Column) -> Column:
    """The bits of a 32-bit float, from its sign, exponent and mantissa; NULL for NULL, NaN and infinities."""
    d = v.cast("float").cast("double")
    size = F.abs(d)
    exponent = F.floor(F.log2(size))
    exponent = F.when(F.pow(F.lit(2.0), exponent) > size, exponent - 1).when(F.pow(F.lit(2.0), exponent + 1) <= size, exponent + 1).otherwise(exponent)
    normal = F.shiftleft((exponent + 127).cast("long"), 23).bitwiseOR(F.round((size * F.pow(F.lit(2.0), -exponent) - 1) * F.lit(float(1 << 23))).cast("long"))
    tiny = F.round(size * F.lit(2.0**149)).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size < F.lit(2.0**-126), tiny).otherwise(normal)
    return F.when(F.isnan(d) | (size == F.lit(float("inf"))), F.lit(None)).otherwise(bits + F.when(d < 0, F.lit(1 << 31)).otherwise(F.lit(0).cast("long")))
