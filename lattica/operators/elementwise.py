"""Operators between cells: arithmetic, extremes, comparisons, bits, complex numbers.

Each takes columns (so that array-array, array-number and number-array forms are one) and gives a column.
Integer division truncates, `fdiv` and `fmod` floor, `smod` is the symmetric remainder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.ndarray import NdArray

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def sub(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def mul(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def idiv(a: Column, b: Column) -> Column:
    """Truncating quotient of whole numbers; null where b is 0."""
    return F.when(b != 0, F.call_function("div", a.cast("bigint"), b.cast("bigint")))


def div(a: Column, b: Column, whole: bool = False) -> Column:
    return idiv(a, b) if whole else F.try_divide(a, b)


def fdiv(a: Column, b: Column, whole: bool = False) -> Column:
    """Floor of the quotient; of `whole` numbers exact at any size."""
    rest = a - fmod(a, b)
    return idiv(rest, b) if whole else F.when(b != 0, F.floor(rest / b))


def fmod(a: Column, b: Column) -> Column:
    """a - b floor(a / b): the remainder with the sign of b."""
    rest = a % b
    return F.when(b != 0, F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest))


def smod(a: Column, b: Column) -> Column:
    """Remainder of least size: v = a % b, less b if 2 v > b."""
    v = F.pmod(a, b)
    return F.when(b != 0, F.when(2 * v > b, v - b).otherwise(v))


def sdiv(a: Column, b: Column) -> Column:
    """The quotient that goes with `smod`."""
    return idiv(a - smod(a, b), b)


def quotient_remainder(a: Column, b: Column) -> Column:
    """Struct (quot, rem) with a remainder of 0 or more."""
    rem = F.pmod(a, F.abs(b))
    return F.struct(idiv(a - rem, b).alias("quot"), rem.alias("rem"))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def larger(a: Column, b: Column) -> Column:
    """The larger of two; NaN if either is NaN."""
    return F.when(F.isnan(a.cast("double")) | F.isnan(b.cast("double")), F.lit(float("nan"))).otherwise(F.greatest(a, b))


def smaller(a: Column, b: Column) -> Column:
    """The smaller of two; NaN if either is NaN."""
    return F.when(F.isnan(a.cast("double")) | F.isnan(b.cast("double")), F.lit(float("nan"))).otherwise(F.least(a, b))


def eq(a: Column, b: Column) -> Column:
    return (a == b).cast("int")


def ne(a: Column, b: Column) -> Column:
    return (a != b).cast("int")


def ge(a: Column, b: Column) -> Column:
    return (a >= b).cast("int")


def gt(a: Column, b: Column) -> Column:
    return (a > b).cast("int")


def le(a: Column, b: Column) -> Column:
    return (a <= b).cast("int")


def lt(a: Column, b: Column) -> Column:
    return (a < b).cast("int")


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def andif(a: Column, b: Column) -> Column:
    """1 where both are not 0; b counts only where a holds."""
    return F.when(a != 0, (b != 0).cast("int")).otherwise(0)


def orif(a: Column, b: Column) -> Column:
    return F.when(a != 0, 1).otherwise((b != 0).cast("int"))


def not_(a: Column) -> Column:
    """1 where 0, else 0."""
    return (a == 0).cast("int")


def neg(a: Column) -> Column:
    return -a


def hamming(a: Column, b: Column | None = None) -> Column:
    """Number of differing bits, or of set bits."""
    return F.bit_count(a if b is None else a.bitwiseXOR(b))


def extract_bits(a: Column, start: int, width: int) -> Column:
    """Bits start .. start + width - 1; a negative width extends the sign of the field's top bit."""
    n = abs(width)
    field = F.shiftrightunsigned(a.cast("bigint"), start).bitwiseAND(F.lit((1 << n) - 1))
    return field if width > 0 else F.when(field >= (1 << (n - 1)), field - (1 << n)).otherwise(field)


def zinv(a: Column) -> Column:
    """1 / a, but 0 where a is 0."""
    return F.when(a == 0, F.lit(0.0)).otherwise(1 / F.nullif(a, F.lit(0)))


def poly(x: Column, coefficients: list[float]) -> Column:
    """Sum of coefficients[k] x^k, by Horner's rule."""
    return reduce(lambda acc, c: acc * x + F.lit(float(c)), reversed(coefficients), F.lit(0.0))


def to_byte(a: Column) -> Column:
    """Unsigned 8-bit value (0 to 255, wrapping) of a number cut to a whole."""
    return a.cast("bigint").bitwiseAND(F.lit(255)).cast("smallint")


def wrapped(a: Column, bits: int) -> Column:
    """Signed value of the low `bits` bits of a number cut to a whole."""
    low = a.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(low >= (1 << (bits - 1)), low - (1 << bits)).otherwise(low)


def rfix(a: Column) -> Column:
    """Nearest 32-bit whole number, halves away from zero."""
    return F.round(a).cast("int")


def swab(a: Column, width: int) -> Column:
    """The value with its `width` bytes in reverse order, unsigned."""
    x = a.cast("bigint")
    out = F.lit(0).cast("bigint")
    for k in range(width):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)), 8 * (width - 1 - k)))
    return out


def set_nan(a: Column, mask: Column) -> Column:
    return F.when(mask != 0, F.lit(float("nan"))).otherwise(a)


def zero_nans(a: Column, value: float = 0.0) -> Column:
    return F.nanvl(a.cast("double"), F.lit(float(value)))


# Complex numbers are structs (re, im).


def cplx(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def cadd(a: Column, b: Column) -> Column:
    return cplx(a["re"] + b["re"], a["im"] + b["im"])


def cmul(a: Column, b: Column) -> Column:
    return cplx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conjugate(a: Column) -> Column:
    return cplx(a["re"], -a["im"])


def complex_square(a: Column) -> Column:
    """a times its conjugate, a real number."""
    return a["re"] * a["re"] + a["im"] * a["im"]


def arg(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def cabs(a: Column) -> Column:
    return F.sqrt(complex_square(a))


def root3(a: Column, b: Column, c: Column) -> Column:
    """The real roots of x^3 + a x^2 + b x + c, ascending (one or three)."""
    q, r = (a * a - 3 * b) / 9, (2 * a * a * a - 9 * a * b + 27 * c) / 54
    three = r * r < q * q * q
    theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r / F.sqrt(F.pow(F.greatest(q, F.lit(1e-300)), F.lit(3.0))))))
    roots = F.array_sort(F.array(*(-2 * F.sqrt(q) * F.cos((theta + 2 * k * 3.141592653589793) / 3) - a / 3 for k in (0, 1, -1))))
    s = -F.signum(r) * F.cbrt(F.abs(r) + F.sqrt(F.greatest(r * r - q * q * q, F.lit(0.0))))
    return F.when(three, roots).otherwise(F.array(s + F.when(s == 0, 0.0).otherwise(q / s) - a / 3))


def apply(a: NdArray, op, b: NdArray | float) -> NdArray:
    """op cell by cell, with an array or a number on the right."""
    return a.zip(b, op) if isinstance(b, NdArray) else a.map(lambda v: op(v, F.lit(b)))
