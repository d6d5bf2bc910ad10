"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 52  # of a fraction held exactly as a whole number
_HALF_BITS = 26


def fixed(c: Column | str, digits: int) -> Column:
    """A number with ``digits`` (1 to 6) decimals, rounded by its exact binary value and at ties to even, as ``printf`` does.

    ``format_string`` rounds the shortest decimal form of a number, half up: 0.3915 is a little
    below the tie and becomes 0.392 there.
    """
    if not 1 <= digits <= 6:
        raise ValueError(f"digits must be 1 to 6, not {digits}")
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    size = F.abs(c)
    whole = F.floor(size)
    scaled = (size - whole) * float(1 << _BITS)  # exact: the difference and a power of two
    n = F.floor(scaled)
    low = F.pmod(n, F.lit(1 << _HALF_BITS)) * 10**digits
    high = F.shiftright(n, _HALF_BITS) * 10**digits + F.shiftright(low, _HALF_BITS)
    units = F.shiftright(high, _HALF_BITS)
    rest = F.pmod(high, F.lit(1 << _HALF_BITS)) * (1 << _HALF_BITS) + F.pmod(low, F.lit(1 << _HALF_BITS))
    half = F.lit(1 << (_BITS - 1))
    # what is below 2**-52 decides only between a tie and more than that
    up = (rest > half) | ((rest == half) & ((scaled > n) | (F.pmod(units, F.lit(2)) == 1)))
    units = units + up.cast("bigint")
    carry = (units >= 10**digits).cast("bigint")
    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    text = F.format_string(f"%s%d.%0{digits}d", sign, whole + carry, units - carry * 10**digits)
    return F.when(size < 9e18, text).otherwise(F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c)))
