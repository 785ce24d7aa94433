"""Numeric helpers (``Column -> Column``)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE_BITS = 60


def round_binary_half_even(x, digits: int = 2) -> Column:
    """``round(x, digits)`` as Python computes it: half-to-even on the exact binary value.

    ``bround`` rounds the shortest decimal spelling instead, so for ratios such
    as 59/200 (stored a hair below 0.295) it goes the other way. Valid for
    |x| < 8 (scores, ratios): the double is scaled by 2**60, which is exact,
    and the rounding is decided with integer/decimal arithmetic.
    """
    if not 0 <= digits <= 6:
        raise ValueError("digits must be within 0..6")
    c = F.col(x) if isinstance(x, str) else x
    a = F.abs(c)
    den = F.lit(2 ** _SCALE_BITS).cast("decimal(38,0)")
    m = (a * float(2 ** _SCALE_BITS)).cast("long").cast("decimal(38,0)")
    num = m * F.lit(10 ** digits).cast("decimal(38,0)")
    q = F.floor(num / den).cast("decimal(38,0)")
    rem2 = (num - q * den) * F.lit(2).cast("decimal(38,0)")
    up = (rem2 > den) | ((rem2 == den) & (q % 2 == 1))
    qr = F.when(up, q + 1).otherwise(q).cast("double") / float(10 ** digits)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.signum(c) * qr)
