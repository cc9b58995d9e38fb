"""Critical values of the unit-root test as column expressions.

Response surface c(m) = b0 + b1/m + b2/m^2 + b3/m^3 for one observed series
with a constant (MacKinnon 2010, N = 1, "c"); m = observations in the test
regression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# MacKinnon (2010) response-surface coefficients, N = 1, constant,
# in order b0, b1, b2, b3.
CRIT_COEFFS = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def critical_value(level: str, m: Column) -> Column:
    """Critical value at ``level`` for ``m`` observations (NULL when m <= 0)."""
    if level not in CRIT_COEFFS:
        raise ValueError(f"unknown level {level!r}")
    b0, b1, b2, b3 = CRIT_COEFFS[level]
    inv = F.try_divide(F.lit(1.0), m.cast("double"))
    return F.lit(b0) + inv * (F.lit(b1) + inv * (F.lit(b2) + inv * F.lit(b3)))


def critical_value_sql(level: str, m: str) -> str:
    """The same polynomial as SQL text (for the oracle)."""
    b0, b1, b2, b3 = CRIT_COEFFS[level]
    inv = f"(1.0 / nullif({m}, 0))"
    return f"({b0} + {inv} * ({b1} + {inv} * ({b2} + {inv} * ({b3}))))"


def critical_value_py(level: str, m: int) -> float:
    b0, b1, b2, b3 = CRIT_COEFFS[level]
    inv = 1.0 / m
    return b0 + inv * (b1 + inv * (b2 + inv * b3))
