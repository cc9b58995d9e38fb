"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gt_not_nan(c: Column, bound) -> Column:
    """``c > bound`` with Python semantics for NaN (NaN is never greater)."""
    return (c > F.lit(bound)) & ~F.isnan(c)


def safe_div(num: Column, den: Column) -> Column:
    """num/den, NULL when den is 0 or NULL (ANSI mode raises on x/0)."""
    return F.when(den != 0, num / den)


# Report precision: at most 6 decimals and at most 10 significant digits:
# x is reported as floor(x*s + 0.5)/s with s = 10^min(6, 9 - floor(log10|x|)).
# Only exact powers of ten and IEEE arithmetic are involved, so equal doubles
# round the same in any engine. |x| >= 1e11, 0, NaN and infinities are kept.
REPORT_MAX_DECIMALS = 6
REPORT_DIGITS = 10


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def round6_scale(name: str) -> Column:
    """The s of the report rounding (see above) of the double column ``name``.

    Numbers of few digits before the point, most of all, get the largest s
    without a power or a logarithm, which cost more than all else of a row. (Where
    log10 rounds up to the next whole number, both scales give the power of ten.)"""
    x = _quoted(name)
    few = 10.0 ** (REPORT_DIGITS - REPORT_MAX_DECIMALS)
    return F.expr(f"CASE WHEN abs({x}) < {few:.1f}D THEN {10.0 ** REPORT_MAX_DECIMALS:.1f}D "
                  f"ELSE pow(10.0D, least({float(REPORT_MAX_DECIMALS)}D, "
                  f"{float(REPORT_DIGITS - 1)}D - CAST(floor(log10(abs({x}))) AS DOUBLE))) END")


def round6(name: str, scale: str) -> Column:
    """Report rounding of the double column ``name`` by its ``scale`` (a
    column, so that it is computed once), parsed from one SQL expression: one
    JVM call instead of ~16 column objects."""
    x, s = _quoted(name), _quoted(scale)
    return F.expr(f"CASE WHEN abs({x}) > 0.0D AND abs({x}) < 1e11D THEN floor({x} * {s} + 0.5D) / {s} ELSE {x} END")


def round6_sql(expr: str) -> str:
    """The same report rounding as SQL text."""
    a = f"abs({expr})"
    s = (f"pow(10.0::DOUBLE, least({float(REPORT_MAX_DECIMALS)}::DOUBLE, "
         f"{float(REPORT_DIGITS - 1)}::DOUBLE - floor(log10({a}))))")
    return (f"CASE WHEN {a} > 0 AND {a} < 1e11 THEN floor(({expr}) * {s} + 0.5) / {s} "
            f"ELSE ({expr}) END")
