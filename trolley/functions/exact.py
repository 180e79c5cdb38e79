"""Rounding and money on integers, so that ties never depend on binary fractions.

``round(double, n)`` breaks ties differently in every engine.  Here money is summed as whole cents and
every rounded figure is one integer division, half away from zero.  Arguments are SQL text, as a rule a
column name; results are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _half_up(a: str, b: str) -> str:
    """a / b as a whole number, half away from zero; NULL when b is 0.  b must not be negative."""
    divisor = f"nullif(2 * ({b}), 0)"
    return (
        f"CASE WHEN ({a}) < 0 THEN -((({b}) - 2 * ({a})) DIV {divisor}) "
        f"ELSE (({b}) + 2 * ({a})) DIV {divisor} END"
    )


def half_up(a: str, b: str, scale: int = 1) -> Column:
    """a / b rounded to a fraction of 1 / scale."""
    whole = _half_up(f"({a}) * {scale}", b) if scale > 1 else _half_up(a, b)
    return F.expr(f"({whole}) / {scale}D")


def cents(price: str) -> Column:
    """A price as whole cents (BIGINT)."""
    return F.expr(f"floor({price} * 100 + 0.5D)")


def money(total_cents: str) -> Column:
    """Cents as an amount with two decimals."""
    return F.expr(f"({total_cents}) / 100D")


def whole_money(total_cents: str) -> Column:
    """Cents rounded to whole units."""
    return half_up(total_cents, "100")


def mean_money(total_cents: str, n: str) -> Column:
    """Average amount, two decimals."""
    return F.expr(f"({_half_up(total_cents, n)}) / 100D")


def pct(part: str, whole: str, places: int = 2) -> Column:
    """100 * part / whole rounded to ``places`` decimals, exact for counts up to 10^20."""
    scaled = f"CAST({part} AS DECIMAL(20,0)) * {100 * 10**places}"
    return F.expr(f"({_half_up(scaled, f'CAST({whole} AS DECIMAL(20,0))')}) / {10**places}D")


def rate(part: str, whole: str) -> Column:
    """100 * part / whole, not rounded."""
    return F.expr(f"100D * ({part}) / nullif({whole}, 0)")


def mean_rate(rates: str, window: str = "") -> Column:
    """Plain mean of a few rates, to the millionth, summed as integers so that row order cannot matter.

    An aggregate, or with ``window`` (such as ``OVER ()``) a window function.
    """
    micro = f"floor({rates} * 1000000 + 0.5D)"
    return F.expr(f"({_half_up(f'sum({micro}) {window}', f'count({micro}) {window}')}) / 1000000D")
