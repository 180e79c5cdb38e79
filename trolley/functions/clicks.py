"""Column expressions over click-log fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from trolley.schema import PURCHASED, Rules

_STRICT_TIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def parse_event_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[ UTC]`` as TIMESTAMP_NTZ; NULL for anything else.

    A checked cast needs no session time zone and throws nothing on bad rows.
    """
    bare = F.replace(text, F.lit(" UTC"), F.lit(""))
    return F.when(bare.rlike(_STRICT_TIME), bare.try_cast("timestamp_ntz"))


def positive(price: Column) -> Column:
    """0 < price < infinity; NaN compares as larger than that in Spark and so is out, too."""
    return (price > 0) & (price < F.lit(float("inf")))


def lost() -> Column:
    """The cart item was not purchased."""
    return F.col("outcome") != PURCHASED


def level_1(category_code: Column) -> Column:
    """Text before the first dot, 'unknown' for NULL."""
    return F.coalesce(F.substring_index(category_code, ".", 1), F.lit("unknown"))


def _ladder(steps: list[tuple[Column, str]]) -> Column:
    first, *rest = steps
    return reduce(lambda c, s: c.when(s[0], F.lit(s[1])), rest, F.when(first[0], F.lit(first[1])))


def report_bands(rules: Rules) -> list[str]:
    """Band labels of the SQL report: 'a. under 5', 'b. 5-10', ... 'e. 40+'."""
    e = rules.band_edges
    names = [f"under {e[0]}"] + [f"{lo}-{hi}" for lo, hi in zip(e, e[1:])] + [f"{e[-1]}+"]
    return [f"{chr(97 + i)}. {n}" for i, n in enumerate(names)]


def report_band(price: Column, rules: Rules) -> Column:
    """Every price falls in a band; the last one also takes NULL."""
    *lower, top = report_bands(rules)
    return _ladder([(price < hi, n) for hi, n in zip(rules.band_edges, lower)]).otherwise(F.lit(top))


def binned_bands(rules: Rules) -> list[str]:
    """Band labels of the binned frame: '<5', '5-10', ... '40+'."""
    e = rules.band_edges
    return [f"<{e[0]}"] + [f"{lo}-{hi}" for lo, hi in zip(e, e[1:])] + [f"{e[-1]}+"]


def binned_band(price: Column, rules: Rules) -> Column:
    """Half-open bins from 0 up to the ceiling; NULL outside of them."""
    edges = [0, *rules.band_edges, rules.band_ceiling]
    return _ladder([
        ((price >= lo) & (price < hi), n) for lo, hi, n in zip(edges, edges[1:], binned_bands(rules))
    ])


def position(value: Column, order: list[str]) -> Column:
    """1-based place of a value in a manual order; NULL when it is not listed."""
    return _ladder([(value == name, str(i)) for i, name in enumerate(order, 1)]).cast("int")
