"""Cleaning of the raw click log and the audit of what it drops.

The order matters: rows that could not be read first, then unparsable times, double-fired events, events without
a session, and events without a positive finite price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trolley.functions.clicks import parse_event_time, positive
from trolley.schema import ARRIVAL, EVENT_COLUMNS, EVENT_KEY, RAGGED, UNREADABLE

# Which of several copies stays: the first to arrive where the log tells; else one with a usable price before one
# without, then the least in these columns, NULL first.
_TIE_BREAK = ["price", "category_id", "brand", "category_code"]


def with_event_time(raw: DataFrame) -> DataFrame:
    return raw.withColumn("event_time", parse_event_time(F.col("event_time")))


_FOLDED = [*EVENT_KEY, "month", "fault"]


def fold(raw: DataFrame) -> DataFrame:
    """One row per event key, month and fault: the copy that stays (``kept``) and how many there are (``copies``).

    A grouped aggregate combines copies before the shuffle, so a key repeated in a third of all rows
    leaves one row per map task.  The shuffle key is the whole event key: neither a busy session nor the
    NULL session gathers in one task.  Rows whose time cannot be parsed keep ``event_time`` NULL.  Rows that the
    source marked with a ``fault`` stay apart from the others.

    The result is a partial one: folds of any parts of a log, in any order, give the whole log's by ``merge_folds``.
    """
    if "fault" not in raw.columns:
        raw = raw.withColumn("fault", F.lit(None).cast("string"))
    unusable = ~F.coalesce(positive(F.col("price")), F.lit(False))
    order = [c for c in ARRIVAL if c in raw.columns] + ["unusable", *_TIE_BREAK]
    return (
        with_event_time(raw)
        .withColumn("unusable", unusable)
        .groupBy(*_FOLDED)
        .agg(F.min(F.struct(*order)).alias("kept"), F.count("*").alias("copies"))
    )


def merge_folds(folds: DataFrame) -> DataFrame:
    """The fold of all parts from the folds of each."""
    return folds.groupBy(*_FOLDED).agg(F.min("kept").alias("kept"), F.sum("copies").alias("copies"))


def events_of(fold: DataFrame) -> DataFrame:
    """The events of a fold, each with its number of copies."""
    columns = [F.col(c) if c in EVENT_KEY else F.col(f"kept.{c}") for c in EVENT_COLUMNS]
    return fold.select(*columns, "copies", "fault", "month")


def collapse_copies(raw: DataFrame) -> DataFrame:
    """One row per event key and month, with the number of raw rows behind it in ``copies``."""
    return events_of(fold(raw))


def _timed() -> Column:
    return F.col("fault").isNull() & F.col("event_time").isNotNull()


def _placed() -> Column:
    return _timed() & F.col("user_session").isNotNull()


def _kept() -> Column:
    return _placed() & positive(F.col("price"))


def dedup_events(collapsed: DataFrame) -> DataFrame:
    """Events with a time, without the double-fired copies."""
    return collapsed.filter(_timed()).drop("copies", "fault")


def clean_events(collapsed: DataFrame) -> DataFrame:
    """The event fact: parsed, unique, in a session and with a price."""
    return collapsed.filter(_kept()).drop("copies", "fault")


def cleaning_audit(collapsed: DataFrame) -> DataFrame:
    """Rows dropped per month and reason; a reason that dropped nothing has no row."""
    infinite = F.col("price") == F.lit(float("inf"))
    bad_price = _placed() & ~F.coalesce(positive(F.col("price")) | infinite, F.lit(False))
    reasons = {
        "double_fired": F.sum(F.when(_timed(), F.col("copies") - 1)),
        "null_session": F.count_if(_timed() & F.col("user_session").isNull()),
        "price_not_positive": F.count_if(bad_price),
        "price_not_finite": F.count_if(_placed() & infinite),
        RAGGED: F.sum(F.when(F.col("fault") == RAGGED, F.col("copies"))),
        UNREADABLE: F.sum(F.when(F.col("fault") == UNREADABLE, F.col("copies"))),
    }
    per_month = collapsed.groupBy("month").agg(*[count.alias(name) for name, count in reasons.items()])
    return (
        per_month.unpivot("month", [*reasons], "drop_reason", "dropped")
        .filter("dropped > 0")
        .orderBy("month", "drop_reason")
    )


def time_audit(collapsed: DataFrame) -> DataFrame:
    """Rows per month whose time cannot be parsed; months without any have no row.

    They are dropped before the audit of ``cleaning_audit``, which does not list them.
    """
    unreadable = collapsed.filter(F.col("event_time").isNull() & F.col("fault").isNull())
    return unreadable.groupBy("month").agg(F.sum("copies").alias("dropped")).orderBy("month")


def row_retention(collapsed: DataFrame) -> DataFrame:
    """Rows out, rows in and their ratio (NULL for an empty log)."""
    counts = collapsed.agg(
        F.count_if(_kept()).alias("total_out"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_in"),
    )
    return counts.withColumn("retention", F.try_divide("total_out", "total_in"))


def cleaning_log(audit: DataFrame, retention: DataFrame, bots: DataFrame) -> DataFrame:
    """(step, message) pairs of the audit figures, ready to be written as a text table."""
    dropped = audit.select(
        F.concat_ws(": ", "month", F.concat(F.lit("dropped "), "drop_reason")).alias("step"),
        F.format_string("%,d rows", "dropped").alias("message"),
    )
    share = F.coalesce(F.format_string(" (%.1f%%)", 100 * F.col("retention")), F.lit(""))
    kept = retention.select(
        F.lit("row retention").alias("step"),
        F.concat(F.format_string("%,d of %,d raw events kept", "total_out", "total_in"), share).alias("message"),
    )
    flagged = bots.select(
        F.lit("flagged bot sessions").alias("step"),
        F.format_string("%,d sessions, %,d events", "bot_sessions", "bot_events").alias("message"),
    )
    return dropped.unionByName(kept).unionByName(flagged)
