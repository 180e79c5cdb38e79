"""Weekly cohorts: which users come back, counted in buckets of days from the first day of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trolley.functions.exact import mean_rate, rate
from trolley.operators.model import human_sessions
from trolley.schema import Rules

_SLICES = 64


def first_day(sessions: DataFrame) -> Column:
    """The earliest day with a session that is not a bot, as a scalar subquery."""
    return human_sessions(sessions).agg(F.to_date(F.min("session_start"))).scalar()


def session_weeks(sessions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Sessions with their day and bucket; buckets after the last one are left out."""
    days = F.datediff("day", first_day(sessions))
    return (
        human_sessions(sessions)
        .select("user_id", "user_session", "session_start", F.to_date("session_start").alias("day"))
        .withColumn("week", F.floor(days / rules.cohort_days).cast("int"))
        .filter(F.col("week") <= rules.last_cohort)
    )


def user_cohorts(sessions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every session in a bucket with its user's first bucket and the distance from it.

    The first bucket is found over at most ``_SLICES`` rows per user and joined back by (user, slice), so
    the sessions of a user who owns a large part of them spread over that many shuffle keys.
    """
    weeks = (
        session_weeks(sessions, rules)
        .filter(F.col("user_id").isNotNull())
        .withColumn("slice", F.pmod(F.hash("user_session"), F.lit(_SLICES)))
    )
    firsts = (
        weeks.groupBy("user_id", "slice")
        .agg(F.min("week").alias("week"))
        .select("user_id", "slice", F.min("week").over(Window.partitionBy("user_id")).alias("cohort"))
    )
    return (
        weeks.join(firsts, ["user_id", "slice"])
        .withColumn("k", F.col("week") - F.col("cohort"))
        .drop("slice")
    )


def cohort_counts(sessions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Users per cohort and distance as columns week_0, week_1, ...; NULL where there is no user.

    Each user shrinks to the set of buckets with a session, no larger than their number, in a single map-side
    reduced aggregate.  No distinct count is needed.
    """
    buckets = range(rules.last_cohort + 1)
    users = (
        session_weeks(sessions, rules)
        .filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.collect_set("week").alias("weeks"))
        .withColumn("cohort", F.array_min("weeks"))
    )
    returned = [
        F.count_if(F.array_contains("weeks", F.col("cohort") + k)).alias(f"week_{k}") for k in buckets
    ]
    counts = users.groupBy("cohort").agg(*returned)
    return counts.select(
        "cohort", *[F.nullif(F.col(f"week_{k}"), F.lit(0)).alias(f"week_{k}") for k in buckets]
    ).orderBy("cohort")


def weekly_retention(
    sessions: DataFrame, rules: Rules = Rules(), counts: DataFrame | None = None
) -> DataFrame:
    """Share of each cohort seen again k buckets later, in percent; ``counts`` are those of ``cohort_counts``.

    A cell without a returning user is NULL, whether or not the bucket lies inside the log; the column
    ``observable`` tells how many later buckets the cohort could have shown.
    """
    starts = F.date_add(first_day(sessions), F.col("cohort") * rules.cohort_days)
    returns = [
        rate(f"week_{k}", "week_0").alias(f"week_{k}_pct")
        for k in range(1, rules.last_cohort + 1)
    ]
    counts = cohort_counts(sessions, rules) if counts is None else counts
    return counts.select(
        "cohort",
        F.date_format(starts, "dd MMM").alias("first_seen"),
        *returns,
        (F.lit(rules.last_cohort) - F.col("cohort")).alias("observable"),
    )


def week1_return(sessions: DataFrame, rules: Rules = Rules(), counts: DataFrame | None = None) -> DataFrame:
    """Plain mean of the week-1 shares of the cohorts that have one; NULL when none has."""
    return weekly_retention(sessions, rules, counts).agg(mean_rate("week_1_pct").alias("week1_return_pct"))


def cohort_sizes(sessions: DataFrame, rules: Rules = Rules(), counts: DataFrame | None = None) -> DataFrame:
    counts = cohort_counts(sessions, rules) if counts is None else counts
    return counts.select("cohort", F.col("week_0").alias("users"))
