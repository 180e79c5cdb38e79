"""The analysis frames: funnel stages, price bands, hours, visits, value and the summary.

``items`` is the output of ``model.human_items``.  The published analysis joins it to products and users,
which only drops items without a product or user id; ``analysed`` applies that as a filter, and the two
joins run only where their columns are shown.

``profile`` is the output of ``item_profile``: the items counted by band, hour and outcome.  It has a few
hundred rows whatever the size of the log, and most frames are sums over it, so one pass over the items
serves them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from trolley.functions.clicks import binned_band, lost
from trolley.functions.exact import cents, mean_rate, money, pct, rate
from trolley.operators.cohorts import week1_return
from trolley.operators.conversion import early_visits, session_outcomes
from trolley.operators.model import human_sessions
from trolley.schema import CART, PURCHASE, PURCHASED, REMOVE, REMOVED, SILENT, STAGES, VIEW, Rules

def _record(one_row: DataFrame) -> Column:
    """A one-row frame as a scalar subquery, to be set beside other figures without a join."""
    return one_row.select(F.struct("*")).scalar()


def analysed(items: DataFrame) -> DataFrame:
    return items.filter(F.col("product_id").isNotNull() & F.col("user_id").isNotNull())


def banded_items(items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The items with their price band: as much of the dashboard table as the views count."""
    return analysed(items).withColumn("price_band", binned_band(F.col("price"), rules))


def cart_item_base(items: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """Items with the product's brand and category and the user's first month."""
    return (
        analysed(items)
        .join(products.select("product_id", "brand", "category_id"), "product_id")
        .join(users.select("user_id", "cohort_month"), "user_id")
        .select(
            "user_session", "product_id", "user_id", "carted_at", "price", "removed_at",
            "purchased_at", "outcome", "seconds_to_purchase", "start_hour", "n_views", "n_carts",
            "is_bot", "brand", "category_id", "cohort_month", lost().alias("abandoned"),
        )
    )


def event_type_volume(events: DataFrame, sessions: DataFrame, bots: DataFrame) -> DataFrame:
    """Events and distinct sessions per event type, without bots.

    The four known types come from the counters of the session table.  The event table is asked only for
    other types and missing ones, a filter that reaches its files and as a rule leaves little to shuffle.
    """
    counters = {VIEW: "n_views", CART: "n_carts", REMOVE: "n_removes", PURCHASE: "n_purchases"}
    totals = human_sessions(sessions).agg(
        *[F.struct(F.lit(t).alias("event_type"), F.coalesce(F.sum(c), F.lit(0)).alias("events"),
                   F.count_if(F.col(c) > 0).alias("sessions")).alias(c) for t, c in counters.items()]
    )
    known = totals.select(F.inline(F.array(*counters.values()))).filter("events > 0")
    others = (
        events.filter(F.col("event_type").isNull() | ~F.col("event_type").isin(*counters))
        .groupBy("event_type", "user_session")
        .agg(F.count("*").alias("n"))
        .join(bots.select("user_session"), "user_session", "left_anti")
        .groupBy("event_type")
        .agg(F.sum("n").alias("events"), F.count("*").alias("sessions"))
    )
    return known.unionByName(others)


def analysis_scope(items: DataFrame) -> DataFrame:
    """Items, users and sessions.  Each distinct count is a count over groups that the map side has reduced."""
    known = analysed(items)
    per_user = known.groupBy("user_id").agg(F.count("*").alias("n"))
    sessions = known.groupBy("user_session").agg(F.lit(1)).agg(F.count("*")).scalar()
    return per_user.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.count("*").alias("users")).withColumn(
        "sessions", sessions)


def funnel_stages(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """View events, carted items and purchased items: the first stage counts events, the others items."""
    views = human_sessions(sessions).agg(F.coalesce(F.sum("n_views"), F.lit(0))).scalar()
    counts = analysed(items).agg(
        F.count("*").alias("carted"), F.count_if(~lost()).alias("bought")
    ).select(views.alias("viewed"), "carted", "bought")
    numbers = zip(STAGES, ("viewed", "carted", "bought"))
    stages = counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("stage_order"), F.lit(stage).alias("stage"), F.col(c).alias("n"))
        for i, (stage, c) in enumerate(numbers, 1)
    ])))
    before = F.lag("n").over(Window.orderBy("stage_order"))
    return (
        stages.withColumn("before", before)
        .withColumn("pct_prev", pct("n", "before", 1))
        .drop("before")
    )


def item_profile(items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Items and their value in cents by price band, start hour and outcome."""
    return (
        banded_items(items, rules)
        .groupBy("price_band", "start_hour", "outcome")
        .agg(F.count("*").alias("n"), F.sum(cents("price")).alias("cents"))
    )


def _n(condition: Column | None = None) -> Column:
    """Aggregate over a profile: the items that meet a condition."""
    n = F.col("n") if condition is None else F.when(condition, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0))


def _outcome(name: str) -> Column:
    return F.col("outcome") == name


def price_band_mix(profile: DataFrame, rules: Rules = Rules()) -> DataFrame:
    shares = {"pct_purchased": PURCHASED, "pct_removed": REMOVED, "pct_silent": SILENT}
    return (
        profile.filter(F.col("price_band").isNotNull())
        .groupBy("price_band")
        .agg(_n().alias("items"), *[_n(_outcome(o)).alias(o) for o in shares.values()])
        .filter(F.col("items") >= rules.band_min_items)
        .select("price_band", "items", *[rate(o, "items").alias(c) for c, o in shares.items()])
    )


def hour_profile(profile: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Items and abandoned share per start hour, for hours with enough items."""
    return (
        profile.groupBy("start_hour")
        .agg(_n().alias("items"), _n(lost()).alias("lost"))
        .filter(F.col("items") >= rules.hour_min_items)
        .select("start_hour", "items", rate("lost", "items").alias("pct_abandoned"))
    )


def hour_profile_local(items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The hour profile on the clock of the shop instead of UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(rules.local_zone), F.col("session_start"))
    per_hour = (
        analysed(items)
        .groupBy(F.hour(local).alias("start_hour"), "outcome")
        .agg(F.count("*").alias("n"))
    )
    return hour_profile(per_hour, rules)


def hour_highlight(profile: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Hours whose rate lies the margin or more above the plain mean of the hourly rates."""
    return (
        hour_profile(profile, rules)
        .withColumn("mean_pct", mean_rate("pct_abandoned", "OVER ()"))
        .withColumn("exact", F.avg("pct_abandoned").over(Window.partitionBy()))
        .withColumn("highlighted", F.col("pct_abandoned") >= F.col("exact") + rules.hour_margin)
        .drop("exact")
    )


def price_band_spread(profile: DataFrame, rules: Rules = Rules()) -> DataFrame:
    unsold = F.lit(100.0) - F.col("pct_purchased")
    return (
        price_band_mix(profile, rules)
        .agg(F.min(unsold).alias("min_pct"), F.max(unsold).alias("max_pct"))
        .withColumn("spread", F.col("max_pct") - F.col("min_pct"))
    )


def hour_extremes(profile: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Hours with the highest and lowest rate, the earlier hour on ties."""
    hour, value = F.col("start_hour"), F.col("pct_abandoned")
    return (
        hour_profile(profile, rules)
        .agg(
            F.max_by(hour, F.struct(value, -hour)).alias("peak_hour"),
            F.max(value).alias("peak_pct"),
            F.min_by(hour, F.struct(value, hour)).alias("trough_hour"),
            F.min(value).alias("trough_pct"),
        )
        .withColumn("difference", F.col("peak_pct") - F.col("trough_pct"))
    )


def first_vs_returning(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Abandoned share on a user's first visit and on later ones."""
    visit = F.when(F.col("session_no") == 1, "first").otherwise("returning")
    return (
        session_outcomes(items)
        .join(early_visits(sessions, 1), "user_session", "left")
        .groupBy(visit.alias("visit"))
        .agg(F.sum("lost").alias("lost"), F.sum("items").alias("items"))
        .select("visit", rate("lost", "items").alias("pct_abandoned"))
    )


def outcome_share(profile: DataFrame) -> DataFrame:
    """Shares of the three outcomes in percent, and silent per removed item."""
    shares = {"pct_purchased": PURCHASED, "pct_removed": REMOVED, "pct_silent": SILENT}
    counts = profile.agg(_n().alias("n"), *[_n(_outcome(o)).alias(o) for o in shares.values()])
    return counts.select(
        *[F.coalesce(rate(o, "n"), F.lit(0.0)).alias(c) for c, o in shares.items()],
        F.try_divide(SILENT, REMOVED).alias("silent_per_removed"),
    )


def value_lost_vs_won(profile: DataFrame) -> DataFrame:
    def value(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("cents"))), F.lit(0))

    totals = profile.agg(value(lost()).alias("lost"), value(~lost()).alias("won")).select(
        money("lost").alias("lost_value"), money("won").alias("won_value")
    )
    return totals.withColumn("lost_per_won", F.col("lost_value") / F.greatest("won_value", F.lit(1.0)))


def headline_abandonment(profile: DataFrame) -> DataFrame:
    counts = profile.agg(_n(lost()).alias("lost"), _n().alias("n"))
    return counts.select(rate("lost", "n").alias("pct_abandoned"))


def _visits_record(visits: DataFrame) -> DataFrame:
    """The rates of first and returning visits side by side."""
    is_first = F.col("visit") == "first"
    return visits.agg(
        F.max(F.when(is_first, F.col("pct_abandoned"))).alias("first_pct"),
        F.max(F.when(~is_first, F.col("pct_abandoned"))).alias("returning_pct"),
    )


def findings_summary(
    sessions: DataFrame, items: DataFrame, profile: DataFrame, rules: Rules = Rules(),
    counts: DataFrame | None = None, visits: DataFrame | None = None,
) -> DataFrame:
    """One row with every headline figure.

    ``counts`` (of ``cohort_counts``) and ``visits`` (of ``first_vs_returning``) are computed where not given.
    """
    visits = first_vs_returning(sessions, items) if visits is None else visits
    facts = analysis_scope(items).select(
        "items",
        "users",
        _record(headline_abandonment(profile)).alias("headline"),
        _record(value_lost_vs_won(profile)).alias("value"),
        _record(outcome_share(profile)).alias("share"),
        _record(week1_return(sessions, rules, counts)).alias("cohort"),
        _record(price_band_spread(profile, rules)).alias("band"),
        _record(_visits_record(visits)).alias("visit"),
        _record(hour_extremes(profile, rules)).alias("hour"),
    )
    return facts.select(
        "items",
        "users",
        "headline.pct_abandoned",
        "value.lost_value",
        "value.won_value",
        "value.lost_per_won",
        "share.pct_removed",
        "share.pct_silent",
        "cohort.week1_return_pct",
        F.col("band.min_pct").alias("band_min_pct"),
        F.col("band.max_pct").alias("band_max_pct"),
        F.col("band.spread").alias("band_spread"),
        "visit.first_pct",
        "visit.returning_pct",
        "hour.peak_hour",
        "hour.peak_pct",
        "hour.trough_hour",
        "hour.trough_pct",
    )


def hypothesis_table(
    sessions: DataFrame, items: DataFrame, profile: DataFrame, rules: Rules = Rules(),
    visits: DataFrame | None = None,
) -> DataFrame:
    """The three hypotheses with the two figures that judge each and their difference."""
    visits = first_vs_returning(sessions, items) if visits is None else visits
    rows = [
        ("price", price_band_spread(profile, rules), "min_pct", "max_pct"),
        ("first visit", _visits_record(visits), "first_pct", "returning_pct"),
        ("time of day", hour_extremes(profile, rules), "trough_pct", "peak_pct"),
    ]
    return reduce(DataFrame.unionByName, [
        df.select(
            F.lit(name).alias("hypothesis"),
            F.col(a).alias("pct_a"),
            F.col(b).alias("pct_b"),
            (F.col(b) - F.col(a)).alias("difference"),
        )
        for name, df, a, b in rows
    ])


def dashboard_export(base: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The flat table behind the dashboards, from ``cart_item_base``."""
    return base.select(
        "user_session", "product_id", "user_id", "carted_at", "price",
        binned_band(F.col("price"), rules).alias("price_band"),
        "outcome", "abandoned", "brand", "start_hour", "n_views", "n_carts", "cohort_month",
        "seconds_to_purchase",
        F.to_date("carted_at").alias("cart_date"),
        F.date_format("carted_at", "EEEE").alias("weekday"),
    )
