"""Headline figures and the six report queries.

``items`` is the output of ``model.human_items`` (no bots) unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trolley.functions.clicks import lost, report_band
from trolley.functions.exact import cents, half_up, mean_money, pct, whole_money
from trolley.operators.model import human_sessions
from trolley.schema import PURCHASED, REMOVED, SILENT, UNKNOWN, Rules

def _n(condition: Column) -> Column:
    return F.count_if(condition)


def _total_cents(condition: Column | None = None) -> Column:
    value = cents("price")
    return F.sum(value if condition is None else F.when(condition, value))


def _session_counts(sessions: DataFrame) -> DataFrame:
    """Sessions, carting sessions and buying sessions, from the counters of the session table."""
    return human_sessions(sessions).agg(
        F.count("*").alias("sessions"),
        _n(F.col("n_carts") > 0).alias("with_cart"),
        _n(F.col("n_purchases") > 0).alias("with_purchase"),
    )


def session_funnel(sessions: DataFrame) -> DataFrame:
    """Sessions that came, carted and bought.  A buyer need not have carted in the same session."""
    buyers_per_carter = F.col("with_purchase") / F.greatest(F.col("with_cart"), F.lit(1))
    return _session_counts(sessions).select(
        "sessions",
        "with_cart",
        "with_purchase",
        F.try_divide("with_cart", "sessions").alias("cart_ratio"),
        buyers_per_carter.alias("purchase_ratio"),
        (1 - buyers_per_carter).alias("session_abandonment"),
    )


def outcome_distribution(all_items: DataFrame) -> DataFrame:
    """Items per outcome over all sessions, bots included."""
    everything = Window.partitionBy()
    total = F.sum("cart_items").over(everything)
    unsold = F.sum(F.when(lost(), F.col("cart_items")).otherwise(0)).over(everything)
    return (
        all_items.groupBy("outcome")
        .agg(F.count("*").alias("cart_items"))
        .select(
            "outcome",
            "cart_items",
            (F.col("cart_items") / total).alias("share"),
            (unsold / total).alias("item_abandonment"),
        )
        .orderBy(F.desc("cart_items"), "outcome")
    )


def funnel_both_grains(sessions: DataFrame, items: DataFrame) -> DataFrame:
    by_session = _session_counts(sessions).select(
        F.lit("session").alias("grain"),
        F.col("sessions").alias("reached_view"),
        F.col("with_cart").alias("reached_cart"),
        F.col("with_purchase").alias("reached_purchase"),
    )
    by_item = items.agg(
        F.count("*").alias("reached_cart"),
        F.sum((F.col("outcome") == PURCHASED).cast("bigint")).alias("reached_purchase"),
    ).select(
        F.lit("cart item").alias("grain"),
        F.lit(None).cast("bigint").alias("reached_view"),
        "reached_cart",
        "reached_purchase",
    )
    return by_session.unionByName(by_item).withColumn(
        "pct_cart_to_purchase", pct("reached_purchase", "reached_cart")
    )


def abandonment_by_price_band(items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    groups = items.groupBy(report_band(F.col("price"), rules).alias("price_band")).agg(
        F.count("*").alias("cart_items"),
        *[_n(F.col("outcome") == o).alias(o) for o in (PURCHASED, REMOVED, SILENT)],
        _total_cents(lost()).alias("lost_cents"),
    )
    return groups.select(
        "price_band",
        "cart_items",
        pct(PURCHASED, "cart_items").alias("pct_purchased"),
        pct(REMOVED, "cart_items").alias("pct_removed"),
        pct(SILENT, "cart_items").alias("pct_silent"),
        whole_money("lost_cents").alias("abandoned_value"),
    ).orderBy("price_band")


def abandonment_by_brand(items: DataFrame, products: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Brands with the most abandoned value among those with enough items.

    Items are summed per product before they meet the product table, so the join sees one row per
    product however popular one product is.
    """
    measures = {
        "cart_items": F.count("*"),
        "lost": _n(lost()),
        "cents": _total_cents(),
        "lost_cents": _total_cents(lost()),
    }
    per_product = items.groupBy("product_id").agg(*[m.alias(c) for c, m in measures.items()])
    brands = products.filter(F.col("brand") != UNKNOWN).select("product_id", "brand")
    return (
        per_product.join(brands, "product_id")
        .groupBy("brand")
        .agg(*[F.sum(c).alias(c) for c in measures])
        .filter(F.col("cart_items") >= rules.brand_min_items)
        .select(
            "brand",
            "cart_items",
            mean_money("cents", "cart_items").alias("avg_price"),
            pct("lost", "cart_items").alias("pct_abandoned"),
            whole_money("lost_cents").alias("abandoned_value"),
        )
        .orderBy(F.desc("abandoned_value"), "brand")
        .limit(rules.brand_top)
    )


def abandonment_by_hour(items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return (
        items.groupBy(F.col("start_hour").alias("hour_utc"))
        .agg(F.count("*").alias("cart_items"), _n(lost()).alias("lost"))
        .filter(F.col("cart_items") >= rules.hour_min_items)
        .select("hour_utc", "cart_items", pct("lost", "cart_items").alias("pct_abandoned"))
        .orderBy(F.desc("pct_abandoned"), "hour_utc")
    )


def early_visits(sessions: DataFrame, last: int) -> DataFrame:
    """Carting sessions among the first ``last`` sessions of every user that are not bots, numbered.

    The bound on the row number lets Spark keep only ``last`` rows per user on each map task, so a user
    with very many sessions does not gather in one task.  Sessions without a cart are numbered too, but
    leave before the table meets the cart items.
    """
    in_time = Window.partitionBy("user_id").orderBy("session_start", "user_session")
    return (
        human_sessions(sessions)
        .select("user_id", "user_session", "session_start", "n_carts")
        .withColumn("session_no", F.row_number().over(in_time))
        .filter((F.col("session_no") <= last) & (F.col("n_carts") > 0))
        .select("user_session", "session_no")
    )


def session_outcomes(items: DataFrame) -> DataFrame:
    """Cart items and abandoned ones per session."""
    return items.groupBy("user_session").agg(
        F.count("product_id").alias("products"), F.count("*").alias("items"), _n(lost()).alias("lost")
    )


def abandonment_by_visit_stage(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Abandonment by how many visits the user had made.  A visit without a cart still counts as one."""
    number = F.col("session_no")
    stage = (
        F.when(number == 1, "1st visit")
        .when(number == 2, "2nd visit")
        .when(number <= 5, "3rd-5th visit")
        .otherwise("6th+ visit")
    )
    return (
        session_outcomes(items)
        .join(early_visits(sessions, 5), "user_session", "left")
        .groupBy(stage.alias("visit_stage"))
        .agg(
            F.count("*").alias("sessions"),
            F.sum("products").alias("cart_items"),
            F.sum("lost").alias("lost"),
        )
        .select(
            "visit_stage",
            "sessions",
            "cart_items",
            pct("lost", "cart_items").alias("pct_abandoned"),
        )
        .orderBy("visit_stage")
    )


def visit_sequence(sessions: DataFrame) -> DataFrame:
    """Every session that is not a bot with its number among the user's visits and their total.

    Sessions are numbered inside (user, minute) and shifted by the user's visits in earlier minutes of the hour
    and in earlier hours, so the ordered work of a user with very many sessions, also within one hour, is spread
    over as many groups as the log has minutes.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    who = ["known_id", "anonymous"]  # together a NULL-free stand-in for user_id, so the join needs no <=>
    visits = human_sessions(sessions).select(
        "user_id",
        "user_session",
        "session_start",
        F.coalesce("user_id", F.lit(0)).alias("known_id"),
        F.col("user_id").isNull().alias("anonymous"),
        F.timestamp_diff("MINUTE", epoch, F.col("session_start")).alias("minute"),
    )
    hour = F.floor(F.col("minute") / 60).alias("hour")
    of_user, of_hour = Window.partitionBy(*who), Window.partitionBy(*who, "hour")

    def before(window, order: str) -> Column:
        earlier = window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(earlier), F.lit(0))

    minutes = visits.groupBy(*who, hour, "minute").agg(F.count("*").alias("n"))
    hours = minutes.groupBy(*who, "hour").agg(F.sum("n").alias("n")).select(
        *who, "hour", before(of_user, "hour").alias("hour_shift"), F.sum("n").over(of_user).alias("lifetime_sessions"))
    shifts = (
        minutes.select(*who, "hour", "minute", before(of_hour, "minute").alias("minute_shift"))
        .join(hours, [*who, "hour"])
        .select(*who, "minute", (F.col("hour_shift") + F.col("minute_shift")).alias("shift"), "lifetime_sessions")
    )
    within_minute = Window.partitionBy(*who, "minute").orderBy("session_start", "user_session")
    numbered = visits.withColumn("place", F.row_number().over(within_minute))
    return numbered.join(shifts, [*who, "minute"]).select(
        "user_id",
        "user_session",
        "session_start",
        (F.col("place") + F.col("shift")).alias("session_no"),
        "lifetime_sessions",
    )


def outcome_split(items: DataFrame) -> DataFrame:
    groups = items.groupBy("outcome").agg(
        F.count("*").alias("cart_items"),
        _total_cents().alias("cents"),
        F.sum("seconds_to_purchase").alias("seconds"),
        F.count("seconds_to_purchase").alias("waits"),
    )
    return groups.select(
        "outcome",
        "cart_items",
        pct("cart_items", "sum(cart_items) OVER ()").alias("pct_of_all"),
        mean_money("cents", "cart_items").alias("avg_price"),
        half_up("seconds", "waits * 60", 10).alias("avg_mins_to_buy"),
        whole_money("cents").alias("total_value"),
    ).orderBy(F.desc("cart_items"), "outcome")
