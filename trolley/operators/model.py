"""Dimension and fact tables built from the cleaned events.

Grouped aggregates keep only fixed-width buffers (counts, sums, bounds of numbers and times), so Spark
runs them as hash aggregates with a map-side part.  The largest text per group is taken in two steps:
the text is first a grouping column, and the greatest text is picked from the few rows that remain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trolley.functions.clicks import level_1
from trolley.functions.exact import cents, mean_money
from trolley.schema import CART, PURCHASE, PURCHASED, REMOVE, REMOVED, SILENT, UNKNOWN, VIEW, Rules


def product_facts(events: DataFrame, *also: str) -> DataFrame:
    """Events and prices by product, brand and category: what the three dimensions of products need, in one scan.

    Columns in ``also`` part the result further, here and in the other partial results.
    """
    return events.groupBy("product_id", "brand", "category_id", "category_code", *also).agg(
        F.count("*").alias("events"),
        F.sum(cents("price")).alias("cents"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )


def session_users(events: DataFrame, *also: str) -> DataFrame:
    """Events by session and user: what sessions and users need, in one scan."""
    return events.groupBy("user_session", "user_id", *also).agg(
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
        F.count("*").alias("n_events"),
        F.count_if(_is_type(VIEW)).alias("n_views"),
        F.count_if(_is_type(CART)).alias("n_carts"),
        F.count_if(_is_type(REMOVE)).alias("n_removes"),
        F.count_if(_is_type(PURCHASE)).alias("n_purchases"),
    )


def merge_product_facts(parts: DataFrame) -> DataFrame:
    """The product facts of a whole log from those of its parts."""
    return parts.groupBy("product_id", "brand", "category_id", "category_code").agg(
        F.sum("events").alias("events"),
        F.sum("cents").alias("cents"),
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
    )


def merge_session_users(parts: DataFrame) -> DataFrame:
    """The session users of a whole log from those of its parts."""
    counters = ["n_events", "n_views", "n_carts", "n_removes", "n_purchases"]
    return parts.groupBy("user_session", "user_id").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        *[F.sum(c).alias(c) for c in counters],
    )


def dim_category(events: DataFrame) -> DataFrame:
    return categories_of(product_facts(events))


def categories_of(facts: DataFrame) -> DataFrame:
    return (
        facts.groupBy("category_id", "category_code")
        .agg(F.sum("events").alias("events"))
        .groupBy("category_id")
        .agg(F.max("category_code").alias("category_code"), F.sum("events").alias("events"))
        .select("category_id", "category_code", level_1(F.col("category_code")).alias("level_1"), "events")
    )


def dim_brand(events: DataFrame) -> DataFrame:
    return brands_of(product_facts(events))


def brands_of(facts: DataFrame) -> DataFrame:
    per_product = (
        facts.select(F.coalesce("brand", F.lit(UNKNOWN)).alias("brand"), "product_id", "events")
        .groupBy("brand", "product_id")
        .agg(F.sum("events").alias("events"))
    )
    return per_product.groupBy("brand").agg(
        F.count("product_id").alias("products"), F.sum("events").alias("events")
    )


def dim_product(events: DataFrame) -> DataFrame:
    return products_of(product_facts(events))


def products_of(facts: DataFrame) -> DataFrame:
    per_brand = facts.groupBy("product_id", "brand").agg(
        F.max("category_id").alias("category_id"),
        F.sum("cents").alias("cents"),
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        F.sum("events").alias("events"),
    )
    return (
        per_brand.groupBy("product_id")
        .agg(
            F.max("category_id").alias("category_id"),
            F.coalesce(F.max("brand"), F.lit(UNKNOWN)).alias("brand"),
            F.sum("cents").alias("cents"),
            F.min("min_price").alias("min_price"),
            F.max("max_price").alias("max_price"),
            F.sum("events").alias("events"),
        )
        .select(
            "product_id",
            "category_id",
            "brand",
            mean_money("cents", "events").alias("avg_price"),
            "min_price",
            "max_price",
            "events",
        )
    )


def _is_type(name: str) -> Column:
    return F.col("event_type") == name


def dim_session(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per session; fast and long sessions carry ``is_bot`` = 1 and stay in the table."""
    return sessions_of(session_users(events), rules)


def sessions_of(visits: DataFrame, rules: Rules = Rules()) -> DataFrame:
    counters = ["n_events", "n_views", "n_carts", "n_removes", "n_purchases"]
    sessions = visits.groupBy("user_session").agg(
        F.max("user_id").alias("user_id"),
        F.min("first_seen").alias("session_start"),
        F.max("last_seen").alias("session_end"),
        *[F.sum(c).alias(c) for c in counters],
    )
    seconds = F.timestamp_diff("SECOND", F.col("session_start"), F.col("session_end"))
    average_gap = seconds / F.greatest(F.col("n_events") - 1, F.lit(1))
    is_bot = (F.col("n_events") >= rules.bot_min_events) & (average_gap < rules.bot_max_avg_gap_s)
    return sessions.select(
        "*", F.hour("session_start").alias("start_hour"), is_bot.cast("int").alias("is_bot")
    )


def dim_user(events: DataFrame) -> DataFrame:
    """One row per user."""
    return users_of(session_users(events))


def users_of(visits: DataFrame) -> DataFrame:
    return (
        visits.groupBy("user_id")
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.count("user_session").alias("n_sessions"),
            F.sum("n_purchases").alias("n_purchase_events"),
        )
        .select(
            "user_id",
            "first_seen",
            "last_seen",
            F.date_format("first_seen", "yyyy-MM").alias("cohort_month"),
            "n_sessions",
            "n_purchase_events",
        )
    )


def bot_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter("is_bot = 1")


def human_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter("is_bot = 0")


def bot_audit(sessions: DataFrame) -> DataFrame:
    """Flagged sessions, their events and the share of all events in percent."""
    flagged = F.col("is_bot") == 1
    totals = sessions.agg(
        F.count_if(flagged).alias("bot_sessions"),
        F.coalesce(F.sum(F.when(flagged, F.col("n_events"))), F.lit(0)).alias("bot_events"),
        F.sum("n_events").alias("all_events"),
    )
    return totals.select(
        "bot_sessions",
        "bot_events",
        F.try_divide(F.lit(100.0) * F.col("bot_events"), "all_events").alias("pct_of_events"),
    )


def first_cart_events(events: DataFrame) -> DataFrame:
    return (
        events.filter(_is_type(CART))
        .groupBy("user_session", "product_id")
        .agg(
            F.max("user_id").alias("user_id"),
            F.min("event_time").alias("carted_at"),
            F.sum(cents("price")).alias("cents"),
            F.count("*").alias("n"),
        )
        .select("user_session", "product_id", "user_id", "carted_at",
                mean_money("cents", "n").alias("price"))
    )


def first_removals(events: DataFrame) -> DataFrame:
    return (
        events.filter(_is_type(REMOVE))
        .groupBy("user_session", "product_id")
        .agg(F.min("event_time").alias("removed_at"))
    )


def first_purchases(events: DataFrame) -> DataFrame:
    return (
        events.filter(_is_type(PURCHASE))
        .groupBy("user_session", "product_id")
        .agg(F.min("event_time").alias("purchased_at"))
    )


def item_facts(events: DataFrame, *also: str) -> DataFrame:
    """Cart events, first removal and first purchase by (session, product), also of products never put in the cart.

    One conditional aggregate replaces three aggregates and two joins: one scan and one shuffle, reduced
    on the map side.  An item without a product id matches no purchase and no removal.
    """
    cart = _is_type(CART)
    known = F.col("product_id").isNotNull()
    return (
        events.filter(F.col("event_type").isin(CART, REMOVE, PURCHASE))
        .groupBy("user_session", "product_id", *also)
        .agg(
            F.max(F.when(cart, F.col("user_id"))).alias("user_id"),
            F.min(F.when(cart, F.col("event_time"))).alias("carted_at"),
            F.sum(F.when(cart, cents("price"))).alias("cents"),
            F.count_if(cart).alias("n"),
            F.min(F.when(_is_type(REMOVE) & known, F.col("event_time"))).alias("removed_at"),
            F.min(F.when(_is_type(PURCHASE) & known, F.col("event_time"))).alias("purchased_at"),
        )
    )


def merge_item_facts(parts: DataFrame) -> DataFrame:
    """The item facts of a whole log from those of its parts."""
    return parts.groupBy("user_session", "product_id").agg(
        F.max("user_id").alias("user_id"),
        F.min("carted_at").alias("carted_at"),
        F.sum("cents").alias("cents"),
        F.sum("n").alias("n"),
        F.min("removed_at").alias("removed_at"),
        F.min("purchased_at").alias("purchased_at"),
    )


def fact_cart_items(events: DataFrame) -> DataFrame:
    return items_of(item_facts(events))


def items_of(facts: DataFrame) -> DataFrame:
    """One row per (session, product) ever put in a cart, with what became of it.

    A purchase or removal counts whether it came before or after the cart event.
    """
    items = facts.filter("n > 0")
    outcome = (
        F.when(F.col("purchased_at").isNotNull(), PURCHASED)
        .when(F.col("removed_at").isNotNull(), REMOVED)
        .otherwise(SILENT)
    )
    wait = F.timestamp_diff("SECOND", F.col("carted_at"), F.col("purchased_at"))
    return items.select(
        "user_session",
        "product_id",
        "user_id",
        "carted_at",
        mean_money("cents", "n").alias("price"),
        "removed_at",
        "purchased_at",
        outcome.alias("outcome"),
        wait.cast("int").alias("seconds_to_purchase"),
    )


def human_items(items: DataFrame, sessions: DataFrame) -> DataFrame:
    """Cart items of sessions that are not bots, with the session's figures.

    Both sides are already one row per key, and only sessions that carted take part.  The join has no
    hint: adaptive execution broadcasts, sorts or splits skewed partitions by the sizes it measures.
    """
    visits = sessions.filter("is_bot = 0 AND n_carts > 0").select(
        "user_session", "session_start", "start_hour", "n_views", "n_carts", "is_bot"
    )
    return items.join(visits, "user_session")


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table, by name."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("table_name")
