"""Every query by name, over the ``events`` table of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trolley.operators import analysis, cleaning, cohorts, conversion, model, views
from trolley.plans import round_trip
from trolley.plans.star import StarSchema
from trolley.schema import Rules
from trolley.sources import events_log
from trolley.sources.files import listing
from trolley.sources.staging import staging_dir
from trolley.streaming import clean as streaming

_stars: dict[tuple, StarSchema] = {}


def star_of(spark: SparkSession, sf_dir: str, root: str | None = None) -> StarSchema:
    """The star schema of a data folder, built once for all queries of the application.

    The tables lie below ``root``, else in the folder of ``spark.checkpoint.dir``.  Changed files get tables anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, listing(spark, f"{sf_dir}/events.parquet"))
    if key not in _stars:
        raw = events_log.read_events(spark, sf_dir)
        _stars[key] = StarSchema(lambda: events_log.raw_from_events(raw), staging_dir(spark, root), Rules())
    return _stars[key]


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, since a stream takes a plain path for a folder and the table may be one file
    arriving = streaming.read_stream_files(spark, f"{sf_dir}/event[s].parquet")
    root = staging_dir(spark)
    streaming.start_clean(events_log.raw_from_events(arriving), f"{root}/stream", f"{root}/checkpoint").awaitTermination()
    return streaming.cleaned(spark, f"{root}/stream")


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The early view with its side table of late events."""
    root = staging_dir(spark)
    for start, name in ((streaming.start_fresh, "fresh"), (streaming.start_clean, "stream")):
        arriving = streaming.read_stream_files(spark, f"{sf_dir}/event[s].parquet")
        start(events_log.raw_from_events(arriving), f"{root}/{name}", f"{root}/{name}-checkpoint").awaitTermination()
    late = streaming.late_events(spark, f"{root}/fresh", f"{root}/stream")
    return streaming.first_seen(spark, f"{root}/fresh").unionByName(late)


_RECIPES: dict[str, Callable[[StarSchema], DataFrame]] = {
    # cleaning
    "dedup_events": lambda s: cleaning.dedup_events(s.collapsed_events),
    "clean_events": lambda s: s.fact_events,
    "cleaning_audit": lambda s: cleaning.cleaning_audit(s.collapsed_events),
    "row_retention": lambda s: cleaning.row_retention(s.collapsed_events),
    "time_audit": lambda s: cleaning.time_audit(s.collapsed_events),
    # model
    "dim_category": lambda s: s.dim_category,
    "dim_brand": lambda s: s.dim_brand,
    "dim_product": lambda s: s.dim_product,
    "dim_session": lambda s: s.dim_session,
    "dim_user": lambda s: s.dim_user,
    "bot_sessions": lambda s: s.bot_sessions,
    "bot_audit": lambda s: model.bot_audit(s.dim_session),
    "first_cart_events": lambda s: model.first_cart_events(s.fact_events),
    "first_removals": lambda s: model.first_removals(s.fact_events),
    "first_purchases": lambda s: model.first_purchases(s.fact_events),
    "fact_cart_items": lambda s: s.fact_cart_items,
    "table_inventory": lambda s: model.table_inventory(s.model_tables()),
    # headline
    "session_funnel": lambda s: conversion.session_funnel(s.dim_session),
    "outcome_distribution": lambda s: conversion.outcome_distribution(s.fact_cart_items),
    # report queries
    "funnel_both_grains": lambda s: conversion.funnel_both_grains(s.dim_session, s.human_items),
    "abandonment_by_price_band": lambda s: conversion.abandonment_by_price_band(s.human_items, s.rules),
    "abandonment_by_brand": lambda s: conversion.abandonment_by_brand(
        s.human_items, s.dim_product, s.rules),
    "abandonment_by_hour": lambda s: conversion.abandonment_by_hour(s.human_items, s.rules),
    "abandonment_by_visit_stage": lambda s: conversion.abandonment_by_visit_stage(
        s.dim_session, s.human_items),
    "visit_sequence": lambda s: conversion.visit_sequence(s.dim_session),
    "outcome_split": lambda s: conversion.outcome_split(s.human_items),
    # analysis
    "cart_item_base": lambda s: s.cart_item_base,
    "event_type_volume": lambda s: analysis.event_type_volume(
        s.fact_events, s.dim_session, s.bot_sessions),
    "analysis_scope": lambda s: analysis.analysis_scope(s.human_items),
    "funnel_stages": lambda s: analysis.funnel_stages(s.dim_session, s.human_items),
    "session_weeks": lambda s: cohorts.session_weeks(s.dim_session, s.rules),
    "user_cohorts": lambda s: cohorts.user_cohorts(s.dim_session, s.rules),
    "cohort_counts": lambda s: s.cohort_counts,
    "weekly_retention": lambda s: cohorts.weekly_retention(s.dim_session, s.rules, s.cohort_counts),
    "week1_return": lambda s: cohorts.week1_return(s.dim_session, s.rules, s.cohort_counts),
    "cohort_sizes": lambda s: cohorts.cohort_sizes(s.dim_session, s.rules, s.cohort_counts),
    "price_band_mix": lambda s: analysis.price_band_mix(s.item_profile, s.rules),
    "hour_profile": lambda s: analysis.hour_profile(s.item_profile, s.rules),
    "hour_profile_local": lambda s: analysis.hour_profile_local(s.human_items, s.rules),
    "hour_highlight": lambda s: analysis.hour_highlight(s.item_profile, s.rules),
    "price_band_spread": lambda s: analysis.price_band_spread(s.item_profile, s.rules),
    "hour_extremes": lambda s: analysis.hour_extremes(s.item_profile, s.rules),
    "first_vs_returning": lambda s: s.visit_rates,
    "outcome_share": lambda s: analysis.outcome_share(s.item_profile),
    "value_lost_vs_won": lambda s: analysis.value_lost_vs_won(s.item_profile),
    "headline_abandonment": lambda s: analysis.headline_abandonment(s.item_profile),
    "findings_summary": lambda s: analysis.findings_summary(
        s.dim_session, s.human_items, s.item_profile, s.rules, s.cohort_counts, s.visit_rates),
    "hypothesis_table": lambda s: analysis.hypothesis_table(
        s.dim_session, s.human_items, s.item_profile, s.rules, s.visit_rates),
    "dashboard_export": lambda s: analysis.dashboard_export(s.cart_item_base, s.rules),
    # dashboard
    "funnel_export": lambda s: views.funnel_export(analysis.funnel_stages(s.dim_session, s.human_items)),
    "view_funnel": lambda s: views.view_funnel(
        views.funnel_export(analysis.funnel_stages(s.dim_session, s.human_items))),
    "view_outcome_split": lambda s: views.view_outcome_split(s.item_profile),
    "view_price_band_pct": lambda s: views.view_price_band_pct(s.item_profile, rules=s.rules),
}


def _query(recipe: Callable[[StarSchema], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: recipe(star_of(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(r) for name, r in _RECIPES.items()} | {
        "stream_clean_events": _stream, "stream_first_seen": _fresh} | round_trip.QUERIES
