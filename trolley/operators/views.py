"""The dashboard views and the funnel file behind the first one.

The item views count rows of the dashboard table.  ``profile`` holds those counts already, be it
``analysis.item_profile`` of the items or ``profile_of`` a dashboard file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from trolley.functions.clicks import binned_bands, position
from trolley.functions.exact import rate
from trolley.schema import PURCHASED, REMOVED, SILENT, STAGES, Rules

_OUTCOME_ORDER = [SILENT, REMOVED, PURCHASED]


def funnel_export(stages: DataFrame) -> DataFrame:
    """``analysis.funnel_stages`` in the layout of the funnel file."""
    return stages.select(
        F.col("stage").alias("Stage"), F.col("n").alias("Events"), F.col("stage_order").alias("StageOrder")
    )


def view_funnel(funnel: DataFrame) -> DataFrame:
    """Events per stage.  Stages in their manual order come first, others by their own number."""
    return (
        funnel.groupBy("Stage", "StageOrder")
        .agg(F.sum("Events").alias("Events"))
        .orderBy(F.asc_nulls_last(position(F.col("Stage"), list(STAGES))), "StageOrder")
    )


def profile_of(export: DataFrame) -> DataFrame:
    """Rows of a dashboard table by price band and outcome."""
    return export.groupBy("price_band", "outcome").agg(F.count("*").alias("n"))


def view_outcome_split(profile: DataFrame) -> DataFrame:
    return (
        profile.groupBy("outcome")
        .agg(F.sum("n").alias("items"))
        .withColumn("outcome_order", position(F.col("outcome"), _OUTCOME_ORDER))
        .orderBy("outcome_order")
    )


def view_price_band_pct(
    profile: DataFrame, bands: Sequence[str] | None = None, rules: Rules = Rules()
) -> DataFrame:
    """Share of each outcome within its price band, in percent; ``bands`` narrows the bands shown."""
    if bands is not None:
        profile = profile.filter(F.col("price_band").isin(*bands))
    return (
        profile.groupBy("price_band", "outcome")
        .agg(F.sum("n").alias("items"))
        .withColumn("pct_of_band", rate("items", "sum(items) OVER (PARTITION BY price_band)"))
        .withColumn("band_order", position(F.col("price_band"), binned_bands(rules)))
        .orderBy(F.asc_nulls_last("band_order"), position(F.col("outcome"), _OUTCOME_ORDER))
    )
