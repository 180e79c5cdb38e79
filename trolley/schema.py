"""Declared schemas, fixed values and the tunable thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Event types and item outcomes.
VIEW = "view"
CART = "cart"
REMOVE = "remove_from_cart"
PURCHASE = "purchase"
PURCHASED = "purchased"
REMOVED = "removed"
SILENT = "abandoned_silent"
UNKNOWN = "unknown"

# Reasons for which a row of a file cannot be used.
RAGGED = "ragged_row"
UNREADABLE = "unreadable_number"
BAD_TIME = "unreadable_time"

# Funnel stages, in order.
STAGES = ("Viewed", "Added to cart", "Purchased")

# Texts a CSV reader takes for a missing value.
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

RAW = T.StructType([
    T.StructField("event_time", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("category_code", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("user_session", T.StringType()),
])

EVENT_KEY = ["event_time", "event_type", "product_id", "user_id", "user_session"]
EVENT_COLUMNS = RAW.fieldNames()

# Where a row stood in the files of its month, in this order; a log may lack any of them.
ARRIVAL = ["arrival_file", "arrival_block", "arrival_row"]

# The stored event table: unique events, the number of raw rows behind each, what is wrong with rows that could not
# be read, and the month as partition.
COLLAPSED = T.StructType(
    [T.StructField("event_time", T.TimestampNTZType()), *RAW.fields[1:]]
    + [T.StructField("copies", T.LongType()), T.StructField("fault", T.StringType()), T.StructField("month", T.StringType())]
)

DASHBOARD = T.StructType([
    T.StructField("user_session", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("carted_at", T.TimestampNTZType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("price_band", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("abandoned", T.BooleanType()),
    T.StructField("brand", T.StringType()),
    T.StructField("start_hour", T.IntegerType()),
    T.StructField("n_views", T.LongType()),
    T.StructField("n_carts", T.LongType()),
    T.StructField("cohort_month", T.StringType()),
    T.StructField("seconds_to_purchase", T.IntegerType()),
    T.StructField("cart_date", T.DateType()),
    T.StructField("weekday", T.StringType()),
])

FUNNEL = T.StructType([
    T.StructField("Stage", T.StringType()),
    T.StructField("Events", T.LongType()),
    T.StructField("StageOrder", T.IntegerType()),
])


@dataclass(frozen=True)
class Rules:
    """Thresholds of the analysis; the defaults are the published ones."""

    bot_min_events: int = 100
    bot_max_avg_gap_s: float = 4.0
    band_edges: tuple[int, ...] = (5, 10, 20, 40)
    band_ceiling: float = 1e9
    band_min_items: int = 50
    brand_min_items: int = 200
    brand_top: int = 15
    hour_min_items: int = 100
    hour_margin: float = 2.0
    cohort_days: int = 7
    last_cohort: int = 3
    local_zone: str = "Europe/Moscow"
