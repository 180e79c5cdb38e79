"""A raw click log derived from the generic ``events`` table, dirt included: a fixture for the queries.

Every event of the table gives a row.  Fixed values of the derivation: the event type map, the id offsets, the
product, category and brand numbers, and the moduli that place duplicates, missing sessions and types, zero prices,
times that cannot be read and bot sessions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley.schema import CART, EVENT_COLUMNS, PURCHASE, REMOVE, VIEW

_TYPES = {"signup": VIEW, "view": VIEW, "click": CART, "error": REMOVE, "purchase": PURCHASE}
_FIRST_DAY = date(2024, 1, 1)
_CODES = {0: "appliances.personal.hair_cutter", 1: "accessories.bag", 2: "stationery"}
_GUESTS = 1_000_000_000_000  # above all user ids


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def raw_from_events(events: DataFrame) -> DataFrame:
    """One scan: each event yields itself, a copy of itself every 90th and 120 bot views every 2000th.

    In a week in which a user is away the events belong to a visitor of that week alone, so that not every visitor
    is seen from the first week to the last.  Every eighth user visits daily, the others weekly.  An event whose
    properties cannot be read has no product number.
    """
    user, event_id = F.col("user_id"), F.col("event_id")
    days = F.datediff(F.to_date("ts"), F.lit(_FIRST_DAY))
    week = F.floor(days / 7)
    p = F.get_json_object("props", "$.k").try_cast("bigint")
    starts = user % 4
    active = (F.col("w") >= starts) & ((F.col("w") == starts) | ((user * user + F.col("w")) % 5 < 3))
    visitor = F.when(active, user).otherwise(user * 8 + F.col("w") + _GUESTS)
    visit = F.when(user % 8 == 0, F.concat(F.lit("-d"), F.col("day"))).otherwise(F.concat(F.lit("-w"), F.col("w")))

    none = F.array().cast("array<int>")
    itself = F.array(F.lit(0))
    copy = F.when(event_id % 90 == 0, itself).otherwise(none)
    bot_views = F.when(event_id % 2000 == 0, F.sequence(F.lit(1), F.lit(120))).otherwise(none)

    at_text = F.col("at").cast("string")  # yyyy-MM-dd HH:mm:ss.SSSSSS
    bot = F.col("i") > 0
    unreadable = F.when(event_id % 1900 == 0, F.lit("at ")).otherwise(F.lit(""))
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("i") * 2)
    known = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in _TYPES.items()])
    kind = F.when(event_id % 1700 != 0, known)
    category = F.col("p") % 20
    code = F.coalesce(*[F.when(category == n, F.lit(c)) for n, c in _CODES.items()])
    brand = F.when(F.col("p") % 5 > 1, F.concat(F.lit("brand_"), F.when(F.col("p") < 80, F.col("p") % 40).otherwise(100)))
    own_session = F.when(event_id % 667 != 0, F.concat(F.col("visitor"), F.col("visit")))
    own_price = F.when(event_id % 1250 == 0, F.lit(0.0)).otherwise(F.col("value"))
    return (
        events.withColumns({"w": week, "p": p, "day": days})
        .withColumns({"visitor": visitor, "visit": visit})
        .withColumn("i", F.explode(F.concat(itself, copy, bot_views)))
        .withColumn("at", F.col("ts") + seconds)
        .select(
            F.concat(unreadable, F.substring(at_text, 1, 19), F.lit(" UTC")).alias("event_time"),
            F.when(bot, VIEW).otherwise(kind).alias("event_type"),
            (F.col("p") + 5_000_000).alias("product_id"),
            (category + 1_487_580_000_000_000_000).alias("category_id"),
            code.alias("category_code"),
            brand.alias("brand"),
            F.when(bot, F.col("value")).otherwise(own_price).alias("price"),
            F.col("visitor").alias("user_id"),
            F.when(bot, F.concat(F.lit("bot-"), event_id)).otherwise(own_session).alias("user_session"),
            F.substring(at_text, 1, 7).alias("month"),
        )
        .select(*EVENT_COLUMNS, "month")
    )
