from pyspark.sql import functions as F

import math

from trolley.functions.clicks import parse_event_time
from trolley.operators import cleaning
from tests.conftest import at


def test_times(spark):
    texts = [
        "2019-10-01 09:15:22 UTC", "2019-10-01 09:15:22", "2019-10-01 UTC 09:15:22", "garbage", "",
        "2019-13-01 09:15:22 UTC", "2019-10-01T09:15:22 UTC", "2019-10-01 09:15:22.5 UTC",
        " 2019-10-01 09:15:22 UTC", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parsed = [r.p for r in df.select("i", parse_event_time(df.t).alias("p")).orderBy("i").collect()]
    moment = at("09:15:22")
    assert parsed == [moment, moment, moment] + [None] * 7


def test_times_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # a time that does not exist there
        df = spark.createDataFrame([("2024-03-10 02:30:00 UTC",)], "t string")
        assert df.select(parse_event_time(df.t).cast("string").alias("p")).first().p == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_copies_keep_the_lowest_price(raw):
    log = raw({"price": 7.0, "brand": "b"}, {"price": 5.0, "brand": "z"}, {"price": 5.0, "brand": "a"})
    kept = cleaning.collapse_copies(log).collect()
    assert [(r.price, r.brand, r.copies) for r in kept] == [(5.0, "a", 3)]


def test_copies_compare_missing_keys_as_equal(raw):
    log = raw({"user_session": None, "product_id": None}, {"user_session": None, "product_id": None})
    collapsed = cleaning.collapse_copies(log)
    assert collapsed.count() == 1
    audit = {r.drop_reason: r.dropped for r in cleaning.cleaning_audit(collapsed).collect()}
    assert audit == {"double_fired": 1, "null_session": 1}


def test_prices(raw):
    prices = [5.0, None, math.nan, 0.0, -1.0]
    log = raw(*[{"price": p, "product_id": i} for i, p in enumerate(prices)])
    collapsed = cleaning.collapse_copies(log)
    assert [r.product_id for r in cleaning.clean_events(collapsed).collect()] == [0]
    audit = cleaning.cleaning_audit(collapsed).collect()
    assert [(r.drop_reason, r.dropped) for r in audit] == [("price_not_positive", 4)]


def test_a_copy_with_a_usable_price_stays(raw):
    """Where the log has no file positions; with them the first copy stays, whatever its price."""
    inf = float("inf")
    copies = raw({"price": None}, {"price": inf}, {"price": 4.0}, {"price": 3.0}, {"price": -1.0})
    collapsed = cleaning.collapse_copies(copies)
    assert [r.price for r in cleaning.clean_events(collapsed).collect()] == [3.0]
    placed = copies.withColumn("arrival_row", F.when(F.col("price").isNull(), 0).otherwise(1).cast("long"))
    assert cleaning.clean_events(cleaning.collapse_copies(placed)).count() == 0


def test_bad_numbers_are_audited(raw):
    inf, nan = float("inf"), float("nan")
    log = raw({"price": inf}, {"product_id": 2, "price": nan}, {"product_id": 3, "price": -inf}, {"product_id": 4})
    collapsed = cleaning.collapse_copies(log)
    assert {r.drop_reason: r.dropped for r in cleaning.cleaning_audit(collapsed).collect()} == {
        "price_not_finite": 1, "price_not_positive": 2}
    assert cleaning.clean_events(collapsed).count() == 1


def test_steps_add_up(raw):
    log = raw(
        {"event_time": "garbage"}, {}, {}, {"user_session": None}, {"product_id": 2, "price": 0.0},
        {"product_id": 3},
    )
    collapsed = cleaning.collapse_copies(log)
    assert cleaning.dedup_events(collapsed).count() == 4
    assert cleaning.clean_events(collapsed).count() == 2
    audit = {r.drop_reason: r.dropped for r in cleaning.cleaning_audit(collapsed).collect()}
    assert audit == {"double_fired": 1, "null_session": 1, "price_not_positive": 1}
    kept = cleaning.row_retention(collapsed).first()
    assert (kept.total_out, kept.total_in) == (2, 6)
    assert kept.retention == 2 / 6


def test_empty_month(raw):
    collapsed = cleaning.collapse_copies(raw({}).limit(0))
    assert tuple(cleaning.row_retention(collapsed).first()) == (0, 0, None)
    assert cleaning.cleaning_audit(collapsed).count() == 0


def test_copies_are_found_within_a_month(raw):
    log = raw({}).unionByName(raw({}, month="2019-Nov"))
    assert cleaning.collapse_copies(log).count() == 2
