from functools import reduce

import pytest
from pyspark.sql import functions as F

from trolley.operators import model
from trolley.schema import Rules
from tests.conftest import at


def test_category_levels(events):
    log = events(
        {"category_id": 1, "category_code": "apparel.glove"},
        {"category_id": 1, "category_code": None},
        {"category_id": 2, "category_code": "plain"},
        {"category_id": 3, "category_code": ".odd"},
        {"category_id": 4},
        {"category_id": 5, "category_code": "a.b"},
        {"category_id": 5, "category_code": "c.d"},
    )
    found = {r.category_id: (r.category_code, r.level_1, r.events) for r in model.dim_category(log).collect()}
    assert found == {
        1: ("apparel.glove", "apparel", 2), 2: ("plain", "plain", 1), 3: (".odd", "", 1),
        4: (None, "unknown", 1), 5: ("c.d", "c", 2),
    }


def test_brands_and_products(events):
    log = events(
        {"product_id": 1, "brand": None, "price": 1.0}, {"product_id": 1, "brand": "x", "price": 2.01},
        {"product_id": 2, "brand": None, "category_id": 11}, {"product_id": None, "brand": "x"},
    )
    brands = {r.brand: (r.products, r.events) for r in model.dim_brand(log).collect()}
    assert brands == {"unknown": (2, 2), "x": (1, 2)}
    products = {r.product_id: r for r in model.dim_product(log).collect()}
    assert (products[1].brand, products[1].avg_price, products[1].min_price) == ("x", 1.51, 1.0)
    assert (products[2].brand, products[2].category_id) == ("unknown", 11)


def test_users(events):
    log = events(
        {"event_time": at("2019-10-31 23:59:59"), "user_session": "a"},
        {"event_time": at("2019-11-01 00:00:00"), "user_session": "b", "event_type": "purchase"},
        {"event_time": at("2019-11-01 00:00:01"), "user_session": "b", "event_type": "purchase"},
    )
    user = model.dim_user(log).first()
    assert (user.cohort_month, user.n_sessions, user.n_purchase_events) == ("2019-10", 2, 2)


@pytest.mark.parametrize("n, seconds, flagged", [(100, 396, 0), (100, 395, 1), (99, 98, 0)])
def test_bots(spark, events, n, seconds, flagged):
    start = at("09:00:00")
    log = events({}).drop("event_time").crossJoin(
        spark.range(n).select(
            F.when(F.col("id") == 0, F.lit(0)).otherwise(F.lit(seconds)).alias("s"))
    ).withColumn("event_time", F.lit(str(start)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s")))
    session = model.dim_session(log).first()
    assert (session.n_events, session.is_bot) == (n, flagged)
    audit = model.bot_audit(model.dim_session(log)).first()
    assert tuple(audit) == (flagged, n * flagged, 100.0 * flagged)


def visit(session, *steps, product=1, **more):
    kinds = {"v": "view", "c": "cart", "r": "remove_from_cart", "p": "purchase"}
    return [
        {"user_session": session, "product_id": product, "event_type": kinds[k],
         "event_time": at(f"09:00:{second:02d}"), **more}
        for second, k in enumerate(steps)
    ]


def test_outcomes(events):
    log = events(
        *visit("carted", *"c"), *visit("all", *"crp"), *visit("early", *"pc"), *visit("rc", *"rc"),
        *visit("none", *"vp"), *visit("no product", *"cpr", product=None),
    )
    found = {r.user_session: r for r in model.fact_cart_items(log).collect()}
    assert {s: r.outcome for s, r in found.items()} == {
        "carted": "abandoned_silent", "all": "purchased", "early": "purchased", "rc": "removed",
        "no product": "abandoned_silent",
    }
    assert found["all"].removed_at == at("09:00:01")
    assert found["all"].seconds_to_purchase == 2
    assert found["early"].seconds_to_purchase == -1
    assert found["no product"].purchased_at is None and found["no product"].removed_at is None


def test_repeated_cart(events):
    log = events(
        {"event_type": "cart", "price": 4.99, "user_id": 1, "event_time": at("10:00:00")},
        {"event_type": "cart", "price": 5.00, "user_id": 2, "event_time": at("09:30:00")},
        {"event_type": "view", "price": 99.0, "user_id": 3, "event_time": at("09:00:00")},
    )
    (item,) = model.fact_cart_items(log).collect()
    assert (item.price, item.user_id, item.carted_at) == (5.0, 2, at("09:30:00"))
    assert model.dim_session(log).first().user_id == 3


def test_one_pass_equals_three_joined_aggregates(spark):
    from trolley.plans.registry import star_of
    from tests.conftest import DATA

    star = star_of(spark, f"{DATA}/sf0.01")
    log = star.fact_events
    keys = ["user_session", "product_id"]
    joined = reduce(
        lambda a, b: a.join(b, keys, "left"),
        [model.first_cart_events(log), model.first_removals(log), model.first_purchases(log)],
    )
    one_pass = star.fact_cart_items.select(joined.columns)
    assert one_pass.exceptAll(joined).count() == 0
    assert joined.exceptAll(one_pass).count() == 0


def test_counts_add_up(spark):
    from trolley.plans.registry import star_of
    from tests.conftest import DATA

    star = star_of(spark, f"{DATA}/sf0.01")
    rows = star.fact_events.count()
    for table, column in (("dim_category", "events"), ("dim_brand", "events"), ("dim_product", "events"),
                          ("dim_session", "n_events")):
        assert getattr(star, table).agg(F.sum(column)).first()[0] == rows, table
    assert star.item_profile.agg(F.sum("n")).first()[0] == star.human_items.count()


def test_rules_are_parameters(events):
    log = events({"event_time": at("09:00:00")}, {"event_time": at("09:00:01")})
    rules = Rules(bot_min_events=2, bot_max_avg_gap_s=2.0)
    assert model.dim_session(log, rules).first().is_bot == 1
