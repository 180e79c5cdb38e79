import random
from datetime import timedelta

from pyspark.sql import Window, functions as F

from trolley.operators import conversion
from trolley.schema import Rules
from tests.conftest import at


def test_buyers_need_not_cart(sessions):
    table = sessions(
        {"user_session": "a", "n_carts": 1}, {"user_session": "b", "n_purchases": 1},
        {"user_session": "c", "n_purchases": 1}, {"user_session": "d", "n_carts": 1, "is_bot": 1},
    )
    funnel = conversion.session_funnel(table).first()
    assert (funnel.sessions, funnel.with_cart, funnel.with_purchase) == (3, 1, 2)
    assert (funnel.purchase_ratio, funnel.session_abandonment) == (2.0, -1.0)


def test_nothing_in_carts(sessions, items):
    none = items({}).limit(0)
    funnel = conversion.session_funnel(sessions({})).first()
    assert (funnel.cart_ratio, funnel.purchase_ratio, funnel.session_abandonment) == (0.0, 0.0, 1.0)
    rows = conversion.funnel_both_grains(sessions({}), none).collect()
    assert [r.pct_cart_to_purchase for r in rows] == [None, None]
    assert conversion.outcome_split(none).count() == 0
    assert conversion.session_funnel(sessions({}).limit(0)).first().cart_ratio is None


def test_bands_of_rounded_prices(items):
    prices = {1: 4.99, 2: 5.0, 3: 9.99, 4: 10.0, 5: 40.0, 6: -1.0, 7: 1e9}
    table = items(*[{"product_id": i, "price": p} for i, p in prices.items()])
    found = {r.price_band: r.cart_items for r in conversion.abandonment_by_price_band(table).collect()}
    assert found == {"a. under 5": 2, "b. 5-10": 2, "c. 10-20": 1, "e. 40+": 2}


def test_band_figures(items):
    table = items(
        {"price": 1.0, "outcome": "purchased"}, {"price": 1.25, "outcome": "removed"},
        {"price": 1.25, "outcome": "abandoned_silent"}, {"price": 50.0, "outcome": "purchased"},
    )
    low, high = conversion.abandonment_by_price_band(table).collect()
    assert tuple(low)[1:] == (3, 33.33, 33.33, 33.33, 3.0)
    assert high.abandoned_value is None


def test_brands_are_ranked_and_limited(spark, items):
    rows = [{"product_id": p, "price": float(p), "user_session": f"s{i}"} for p in range(1, 6) for i in range(3)]
    products = spark.createDataFrame(
        [(1, "one"), (2, "two"), (3, "three"), (4, "unknown"), (5, "three")], "product_id long, brand string")
    found = conversion.abandonment_by_brand(items(*rows), products, Rules(brand_min_items=3, brand_top=2))
    assert [(r.brand, r.cart_items, r.abandoned_value) for r in found.collect()] == [
        ("three", 6, 24.0), ("two", 3, 6.0)]


def test_visit_stages(sessions, items):
    visits = sessions(*[
        {"user_session": f"s{i}", "session_start": at(f"2019-10-{i:02d} 09:00:00"), "n_carts": int(i not in (3, 7))}
        for i in range(1, 9)])
    carted = items(*[{"user_session": f"s{i}"} for i in (1, 2, 4, 5, 6, 8)],
                   {"user_session": "s8", "product_id": None, "outcome": "purchased"})
    found = {r.visit_stage: (r.sessions, r.cart_items, r.pct_abandoned)
             for r in conversion.abandonment_by_visit_stage(visits, carted).collect()}
    assert found == {
        "1st visit": (1, 1, 100.0), "2nd visit": (1, 1, 100.0), "3rd-5th visit": (2, 2, 100.0),
        "6th+ visit": (2, 2, 100.0),
    }


def test_visits_at_the_same_time_go_by_session(sessions):
    visits = sessions({"user_session": "b"}, {"user_session": "a"}, {"user_session": "c", "is_bot": 1})
    found = {r.user_session: (r.session_no, r.lifetime_sessions)
             for r in conversion.visit_sequence(visits).collect()}
    assert found == {"a": (1, 2), "b": (2, 2)}


def test_visit_numbers_equal_a_plain_window(sessions):
    """One user owns most sessions, another has none of an id, hours repeat and times tie."""
    draw = random.Random(3)
    rows = [
        {
            "user_session": f"s{i}",
            "user_id": draw.choice([7, 7, 7, 0, None, i]),
            "session_start": at(f"2019-10-{draw.randint(1, 3):02d} {draw.randint(0, 23):02d}:00:"
                                f"{draw.randint(0, 9):02d}"),
        }
        for i in range(600)
    ]
    visits = sessions(*rows)
    user = Window.partitionBy("user_id")
    plain = visits.select(
        "user_id", "user_session", "session_start",
        F.row_number().over(user.orderBy("session_start", "user_session")).alias("session_no"),
        F.count("*").over(user).alias("lifetime_sessions"),
    )
    ours = conversion.visit_sequence(visits)
    assert sorted(map(str, ours.collect())) == sorted(map(str, plain.collect()))


def test_outcome_split_figures(items):
    table = items(
        {"outcome": "purchased", "seconds_to_purchase": 60, "price": 1.0},
        {"outcome": "purchased", "seconds_to_purchase": -63, "price": 1.01},
        {"outcome": "removed", "price": 2.5},
    )
    bought, removed = conversion.outcome_split(table).collect()
    assert tuple(bought) == ("purchased", 2, 66.67, 1.01, -0.0, 2.0)
    assert tuple(removed) == ("removed", 1, 33.33, 2.5, None, 3.0)


def test_a_user_with_a_third_of_an_hour(sessions):
    """The visits of one user are numbered minute by minute; those without a user, too."""
    rows = [
        {"user_session": f"{u}-{k:04d}", "user_id": u, "session_start": at("09:00:00") + timedelta(seconds=k * 37 % 5000)}
        for u, n in ((1, 300), (2, 150), (None, 150)) for k in range(n)
    ]
    found = {r.user_session: (r.session_no, r.lifetime_sessions) for r in conversion.visit_sequence(sessions(*rows)).collect()}
    for u in (1, 2, None):
        own = sorted((r["session_start"], r["user_session"]) for r in rows if r["user_id"] == u)
        assert [found[name] for _, name in own] == [(k, len(own)) for k in range(1, len(own) + 1)]
    plan = conversion.visit_sequence(sessions(*rows))._jdf.queryExecution().analyzed().toString()
    numbering = plan.split("row_number()", 1)[1].split("windowspecdefinition(", 1)[1]
    assert "minute" in numbering.split("session_start", 1)[0]
