import pytest

from trolley.operators import analysis, views
from trolley.schema import Rules
from tests.conftest import at


def test_bins_leave_out_what_lies_outside(items):
    table = items(*[{"price": p} for p in (4.99, 5.0, 10.0, 40.0, -1.0, 1e9)])
    mix = analysis.price_band_mix(analysis.item_profile(table), Rules(band_min_items=1)).collect()
    assert {r.price_band: r.items for r in mix} == {"<5": 1, "5-10": 1, "10-20": 1, "40+": 1}
    assert analysis.banded_items(table).filter("price_band IS NULL").count() == 2


def test_thin_bands_and_hours_are_left_out(items):
    profile = analysis.item_profile(items(*[{"price": 1.0}] * 3, {"price": 6.0, "start_hour": 3}))
    rules = Rules(band_min_items=2, hour_min_items=2)
    assert [r.price_band for r in analysis.price_band_mix(profile, rules).collect()] == ["<5"]
    assert [r.start_hour for r in analysis.hour_profile(profile, rules).collect()] == [9]


def test_items_without_ids_are_not_analysed(items):
    table = items({}, {"product_id": None}, {"user_id": None})
    assert analysis.analysis_scope(table).first().items == 1
    assert analysis.headline_abandonment(analysis.item_profile(table)).first().pct_abandoned == 100.0


def test_base_equals_filter(spark):
    from trolley.plans.registry import star_of
    from tests.conftest import DATA

    star = star_of(spark, f"{DATA}/sf0.01")
    assert star.cart_item_base.count() == analysis.analysed(star.human_items).count()


def hours(items, rates):
    rows = []
    for hour, (lost, won) in rates.items():
        rows += [{"start_hour": hour}] * lost + [{"start_hour": hour, "outcome": "purchased"}] * won
    return analysis.item_profile(items(*rows))


def test_hour_extremes_take_the_earlier_hour(items):
    profile = hours(items, {8: (3, 1), 5: (3, 1), 7: (1, 1), 2: (1, 1)})
    found = analysis.hour_extremes(profile, Rules(hour_min_items=1)).first()
    assert tuple(found) == (5, 75.0, 2, 50.0, 25.0)


def test_hour_highlight(items):
    profile = hours(items, {1: (50, 50), 2: (54, 46), 3: (50, 50)})
    found = {r.start_hour: (r.mean_pct, r.highlighted)
             for r in analysis.hour_highlight(profile, Rules()).collect()}
    assert found == {1: (51.333333, False), 2: (51.333333, True), 3: (51.333333, False)}


def test_local_hours(items):
    table = items({"session_start": at("22:30:00"), "start_hour": 22})
    assert analysis.hour_profile_local(table, Rules(hour_min_items=1)).first().start_hour == 1


def test_no_items_at_all(items, sessions):
    none = items({}).limit(0)
    profile = analysis.item_profile(none)
    assert tuple(analysis.outcome_share(profile).first()) == (0.0, 0.0, 0.0, None)
    assert tuple(analysis.value_lost_vs_won(profile).first()) == (0.0, 0.0, 0.0)
    assert analysis.headline_abandonment(profile).first().pct_abandoned is None
    assert [r.n for r in analysis.funnel_stages(sessions({}), none).collect()] == [1, 0, 0]
    assert analysis.findings_summary(sessions({}), none, profile).first()["items"] == 0


def test_no_views(sessions, items):
    stages = analysis.funnel_stages(sessions({"n_views": 0}), items({}))
    assert [(r.n, r.pct_prev) for r in stages.orderBy("stage_order").collect()] == [
        (0, None), (1, None), (0, 0.0)]


def test_value(items):
    profile = analysis.item_profile(items({"price": 0.1}, {"price": 0.2}, {"price": 0.5, "outcome": "purchased"}))
    assert tuple(analysis.value_lost_vs_won(profile).first()) == (0.3, 0.5, 0.3)


def test_unknown_event_types_are_counted(events, sessions):
    table = sessions({"user_session": "a", "n_views": 2}, {"user_session": "bot", "n_views": 5, "is_bot": 1})
    log = events(
        {"user_session": "a", "event_type": "wish"}, {"user_session": "a", "event_type": "wish"},
        {"user_session": "bot", "event_type": "wish"}, {"user_session": "a"}, {"user_session": "a"},
        {"user_session": "a", "event_type": None}, {"user_session": "bot", "event_type": None},
    )
    bots = table.filter("is_bot = 1")
    found = {r.event_type: (r.events, r.sessions)
             for r in analysis.event_type_volume(log, table, bots).collect()}
    assert found == {"view": (2, 1), "wish": (2, 1), None: (1, 1)}


def test_first_and_returning(sessions, items):
    visits = sessions({"user_session": "a", "n_carts": 1},
                      {"user_session": "b", "n_carts": 1, "session_start": at("10:00:00")})
    table = items({"user_session": "a"}, {"user_session": "b", "outcome": "purchased"})
    found = {r.visit: r.pct_abandoned for r in analysis.first_vs_returning(visits, table).collect()}
    assert found == {"first": 100.0, "returning": 0.0}


def test_views(spark, items):
    profile = analysis.item_profile(items(
        {"price": 1.0}, {"price": 1.0, "outcome": "purchased"}, {"price": 7.0, "outcome": "removed"},
        {"price": -1.0}))
    split = views.view_outcome_split(profile).collect()
    assert [(r.outcome, r["items"]) for r in split] == [("abandoned_silent", 2), ("removed", 1), ("purchased", 1)]
    bands = views.view_price_band_pct(profile).collect()
    assert [(r.price_band, r.outcome, r.pct_of_band) for r in bands] == [
        ("<5", "abandoned_silent", 50.0), ("<5", "purchased", 50.0), ("5-10", "removed", 100.0),
        (None, "abandoned_silent", 100.0)]
    assert views.view_price_band_pct(profile, ["5-10"]).count() == 1
    funnel = spark.createDataFrame([("Purchased", 1, 3), ("Viewed", 9, 1), ("Viewed", 1, 1)],
                                   "Stage string, Events long, StageOrder int")
    assert [tuple(r) for r in views.view_funnel(funnel).collect()] == [("Viewed", 1, 10), ("Purchased", 3, 1)]


@pytest.fixture(scope="module")
def large(spark):
    from trolley.plans.star import StarSchema
    from trolley.sources import events_log
    from tests.conftest import DATA

    raw = events_log.raw_from_events(events_log.read_events(spark, f"{DATA}/sf0.1"))
    return StarSchema(lambda: raw)  # no root: lazy, with the published thresholds


def test_published_thresholds(large):
    from trolley.operators import conversion

    brands = conversion.abandonment_by_brand(large.human_items, large.dim_product).collect()
    assert len(brands) == 15 and all(r.cart_items >= 200 for r in brands)  # of 25 names
    by_hour = conversion.abandonment_by_hour(large.human_items).collect()
    assert by_hour and all(r.cart_items >= 100 for r in by_hour)
    assert [r.pct_abandoned for r in by_hour] == sorted((r.pct_abandoned for r in by_hour), reverse=True)


def test_totals_agree(large):
    from trolley.operators import conversion

    bands = conversion.abandonment_by_price_band(large.human_items).collect()
    split = conversion.outcome_split(large.human_items).collect()
    assert sum(r.cart_items for r in bands) == sum(r.cart_items for r in split) == 19566  # 9 fewer than without the times that cannot be read
    assert abs(sum(r.pct_of_all for r in split) - 100) < 0.02
    grains = conversion.funnel_both_grains(large.dim_session, large.human_items).first()
    funnel = conversion.session_funnel(large.dim_session).first()
    assert (grains.reached_view, grains.reached_cart, grains.reached_purchase) == tuple(funnel)[:3]
