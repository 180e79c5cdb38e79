"""The shape of the physical plans: one shuffle where one is enough, filters at the files, no products."""

import pytest

from trolley.operators import cleaning, cohorts, conversion, model
from trolley.plans.registry import all_queries as queries, star_of
from trolley.sources import events_log
from tests.conftest import DATA

SF = f"{DATA}/sf0.01"


def plan_of(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def shuffles(df):
    return plan_of(df).count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def star(spark):
    return star_of(spark, SF).build()


def test_cart_items_take_one_shuffle(star):
    df = model.fact_cart_items(star.fact_events)
    assert shuffles(df) == 1
    assert "partial_min" in plan_of(df) and "SortAggregate" not in plan_of(df)
    assert "In(event_type" in plan_of(df)


def test_session_users_take_one_shuffle(star):
    df = model.session_users(star.fact_events)
    assert shuffles(df) == 1 and "SortAggregate" not in plan_of(df)


def test_the_star_scans_the_log_three_times(star):
    """Sessions and users share one scan, products, brands and categories another; cart items take the third."""
    from_log = [n for n in star.STORED if n in ("session_users", "product_facts", "fact_cart_items")]
    assert len(from_log) == 3
    for name in ("dim_brand", "dim_category", "dim_product"):
        assert "product_facts" in plan_of(getattr(model, {"dim_brand": "brands_of", "dim_category": "categories_of", "dim_product": "products_of"}[name])(star.product_facts))
    assert "session_users" in plan_of(model.sessions_of(star.session_users))
    assert "collapsed_events" not in plan_of(model.users_of(star.session_users))


def test_scope_needs_no_expand(star):
    from trolley.operators import analysis

    assert "Expand" not in plan_of(analysis.analysis_scope(star.human_items))


def test_copies_meet_before_the_shuffle(spark):
    raw = events_log.raw_from_events(events_log.read_events(spark, SF))
    df = cleaning.collapse_copies(raw)
    assert shuffles(df) == 1 and "partial_min" in plan_of(df)  # text in the buffer: Spark sorts, it cannot hash


@pytest.mark.parametrize("build", [model.dim_category, model.dim_brand, model.dim_product, model.dim_user])
def test_dimensions_reduce_before_the_shuffle(star, build):
    first_aggregate = plan_of(build(star.fact_events)).rsplit("Exchange", 1)[1]
    assert "HashAggregate" in first_aggregate and "SortAggregate" not in first_aggregate


def test_visits_are_limited_before_the_shuffle(star):
    plan = plan_of(conversion.early_visits(star.dim_session, 5))
    assert plan.count("WindowGroupLimit") == 2


def test_cohorts_shuffle_once(star):
    assert shuffles(cohorts.cohort_counts(star.dim_session).drop("cohort")) <= 2


def test_filters_reach_the_files(star):
    plan = plan_of(model.first_removals(star.fact_events))
    assert "EqualTo(event_type,remove_from_cart)" in plan
    assert "brand" not in plan.rsplit("ReadSchema", 1)[1]


@pytest.mark.parametrize("name", sorted(n for n in queries() if not n.startswith("stream_")))
def test_no_products_and_no_python(spark, star, name):
    plan = plan_of(queries()[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "Scan ExistingRDD"):
        assert operator not in plan
