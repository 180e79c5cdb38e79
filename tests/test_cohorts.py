from datetime import timedelta

from trolley.operators import cohorts
from trolley.schema import Rules
from tests.conftest import at


def visits(sessions, *user_days):
    return sessions(*[
        {"user_session": f"s{i}", "user_id": u, "session_start": at(f"2019-10-{d:02d} 10:00:00")}
        for i, (u, d) in enumerate(user_days)
    ])


def test_cells_without_users_are_null(sessions):
    table = visits(sessions, (1, 1), (2, 1), (1, 8), (3, 9), (1, 15), (1, 16), (4, 30))
    counts = [tuple(r) for r in cohorts.cohort_counts(table).collect()]
    assert counts == [(0, 2, 1, 1, None), (1, 1, None, None, None)]
    retention = cohorts.weekly_retention(table).orderBy("cohort").collect()
    assert [tuple(r) for r in retention] == [
        (0, "01 Oct", 50.0, 50.0, None, 3), (1, "08 Oct", None, None, None, 2)]
    assert cohorts.week1_return(table).first()[0] == 50.0
    assert [tuple(r) for r in cohorts.cohort_sizes(table).collect()] == [(0, 2), (1, 1)]


def test_sixty_buckets(sessions):
    """A bucket a day over two months: more than a 64-bit word could hold of cohorts and distances together."""
    rules = Rules(cohort_days=1, last_cohort=59)
    start = at("2019-10-01 10:00:00")
    table = sessions(*[
        {"user_session": f"{u}-{d}", "user_id": u, "session_start": start + timedelta(days=d)}
        for u, days in {1: (0, 59), 2: (0, 1), 3: (40, 59)}.items() for d in days
    ])
    found = {r.cohort: r.asDict() for r in cohorts.cohort_counts(table, rules).collect()}
    assert {c: {k: v for k, v in r.items() if v and k != "cohort"} for c, r in found.items()} == {
        0: {"week_0": 2, "week_1": 1, "week_59": 1}, 40: {"week_0": 1, "week_19": 1}}
    assert cohorts.week1_return(table, rules).first()[0] == 50.0
    assert len(cohorts.weekly_retention(table, rules).columns) == 62


def test_nobody_returns(sessions):
    assert cohorts.week1_return(visits(sessions, (1, 1), (2, 9))).first()[0] is None


def test_days_after_the_last_bucket(sessions):
    table = visits(sessions, (1, 1), (2, 28), (3, 29))
    assert sorted(r.user_id for r in cohorts.session_weeks(table).collect()) == [1, 2]
    assert sorted(r.user_id for r in cohorts.user_cohorts(table).collect()) == [1, 2]


def test_users_without_id(sessions):
    table = visits(sessions, (None, 1), (1, 2))
    assert cohorts.session_weeks(table).count() == 2
    assert cohorts.user_cohorts(table).count() == 1
    assert [r.users for r in cohorts.cohort_sizes(table).collect()] == [1]


def test_bots_do_not_set_the_first_day(sessions):
    table = sessions(
        {"user_session": "a", "session_start": at("2019-10-01 10:00:00"), "is_bot": 1},
        {"user_session": "b", "session_start": at("2019-10-05 10:00:00"), "user_id": 1},
    )
    assert cohorts.weekly_retention(table).first().first_seen == "05 Oct"


def test_a_user_with_most_sessions(sessions):
    table = visits(sessions, *[(1, d) for d in range(1, 28) for _ in range(8)], (2, 9), (2, 16))
    found = cohorts.user_cohorts(table).collect()
    assert {(r.user_id, r.cohort) for r in found} == {(1, 0), (2, 1)}
    assert len(found) == 27 * 8 + 2
    assert all(r.k == r.week - r.cohort for r in found)
