import csv
import os
import shutil

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from trolley.operators import analysis, cleaning, conversion, views
from trolley.plans import star
from trolley.schema import EVENT_COLUMNS, Rules
from trolley.sources import events_log, files, raw_log, sinks
from tests.conftest import DATA

HEADER = EVENT_COLUMNS


def row(time="2019-10-01 09:00:00 UTC", kind="view", product=1, code="", brand="", price="5.00", user=100,
        session="s1"):
    return [time, kind, product, 1487580000000000001, code, brand, price, user, session]


def write_month(folder, month, rows, header=HEADER):
    with open(os.path.join(folder, f"{month}.csv"), "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "sample"
    path.mkdir()
    write_month(path, "2019-Oct", [
        row(kind="cart"), row(kind="cart"), row(time="2019-10-01 09:05:00 UTC", kind="purchase"),
        row(product=2, brand="NULL", session=""), row(product=3, price="0.0"), row(time="never"),
    ])
    write_month(path, "2019-Nov", [row(time="2019-11-02 09:00:00 UTC", kind="cart", product=4, session="s2",
                                       brand="runail")])
    return str(path)


def test_months(spark, folder):
    assert raw_log.months_of(spark, folder) == ["2019-Nov", "2019-Oct"]
    everything = raw_log.load_raw(spark, folder)
    assert {r.month: r["count"] for r in everything.groupBy("month").count().collect()} == {
        "2019-Nov": 1, "2019-Oct": 6}
    assert raw_log.load_raw(spark, folder, ["2019-Nov"]).count() == 1
    november = everything.filter("month = '2019-Nov'")._jdf.queryExecution().executedPlan().toString()
    assert november.count("FileScan csv") == 1
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        raw_log.load_raw(spark, folder, ["2019-Dec"])


def test_source_path():
    assert raw_log.source_path("/data", "raw") == "/data/raw"
    with pytest.raises(ValueError):
        raw_log.source_path("/data", "other")


def test_ids_and_missing_text(spark, folder):
    log = raw_log.load_raw(spark, folder, ["2019-Oct"])
    assert log.first().category_id == 1487580000000000001
    assert log.filter("brand IS NOT NULL").count() == 0
    assert log.filter("user_session IS NULL").count() == 1


def test_columns_go_by_name(spark, folder):
    straight = [row(), row(product=7, price="2.50")]
    write_month(folder, "2019-Dec", straight)
    write_month(folder, "2020-Jan", [r[::-1] for r in straight], header=HEADER[::-1])
    a, b = (raw_log.load_raw(spark, folder, [m]).select(EVENT_COLUMNS).collect() for m in ("2019-Dec", "2020-Jan"))
    assert a == b and len(a) == 2
    write_month(folder, "2020-Feb", [r[1:] for r in straight], header=HEADER[1:])
    with pytest.raises(ValueError, match="lacks the columns"):
        raw_log.load_raw(spark, folder, ["2020-Feb"])


def test_cells_and_rows_that_cannot_be_read(spark, folder, tmp_path):
    good = [row(product="8.0"), row(product=9)]
    bad = [row(product="x9"), row(price="cheap"), [*row(product=5), "extra"], row(product=6)[:-1], row(product=4, price="Infinity")]
    write_month(folder, "2019-Dec", good + bad)
    built = star.load_and_model(spark, folder, str(tmp_path / "out"), ["2019-Dec"])
    assert sorted(r.product_id for r in built.fact_events.collect()) == [8, 9]
    audit = {r.drop_reason: r.dropped for r in spark.read.parquet(str(tmp_path / "out/cleaning_audit")).collect()}
    assert audit == {"unreadable_number": 2, "ragged_row": 2, "price_not_finite": 1}
    retention = cleaning.row_retention(built.collapsed_events).first()
    assert (retention.total_out, retention.total_in) == (2, 7)


def test_source_is_chosen_in_the_load(spark, folder, tmp_path):
    os.makedirs(tmp_path / "data")
    shutil.copytree(folder, tmp_path / "data/raw")
    built = star.load_and_model(spark, str(tmp_path / "data"), str(tmp_path / "chosen"), source="raw")
    assert built.fact_events.count() == 3
    with pytest.raises(ValueError):
        star.load_and_model(spark, str(tmp_path / "data"), str(tmp_path / "chosen"), source="other")


def test_the_first_copy_in_the_file_stays(spark, tmp_path):
    """Copies that differ in price and brand, in one file and over the parts of one month."""
    rows = [row(product=p, price=f"{9 - i}.50", brand=f"b{i}") for i in range(4) for p in range(300)]
    write_month(tmp_path, "2019-Oct", rows)
    parts = tmp_path / "2019-Nov.csv"
    parts.mkdir()
    for i in range(4):
        write_month(parts, f"part-{i}", rows[i * 300:(i + 1) * 300])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits per file
    try:
        log = raw_log.load_raw(spark, str(tmp_path))
        assert log.rdd.getNumPartitions() > 8
        kept = cleaning.collapse_copies(log).select("month", "price", "brand", "copies").distinct()
        assert sorted(tuple(r) for r in kept.collect()) == [
            ("2019-Nov", 9.5, "b0", 4), ("2019-Oct", 9.5, "b0", 4)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_load_and_model(spark, folder, tmp_path):
    root = str(tmp_path / "out")
    built = star.load_and_model(spark, folder, root)
    assert built.fact_events.count() == 3
    assert {r.user_session: r.outcome for r in built.fact_cart_items.collect()} == {
        "s1": "purchased", "s2": "abandoned_silent"}
    assert sorted(os.listdir(f"{root}/collapsed_events"))[-2:] == ["month=2019-Nov", "month=2019-Oct"]

    audit = {(r.month, r.drop_reason): r.dropped for r in spark.read.parquet(f"{root}/cleaning_audit").collect()}
    assert audit == {("2019-Oct", "double_fired"): 1, ("2019-Oct", "null_session"): 1,
                     ("2019-Oct", "price_not_positive"): 1}
    log = spark.read.option("header", True).csv(f"{root}/cleaning_log").collect()
    assert ("row retention", "3 of 7 raw events kept (42.9%)") in [tuple(r) for r in log]

    again = star.StarSchema.open(spark, root)
    assert again.human_items.count() == 2
    assert again.fact_events.filter("month = '2019-Nov'").count() == 1

    with pytest.raises(ValueError, match="other rules"):
        star.StarSchema.open(spark, root, Rules(bot_min_events=5))


def test_a_reloaded_month_reaches_every_table(spark, folder, tmp_path):
    root = str(tmp_path / "out")
    before = star.load_and_model(spark, folder, root).fact_cart_items.count()
    write_month(folder, "2019-Nov", [row(session=f"n{k}", kind="cart") for k in range(3)])
    star.reload_month(spark, folder, root, "2019-Nov")
    opened = star.StarSchema.open(spark, root)
    november = opened.fact_events.filter("month = '2019-Nov'").count()
    assert november == 3 and opened.fact_cart_items.count() >= before
    assert {r.user_session for r in opened.fact_cart_items.collect()} >= {"n0", "n1", "n2"}

    write_month(folder, "2019-Nov", [])  # an emptied month leaves nothing behind
    star.reload_month(spark, folder, root, "2019-Nov")
    opened = star.StarSchema.open(spark, root)
    assert opened.fact_events.filter("month = '2019-Nov'").count() == 0
    assert not {r.user_session for r in opened.fact_cart_items.collect()} & {"n0", "n1", "n2"}

    files.remove(spark, f"{root}/versions")
    with pytest.raises(ValueError, match="not completely built"):
        star.StarSchema.open(spark, root)


def test_month_filter_prunes_partitions(spark, folder, tmp_path):
    root = str(tmp_path / "out")
    star.load_months(spark, folder, root)
    november = star.StarSchema.over(spark, root).fact_events.filter("month = '2019-Nov'")
    plan = november._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_sql_over_views(spark, folder, tmp_path):
    star.load_and_model(spark, folder, str(tmp_path / "out")).register()
    found = spark.sql("""
        SELECT outcome, count(*) AS n FROM fact_cart_items JOIN dim_session USING (user_session)
        WHERE is_bot = 0 GROUP BY outcome HAVING n >= 1 ORDER BY outcome
    """).collect()
    assert [tuple(r) for r in found] == [("abandoned_silent", 1), ("purchased", 1)]
    for table in ("dim_brand", "dim_category", "dim_product", "dim_user", "fact_events"):
        assert spark.table(table).count() > 0


def test_events_as_csv_give_the_same_model(spark, tmp_path):
    """The generic log written as a monthly CSV folder and read back through the file path."""
    raw = events_log.raw_from_events(events_log.read_events(spark, f"{DATA}/sf0.01"))
    src = tmp_path / "raw"
    src.mkdir()
    sinks.write_csv(raw.select(EVENT_COLUMNS).repartition(3), str(src / "2024-01.csv"))
    built = star.load_and_model(spark, str(src), str(tmp_path / "out"))
    lazy = star.StarSchema(lambda: raw)
    for name in ("fact_events", "fact_cart_items", "dim_session"):
        a, b = getattr(built, name), getattr(lazy, name)
        assert a.select(b.columns).exceptAll(b).count() == 0, name
        assert a.count() == b.count()


def test_exports(spark, tmp_path):
    from trolley.plans.registry import star_of

    s = star_of(spark, f"{DATA}/sf0.01")
    export = analysis.dashboard_export(s.cart_item_base, s.rules)
    star.export_dashboard(s, str(tmp_path))
    back = raw_log.load_dashboard_items(spark, str(tmp_path / "dashboard_cart_items"))
    assert back.exceptAll(export).count() == 0 and back.count() == s.cart_item_base.count() > 1500
    assert {r.weekday for r in back.select("weekday").distinct().collect()} >= {"Monday", "Sunday"}
    split = views.view_outcome_split(views.profile_of(back)).collect()
    assert [tuple(r) for r in split] == [tuple(r) for r in views.view_outcome_split(s.item_profile).collect()]

    read = raw_log.load_funnel(spark, str(tmp_path / "funnel"))
    assert [r.Events for r in views.view_funnel(read).collect()] == [r.n for r in analysis.funnel_stages(s.dim_session, s.human_items).collect()]
    findings = spark.read.option("header", True).csv(str(tmp_path / "findings")).first()
    assert findings["items"] == str(back.count())
    assert spark.read.option("header", True).csv(str(tmp_path / "hypotheses")).count() == 3


def test_session_zone_does_not_matter(spark):
    raw = events_log.raw_from_events(events_log.read_events(spark, f"{DATA}/sf0.01"))

    def figures():
        s = star.StarSchema(lambda: raw)
        return (conversion.outcome_split(s.human_items).orderBy("outcome").collect(),
                s.dim_session.agg(F.sum("start_hour"), F.sum("is_bot")).collect(),
                analysis.hour_profile_local(s.human_items).orderBy("start_hour").collect())

    here = figures()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert figures() == here
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_changed_data_is_read_again(spark, tmp_path):
    from trolley.plans.registry import all_queries

    events = events_log.read_events(spark, f"{DATA}/sf0.001")
    path = f"{tmp_path}/events.parquet"
    events.write.parquet(path)
    scope = all_queries()["analysis_scope"]
    before = scope(spark, str(tmp_path)).first()
    events.filter("user_id % 2 = 0").write.mode("overwrite").parquet(path)
    assert scope(spark, str(tmp_path)).first()["items"] < before["items"]
