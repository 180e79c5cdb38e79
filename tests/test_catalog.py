"""Tables found by name in another session, lines that were turned away, and files with headers of their own."""

import csv
import gzip

import pytest

from tests.conftest import DATA
from tests.test_sources import HEADER, row, write_month
from trolley.operators import conversion
from trolley.plans import catalog, round_trip, star
from trolley.sources import raw_log


def reports(s):
    frames = [
        conversion.funnel_both_grains(s.dim_session, s.human_items), conversion.abandonment_by_price_band(s.human_items, s.rules),
        conversion.abandonment_by_brand(s.human_items, s.dim_product, s.rules), conversion.abandonment_by_hour(s.human_items, s.rules),
        conversion.abandonment_by_visit_stage(s.dim_session, s.human_items), conversion.outcome_split(s.human_items)]
    return [sorted(map(str, f.collect())) for f in frames]


def test_another_session_finds_the_tables(spark):
    root = round_trip.folder_of(spark, f"{DATA}/sf0.01")
    name = round_trip.database_of(spark, f"{DATA}/sf0.01")
    other = spark.newSession()
    assert {r.tableName for r in other.sql(f"SHOW TABLES IN `{name}`").collect()} == {*star.StarSchema.STORED, "collapsed_events", "fact_events"}
    built = star.StarSchema.open(spark, f"{root}/tables")
    assert reports(catalog.star_of(other, name)) == reports(built)
    assert other.sql(f"SELECT count(*) FROM `{name}`.fact_events").first()[0] == built.fact_events.count()


def test_names_follow_a_reload(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "it's")
    src.mkdir()
    write_month(src, "2019-Oct", [row(kind="cart")])
    write_month(src, "2019-Nov", [row(time="2019-11-01 09:00:00 UTC", kind="cart", session="s2")])
    star.load_and_model(spark, str(src), root)
    catalog.publish(spark, root, "follows")
    try:
        write_month(src, "2019-Nov", [row(time=f"2019-11-01 09:0{k}:00 UTC", session="s3") for k in range(4)])
        star.reload_month(spark, str(src), root, "2019-Nov")
        catalog.publish(spark, root, "follows")
        found = spark.newSession().sql("SELECT month, count(*) AS n FROM follows.fact_events GROUP BY month")
        assert sorted(map(tuple, found.collect())) == [("2019-Nov", 4), ("2019-Oct", 1)]
        assert {r.user_session for r in spark.sql("SELECT user_session FROM follows.dim_session").collect()} == {"s1", "s3"}
    finally:
        spark.sql("DROP DATABASE follows CASCADE")


def test_lines_that_are_turned_away_are_kept(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    bad = {"2019-10-01 09:00:00 UTC,view,x9,1,,,5.0,7,s1": "unreadable_number", "never,view,1,1,,,5.0,7,s1": "unreadable_time",
           "too,few": "ragged_row", '2019-10-01 09:00:00 UTC,view,1,1,,"a, b",5.0,7,s1,more': "ragged_row",
           '2019-10-01 09:00:00 UTC,view,1,1,,"a, b",cheap,7,s1': "unreadable_number"}
    good = ['2019-10-01 09:00:00 UTC,view,1,1,,"a, b",5.0,7,s1', "2019-10-01 09:00:00 UTC,view,2,1,,,0.0,7,s1", ""]
    (src / "2019-Oct.csv").write_text("\n".join([",".join(HEADER), *good, *bad]) + "\n")
    write_month(src, "2019-Nov", [row()])
    star.load_and_model(spark, str(src), root)
    kept = star.rejected_lines(spark, root).collect()
    assert {r.line: r.reason for r in kept} == bad and {(r.month, r.file) for r in kept} == {("2019-Oct", "2019-Oct.csv")}
    write_month(src, "2019-Oct", [row()])
    star.reload_month(spark, str(src), root, "2019-Oct")
    assert star.rejected_lines(spark, root).count() == 0


def test_each_part_goes_by_its_own_header(spark, tmp_path):
    parts = tmp_path / "2019-Oct.csv"
    parts.mkdir()
    write_month(parts, "a", [row(product=1), row(product=2, price="9.00")])
    write_month(parts, "b", [r[::-1] for r in (row(product=2, price="1.00"), row(product=3))], header=HEADER[::-1])
    with gzip.open(parts / "c.csv.gz", "wt", newline="") as f:
        csv.writer(f).writerows([["note", *HEADER], ["n", *row(product=4)], ["n", *row(product="x")]])
    (parts / "d.csv").write_text("")
    log = raw_log.load_raw(spark, str(tmp_path))
    assert sorted((r.product_id, r.price) for r in log.filter("fault IS NULL").collect()) == [(1, 5.0), (2, 1.0), (2, 9.0), (3, 5.0), (4, 5.0)]
    star.load_and_model(spark, str(tmp_path), str(tmp_path / "out"))
    events = star.StarSchema.open(spark, str(tmp_path / "out")).fact_events
    assert sorted((r.product_id, r.price) for r in events.collect()) == [(1, 5.0), (2, 9.0), (3, 5.0), (4, 5.0)]  # the first copy
    assert [(r.file, r.reason) for r in star.rejected_lines(spark, str(tmp_path / "out")).collect()] == [("c.csv.gz", "unreadable_number")]
    write_month(parts, "e", [row()[1:]], header=HEADER[1:])
    with pytest.raises(ValueError, match="lacks the columns"):
        raw_log.load_raw(spark, str(tmp_path))


def test_a_line_is_split_once(spark, tmp_path):
    write_month(tmp_path, "2019-Oct", [row(product="x"), row()])
    found = raw_log.rejected_lines(spark, str(tmp_path), "2019-Oct")
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("from_csv(") == 1
    assert [(r.month, r.reason) for r in found.collect()] == [("2019-Oct", "unreadable_number")]


def test_all_months_are_named_at_once(spark, tmp_path, monkeypatch):
    src, root = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for month in ("2019-Oct", "2019-Nov", "2019 Dec=5%"):
        write_month(src, month, [row()])
    star.load_and_model(spark, str(src), root)
    said, real = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *rest, **more: (said.append(text), real(self, text, *rest, **more))[1])
    try:
        catalog.publish(spark, root, "at_once")
        assert sum(text.startswith("ALTER TABLE") for text in said) == 1
        assert spark.sql("SELECT month FROM at_once.fact_events").count() == 3
    finally:
        spark.sql("DROP DATABASE at_once CASCADE")
