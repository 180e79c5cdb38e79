"""The stream against the batch, whatever the order and the cut of the files."""

import pytest
from pyspark.sql import Window, functions as F

from tests.conftest import DATA
from tests.test_sources import row, write_month
from trolley.operators import cleaning
from trolley.sources import events_log, raw_log
from trolley.streaming import clean


def same(a, b):
    return a.count() == b.count() and a.select(b.columns).exceptAll(b).count() == 0


@pytest.mark.parametrize("newest_first", [False, True])
@pytest.mark.parametrize("max_files", [None, 1])
def test_files_in_any_order_equal_the_batch(spark, tmp_path, newest_first, max_files):
    """Files that arrive one after the other, the later ones with copies of earlier rows at another price."""
    raw = events_log.raw_from_events(events_log.read_events(spark, f"{DATA}/sf0.001"))
    again = raw.withColumn("price", F.when(F.hash("event_time") % 3 == 0, F.lit(None)).otherwise(F.col("price") / 2))
    everything = raw.unionByName(again)
    src, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    days = [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-02")]
    for start, end in reversed(days) if newest_first else days:
        between = (F.col("event_time") >= start) & (F.col("event_time") < end)
        for part in (raw, again):
            part.filter(between).coalesce(1).write.mode("append").parquet(src)
        clean.start_clean(clean.read_stream_files(spark, src, max_files), out, checkpoint).awaitTermination()
    batch = cleaning.clean_events(cleaning.collapse_copies(everything))
    assert same(clean.cleaned(spark, out), batch)


def test_a_copy_in_a_later_file(spark, raw, tmp_path):
    src, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for price in (None, 4.0, 3.0):
        raw({"price": price}, {"user_session": None}, {"price": 0.0, "product_id": 2}).write.mode("append").parquet(src)
        clean.start_clean(clean.read_stream_files(spark, src), out, checkpoint).awaitTermination()
    assert [r.price for r in clean.cleaned(spark, out).collect()] == [3.0]


def test_monthly_csv_files(spark, tmp_path):
    src = tmp_path / "months"
    src.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    rows = [row(product=p, price=f"{9 - i}.50") for i in range(3) for p in range(20)]
    for month in ("2019-Nov", "2019-Oct"):
        write_month(src, month, rows + [row(product="x")])
        clean.start_clean(clean.read_stream_months(spark, str(src)), out, checkpoint).awaitTermination()
    batch = cleaning.clean_events(cleaning.collapse_copies(raw_log.load_raw(spark, str(src))))
    assert same(clean.cleaned(spark, out), batch) and batch.count() == 40


def test_no_state(spark):
    raw = events_log.raw_from_events(clean.read_stream_files(spark, f"{DATA}/sf0.001/event[s].parquet"))
    assert raw.isStreaming and "StateStore" not in raw._jdf.queryExecution().toString()


def _written(monkeypatch):
    """Counts the rows that runs are written from, by level."""
    rows = {}
    real = clean.Runs._write

    def counted(self, fold, level):
        folder, days = real(self, fold, level)
        rows[level] = rows.get(level, 0) + self._spark.read.parquet(f"{self._path}/{folder}").count()
        return folder, days

    monkeypatch.setattr(clean.Runs, "_write", counted)
    return rows


@pytest.mark.parametrize("batches, shuffled", [(1, False), (10, False), (40, False), (12, True)])
def test_work_follows_the_rows(spark, tmp_path, monkeypatch, batches, shuffled):
    """However many micro-batches a log comes in, in time order or dealt at random, a row is written once per level."""
    monkeypatch.setattr(clean, "FAN_IN", 4)
    raw = events_log.raw_from_events(events_log.read_events(spark, f"{DATA}/sf0.001"))
    raw = raw.unionByName(raw.withColumn("price", F.col("price") / 2)).cache()
    n = raw.count()
    place = F.pmod(F.hash("event_time", "user_id", "price"), F.lit(batches))
    if not shuffled:
        place = (F.percent_rank().over(Window.orderBy("event_time", "user_id")) * (batches - 0.001)).cast("int")
    parts = raw.withColumn("part", place).cache()
    rows = _written(monkeypatch)
    runs = clean.Runs(spark, str(tmp_path / "out"))
    for k in range(batches):
        runs.add(parts.filter(F.col("part") == k).drop("part"), "test", k)
    levels = {1: 0, 10: 2, 12: 2, 40: 3}[batches]
    assert sum(rows.values()) <= n * (1 + levels) and max(rows) <= levels
    if not shuffled:  # days are finished one after the other: only a day that several parts touch is merged, once or twice
        assert sum(count for level, count in rows.items() if level) <= n
    assert max(len(live) for live in runs.versions.current()[1]["days"].values()) < 3 * clean.FAN_IN
    batch = cleaning.clean_events(cleaning.collapse_copies(raw))
    assert same(clean.cleaned(spark, str(tmp_path / "out")), batch)
    runs.compact()
    assert all(len(live) == 1 for live in runs.versions.current()[1]["days"].values())
    compacted = clean.cleaned(spark, str(tmp_path / "out"))
    assert same(compacted, batch)
    assert "Exchange" not in compacted._jdf.queryExecution().executedPlan().toString()
    raw.unpersist()
    parts.unpersist()


def test_a_repeated_micro_batch_adds_nothing(spark, raw, tmp_path):
    runs = clean.Runs(spark, str(tmp_path))
    log = raw({}, {"product_id": 2}, {"event_time": "never"})
    for query, number in (("a", 0), ("a", 0), ("a", 1), ("a", 0), ("b", 0)):
        runs.add(log, query, number)
    assert [r.copies for r in runs.fold().orderBy("event_time").collect()] == [3, 3, 3]


def test_a_failing_merge_leaves_what_has_arrived(spark, raw, tmp_path, monkeypatch):
    monkeypatch.setattr(clean, "FAN_IN", 2)
    runs = clean.Runs(spark, str(tmp_path))
    runs.add(raw({}), "a", 0)
    monkeypatch.setattr(clean.Runs, "_merge", lambda *given: (_ for _ in ()).throw(OSError("disk is full")))
    with pytest.raises(OSError):
        runs.add(raw({}, {"product_id": 2}), "a", 1)
    monkeypatch.undo()
    assert clean.cleaned(spark, str(tmp_path)).count() == 2
    runs.add(raw({}, {"product_id": 2}), "a", 1)  # repeated: it had been taken in
    assert sorted(r.copies for r in runs.fold().collect()) == [1, 2]


def test_nothing_has_arrived(spark, raw, tmp_path):
    with pytest.raises(ValueError, match="nothing has arrived"):
        clean.cleaned(spark, str(tmp_path))
    runs = clean.Runs(spark, str(tmp_path))
    runs.add(raw({}).limit(0), "a", 0)
    assert clean.cleaned(spark, str(tmp_path)).count() == 0


def test_the_early_view_forgets(spark, raw, tmp_path):
    """State stays with the events of the delay; late rows and copies are left to the merged table."""
    src, fresh, out = (str(tmp_path / n) for n in ("in", "fresh", "out"))
    for day in range(1, 9):
        rows = [{"event_time": f"2019-10-0{day} 0{h}:{m:02}:00 UTC", "product_id": m} for h in range(10) for m in range(50)]
        rows += rows[-5:]  # copies
        if day == 6:
            rows += [{"event_time": "2019-10-02 23:00:00 UTC"}, {"event_time": "never"}, {"price": 0.0}]  # a late event, bad rows
        raw(*rows).coalesce(1).write.mode("append").parquet(src)
        query = clean.start_fresh(clean.read_stream_files(spark, src, 1), fresh, str(tmp_path / "c1"), "30 minutes")
        query.awaitTermination()
        held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        assert held and held[-1] <= 600
    clean.start_clean(clean.read_stream_files(spark, src), out, str(tmp_path / "c2")).awaitTermination()
    seen, late = clean.first_seen(spark, fresh), clean.late_events(spark, fresh, out)
    assert seen.count() == 8 * 500 and seen.dropDuplicates(["event_time", "product_id"]).count() == 8 * 500
    assert [str(r.event_time) for r in late.collect()] == ["2019-10-02 23:00:00"]
    assert same(seen.unionByName(late), clean.cleaned(spark, out))
