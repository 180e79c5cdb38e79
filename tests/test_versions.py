"""Replacing tables all at once, loads that fail, and months that are read again."""

import os

import pytest
from pyspark.sql import functions as F

from tests.test_sources import row, write_month
from trolley.operators import cleaning, model
from trolley.plans import star
from trolley.sources import sinks
from trolley.sources.versions import KEPT, Conflict, Versions, fresh


def test_states_follow_one_another(spark, tmp_path):
    table = Versions(spark, str(tmp_path))
    assert table.current() == (0, {})
    assert table.publish({"a": 1}, 0) == 1 and table.publish({"a": "é"}, 1) == 2
    assert Versions(spark, str(tmp_path)).current() == (2, {"a": "é"})


def test_the_second_of_two_writers_starts_over(spark, tmp_path):
    table = Versions(spark, str(tmp_path))
    table.publish({"n": 0}, 0)
    with pytest.raises(Conflict):
        table.publish({"n": 9}, 0)
    assert table.current() == (1, {"n": 0})
    seen = []

    def add(state):
        if not seen:  # another writer comes first
            table.publish({"n": 5}, 1)
        seen.append(state["n"])
        return {"n": state["n"] + 1}

    assert table.update(add) == {"n": 6} and seen == [0, 5] and table.current() == (3, {"n": 6})
    assert table.update(lambda state: None) == {"n": 6} and table.current()[0] == 3
    assert not [n for n in os.listdir(tmp_path / "versions") if not n.endswith(("json", "crc"))]


def test_old_folders_go(spark, tmp_path):
    table = Versions(spark, str(tmp_path))
    folders = []
    for number in range(KEPT + 2):
        folders.append(fresh("t"))
        sinks.write_table(spark.range(number + 1), f"{tmp_path}/{folders[-1]}")
        table.publish({"t": folders[-1], "deep": {"first": [[0, folders[0]]]} if number < KEPT + 1 else {}}, number)
    table.tidy()
    assert [os.path.exists(f"{tmp_path}/{f}") for f in folders] == [True, False] + [True] * KEPT  # the first is named still
    assert spark.read.parquet(f"{tmp_path}/{table.current()[1]['t']}").count() == KEPT + 2


@pytest.fixture
def loaded(spark, tmp_path):
    """Three months with sessions, products and items that go over month ends, loaded."""
    src, root = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for n, month in enumerate(("2019-Oct", "2019-Nov", "2019-Dec")):
        rows = [row(time=f"2019-{10 + n}-0{1 + k % 7} 09:0{k % 10}:00 UTC", kind=("view", "cart", "purchase", "remove_from_cart")[(k + n) % 4],
                    product=k % 9, session=f"s{k % 5}", user=k % 4, price=f"{1 + k % 6}.50", brand="ab"[k % 2]) for k in range(60)]
        write_month(src, month, rows)
    star.load_and_model(spark, str(src), root)
    return str(src), root


def tables_of(spark, root):
    built = star.StarSchema.open(spark, root)
    return {n: sorted(map(str, getattr(built, n).collect())) for n in [*star.StarSchema.STORED, "fact_events"]}


def test_a_failing_reload_leaves_the_old_month(spark, loaded, monkeypatch):
    src, root = loaded
    before = tables_of(spark, root)
    write_month(src, "2019-Nov", [row(session="new", kind="cart")])

    def fails(df, path, *rest):
        if "dim_user" in path:
            raise OSError("disk is full")
        real(df, path, *rest)

    real = sinks.write_table
    monkeypatch.setattr(sinks, "write_table", fails)
    with pytest.raises(OSError):
        star.reload_month(spark, src, root, "2019-Nov")
    with pytest.raises(OSError):
        star.load_and_model(spark, src, root)
    assert tables_of(spark, root) == before
    monkeypatch.undo()
    star.reload_month(spark, src, root, "2019-Nov")
    assert tables_of(spark, root) != before


def test_an_open_reader_keeps_its_tables(spark, loaded):
    src, root = loaded
    reader = star.StarSchema.open(spark, root)
    before = sorted(map(str, reader.fact_events.collect()))
    write_month(src, "2019-Nov", [row(session="new", kind="cart")])
    star.reload_month(spark, src, root, "2019-Nov")
    assert sorted(map(str, reader.fact_events.collect())) == before


def test_a_reload_reads_one_month(spark, loaded, tmp_path):
    """The other months' events are spoilt on disk: any read of them would fail."""
    src, root = loaded
    write_month(src, "2019-Nov", [row(time=f"2019-11-05 10:0{k}:00 UTC", kind="cart", product=k, session="s1", user=1) for k in range(9)])
    events = Versions(spark, root).current()[1]["events"]
    for month in ("2019-Oct", "2019-Dec"):
        folder = f"{root}/{events[month]}"
        for name in os.listdir(folder):
            if name.endswith(".parquet"):
                os.remove(f"{folder}/.{name}.crc")
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(b"not parquet")
    star.reload_month(spark, src, root, "2019-Nov")
    whole = str(tmp_path / "whole")
    star.load_and_model(spark, src, whole)
    again, new = star.StarSchema.open(spark, root), star.StarSchema.open(spark, whole)
    for name in star.StarSchema.STORED:
        a, b = getattr(again, name), getattr(new, name)
        assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect())), name


def test_two_loads_at_once(spark, loaded, monkeypatch):
    """The load that started from an older state is refused."""
    src, root = loaded
    real = star.StarSchema.build

    def overtaken(self):
        built = real(self)
        monkeypatch.setattr(star.StarSchema, "build", real)
        star.reload_month(spark, src, root, "2019-Oct")
        return built

    monkeypatch.setattr(star.StarSchema, "build", overtaken)
    with pytest.raises(Conflict):
        star.reload_month(spark, src, root, "2019-Nov")
    assert star.StarSchema.open(spark, root).fact_events.count() > 0


def test_months_with_odd_names(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    write_month(src, "2019 Oct=50%", [row()])
    built = star.load_and_model(spark, str(src), str(tmp_path / "out"))
    assert [r.month for r in built.fact_events.collect()] == ["2019 Oct=50%"]


@pytest.mark.parametrize("make, merge", [
    (cleaning.fold, cleaning.merge_folds), (model.session_users, model.merge_session_users),
    (model.product_facts, model.merge_product_facts), (model.item_facts, model.merge_item_facts)])
def test_parts_in_any_cut_merge_to_the_whole(spark, raw, make, merge):
    kinds = ("view", "cart", "purchase", "remove_from_cart", None)
    log = raw(*[{"event_type": kinds[k % 5], "product_id": k % 4 or None, "user_id": k % 3, "user_session": f"s{k % 2}",
                 "price": [1.5, 2.25, None][k % 3], "brand": [None, "a", "b"][k % 3],
                 "event_time": f"2019-10-01 09:0{k % 6}:00 UTC"} for k in range(200)])
    if make is not cleaning.fold:
        log = cleaning.clean_events(cleaning.collapse_copies(log))
    log = log.withColumn("cut", F.pmod(F.hash(*log.columns) + F.lit(1), F.lit(3))).cache()
    parts = [make(log.filter(F.col("cut") == k).drop("cut")) for k in range(3)]
    merged = merge(parts[2].unionByName(parts[0]).unionByName(parts[1]))
    whole = make(log.drop("cut"))
    assert sorted(map(str, merged.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    log.unpersist()


def test_months_share_their_jobs(spark, tmp_path, monkeypatch):
    """Five months take as many writes as one, and give the rows and the turned-away lines of each."""
    written = []
    real = sinks.write_table
    monkeypatch.setattr(sinks, "write_table", lambda df, path, *rest: (written.append(path), real(df, path, *rest)))
    counts = {}
    for many in (1, 5):
        src = tmp_path / f"src{many}"
        src.mkdir()
        for k in range(many):
            write_month(src, f"2019-0{k + 1}", [row(time=f"2019-0{k + 1}-01 09:00:00 UTC", kind="cart", product=n) for n in range(k + 1)] + [row(product="x")])
        written.clear()
        star.load_months(spark, str(src), str(tmp_path / f"out{many}"))
        counts[many] = len(written)
    assert counts[5] == counts[1]
    root = str(tmp_path / "out5")
    kept = star.StarSchema.over(spark, root).fact_events.groupBy("month").count()
    assert sorted(map(tuple, kept.collect())) == [(f"2019-0{k + 1}", k + 1) for k in range(5)]
    assert sorted(r.month for r in star.rejected_lines(spark, root).collect()) == [f"2019-0{k + 1}" for k in range(5)]


def test_groups_of_months_are_all_loaded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(star, "MONTHS_AT_ONCE", 2)
    src = tmp_path / "src"
    src.mkdir()
    for k in range(5):
        write_month(src, f"2019-0{k + 1}", [row(time=f"2019-0{k + 1}-01 09:00:00 UTC", session=f"s{k}")] if k != 3 else [])
    built = star.load_and_model(spark, str(src), str(tmp_path / "out"))
    assert sorted(r.user_session for r in built.dim_session.collect()) == ["s0", "s1", "s2", "s4"]
    assert sorted(Versions(spark, str(tmp_path / "out")).current()[1]["events"]) == [f"2019-0{k + 1}" for k in range(5)]


def test_one_write_for_all_values(spark, tmp_path):
    log = spark.range(1000, numPartitions=3).selectExpr("id", "concat('m', id % 2) AS month")
    sinks.write_csvs(log, "month", str(tmp_path), {"m0": "a.csv", "m1": "b.csv", "m2": "none.csv"})
    assert sorted(n for n in os.listdir(tmp_path) if not n.startswith(".")) == ["a.csv", "b.csv", "none.csv"]
    for odd, name in enumerate(("a.csv", "b.csv")):
        files = sorted(n for n in os.listdir(tmp_path / name) if n.endswith(".csv"))
        texts = [open(tmp_path / name / n).read().split() for n in files]
        assert {t[0] for t in texts} == {"id"} and [int(v) for t in texts for v in t[1:]] == list(range(odd, 1000, 2))
