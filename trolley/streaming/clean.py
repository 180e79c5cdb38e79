"""Incremental cleaning: the batch rules over arriving files, as Structured Streaming queries.

``start_clean`` gives the batch result whatever the order and the cut of the files, an event at any time.  A micro-batch
is folded to one row per event (``cleaning.fold``), which is a partial result, and written as a run.  Rows of one event have one
time, so runs are cut by month and day of the event, and only runs of one day ever have to be merged.  When a day
has ``FAN_IN`` runs of one level they are merged to one of the next level: a row is written at most once per level,
and the levels grow with the logarithm of the number of runs of its day, not with their number.  Days that a micro-batch does not touch
are not read.  Readers merge what runs a day has left (``cleaned``); days with one run need no shuffle.

Which runs are live, and up to which micro-batch, is one state that changes all at once (``sources.versions``): a
micro-batch that is repeated after a failure adds nothing, and a reader never sees half of one.

``start_fresh`` is the early view: it passes each event on at first sight, with state bounded by a watermark.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from trolley.functions.clicks import positive
from trolley.operators import cleaning
from trolley.schema import COLLAPSED, EVENT_COLUMNS, EVENT_KEY
from trolley.sources import raw_log
from trolley.sources.files import file_system
from trolley.sources.versions import Versions, fresh

#: Runs of one level of one day that are merged to one of the next level.
FAN_IN = 8

#: A cleaned event.
CLEAN = T.StructType([f for f in COLLAPSED.fields if f.name not in ("copies", "fault")])

_MONTH_OF_FILE = r"([^/]+?)\.csv"


class Runs:
    """Folds of micro-batches at a path, by month and day.

    The state has ``batches``: the last micro-batch of each streaming query, ``schema``: that of a fold, and ``days``: for each
    day's folder name the live runs as [level, folder].
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self.versions = Versions(spark, path)
        self._path = self.versions.root

    def add(self, rows: DataFrame, query: str, number: int) -> None:
        """Take in a micro-batch, unless it has been taken in before."""
        _, state = self.versions.current()
        if state.get("batches", {}).get(query, -1) >= number:
            return
        fold = cleaning.fold(rows)
        folder, days = self._write(fold, 0)

        def added(state: dict) -> dict:
            state.setdefault("schema", fold.schema.json())
            state.setdefault("batches", {})[query] = number
            for day in days:
                state.setdefault("days", {}).setdefault(day, []).append([0, folder])
            return state

        state = self.versions.update(added)
        while due := self._due(state):
            state = self._merge(state, due)
        self.versions.tidy()

    def compact(self) -> None:
        """Merge all runs of every day to one."""
        _, state = self.versions.current()
        several = {day: runs for day, runs in state.get("days", {}).items() if len(runs) > 1}
        if several:
            self._merge(state, several)
            self.versions.tidy()

    def fold(self) -> DataFrame | None:
        """The fold of all that has arrived; None before the first micro-batch."""
        _, state = self.versions.current()
        if "schema" not in state:
            return None
        one, several = {}, {}
        for day, runs in state.get("days", {}).items():
            (one if len(runs) == 1 else several)[day] = runs
        parts = [self._read(state, one)] if one or not several else []
        if several:
            parts.append(cleaning.merge_folds(self._read(state, several)))
        return reduce(DataFrame.unionByName, parts)

    @staticmethod
    def _due(state: dict) -> dict[str, list]:
        """The runs of one level, by day, where that level is full."""
        due = {}
        for day, runs in state.get("days", {}).items():
            for level in sorted({level for level, _ in runs}):
                own = [run for run in runs if run[0] == level]
                if len(own) >= FAN_IN:
                    due[day] = own
                    break
        return due

    def _read(self, state: dict, days: dict[str, list]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self._path}/{folder}/{day}" for day, runs in days.items() for _, folder in runs]
        return self._spark.read.schema(schema).parquet(*paths) if paths else self._spark.createDataFrame([], schema)

    def _write(self, fold: DataFrame, level: int) -> tuple[str, list[str]]:
        """A run of the given level, and the days that it has."""
        folder = fresh(f"runs/level={level}")
        day = F.coalesce(F.to_date("event_time").cast("string"), F.lit("none"))
        cut = fold.withColumns({"in_month": F.col("month"), "in_day": day})
        cut.write.partitionBy("in_month", "in_day").parquet(f"{self._path}/{folder}")
        where, files = file_system(self._spark, f"{self._path}/{folder}/in_month=*/in_day=*")
        found = files.globStatus(where) or []
        return folder, [f"{s.getPath().getParent().getName()}/{s.getPath().getName()}" for s in found]

    def _merge(self, state: dict, due: dict[str, list]) -> dict:
        """Merge the given runs of each day to one of the level above them."""
        level = 1 + max(level for runs in due.values() for level, _ in runs)
        folder, _ = self._write(cleaning.merge_folds(self._read(state, due)), level)

        def merged(state: dict) -> dict | None:
            days = state["days"]
            if any(run not in days.get(day, []) for day, runs in due.items() for run in runs):
                return None  # another writer has merged them
            for day, runs in due.items():
                days[day] = [run for run in days[day] if run not in runs] + [[level, folder]]
            return state

        return self.versions.update(merged)


def _each_batch(raw: DataFrame, checkpoint: str, take_in: Callable[[DataFrame, str, int], None]) -> StreamingQuery:
    """Hand everything that has arrived to ``take_in`` with the id of the query and the number of the micro-batch."""
    ids: list[str] = []
    started = threading.Event()

    def each(batch: DataFrame, number: int) -> None:
        started.wait()
        take_in(batch, ids[0], number)

    query = raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    ids.append(query.id)
    started.set()
    return query


def start_clean(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take in everything that has arrived in the streaming raw log and stop; the runs lie at ``path``."""

    def take_in(batch: DataFrame, query: str, number: int) -> None:
        if "arrival_block" in batch.columns:  # a log with file positions
            batch = batch.withColumn("arrival_row", F.monotonically_increasing_id())
        Runs(batch.sparkSession, path).add(batch, query, number)

    return _each_batch(raw, checkpoint, take_in)


def cleaned(spark: SparkSession, path: str) -> DataFrame:
    """The cleaned events of all that has arrived."""
    fold = Runs(spark, path).fold()
    if fold is None:
        raise ValueError(f"nothing has arrived at {path}")
    return cleaning.clean_events(cleaning.events_of(fold))


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def start_fresh(raw: DataFrame, path: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Pass on each clean event at the first sight of a usable copy, and stop when all that has arrived is taken in.

    Copies within ``delay`` of the latest event time are recognised by a state of event keys in RocksDB, which forgets a key when the
    watermark passes it, so its size follows the events of the delay and not those of the log.  Rows behind the
    watermark are left out here; ``start_clean`` over the same files takes them in, and ``late_events`` lists them.
    """
    spark = raw.sparkSession
    columns = [*EVENT_COLUMNS, "month"]
    timed = cleaning.with_event_time(raw)
    usable = F.col("event_time").isNotNull() & F.col("user_session").isNotNull() & positive(F.col("price"))
    if "fault" in raw.columns:
        usable &= F.col("fault").isNull()
    # a watermark needs an instant: the zone-free time read as UTC, whatever the session's zone
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    moment = F.timestamp_seconds(F.timestamp_diff("SECOND", epoch, F.col("event_time")))
    first = (
        timed.filter(usable).select(*columns, moment.alias("moment"))
        .withWatermark("moment", delay)
        .dropDuplicatesWithinWatermark([*EVENT_KEY, "month"])
        .drop("moment")
    )
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return (
            first.writeStream.format("parquet").partitionBy("month").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)


def first_seen(spark: SparkSession, path: str) -> DataFrame:
    """The events that ``start_fresh`` has passed on."""
    return spark.read.schema(CLEAN).parquet(path)


def late_events(spark: SparkSession, fresh_path: str, path: str) -> DataFrame:
    """Cleaned events that came too late for the early view: the side table to add to it."""
    everything, seen = cleaned(spark, path).alias("e"), first_seen(spark, fresh_path).alias("s")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*EVENT_KEY, "month")]
    return everything.join(seen, reduce(lambda a, b: a & b, same), "left_anti")


def read_stream_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream over the Parquet files at a path, with the schema of the files there now.

    ``max_files`` bounds a micro-batch; else all new files form one.
    """
    return _bounded(spark, max_files).schema(spark.read.parquet(path).schema).parquet(path)


def read_stream_months(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream over the monthly CSV files of a folder that has one at least; a file's name is its month."""
    log = raw_log.read_events(_bounded(spark, max_files), raw_log.header_of(spark, path), path)
    name = F.col("_metadata.file_name")
    return log.withColumns({
        "month": F.regexp_extract(name, _MONTH_OF_FILE, 1),
        "arrival_file": name,
        "arrival_block": F.col("_metadata.file_block_start"),
    }).drop("_metadata")


def _bounded(spark: SparkSession, max_files: int | None):
    reader = spark.readStream
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader
