"""Intermediate tables in the shared folder, and row filters by a list of ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley.sources.staging import root_of, use_root

#: A list of ids is broadcast up to this many rows (16 bytes each or less); beyond it rows are shuffled.
BROADCAST_IDS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without the setting gets its own."""
    if not root_of(spark):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("intermediate tables need a shared folder: set spark.checkpoint.dir")
        use_root(spark, tempfile.mkdtemp(prefix="llm-"))
    return root_of(spark).rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Settings while a table is written: shuffle files go when their query ends, and a batch of rows that is passed to or
#: from Python stays small however long its texts are (both sides hold it whole, and keep its memory for the next one).
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    _BATCH: "4m",
}


def small_batches(spark: SparkSession) -> None:
    """The same bound on batches for what the session runs from now on, unless it names one itself.

    For rows that are returned: their query runs later, wherever the caller writes or collects them.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, _SETTINGS[_BATCH])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later steps neither repeat it nor depend on lost executors.

    The shuffle files behind it go as soon as it is written, so only one step's shuffles lie on the disks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def by_ids(docs: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Rows of ``docs`` whose ``column`` is (left_semi) or is not (left_anti) in the stored one-column ``ids``.

    The list is broadcast only after its rows have been counted; a longer one is joined by a shuffle.
    """
    key = ids.columns[0]
    ids = ids.select(F.col(key).alias("_llm_id"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[column] == F.col("_llm_id"), how)
