"""What executors and their Python workers hold."""

import re
from pathlib import Path

import pyarrow as pa

from trolley.llm import decontam
from trolley.llm._store import small_batches
from trolley.llm._words import chunks

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_stay_small_whoever_runs_the_query(spark):
    """A stage's last rows are written by its caller, not by ``stored``."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    spark.conf.unset(BATCH)
    texts = spark.range(64, numPartitions=1).selectExpr("id AS doc_id", "repeat('x', 500000) AS text")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    kept = decontam.clean(texts, decontam.index(texts, bench))
    found = kept.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 64 and max(r.bytes for r in found) < 8_000_000


def test_the_sessions_own_bound_stays(spark):
    spark.conf.set(BATCH, "1m")
    small_batches(spark)
    assert spark.conf.get(BATCH) == "1m"
    spark.conf.unset(BATCH)


def held_mb():
    return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_freed_memory_is_given_back():
    """A block that lives on behind freed ones must not keep them with the worker."""
    rows, last = pa.RecordBatch.from_pydict({"text": ["some text"]}), []
    before = held_mb()
    for _ in chunks(iter([rows]), 0):
        freed = [bytes(2000 + k % 7) for k in range(50_000)]
        last.append(bytes(2000))
        assert held_mb() > before + 90
        del freed
    assert held_mb() < before + 40
