"""Intermediate tables."""

import pyarrow as pa

from trolley.llm._store import stored


def test_batches_of_long_texts_stay_small(spark):
    """Each side holds a batch whole, so its size must not follow from the length of 10,000 texts."""
    texts = spark.range(64, numPartitions=1).selectExpr("id", "repeat('x', 500000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found = stored(texts.mapInArrow(sizes, "n long, bytes long"), "sizes").collect()
    assert sum(r.n for r in found) == 64 and max(r.bytes for r in found) < 8_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
