import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import SparkSession, types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trolley.schema import COLLAPSED, RAW  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("trolley-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "2000")  # whole filter lists in plan texts
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text):
    """'09:15:22' on 1 Oct 2019, or a full date and time."""
    return datetime.fromisoformat(text if " " in text else f"2019-10-01 {text}")


@pytest.fixture
def raw(spark):
    """Raw rows from dicts; fields left out take plain values."""

    def make(*rows, month="2019-Oct"):
        plain = {
            "event_time": "2019-10-01 09:00:00 UTC", "event_type": "view", "product_id": 1,
            "category_id": 10, "category_code": None, "brand": None, "price": 5.0, "user_id": 100,
            "user_session": "s1", "month": month,
        }
        schema = T.StructType(RAW.fields + [T.StructField("month", T.StringType())])
        return spark.createDataFrame([tuple({**plain, **r}[f] for f in schema.names) for r in rows], schema)

    return make


@pytest.fixture
def events(spark):
    """Cleaned events from dicts; fields left out take plain values."""

    def make(*rows):
        plain = {
            "event_time": at("09:00:00"), "event_type": "view", "product_id": 1, "category_id": 10,
            "category_code": None, "brand": None, "price": 5.0, "user_id": 100, "user_session": "s1",
            "month": "2019-10",
        }
        schema = T.StructType([f for f in COLLAPSED.fields if f.name not in ("copies", "fault")])
        return spark.createDataFrame([tuple({**plain, **r}[f] for f in schema.names) for r in rows], schema)

    return make


@pytest.fixture
def items(spark):
    """Cart items with their session's figures, from dicts."""

    def make(*rows):
        plain = {
            "user_session": "s1", "product_id": 1, "user_id": 100, "price": 5.0,
            "outcome": "abandoned_silent", "seconds_to_purchase": None, "start_hour": 9,
            "session_start": at("09:00:00"), "n_views": 1, "n_carts": 1, "is_bot": 0,
            "carted_at": at("09:00:00"), "removed_at": None, "purchased_at": None,
        }
        schema = ("user_session string, product_id long, user_id long, price double, outcome string, "
                  "seconds_to_purchase int, start_hour int, session_start timestamp_ntz, n_views long, "
                  "n_carts long, is_bot int, carted_at timestamp_ntz, removed_at timestamp_ntz, "
                  "purchased_at timestamp_ntz")
        return spark.createDataFrame([tuple({**plain, **r}[f] for f in plain) for r in rows], schema)

    return make


@pytest.fixture
def sessions(spark):
    """Session rows (session, user, start[, counters]) from dicts."""

    def make(*rows):
        plain = {
            "user_session": "s1", "user_id": 100, "session_start": at("09:00:00"), "n_events": 1,
            "n_views": 1, "n_carts": 0, "n_removes": 0, "n_purchases": 0, "start_hour": 9, "is_bot": 0,
        }
        schema = ("user_session string, user_id long, session_start timestamp_ntz, n_events long, "
                  "n_views long, n_carts long, n_removes long, n_purchases long, start_hour int, is_bot int")
        return spark.createDataFrame([tuple({**plain, **r}[f] for f in plain) for r in rows], schema)

    return make
