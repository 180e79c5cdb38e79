"""The star schema as tables of the session catalog, found by name from any session that shares it.

Tables are external: the catalog holds schema and location, the files stay where the load put them.  The event table is
partitioned by month, each partition at the folder of its last load; the cleaned events are a view over it.  Publishing
again after a reload moves the names to the new folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trolley.plans.star import StarSchema
from trolley.schema import COLLAPSED, Rules
from trolley.sources.versions import Versions

_CLEAN = "fault IS NULL AND event_time IS NOT NULL AND user_session IS NOT NULL AND price > 0 AND price < double('Infinity')"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def publish(spark: SparkSession, root: str, database: str, rules: Rules = Rules()) -> None:
    """Give the tables of the last finished load at ``root`` names in ``database``."""
    star = StarSchema.open(spark, root, rules)
    _, state = Versions(spark, root).current()
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name in star.STORED:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in getattr(star, name).schema.fields)
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
        spark.sql(f"CREATE TABLE `{database}`.`{name}` ({columns}) USING parquet "
                  f"LOCATION {_quoted(f'{root}/{state["tables"]}/{name}')}")
    events = f"`{database}`.`collapsed_events`"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in COLLAPSED.fields)
    spark.sql(f"DROP TABLE IF EXISTS {events}")
    spark.sql(f"CREATE TABLE {events} ({columns}) USING parquet PARTITIONED BY (month) LOCATION {_quoted(f'{root}/collapsed_events')}")
    parts = [f"PARTITION (month = {_quoted(m)}) LOCATION {_quoted(f'{root}/{folder}')}" for m, folder in sorted(state["events"].items())]
    spark.sql(f"ALTER TABLE {events} ADD IF NOT EXISTS {' '.join(parts)}")
    kept = ", ".join(f"`{f.name}`" for f in COLLAPSED.fields if f.name not in ("copies", "fault"))
    spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`fact_events` AS SELECT {kept} FROM {events} WHERE {_CLEAN}")


def table(spark: SparkSession, database: str, name: str) -> DataFrame:
    return spark.table(f"`{database}`.`{name}`")


def star_of(spark: SparkSession, database: str, rules: Rules = Rules()) -> StarSchema:
    """The star schema over the published tables."""
    star = StarSchema(lambda: table(spark, database, "collapsed_events"), rules=rules)
    for name in ("collapsed_events", *StarSchema.STORED):
        star._tables[name] = table(spark, database, name)
    return star
