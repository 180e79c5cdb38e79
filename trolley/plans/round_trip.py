"""The ways through files as queries: the derived log as monthly CSV files, loaded, reloaded, published and exported."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trolley.operators import cleaning, views
from trolley.plans import catalog, star
from trolley.schema import EVENT_COLUMNS
from trolley.sources import events_log, raw_log, sinks
from trolley.sources.files import listing
from trolley.sources.staging import staging_dir

_folders: dict[tuple, str] = {}

#: The band that ``csv_one_band`` shows.
BAND = "5-10"


def folder_of(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the log as monthly files (``raw``), its tables (``tables``) and exports (``out``), made once.

    Every month is loaded, the last one is loaded again on its own, and all results are read back from the files.
    """
    key = (spark.sparkContext.applicationId, sf_dir, listing(spark, f"{sf_dir}/events.parquet"))
    if key not in _folders:
        root = staging_dir(spark)
        raw = events_log.raw_from_events(events_log.read_events(spark, sf_dir))
        months = sorted(r["month"] for r in raw.select("month").distinct().collect())
        sinks.write_csvs(raw.select(*EVENT_COLUMNS, "month"), "month", f"{root}/raw", {m: f"{m}.csv" for m in months})
        star.load_and_model(spark, root, f"{root}/tables", source="raw")
        built = star.reload_month(spark, f"{root}/raw", f"{root}/tables", months[-1])
        star.export_dashboard(built, f"{root}/out")
        _folders[key] = root
    return _folders[key]


def database_of(spark: SparkSession, sf_dir: str) -> str:
    """The database with the loaded tables of a data folder."""
    root = folder_of(spark, sf_dir)
    name = f"trolley_{hashlib.md5(root.encode()).hexdigest()}"
    if not spark.catalog.databaseExists(name):
        catalog.publish(spark, f"{root}/tables", name)
    return name


def _star(spark: SparkSession, sf_dir: str) -> star.StarSchema:
    return star.StarSchema.open(spark, f"{folder_of(spark, sf_dir)}/tables")


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months found in the folder, with the lines of each."""
    log = raw_log.load_raw(spark, f"{folder_of(spark, sf_dir)}/raw")
    return log.groupBy("month").agg(F.count("*").alias("n_rows"))


def outcomes_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published tables asked by name, from a session of its own."""
    name = database_of(spark, sf_dir)
    return spark.newSession().sql(f"""
        SELECT i.outcome, s.start_hour, count(*) AS items, count(DISTINCT i.user_session) AS sessions
        FROM `{name}`.fact_cart_items i JOIN `{name}`.dim_session s ON s.user_session = i.user_session
        WHERE s.is_bot = 0 GROUP BY i.outcome, s.start_hour""")


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_log.load_dashboard_items(spark, f"{folder_of(spark, sf_dir)}/out/dashboard_cart_items")


def cleaning_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema("step string, message string").option("header", True).csv(
        f"{folder_of(spark, sf_dir)}/tables/cleaning_log")


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.rejected_lines(spark, f"{folder_of(spark, sf_dir)}/tables").select("month", "line", "reason")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_months": months,
    "csv_clean_events": lambda spark, sf_dir: _star(spark, sf_dir).fact_events,
    "csv_dim_session": lambda spark, sf_dir: _star(spark, sf_dir).dim_session,
    "csv_cart_items": lambda spark, sf_dir: _star(spark, sf_dir).fact_cart_items,
    "csv_dim_product": lambda spark, sf_dir: _star(spark, sf_dir).dim_product,
    "csv_row_retention": lambda spark, sf_dir: cleaning.row_retention(_star(spark, sf_dir).collapsed_events),
    "csv_cleaning_audit": lambda spark, sf_dir: spark.read.parquet(f"{folder_of(spark, sf_dir)}/tables/cleaning_audit"),
    "csv_cleaning_log": cleaning_log,
    "csv_rejected_lines": rejected,
    "csv_dashboard": dashboard,
    "csv_funnel": lambda spark, sf_dir: raw_log.load_funnel(spark, f"{folder_of(spark, sf_dir)}/out/funnel"),
    "csv_one_band": lambda spark, sf_dir: views.view_price_band_pct(views.profile_of(dashboard(spark, sf_dir)), [BAND]),
    "sql_outcomes": outcomes_by_sql,
}
