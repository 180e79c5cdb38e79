"""The star schema: derived tables, each written once and read by every later query."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from trolley.operators import analysis, cleaning, cohorts, model, views
from trolley.schema import COLLAPSED, Rules
from trolley.sources import raw_log, sinks
from trolley.sources.versions import Versions, fresh

#: Months that are cleaned in the same jobs, which bounds the size of a plan, and how many such groups run side by side.
MONTHS_AT_ONCE, GROUPS_AT_ONCE = 16, 4

#: What is kept for each month: its unique events and the partial results from which all tables are merged.
_PARTS = {
    "session_users": (model.session_users, model.merge_session_users),
    "product_facts": (model.product_facts, model.merge_product_facts),
    "item_facts": (model.item_facts, model.merge_item_facts),
}


def _read_events(spark: SparkSession, root: str, months: dict[str, str]) -> DataFrame:
    """The event table of the given months, each from its folder; a filter on ``month`` drops the others."""
    if not months:
        raise ValueError(f"there are no events at {root}")
    reader = spark.read.schema(COLLAPSED).option("basePath", f"{root}/collapsed_events")
    return reader.parquet(*[f"{root}/{folder}" for _, folder in sorted(months.items())])


def _manifest(rules: Rules) -> str:
    return json.dumps(asdict(rules), sort_keys=True)


class StarSchema:
    """Tables derived from a raw click log.

    With a ``root`` folder a table is written there as Parquet at first use and read back from then on, so
    the cleaning shuffle runs once however many queries follow, file sizes tell Spark which sides are
    small enough to broadcast, and a lost executor costs only its running tasks.  Without a root every
    table is a lazy DataFrame.
    """

    def __init__(
        self, raw: Callable[[], DataFrame], root: str | None = None, rules: Rules = Rules()
    ) -> None:
        self._raw = raw
        self._root = root
        self.rules = rules
        self._tables: dict[str, DataFrame] = {}
        self._parts: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = {}

    STORED = [
        "session_users", "product_facts", "dim_brand", "dim_category", "dim_product", "dim_session", "dim_user",
        "fact_cart_items", "bot_sessions", "human_items", "item_profile", "cohort_counts", "visit_rates",
    ]

    @classmethod
    def over(cls, spark: SparkSession, root: str, rules: Rules = Rules(), state: dict | None = None) -> StarSchema:
        """A schema over the months loaded at ``root``; its tables go to a folder of their own, unseen by others."""
        state = Versions(spark, root).current()[1] if state is None else state
        star = cls(lambda: None, f"{root}/{fresh('tables')}", rules)
        star._tables["collapsed_events"] = _read_events(spark, root, state.get("events", {}))
        for name, months in state.get("parts", {}).items():
            star._parts[name] = spark.read.parquet(*[f"{root}/{folder}" for _, folder in sorted(months.items())])
        return star

    @classmethod
    def open(cls, spark: SparkSession, root: str, rules: Rules = Rules()) -> StarSchema:
        """A schema over the tables that the last finished load wrote, under the same rules."""
        state = Versions(spark, root).current()[1]
        if "tables" not in state:
            raise ValueError(f"the tables at {root} are not completely built")
        if state["rules"] != _manifest(rules):
            raise ValueError(f"the tables at {root} were built under other rules: {state['rules']}")
        star = cls(lambda: None, f"{root}/{state['tables']}", rules)
        star._tables["collapsed_events"] = _read_events(spark, root, state["events"])
        for name in cls.STORED:
            star._tables[name] = spark.read.parquet(f"{root}/{state['tables']}/{name}")
        return star

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        with self._locks.setdefault(name, threading.Lock()):
            if name not in self._tables:
                df = make()
                if self._root:
                    path = f"{self._root}/{name}"
                    sinks.write_table(df, path)
                    df = df.sparkSession.read.schema(df.schema).parquet(path)
                self._tables[name] = df
            return self._tables[name]

    def _merged(self, name: str) -> DataFrame:
        """Partial results merged from the months' where these are stored, else taken from the events."""
        make, merge = _PARTS[name]
        return merge(self._parts[name]) if name in self._parts else make(self.fact_events)

    @property
    def collapsed_events(self) -> DataFrame:
        """All raw events without their copies, still with the rows that cleaning drops."""
        return self._table("collapsed_events", lambda: cleaning.collapse_copies(self._raw()))

    @property
    def fact_events(self) -> DataFrame:
        return cleaning.clean_events(self.collapsed_events)

    @property
    def session_users(self) -> DataFrame:
        return self._table("session_users", lambda: self._merged("session_users"))

    @property
    def product_facts(self) -> DataFrame:
        return self._table("product_facts", lambda: self._merged("product_facts"))

    @property
    def dim_category(self) -> DataFrame:
        return self._table("dim_category", lambda: model.categories_of(self.product_facts))

    @property
    def dim_brand(self) -> DataFrame:
        return self._table("dim_brand", lambda: model.brands_of(self.product_facts))

    @property
    def dim_product(self) -> DataFrame:
        return self._table("dim_product", lambda: model.products_of(self.product_facts))

    @property
    def dim_session(self) -> DataFrame:
        return self._table("dim_session", lambda: model.sessions_of(self.session_users, self.rules))

    @property
    def dim_user(self) -> DataFrame:
        return self._table("dim_user", lambda: model.users_of(self.session_users))

    @property
    def fact_cart_items(self) -> DataFrame:
        return self._table("fact_cart_items", lambda: model.items_of(self._merged("item_facts")))

    @property
    def bot_sessions(self) -> DataFrame:
        return self._table("bot_sessions", lambda: model.bot_sessions(self.dim_session))

    @property
    def human_items(self) -> DataFrame:
        return self._table("human_items", lambda: model.human_items(self.fact_cart_items, self.dim_session))

    @property
    def item_profile(self) -> DataFrame:
        return self._table("item_profile", lambda: analysis.item_profile(self.human_items, self.rules))

    @property
    def cohort_counts(self) -> DataFrame:
        return self._table("cohort_counts", lambda: cohorts.cohort_counts(self.dim_session, self.rules))

    @property
    def visit_rates(self) -> DataFrame:
        return self._table("visit_rates", lambda: analysis.first_vs_returning(self.dim_session, self.human_items))

    @property
    def cart_item_base(self) -> DataFrame:
        return analysis.cart_item_base(self.human_items, self.dim_product, self.dim_user)

    def model_tables(self) -> dict[str, DataFrame]:
        """The seven tables of the model."""
        names = [
            "fact_events", "fact_cart_items", "dim_brand", "dim_category", "dim_product", "dim_session",
            "dim_user",
        ]
        return {name: getattr(self, name) for name in names}

    def build(self) -> StarSchema:
        """Write every stored table now.

        Once the events are there the tables need little of each other, so their jobs run side by side
        and fill the slots that the last tasks of one leave idle.
        """
        self.collapsed_events
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda name: getattr(self, name), self.STORED))
        return self

    def register(self) -> None:
        """Make the model available to ``spark.sql`` as temporary views."""
        for name, df in self.model_tables().items():
            df.createOrReplaceTempView(name)


def _load_group(spark: SparkSession, src: str, root: str, months: list[str], state: dict) -> None:
    """Clean some months in the same jobs, each month into folders of its own, and name them in ``state``."""
    events = {m: fresh(f"collapsed_events/month={quote(m, safe='')}") for m in months}
    collapsed = cleaning.collapse_copies(raw_log.load_raw(spark, src, months))
    sinks.write_tables(collapsed, "month", root, events)
    state.setdefault("events", {}).update(events)
    stored = _read_events(spark, root, events)
    rejected = state.setdefault("rejected", {})
    for month in months:
        rejected.pop(month, None)
    faulty = stored.filter("fault IS NOT NULL OR event_time IS NULL").select("month").distinct().collect()
    if faulty:
        lines = {r["month"]: fresh(f"rejected/{quote(r['month'], safe='')}") for r in faulty}
        found = reduce(DataFrame.unionByName, [raw_log.rejected_lines(spark, src, m) for m in sorted(lines)])
        sinks.write_tables(found, "month", root, lines)
        rejected.update(lines)
    kept = cleaning.clean_events(stored)
    for name, (make, _) in _PARTS.items():
        parts = {m: fresh(f"parts/{name}/{quote(m, safe='')}") for m in months}
        sinks.write_tables(make(kept, "month"), "month", root, parts)
        state.setdefault("parts", {}).setdefault(name, {}).update(parts)


def _load_months(spark: SparkSession, src: str, root: str, months: Iterable[str] | None) -> dict:
    months = sorted(set(months) if months is not None else raw_log.months_of(spark, src))
    if not months:
        raise ValueError(f"no monthly files in {src}")
    state: dict = {}
    groups = [months[k : k + MONTHS_AT_ONCE] for k in range(0, len(months), MONTHS_AT_ONCE)]
    with ThreadPoolExecutor(GROUPS_AT_ONCE) as pool:
        list(pool.map(lambda group: _load_group(spark, src, root, group, state), groups))
    return state


def load_months(spark: SparkSession, src: str, root: str, months: Iterable[str] | None = None) -> None:
    """Clean a folder of monthly files into the event table at ``root``, in place of the whole table.

    Copies are found within a month; a few months are cleaned in the same jobs, each into folders of its own.  The new
    table takes the place of the old one when all months are there; until then readers see the old one.
    """
    state = _load_months(spark, src, root, months)
    Versions(spark, root).update(lambda _: state)


def rejected_lines(spark: SparkSession, root: str) -> DataFrame:
    """The lines of all loaded months that gave no event, with their files and reasons."""
    folders = Versions(spark, root).current()[1].get("rejected", {})
    schema = "month string, file string, line string, reason string"
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders.values()]) if folders else spark.createDataFrame([], schema)


def _build(spark: SparkSession, root: str, rules: Rules, state: dict, after: int) -> StarSchema:
    """Build the tables of ``state`` and publish both at once, unless another writer came first."""
    star = StarSchema.over(spark, root, rules, state).build()
    versions = Versions(spark, root)
    versions.publish(state | {"tables": star._root.removeprefix(f"{root}/"), "rules": _manifest(rules)}, after)
    versions.tidy()
    return star


def reload_month(spark: SparkSession, src: str, root: str, month: str, rules: Rules = Rules()) -> StarSchema:
    """Read one month again, whether it has rows or none now, and put new tables in place of the old ones.

    Of the events only that month's are read: sessions, users, products and items are merged from the stored partial
    results of all months.  Until the new tables are complete, and if that fails, the old month and tables stay.
    """
    after, state = Versions(spark, root).current()
    _load_group(spark, src, root, [month], state)
    return _build(spark, root, rules, state, after)


def load_and_model(
    spark: SparkSession,
    src: str,
    root: str,
    months: Iterable[str] | None = None,
    rules: Rules = Rules(),
    source: str | None = None,
) -> StarSchema:
    """From a folder of monthly CSV files to the written star schema, its audit and its log.

    With ``source`` ("sample" or "raw") the files lie in that folder below ``src``.  What stood at ``root`` before is
    read by others until all of the new tables are there.
    """
    src = raw_log.source_path(src, source) if source else src
    after, _ = Versions(spark, root).current()
    star = _build(spark, root, rules, _load_months(spark, src, root, months), after)
    audit = cleaning.cleaning_audit(star.collapsed_events)
    retention = cleaning.row_retention(star.collapsed_events)
    sinks.write_table(audit, f"{root}/cleaning_audit")
    log = cleaning.cleaning_log(audit, retention, model.bot_audit(star.dim_session))
    sinks.write_csv(log, f"{root}/cleaning_log")
    return star


def export_dashboard(star: StarSchema, path: str) -> None:
    """The flat files of the dashboards and the record of headline figures, as CSV folders."""
    stages = analysis.funnel_stages(star.dim_session, star.human_items)
    figures = (star.dim_session, star.human_items, star.item_profile, star.rules)
    sinks.write_csv(
        analysis.dashboard_export(star.cart_item_base, star.rules), f"{path}/dashboard_cart_items"
    )
    sinks.write_csv(views.funnel_export(stages), f"{path}/funnel")
    sinks.write_csv(analysis.findings_summary(*figures), f"{path}/findings")
    sinks.write_csv(analysis.hypothesis_table(*figures), f"{path}/hypotheses")
