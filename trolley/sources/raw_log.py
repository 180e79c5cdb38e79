"""Reading the monthly click log and the dashboard files."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trolley.functions.clicks import parse_event_time
from trolley.schema import BAD_TIME, DASHBOARD, EVENT_COLUMNS, FUNNEL, MISSING_TEXT, RAGGED, RAW, UNREADABLE
from trolley.sources.files import first_line, matching, parts_of

_TEXT_COLUMNS = ["event_type", "category_code", "brand", "user_session"]
_LONGEST_MISSING = max(map(len, MISSING_TEXT))


def source_path(root: str, source: str = "sample") -> str:
    """Folder of the sample or the raw log below a data folder."""
    if source not in ("sample", "raw"):
        raise ValueError(f"source is 'sample' or 'raw', not {source!r}")
    return os.path.join(root, source)


def _present(name: str) -> Column:
    """A text column with NULL for texts that mean a missing value; longer texts need no lookup."""
    text = F.col(name)
    return F.when((F.octet_length(text) > _LONGEST_MISSING) | ~text.isin(MISSING_TEXT), text)


def _month_files(spark: SparkSession, path: str) -> dict[str, tuple[str, bool]]:
    """Month -> file and whether it is a folder of parts: {month}.csv, also compressed."""
    found = matching(spark, f"{path}/*.csv*")
    return {name.split(".csv")[0]: (name, folder) for name, folder in found.items()}


def months_of(spark: SparkSession, path: str) -> list[str]:
    """Month names in a folder, in order."""
    return sorted(_month_files(spark, path))


_BROKEN = "_broken_line"
_NUMBERS = {f.name: f.dataType for f in RAW.fields if not isinstance(f.dataType, T.StringType)}


def _number(name: str, kind: T.DataType) -> Column:
    """A number from its text; a whole number may be written with zero decimals."""
    text = F.trim(_present(name))
    if isinstance(kind, T.LongType):
        text = F.regexp_replace(text, r"\.0*$", "")
    return text.try_cast(kind)


def _fields(header: list[str], path: str) -> T.StructType:
    absent = [c for c in EVENT_COLUMNS if c not in header]
    if absent:
        raise ValueError(f"{path} lacks the columns {absent}")
    return T.StructType([T.StructField(c, T.StringType()) for c in [*header, _BROKEN]])


_READ = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}


def _fault() -> Column:
    """Why a line of text fields cannot be used, if it cannot."""
    unreadable = reduce(
        lambda a, b: a | b, [_present(c).isNotNull() & _number(c, kind).isNull() for c, kind in _NUMBERS.items()])
    return F.when(F.col(_BROKEN).isNotNull(), RAGGED).when(unreadable, UNREADABLE)


def read_events(reader, header: list[str], *paths: str) -> DataFrame:
    """The event columns of CSV files whose header is ``header``, in any order, from a (stream) reader.

    Lines with too few or too many fields, and numbers that cannot be read, are marked in ``fault``.
    """
    options = {"header": True, "enforceSchema": False, **_READ}
    log = reader.schema(_fields(header, paths[0])).options(**options).csv(paths[0] if len(paths) == 1 else list(paths))
    return log.select(
        *[_number(c, _NUMBERS[c]).alias(c) if c in _NUMBERS else _present(c).alias(c) if c in _TEXT_COLUMNS else c
          for c in EVENT_COLUMNS],
        _fault().alias("fault"), "_metadata")


def header_of(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def _by_header(spark: SparkSession, path: str, folder: bool) -> dict[str, list[str]]:
    """The files of a month by their first lines: each part of a folder has a header of its own."""
    if not folder:
        return {first_line(spark, path): [path]}
    parts = parts_of(spark, path)
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda part: first_line(spark, part), parts))
    found: dict[str, list[str]] = {}
    for header, part in zip(headers, parts):
        if header:  # a part without a line has no rows
            found.setdefault(header, []).append(part)
    return found


def _names(header: str) -> list[str]:
    return next(csv.reader([header.removeprefix("\ufeff")]), [])


def _load_month(spark: SparkSession, path: str, month: str, folder: bool) -> DataFrame:
    if not matching(spark, path):
        spark.read.text(path)  # raises PATH_NOT_FOUND
    logs = [read_events(spark.read, _names(h), *parts) for h, parts in sorted(_by_header(spark, path, folder).items())]
    if not logs:
        raise ValueError(f"{path} has no header")
    arrival = {
        "arrival_block": F.col("_metadata.file_block_start"),
        "arrival_row": F.monotonically_increasing_id(),
    }
    if folder:
        arrival["arrival_file"] = F.col("_metadata.file_name")
    return reduce(DataFrame.unionByName, [
        log.withColumns({"month": F.lit(month)} | arrival).drop("_metadata") for log in logs])


def rejected_lines(spark: SparkSession, path: str, month: str) -> DataFrame:
    """Lines of a month that give no event, as they stand in its files: month, file, line and reason.

    Reasons are fields too few or too many, numbers and times that cannot be read.  A line like the file's header counts as
    one.  This reads the month's files once more, so it is for months in which such lines have been found.
    """
    name, folder = _month_files(spark, path).get(month, (f"{month}.csv", False))
    parts = []
    for header, files in sorted(_by_header(spark, f"{path}/{name}", folder).items()):
        text = spark.read.text(files).filter((F.trim("value") != "") & (F.col("value") != F.lit(header)))
        fields = F.from_csv("value", F.lit(_fields(_names(header), files[0]).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), _READ)
        # a line is split once: as rows of an array its fields are not computed anew wherever they are used
        read = text.select("value", F.col("_metadata.file_name").alias("file"), F.inline(F.array(fields)))
        timed = F.when(parse_event_time(F.col("event_time")).isNull(), BAD_TIME)
        parts.append(read.select(
            F.lit(month).alias("month"), "file", F.col("value").alias("line"), F.coalesce(_fault(), timed).alias("reason")))
    return reduce(DataFrame.unionByName, parts).filter("reason IS NOT NULL")


def load_raw(spark: SparkSession, path: str, months: Iterable[str] | None = None) -> DataFrame:
    """The raw log of the given months (all of the folder if none are given).

    Columns are taken by name, whatever their order in the file or in each part of a month's folder; a file that lacks
    one is refused.  Rows that cannot be read carry a ``fault``.  A month whose file is absent raises PATH_NOT_FOUND.
    Each month has scans of its own with a constant ``month``, so a filter on it drops the other scans from the plan.  The ``arrival`` columns order rows as they stand in the month's files:
    rows of one split are numbered in reading order, whichever task reads it.
    """
    files = _month_files(spark, path)
    months = list(months) if months is not None else sorted(files)
    if not months:
        raise ValueError(f"no monthly files in {path}")
    named = [(m, *files.get(m, (f"{m}.csv", False))) for m in months]
    mixed = any(folder for _, _, folder in named)
    parts = [_load_month(spark, f"{path}/{name}", month, mixed) for month, name, _ in named]
    return reduce(DataFrame.unionByName, parts)


def load_dashboard_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DASHBOARD).option("header", True).csv(path)


def load_funnel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FUNNEL).option("header", True).csv(path)
