"""Where derived tables are written."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from pyspark.sql import SparkSession

from trolley.sources.files import file_system


_roots: dict[str, str] = {}


def use_root(spark: SparkSession, root: str) -> None:
    """Name the shared folder for an application whose session has no ``spark.checkpoint.dir``."""
    _roots[spark.sparkContext.applicationId] = root


def root_of(spark: SparkSession) -> str | None:
    """The shared folder of the application, if it has one."""
    return spark.conf.get("spark.checkpoint.dir", None) or _roots.get(spark.sparkContext.applicationId)


def staging_dir(spark: SparkSession, root: str | None = None) -> str:
    """A fresh folder for derived tables below ``root``, removed when the application ends.

    Without ``root`` it lies in the application's shared folder (``root_of``).  It must be shared by all
    executors, so that the tables outlive any of them.
    """
    root = root or root_of(spark)
    if not root:
        raise ValueError("derived tables need a shared folder: give a root or set spark.checkpoint.dir")
    path = f"{root.rstrip('/')}/trolley-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    where, files = file_system(spark, path)
    owner = os.getpid()

    def remove() -> None:
        if os.getpid() == owner:
            with contextlib.suppress(Exception):
                files.delete(where, True)

    atexit.register(remove)
