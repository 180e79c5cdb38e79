import os
import subprocess
import sys
from pathlib import Path

import pytest

from trolley.sources.staging import staging_dir, use_root

ROOT = Path(__file__).parent.parent


def test_tables_go_to_the_folder_the_session_names(spark):
    assert staging_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir") + "/trolley-")


class _Bare:
    """A session, whatever its master, that names no folder."""

    def __init__(self, spark, application):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        self.sparkContext = type("Context", (), {
            "applicationId": application, "_jvm": spark.sparkContext._jvm, "_jsc": spark.sparkContext._jsc})


def test_a_root_is_needed(spark, tmp_path):
    bare = _Bare(spark, "another application")
    with pytest.raises(ValueError, match="shared folder"):
        staging_dir(bare)
    assert staging_dir(bare, str(tmp_path)).startswith(f"{tmp_path}/trolley-")
    use_root(bare, str(tmp_path / "named"))
    assert staging_dir(bare).startswith(f"{tmp_path}/named/trolley-")


def test_staged_tables_go_with_the_application(tmp_path):
    script = f"""
import os, sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from __spark_entry__ import entry
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
assert entry(spark).count() == 3
assert any(n.startswith("trolley-") for n in os.listdir({str(tmp_path)!r}))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=300)
    assert not [n for n in os.listdir(tmp_path) if n.startswith("trolley-")]
