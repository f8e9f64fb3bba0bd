"""Partitioned writes do not sort the rows of a task by folder, and keep every row whatever the number of folders."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession, functions as F
from palmares.sources.tables import append_table, overwrite_table
from palmares.store import stored

base = sys.argv[1]
options = {
    "spark.ui.enabled": "false", "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + base + "/events",
    "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false", "spark.sql.warehouse.dir": base + "/tables",
    "spark.checkpoint.dir": base + "/shared", "spark.sql.shuffle.partitions": "2",
}
builder = SparkSession.builder.master("local[2]")
for key, value in options.items():
    builder = builder.config(key, value)
spark = builder.getOrCreate()
before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
for folders in (2, 30):
    part = F.when(F.col("id") % folders > 0, F.col("id") % folders)
    rows = spark.range(0, 3000, 1, 2).select("id", part.alias("part"))
    tables = [stored(rows, "parts", ["part"])]
    overwrite_table(rows, f"over{folders}", ["part"])
    overwrite_table(rows, f"over{folders}", ["part"])
    append_table(rows, f"more{folders}", ["part"])
    for table in [*tables, spark.table(f"over{folders}"), spark.table(f"more{folders}")]:
        assert table.select("id", "part").exceptAll(rows).isEmpty() and table.count() == 3000, folders
assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
spark.stop()
"""


def test_partitioned_writes_do_not_sort(tmp_path):
    (tmp_path / "events").mkdir()
    env = os.environ | {"PYTHONPATH": f"{Path(__file__).parents[1]}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    plans = []
    for line in next((tmp_path / "events").iterdir()).read_text().splitlines():
        event = json.loads(line)
        if event["Event"].endswith("SparkListenerSQLExecutionStart") and "WriteFiles" in event["physicalPlanDescription"]:
            plans.append(event["physicalPlanDescription"])
    assert len(plans) == 8
    assert not [plan for plan in plans if "Sort" in plan]
