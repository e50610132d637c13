"""Folders of the shared store go when they are no longer needed."""

from __future__ import annotations

import os
import subprocess
import sys

from marketloom.llm import scratch

CODE = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from marketloom.llm import scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {tmp!r}).getOrCreate()
scratch.write_through(spark.range(3), "left").count()
print("AT", scratch._MADE[0][1])
"""


def test_clear_and_the_end_of_an_application(spark, tmp_path):
    before = list(scratch._MADE)
    scratch._MADE.clear()
    scratch.write_through(spark.range(5), "gone").count()
    path = scratch._MADE[0][1].removeprefix("file:")
    assert os.path.isdir(path)
    scratch.clear()
    assert not os.path.exists(path)
    scratch._MADE.extend(before)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root, tmp=str(tmp_path / "w"))], capture_output=True, text=True)
    at = [x for x in out.stdout.splitlines() if x.startswith("AT ")][0][3:].removeprefix("file:")
    assert out.returncode == 0 and not os.path.exists(at)
