"""The driver contract works in a local session that names no checkpoint folder."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

from helpers import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as E
print("ROWS", E.entry(spark).count())
"""


def test_entry_without_configured_checkpoint_dir():
    env = dict(os.environ, SPARK_CONF_DIR=tempfile.mkdtemp(prefix="transitlens-noconf-"))
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT)],
        env=env, capture_output=True, text=True, timeout=300,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    assert "ROWS 21" in out.stdout
