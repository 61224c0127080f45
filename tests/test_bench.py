"""bench.py prints one JSON line with the fields the round driver records."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from helpers import ROOT

import __spark_entry__ as E


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_REPEATS="1",
               BENCH_CPUS="2", BENCH_ONLY="ping", BENCH_MANY_ROWS="3000")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        env=env, capture_output=True, text=True, timeout=600,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    result = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(result)
    assert result["unit"] == "sec" and result["sf"] == 0.001
    assert set(result["queries"]) == set(E.ping_queries()) and result["value"] > 0
    assert result["totals"]["ping"] == result["value"] and result["totals"]["training_data"] == 0
    assert result["variants"]["many_splits"] > 8
