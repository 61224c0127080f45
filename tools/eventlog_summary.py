"""Summarise a Spark event log: per stage, the number of tasks, median and maximum task
time, input and shuffle bytes and spill; overall, the worst task-time skew.

    python tools/eventlog_summary.py EVENT_LOG [--stages] [--top N]

``EVENT_LOG`` is a log file, a rolling event-log folder, or the ``spark.eventLog.dir``.

Write an event log with ``spark.eventLog.enabled=true`` and ``spark.eventLog.dir`` in the
scratch folder (``BENCH_EVENT_LOG=1 python bench.py`` does so).
"""

from __future__ import annotations

import io
import json
import os
import statistics
import sys
from collections import defaultdict


def _lines(path: str):
    """Event lines of a log file, a rolling log folder, or a folder holding one of those;
    zstd-compressed parts (Spark's default) are decompressed on the fly."""
    if os.path.isdir(path):
        entries = sorted(os.listdir(path))
        parts = [os.path.join(path, e) for e in entries if e.startswith("events_")]
        if not parts:  # a spark.eventLog.dir: descend into its (single) application log
            logs = [os.path.join(path, e) for e in entries if not e.startswith(".")]
            for log in logs:
                yield from _lines(log)
            return
        for part in sorted(parts, key=lambda p: int(os.path.basename(p).split("_")[1])):
            yield from _lines(part)
        return
    if path.endswith(".zstd"):
        import zstandard

        with open(path, "rb") as fh:
            reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), "utf-8")
            yield from reader
        return
    with open(path) as fh:
        yield from fh


def summarise(path: str) -> dict:
    tasks: dict[int, list[dict]] = defaultdict(list)
    names: dict[int, str] = {}
    for line in _lines(path):
        event = json.loads(line)
        if event.get("Event") == "SparkListenerStageCompleted":
            info = event["Stage Info"]
            names[info["Stage ID"]] = info.get("Stage Name", "")
        if event.get("Event") != "SparkListenerTaskEnd":
            continue
        info = event["Task Info"]
        metrics = event.get("Task Metrics") or {}
        tasks[event["Stage ID"]].append(
            {
                "ms": info["Finish Time"] - info["Launch Time"],
                "input": (metrics.get("Input Metrics") or {}).get("Bytes Read", 0),
                "shuffle_write": (metrics.get("Shuffle Write Metrics") or {}).get(
                    "Shuffle Bytes Written", 0
                ),
                "spill": metrics.get("Memory Bytes Spilled", 0)
                + metrics.get("Disk Bytes Spilled", 0),
            }
        )
    stages = []
    for stage, ts in sorted(tasks.items()):
        times = [t["ms"] for t in ts]
        stages.append(
            {
                "stage": stage,
                "name": names.get(stage, ""),
                "tasks": len(ts),
                "median_ms": statistics.median(times),
                "max_ms": max(times),
                "input_bytes": sum(t["input"] for t in ts),
                "shuffle_write_bytes": sum(t["shuffle_write"] for t in ts),
                "spill_bytes": sum(t["spill"] for t in ts),
            }
        )
    # Skew only means something where there are several tasks and they take measurable time.
    skews = [
        s["max_ms"] / max(s["median_ms"], 1)
        for s in stages
        if s["tasks"] >= 4 and s["max_ms"] >= 50
    ]
    return {
        "stages": len(stages),
        "tasks": sum(s["tasks"] for s in stages),
        "max_task_skew": round(max(skews), 2) if skews else None,
        "spill_bytes": sum(s["spill_bytes"] for s in stages),
        "shuffle_write_bytes": sum(s["shuffle_write_bytes"] for s in stages),
        "per_stage": stages,
    }


def main() -> None:
    out = summarise(sys.argv[1])
    if "--top" in sys.argv:
        n = int(sys.argv[sys.argv.index("--top") + 1])
        out["slowest_stages"] = sorted(out["per_stage"], key=lambda st: -st["max_ms"])[:n]
    if "--stages" not in sys.argv:
        out.pop("per_stage")
    print(json.dumps(out, indent=1))


if __name__ == "__main__":
    main()
