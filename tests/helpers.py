"""What several test modules share, under a name that no other test folder uses."""

from __future__ import annotations

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def write_lines(spark, path: str, lines: list[str]) -> str:
    """Write raw text lines as one day file (a folder with one part file)."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path
