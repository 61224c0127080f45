"""The command line picks the report from the options given and prints every section."""

from __future__ import annotations

import pytest
from helpers import write_lines
from test_source import ROWS

from transitlens.__main__ import main
from transitlens.session import scratch_path


@pytest.fixture(scope="module")
def day_file(spark):
    return write_lines(spark, scratch_path(spark, "cli-rows"), ROWS)


def sections(out: str) -> list[str]:
    return [line[3:] for line in out.splitlines() if line.startswith("== ")]


def test_box_report(spark, day_file, capsys):
    assert main([day_file, "--box", "-43.2", "-43.3", "-22.8", "-22.9"]) == 0
    assert sections(capsys.readouterr().out) == ["stats", "line_means", "slow", "fast"]


def test_full_report(spark, day_file, capsys):
    argv = [day_file, "--box", "-43.2", "-43.3", "-22.8", "-22.9",
            "--days", "1", "2", "--clock", "08:00:00", "08:00:10", "--persist"]
    assert main(argv) == 0
    out = capsys.readouterr().out
    assert sections(out) == ["stats", "line_means", "exact", "fast"]
    assert "|0       |2014-10-01 08:00:01|0.0  |" in out


@pytest.mark.parametrize("opts", [["--clock", "08:00:00", "09:00:00"], ["--days", "1", "2"]])
def test_window_reports(spark, day_file, capsys, opts):
    assert main([day_file, *opts]) == 0
    assert sections(capsys.readouterr().out) == ["stats", "line_means", "exact", "fast"]


def test_unsupported_combination(spark, day_file):
    with pytest.raises(SystemExit):
        main([day_file, "--box", "-43.2", "-43.3", "-22.8", "-22.9", "--days", "1", "2"])


def test_bad_clock_text_is_a_clean_error(spark, day_file):
    with pytest.raises(SystemExit, match="error"):
        main([day_file, "--days", "1", "2", "--clock", "8h", "09:00:00"])


def test_parquet_layout_input(spark, day_file, capsys):
    from transitlens import load_pings, write_partitioned

    layout = write_partitioned(load_pings(spark, day_file), scratch_path(spark, "cli-layout"))
    assert main([layout, "--parquet", "--days", "1", "2"]) == 0
    out = capsys.readouterr().out
    assert sections(out) == ["stats", "line_means", "exact", "fast"]
    assert "|0       |2014-10-01 08:00:01|0.0  |" in out
