"""The file-stream source gives the same rows and answers as the batch source."""

from __future__ import annotations

import __spark_entry__ as E
from transitlens import line_mean, load_pings, write_day_files
from transitlens.plans.report import WINDOW_SPEC, report
from transitlens.session import scratch_path
from transitlens.sources.events import load_event_pings
from transitlens.streaming import observation_stream, read_ping_stream, start


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stream_matches_batch(spark):
    base = write_day_files(
        load_event_pings(spark, "/root/testdata/sf0.001", clean=False), scratch_path(spark, "stream-days")
    )
    folder = base + "/day=*"
    batch = load_pings(spark, folder)
    stream = read_ping_stream(spark, folder, max_files_per_trigger=5)

    obs = start(observation_stream(stream, WINDOW_SPEC, box=E.BOX, window=E.DAY_CLOCK), "tl_obs")
    means = start(line_mean(stream, box=E.BOX, window=E.DAY_CLOCK), "tl_means", output_mode="complete")
    try:
        obs.processAllAvailable()
        means.processAllAvailable()
        expected_obs = report(batch, box=E.BOX, window=E.DAY_CLOCK, spec=WINDOW_SPEC)
        want = _rows(expected_obs.long().where("section IN ('exact', 'fast')").select(
            "section", "bus_line", "datetime", "speed"))
        assert _rows(spark.table("tl_obs")) == want and len(want) > 0
        got = {r.bus_line: r.mean_speed for r in spark.table("tl_means").collect()}
        exp = {r.bus_line: r.mean_speed for r in line_mean(batch, box=E.BOX, window=E.DAY_CLOCK).collect()}
        assert got.keys() == exp.keys()
        for k in exp:
            assert abs(got[k] - exp[k]) < 1e-9
    finally:
        obs.stop()
        means.stop()


def test_a_restarted_stream_goes_on_where_it_stopped(spark, scratch):
    from helpers import write_lines

    base, out = scratch("days"), scratch("out")
    for day in (1, 2):
        write_lines(spark, f"{base}/day={day}", [f"10-0{day}-2014,08:00:0{i},T{i},1,-22.85,-43.25,0.0" for i in range(3)])
        stream = read_ping_stream(spark, base + "/day=*")
        query = start(observation_stream(stream, WINDOW_SPEC, box=E.BOX), f"again{day}", sink="parquet", path=out)
        query.processAllAvailable()
        query.stop()
        assert spark.read.parquet(out).count() == 3 * day
