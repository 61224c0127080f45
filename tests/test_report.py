"""Reports R1-R5 and the preview sink (S6): the long form equals the stacked sections,
persisting changes nothing, and the section plan is as small as intended."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from transitlens import (
    ReportSpec,
    box_report,
    clock_report,
    day_clock_report,
    days_report,
    full_report,
    load_event_pings,
    preview,
    report,
)
from transitlens.plans.report import LONG_COLUMNS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pings(spark):
    return load_event_pings(spark, SF)


def stacked(rep):
    """The long form built naively: one query per section, unioned."""
    out = None
    for name, df in rep.items():
        part = df.withColumn("section", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).alias(c) for c in LONG_COLUMNS])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert len(x) == len(y)
        for u, v in zip(x, y):
            if isinstance(u, float):
                assert v == pytest.approx(u, rel=1e-9, abs=1e-12)
            else:
                assert u == v


def make_reports(p):
    return {
        "box": box_report(p, E.BOX),
        "clock": clock_report(p, E.CLOCK1, E.CLOCK2),
        "days": days_report(p, E.DAY1, E.DAY2, E.YEAR, E.MONTH),
        "day_clock": day_clock_report(p, E.DAY1, E.DAY2, E.CLOCK1, E.CLOCK2, E.YEAR, E.MONTH),
        "all": full_report(p, E.BOX, E.DAY1, E.DAY2, E.CLOCK1, E.CLOCK2, E.YEAR, E.MONTH),
    }


def test_sections(pings):
    reps = make_reports(pings)
    assert list(reps["box"]) == ["stats", "line_means", "slow", "fast"]
    for name in ("clock", "days", "day_clock", "all"):
        assert list(reps[name]) == ["stats", "line_means", "exact", "fast"]


@pytest.mark.parametrize("name", ["box", "clock", "days", "day_clock", "all"])
def test_long_equals_stacked_sections(pings, name):
    rep = make_reports(pings)[name]
    long = rep.long()
    assert tuple(long.columns) == LONG_COLUMNS
    close(rows(long), rows(stacked(rep)))


def test_long_on_empty_restriction_keeps_stats_row(pings):
    rep = report(pings, box=E.Box(0.0, -1.0, 0.0, -1.0), spec=ReportSpec(exact=0.0, fast_above=100.0))
    got = rep.long().collect()
    assert len(got) == 1 and got[0].section == "stats" and got[0].mean_speed is None


def test_observation_in_two_sections(spark):
    df = spark.createDataFrame(
        [("L", -22.85, -43.25, 0.0)], "bus_line string, latitude double, longitude double, speed double"
    ).withColumn("datetime", F.lit("2014-10-01 08:00:00").cast("timestamp_ntz"))
    rep = report(df, box=E.Box(-43.2, -43.3, -22.8, -22.9), spec=ReportSpec(slow_below=10.0, exact=0.0))
    sections = sorted(r.section for r in rep.long().collect())
    assert sections == ["exact", "line_means", "slow", "stats"]


def test_persisted_report_same_result(pings):
    plain = full_report(pings, E.BOX, E.DAY1, E.DAY2, E.CLOCK1, E.CLOCK2, E.YEAR, E.MONTH)
    with full_report(
        pings, E.BOX, E.DAY1, E.DAY2, E.CLOCK1, E.CLOCK2, E.YEAR, E.MONTH, persist=True
    ) as cached:
        assert cached.persisted
        for name in plain:
            close(rows(plain[name]), rows(cached[name]))
        close(rows(plain.long()), rows(cached.long()))
    assert not cached.persisted


def test_preview_is_deterministic_top_n(pings):
    top = preview(pings, 20, E.PREVIEW_ORDER)
    got = [tuple(r) for r in top.collect()]
    full = sorted(
        (tuple(r) for r in pings.select(*E.PREVIEW_ORDER).collect()),
    )[:20]
    assert [tuple(r[c] for c in E.PREVIEW_ORDER) for r in top.collect()] == full
    assert len(got) == 20
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_empty_spec_rejected():
    with pytest.raises(ValueError):
        ReportSpec(stats=False, line_means=False)
