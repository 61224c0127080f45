"""Property test of the text source: random raw lines against a plain-Python model of
"split on commas, parse numbers and the date-time, keep speed <= 120"."""

from __future__ import annotations

import math
from datetime import datetime

from helpers import write_lines
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from transitlens import load_pings
from transitlens.session import scratch_path

dates = st.sampled_from(["10-01-2014", "10-31-2014", "02-29-2016", "13-45-2014", "2014-10-01", ""])
times = st.sampled_from(["00:00:00", "08:15:30", "23:59:59", "24:00:00", "8h", ""])
ids = st.sampled_from(["C500280", "A1", "", "x y", '"q"'])
lines_ = st.sampled_from(["302.0", "0", "LECD100", "", "10"])
numbers = st.sampled_from(
    ["-22.85", "-43.25", "0", "0.0", "35.5", "120", "120.0", "120.01", "-1", "1e2", "NaN",
     "abc", "", "90", "-0.0", "inf", "-inf", "Infinity", "-Infinity", "+Infinity", "-infinity",
     "Inf", "-INF", "nan", " -inf", " -Infinity ", "-NaN", "1d", "0x1p3", "1_0", " 7 ", "+5", "infinite"]
)
# every spelling that both readers take for a number, besides what float() reads
SPELLINGS = {"1d": 1.0, "0x1p3": 8.0}
WORDS = ("inf", "-inf", "Infinity", "-Infinity", "+Infinity", " -Infinity ", "NaN", "-NaN")
extra = st.lists(st.sampled_from(["x", "", "1"]), max_size=2)


@st.composite
def raw_line(draw) -> str:
    fields = [draw(dates), draw(times), draw(ids), draw(lines_), draw(numbers), draw(numbers),
              draw(numbers)]
    cut = draw(st.integers(min_value=2, max_value=7))
    return ",".join(fields[:cut] + (draw(extra) if cut == 7 else []))


def to_float(text: str | None) -> float | None:
    if text in SPELLINGS:
        return SPELLINGS[text]
    if text in (None, "") or "_" in text or ("n" in text.lower() and text not in WORDS):
        return None
    try:
        return float(text)
    except ValueError:
        return None


def model(lines: list[str]) -> list[tuple]:
    out = []
    for line in lines:
        if line == "":
            continue
        p = line.split(",")
        p += [None] * (7 - len(p))
        speed = to_float(p[6])
        if speed is None or math.isnan(speed) or speed > 120:
            continue
        try:
            ts = datetime.strptime(f"{p[0]} {p[1]}", "%m-%d-%Y %H:%M:%S") if p[0] and p[1] else None
        except ValueError:
            ts = None
        out.append((p[2] or "", p[3] or "", to_float(p[4]), to_float(p[5]), speed, ts))
    return out


def norm(rows):
    fix = lambda v: "nan" if isinstance(v, float) and v != v else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=str)


@settings(max_examples=20, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(lines=st.lists(raw_line(), min_size=1, max_size=20))
def test_csv_source_matches_split_model(spark, lines):
    path = write_lines(spark, scratch_path(spark, "prop-lines"), lines)
    got = [tuple(r) for r in load_pings(spark, path).collect()]
    assert norm(got) == norm(model(lines))


@st.composite
def full_line(draw) -> str:
    fields = [draw(dates), draw(times), draw(ids), draw(lines_), draw(numbers), draw(numbers),
              draw(numbers)]
    return ",".join(fields + draw(extra))


@settings(max_examples=10, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(lines=st.lists(full_line(), min_size=1, max_size=20))
def test_strict_line_parser_matches_split_model(spark, lines):
    path = write_lines(spark, scratch_path(spark, "prop-strict"), lines)
    got = [tuple(r) for r in load_pings(spark, path, strict=True).collect()]
    assert norm(got) == norm(model(lines))


def test_both_readers_read_every_spelling_alike(spark):
    """In each numeric field in turn; a speed of minus infinity is kept, as a split and a cast do."""
    spellings = sorted(numbers.elements)
    lines = [f"10-01-2014,08:15:30,b{i},7,{','.join(x if j == k else '1' for j in range(3))}" for i, x in enumerate(spellings) for k in range(3)]
    path = write_lines(spark, scratch_path(spark, "prop-words"), lines)
    csv = [tuple(r) for r in load_pings(spark, path).collect()]
    assert norm(csv) == norm([tuple(r) for r in load_pings(spark, path, strict=True).collect()]) == norm(model(lines))
    speeds = {r[0]: r[4] for r in csv if r[2] == r[3] == 1.0}
    assert speeds[f"b{spellings.index('-inf')}"] == speeds[f"b{spellings.index('-Infinity')}"] == -math.inf
    plan = load_pings(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(speed,120.0)" in plan
