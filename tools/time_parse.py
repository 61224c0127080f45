"""Times the forms of the wall-clock parse on generated rows (default 10 million).

    python tools/time_parse.py [rows]

Prints the median seconds of five runs of each form, in alternating order, and the rows on which
it differs from the first. ``none`` only builds the text, so its time is to be taken off.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Column, functions as F  # noqa: E402

from transitlens.functions.columns import DATETIME_FORMAT, compose_datetime, ntz_literal, parse_datetime  # noqa: E402
from transitlens.session import local_session  # noqa: E402


def two_parses(text: Column) -> Column:
    """Validity by the zoned parser, then the local one."""
    fmt = F.lit(DATETIME_FORMAT)
    return F.when(F.try_to_timestamp(text, fmt).isNotNull(), F.to_timestamp_ntz(text, fmt))


def one_parse(text: Column) -> Column:
    """The zoned parser on the text as UTC, moved to wall-clock time by its distance from 1970."""
    instant = F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(DATETIME_FORMAT + "X"))
    return F.timestamp_add("SECOND", F.unix_seconds(instant), ntz_literal("1970-01-01"))


def by_digits(text: Column) -> Column:
    """The digit groups of a fixed shape."""
    part = lambda a, n: F.substring(text, a, n).cast("int")
    made = F.try_make_timestamp_ntz(part(7, 4), part(1, 2), part(4, 2), part(12, 2), part(15, 2), part(18, 2))
    return F.when(text.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), made)


def by_mapped_digits(text: Column) -> Column:
    """The same, with the shape told by turning every digit into 0."""
    part = lambda a, n: F.substring(text, a, n).cast("int")
    second = part(18, 2)
    made = F.try_make_timestamp_ntz(part(7, 4), part(1, 2), part(4, 2), part(12, 2), part(15, 2), second)
    shape = F.translate(text, "123456789", "000000000") == F.lit("00-00-0000 00:00:00")
    return F.when(shape, F.when(second < 60, made)).otherwise(two_parses(text))


def joined(text: Column) -> Column:
    """A date and a time column, joined for the formatter."""
    return two_parses(F.concat(F.col("date"), F.lit(" "), F.col("time")))


def composed(text: Column) -> Column:
    """A date and a time column, taken apart where they are."""
    return compose_datetime(F.col("date"), F.col("time"))


FORMS = {"none": lambda t: t, "two_parses": two_parses, "one_parse": one_parse, "by_digits": by_digits, "by_mapped_digits": by_mapped_digits, "library": parse_datetime, "joined": joined, "composed": composed}


def main(rows: int) -> None:
    # a zone with daylight-saving gaps, so that differences inside them would show
    spark = local_session("*", extra_conf={"spark.sql.session.timeZone": "America/Sao_Paulo", "spark.ui.showConsoleProgress": "false"})
    stamp = F.timestamp_add("SECOND", F.col("id") * 61 % 500_000_000, ntz_literal("2005-01-01"))
    text = F.date_format(stamp, DATETIME_FORMAT)
    bad = F.when(F.col("id") % 97 == 0, F.lit("13-45-2014 00:00:00")).otherwise(text)
    path = f"{spark.sparkContext.getCheckpointDir()}/time-parse"
    parts = [F.split_part(F.col("text"), F.lit(" "), F.lit(i)).alias(name) for i, name in ((1, "date"), (2, "time"))]
    spark.range(rows).select(bad.alias("text")).select("text", *parts).write.parquet(path)
    table = spark.read.parquet(path)
    times: dict[str, list[float]] = {name: [] for name in FORMS}
    for _ in range(5):
        for name, form in FORMS.items():
            t = time.perf_counter()
            table.select(form(F.col("text")).alias("x")).write.format("noop").mode("overwrite").save()
            times[name].append(time.perf_counter() - t)
    base = two_parses(F.col("text"))
    for name, form in FORMS.items():
        differ = table.where(~form(F.col("text")).eqNullSafe(base)).count() if name != "none" else 0
        print(f"{name}: {sorted(times[name])[2]:.2f} s, {differ} rows differ")
    spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 10_000_000)
