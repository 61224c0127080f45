"""Schemas of the raw day files and of the cleaned ping table."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values:
# - the positional layout of one raw line (comma separated, no header);
# - the text formats of its date and time fields;
# - the outlier bound: speeds above it (km/h) are dropped when loading, the bound itself
#   is kept;
# - the year and month that day numbers refer to when none are given.
RAW_FIELDS = ("date", "time", "bus_id", "bus_line", "latitude", "longitude", "speed")
DATE_FORMAT = "MM-dd-yyyy"
TIME_FORMAT = "HH:mm:ss"
MAX_PLAUSIBLE_SPEED = 120.0
DEFAULT_YEAR = 2014
DEFAULT_MONTH = 10

DATETIME_FORMAT = f"{DATE_FORMAT} {TIME_FORMAT}"

RAW_SCHEMA = T.StructType(
    [
        T.StructField("date", T.StringType(), True),
        T.StructField("time", T.StringType(), True),
        T.StructField("bus_id", T.StringType(), True),
        T.StructField("bus_line", T.StringType(), True),
        T.StructField("latitude", T.DoubleType(), True),
        T.StructField("longitude", T.DoubleType(), True),
        T.StructField("speed", T.DoubleType(), True),
    ]
)

PING_SCHEMA = T.StructType(
    [
        T.StructField("bus_id", T.StringType(), True),
        T.StructField("bus_line", T.StringType(), True),
        T.StructField("latitude", T.DoubleType(), True),
        T.StructField("longitude", T.DoubleType(), True),
        T.StructField("speed", T.DoubleType(), True),
        T.StructField("datetime", T.TimestampNTZType(), True),
    ]
)

PING_COLUMNS = tuple(f.name for f in PING_SCHEMA.fields)

# Day partition column of the normalised Parquet layout (see sources.parquet): a name of the
# layout's own, so that a data column such as a feed's service_date is never taken for it.
SERVICE_DATE = "ping_layout_day"

PARTITIONED_SCHEMA = T.StructType(
    PING_SCHEMA.fields + [T.StructField(SERVICE_DATE, T.DateType(), True)]
)

# Columns returned by the observation queries (slow / fast / exact speed).
OBSERVATION_COLUMNS = ("bus_line", "datetime", "speed")
