"""Column expressions and predicates."""

from transitlens.functions.columns import (
    compose_datetime,
    date_literal,
    ntz_literal,
    parse_datetime,
    service_date,
    truncate_to_second,
)
from transitlens.functions.predicates import (
    Box,
    TimeWindow,
    outlier_condition,
    restriction,
)

__all__ = [
    "Box",
    "TimeWindow",
    "compose_datetime",
    "date_literal",
    "ntz_literal",
    "outlier_condition",
    "parse_datetime",
    "restriction",
    "service_date",
    "truncate_to_second",
]
