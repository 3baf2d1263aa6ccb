"""The six aggregates of samples."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import BadRequest


class Aggregation(Enum):
    MEAN = "mean"
    SUM = "sum"
    MIN = "min"
    MAX = "max"
    COUNT = "count"
    LAST = "last"

    @classmethod
    def of(cls, name: str | Aggregation) -> Aggregation:
        """By name, in either case."""
        try:
            return name if isinstance(name, cls) else cls(str(name).lower())
        except ValueError:
            raise BadRequest(f"there is no aggregate {name!r}; there are {', '.join(a.value for a in cls)}") from None


def check_order(order: str) -> str:
    if order not in ("time", "arrival"):
        raise BadRequest(f"order must be 'time' or 'arrival', not {order!r}")
    return order


def ordering(order: str) -> Column:
    """What samples are ordered by: (ts, seq), or seq alone."""
    return F.struct("ts", "seq") if check_order(order) == "time" else F.col("seq")


def aggregate_column(agg: str | Aggregation, order: str = "time") -> Column:
    """The aggregate of the column value; all but LAST ignore the order."""
    value = F.col("value")
    return {
        Aggregation.MEAN: F.avg(value),
        Aggregation.SUM: F.sum(value),
        Aggregation.MIN: F.min(value),
        Aggregation.MAX: F.max(value),
        Aggregation.COUNT: F.count(F.lit(1)).cast("double"),
        Aggregation.LAST: F.max_by(value, ordering(order)),
    }[Aggregation.of(agg)].alias("value")


def aggregate_columns(agg: str | Aggregation | list[str | Aggregation], order: str = "time") -> list[Column]:
    """The column value of one aggregate, or a column of its own name for each of a list."""
    if not isinstance(agg, (list, tuple)):
        return [aggregate_column(agg, order)]
    return [aggregate_column(a, order).alias(Aggregation.of(a).value) for a in agg]
