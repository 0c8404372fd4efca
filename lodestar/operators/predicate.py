"""Filters on owner and time, joined by AND, with liveness always implied."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """user: equality. lower, upper: a half-open range of time. None: no such clause."""

    user: int | None = None
    lower: int | None = None
    upper: int | None = None

    def is_empty(self) -> bool:
        return self.lower is not None and self.upper is not None and self.lower >= self.upper

    def kind(self) -> str:
        if self.is_empty():
            return "Empty"
        time = self.lower is not None or self.upper is not None
        return {(False, False): "All", (True, False): "User", (False, True): "Time", (True, True): "UserAndTime"}[self.user is not None, time]

    def clauses(self) -> Column:
        """The supplied clauses, without liveness; false for an empty range, which the optimizer folds away."""
        if self.is_empty():
            return F.lit(False)
        out = []
        if self.user is not None:
            out.append(F.col("user_id") == self.user)
        if self.lower is not None:
            out.append(F.col("timestamp") >= self.lower)
        if self.upper is not None:
            out.append(F.col("timestamp") < self.upper)
        return reduce(lambda a, b: a & b, out, F.lit(True))

    def live(self) -> Column:
        return F.col("live") & self.clauses()


ALL = Filter()


def checked_range(lower: int | None, upper: int | None) -> Filter:
    """As the evaluation's oracle has it: a range that ends before it begins is an error, an empty one is not."""
    if lower is not None and upper is not None and lower > upper:
        raise ValueError("InvalidFilterRange")
    return Filter(None, lower, upper)


def from_document(where: dict) -> Filter:
    """A nested document such as {"$and": [{"user_id": {"$eq": 1}}, {"timestamp": {"$gte": 0}}]}."""
    user = lower = upper = None
    for part in where.get("$and", [where] if where else []):
        for name, test in part.items():
            for op, value in (test if isinstance(test, dict) else {"$eq": test}).items():
                if (name, op) == ("user_id", "$eq"):
                    user = value
                elif (name, op) == ("timestamp", "$gte"):
                    lower = value
                elif (name, op) == ("timestamp", "$lt"):
                    upper = value
                else:
                    raise ValueError(f"unknown clause {name} {op}")
    return Filter(user, lower, upper)


def eligible(records: DataFrame, where: Filter = ALL) -> DataFrame:
    return records.where(where.live())


def slots(records: DataFrame, where: Filter = ALL) -> DataFrame:
    """Eligible rows' slots and ids, in slot order."""
    return eligible(records, where).select("slot", "id").orderBy("slot")


def page(records: DataFrame, offset: int, limit: int, where: Filter | None) -> tuple[DataFrame, DataFrame]:
    """A page in slot order and the total. With a filter: live matches. With None: all rows, deleted ones too."""
    rows = records if where is None else eligible(records, where)
    return rows.orderBy("slot").offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))


def unmatched(plan: DataFrame, records: DataFrame, where: Filter) -> DataFrame:
    """Slots of a compiled list that are unknown, deleted or don't match any more, or occur twice: it must be empty."""
    repeated = plan.groupBy("slot").count().where("count > 1").select("slot")
    return plan.join(eligible(records, where).select("slot"), "slot", "left_anti").union(repeated)


def workload_upper(records: DataFrame, count: int) -> int | None:
    """The exclusive upper bound of time that leaves count rows eligible: the timestamp at that rank; None beyond the last."""
    row = records.select("timestamp", "id").orderBy("timestamp", "id").offset(count).limit(1).first()
    return None if row is None else row[0]
