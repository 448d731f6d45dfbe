"""Issues and reports."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from objtrail.records import _text
from objtrail.schema import ISSUE, plain


class Level(str, Enum):
    ERROR = "error"
    WARNING = "warning"


@dataclass(frozen=True, slots=True)
class Issue:
    """One issue, for those that read a report row by row."""

    code: str
    message: str
    level: Level = Level.ERROR
    at: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _text(self.code, "Issue.code")
        _text(self.message, "Issue.message")
        if not isinstance(self.level, Level):
            raise TypeError("Issue.level must be Level")
        if not isinstance(self.at, tuple):
            raise TypeError("Issue.at must be a tuple")
        if not all(isinstance(x, str) for x in self.at):
            raise TypeError("every item in Issue.at must be str")


def issue(code: str, message: Column, *at: Column | str, level: Level = Level.ERROR) -> Column:
    """An issue as a struct; texts in ``at`` are literals."""
    place = F.array(*[F.lit(x) if isinstance(x, str) else x for x in at])
    return F.struct(
        F.lit(code).alias("code"), message.alias("message"), F.lit(level.value).alias("level"), place.alias("at")
    )


@dataclass(frozen=True)
class Report:
    """A multiset of issues (code, message, level, at); ``ordered`` sorts it at the edge."""

    issues: DataFrame

    def __post_init__(self) -> None:
        if not isinstance(self.issues, DataFrame):
            raise TypeError("Report.issues must be a DataFrame")
        wanted = {f.name: plain(f.dataType) for f in ISSUE}
        found = {f.name: plain(f.dataType) for f in self.issues.schema}
        if wanted != found:
            raise TypeError(f"Report.issues must have {wanted}, not {found}")

    @property
    def valid(self) -> bool:
        """Whether there is no error; stops at the first."""
        return self.errors.isEmpty()

    @property
    def errors(self) -> DataFrame:
        return self.issues.where(F.col("level") == Level.ERROR.value)

    @property
    def warnings(self) -> DataFrame:
        return self.issues.where(F.col("level") == Level.WARNING.value)

    def has(self, code: str) -> bool:
        _text(code, "code")
        return not self.issues.where(F.col("code") == code).isEmpty()

    def ordered(self) -> DataFrame:
        return self.issues.orderBy("code", "at", "message", "level")

    def summary(self) -> DataFrame:
        """Issues per code; an addition of this engine."""
        return self.issues.groupBy("code").agg(F.count("*").alias("n"))

    def collect(self, limit: int = 100_000) -> tuple[Issue, ...]:
        """All issues in order; a report of more than ``limit`` is refused, ``iterate`` reads those."""
        rows = self.ordered().limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"the report has more than {limit} issues")
        return tuple(map(_issue, rows))

    def iterate(self) -> Iterator[Issue]:
        """All issues in order, a partition at a time."""
        return map(_issue, self.ordered().toLocalIterator())


def _issue(row: Row) -> Issue:
    return Issue(row.code, row.message, Level(row.level), tuple(row.at))
