"""The dashboard filter panel as one declarative predicate.

``FilterSpec.apply`` adds a single ``where`` that Catalyst pushes towards the
scan; nothing is evaluated on the driver. A dimension left at ``None`` means
"all values", which (as in the reproduced system, Q6) excludes nulls.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import columns as C

DIMENSIONS = ["model", "line", "process", "station"]
# F5 searched columns per profile (Q7: explicit list; null never matches).
SEARCH_COLUMNS = {
    "tests": ["track_id", "station", "model", "line", "process", "failed_testcode"],
    "span": ["track_id", "model", "line", "process", "station", "status",
             "failed_testcode", "status_display", "_date_text", "_time_text"],
}
SEARCH_COLUMNS["pattern"] = SEARCH_COLUMNS["span"]


@dataclass(frozen=True)
class FilterSpec:
    start_date: str | None = None          # F1, inclusive, 'yyyy-MM-dd'
    end_date: str | None = None
    start_time: str | None = None          # F2, inclusive, 'HH:MM[:SS]', no wrap
    end_time: str | None = None
    shift: str | None = None               # F3 preset: Day / AM / PM
    model: list[str] | None = None         # F4
    line: list[str] | None = None
    process: list[str] | None = None
    station: list[str] | None = None
    search: str | None = None              # F5: lower-cased regular expression
    literal: bool = False                  #     or a plain substring
    status: str = "All"                    # F6: All / Passed / Failed / NTF / Real Fail
    profile: str = "tests"
    extra: dict = field(default_factory=dict)

    def predicate(self) -> Column:
        conds: list[Column] = []
        if self.start_date:
            conds.append(F.col("date") >= F.lit(self.start_date).cast("date"))
        if self.end_date:
            conds.append(F.col("date") <= F.lit(self.end_date).cast("date"))
        start, end = self.start_time, self.end_time
        if self.shift:
            start, end = K.SHIFT_PRESETS[self.shift]
        if start:
            conds.append(F.col("tod") >= F.lit(C.time_text_to_micros(start)))
        if end:
            conds.append(F.col("tod") <= F.lit(C.time_text_to_micros(end)))
        for dim in DIMENSIONS:
            chosen = getattr(self, dim)
            conds.append(F.col(dim).isNotNull() if chosen is None else F.col(dim).isin(*chosen))
        if self.search:
            conds.append(self._search())
        if self.status != "All":
            conds.append(self._status())
        return reduce(lambda a, b: a & b, conds)

    def _search(self) -> Column:
        term = self.search.strip().lower()
        cols = []
        for c in SEARCH_COLUMNS[self.profile]:
            if c == "_date_text":
                v = F.date_format("date", "yyyy-MM-dd")
            elif c == "_time_text":
                v = F.date_format("event_ts", "HH:mm:ss")
            else:
                v = F.col(c)
            low = F.lower(v)
            hit = low.contains(term) if self.literal else low.rlike(term)
            cols.append(F.coalesce(hit, F.lit(False)))
        return reduce(lambda a, b: a | b, cols)

    def _status(self) -> Column:
        if self.profile == "tests":
            return F.col("status") == ("P" if self.status == K.PASSED else "F")
        if self.status == K.FAILED:
            return F.col("failed")
        return F.col("status_display") == self.status

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate())


def domains(df: DataFrame) -> DataFrame:
    """F11 values: one row per (dimension, distinct non-null value); long
    form so no value list is ever gathered into a single row, sorted, in one
    scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS]))
    return (df.select(pairs.alias("_p")).select("_p.*").where(F.col("value").isNotNull())
            .distinct().orderBy("dimension", "value"))


def summary(df: DataFrame) -> DataFrame:
    """F11 bounds: date and time-of-day range, rows, distinct tracks."""
    return df.agg(
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.date_format(F.min("event_ts"), "HH:mm:ss").alias("first_time"),
        F.date_format(F.max("event_ts"), "HH:mm:ss").alias("last_time"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("track_id").alias("total_tracks"))
