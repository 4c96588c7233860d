"""Cutoff grids and horizon arithmetic.

A grid is regular and descending: cutoff_k = start - k * step_days for
k = 0 .. count-1. Because it is regular, the cutoffs a timestamp belongs to
are found by arithmetic (no join), see ``horizon_indexes``.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400
DAY_MICROS = DAY * 1_000_000


@dataclass(frozen=True)
class CutoffGrid:
    start: _dt.date
    end: _dt.date
    step_days: int

    @property
    def count(self) -> int:
        return (self.start - self.end).days // self.step_days + 1

    def dates(self) -> list[_dt.date]:
        return [self.start - _dt.timedelta(days=k * self.step_days) for k in range(self.count)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(k int, cutoff date) — count rows, fixed by the parameters."""
        return (spark.range(self.count)
                .select(F.col("id").cast("int").alias("k"))
                .withColumn("cutoff", cutoff_of(self, F.col("k"))))

    def sql(self) -> str:
        """DuckDB text of the same grid."""
        return (f"SELECT CAST(k AS INTEGER) AS k, DATE '{self.start.isoformat()}' - "
                f"CAST(k * {self.step_days} AS INTEGER) AS cutoff FROM range(0, {self.count}) t(k)")


def _d(s: str) -> _dt.date:
    return _dt.date.fromisoformat(s)


# The grids used by the dataset builds, shifted onto the span of
# the provided tables (train: every 4 weeks; test: every 2 weeks).
TRAIN_GRID = CutoffGrid(_d("2000-06-04"), _d("1998-08-01"), 28)
TEST_GRID = CutoffGrid(_d("2001-05-01"), _d("2000-10-31"), 14)
HORIZON_DAYS = 180


def cutoff_of(grid: CutoffGrid, k: Column) -> Column:
    return F.date_sub(F.lit(grid.start), (k * F.lit(grid.step_days)).cast("int"))


def _micros_from_start(grid: CutoffGrid, ts: Column) -> Column:
    start = F.lit(_dt.datetime.combine(grid.start, _dt.time())).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, ts.cast("timestamp_ntz"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a date or time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(_dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _floor_div(x: Column, step: int) -> Column:
    """Whole-number division rounded down, exact to the microsecond."""
    return ((x - F.pmod(x, F.lit(step))) / F.lit(step)).cast("long")


def horizon_indexes(grid: CutoffGrid, ts: Column, horizon_days: int = HORIZON_DAYS) -> Column:
    """array<int> of k with cutoff_k < ts <= cutoff_k + horizon (may be empty).

    k > -x/step and k <= (H - x)/step with x = ts - start; at most
    ceil(H/step)+1 entries, so the fan-out is bounded by the parameters.
    """
    x = _micros_from_start(grid, ts)
    step = grid.step_days * DAY_MICROS
    lo = F.greatest(_floor_div(-x, step) + 1, F.lit(0))
    hi = F.least(_floor_div(F.lit(horizon_days * DAY_MICROS) - x, step), F.lit(grid.count - 1))
    return F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(
        F.array().cast("array<int>"))


def asof_bucket(grid: CutoffGrid, ts: Column) -> Column:
    """Largest k with ts <= cutoff_k (the nearest cutoff at or after ts), clipped
    to the oldest cutoff; null when ts is after the newest cutoff."""
    k = _floor_div(-_micros_from_start(grid, ts), grid.step_days * DAY_MICROS)
    return F.when(k >= 0, F.least(k, F.lit(grid.count - 1)).cast("int"))


def _at(day: _dt.date) -> Column:
    return F.lit(_dt.datetime.combine(day, _dt.time())).cast("timestamp_ntz")


def in_horizons(grid: CutoffGrid, ts: Column, horizon_days: int = HORIZON_DAYS) -> Column:
    """The plain bounds that any horizon of the grid implies; a scan can skip row groups by them."""
    return (ts > _at(grid.dates()[-1])) & (ts <= _at(grid.start + _dt.timedelta(days=horizon_days)))


def up_to_newest(grid: CutoffGrid, ts: Column) -> Column:
    """The plain bound of an as-of read: nothing after the newest cutoff."""
    return ts <= _at(grid.start)


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
