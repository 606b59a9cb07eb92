"""Predicates on year intervals; a null end is the start, bounds are inclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return (start_a <= F.coalesce(end_b, start_b)) & (F.coalesce(end_a, start_a) >= start_b)


def overlap_length(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.coalesce(end_a, start_a), F.coalesce(end_b, start_b)) - F.greatest(start_a, start_b) + 1)


def in_years(low: Column, high: Column, start: int | None, end: int | None) -> Column:
    """Texts without years pass; others must overlap the range; no range passes all."""
    if start is None or end is None:
        return F.lit(True)
    return low.isNull() | overlaps(low, high, F.lit(start), F.lit(end))


def in_periods(period: Column, periods: Column, wanted: list[str] | None) -> Column:
    if not wanted:
        return F.lit(True)
    several = F.coalesce(periods, F.array().cast("array<string>"))
    return F.coalesce(period.isin(wanted), F.lit(False)) | F.arrays_overlap(several, F.array(*[F.lit(p) for p in wanted]))


def edge_in_years(start: Column, end: Column, low: int | None, high: int | None, slack: int = 5) -> Column:
    """Edges near a range of years; undated ones pass."""
    if low is None or high is None:
        return F.lit(True)
    return start.isNull() | ((start <= high + slack) & (F.coalesce(end, start) >= low - slack))


def valid_years(start: Column, end: Column) -> tuple[Column, Column]:
    """Both years, or neither where the start is missing or after the end."""
    good = start.isNotNull() & (end.isNull() | (start <= end))
    return F.when(good, start), F.when(good, end)


def after_cutoff(low: Column, path: Column, max_year: int, lead: str = "Mở đầu") -> Column:
    """Chunks whose every year lies after the cutoff; leads are kept."""
    return F.coalesce(low > max_year, F.lit(False)) & (F.coalesce(path, F.lit("")) != lead)
