"""Shelf states, progress and goals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shelf states.
STATUSES = ("Not Interested", "To Be Read", "Reading", "Read", "Did Not Finish")


def canonical_status(c: Column) -> Column:
    """The state's own spelling, whatever the case; null if it isn't one."""
    return F.element_at(F.create_map(*[x for s in STATUSES for x in (F.lit(s.lower()), F.lit(s))]), F.lower(c))


def _clamp(c: Column, most: Column) -> Column:
    return F.least(most, F.greatest(F.lit(0), F.round(c).cast("long")))


def progress(pages: Column, percent: Column, page_count: Column, driver: str) -> tuple[Column, Column, Column]:
    """pages, percent and page count after an edit of one of them ("pages", "percent" or "page_count")."""
    count = F.coalesce(page_count, F.lit(0)).cast("long")
    if driver == "page_count":
        count = _clamp(page_count, F.lit(2**53 - 1))
    if driver in ("pages", "page_count"):
        pages = _clamp(F.coalesce(pages, F.lit(0)), F.when(count > 0, count).otherwise(F.lit(2**53 - 1)))
        return pages, F.when(count > 0, F.round(pages / count * 100).cast("long")).otherwise(percent.cast("long")), count
    percent = _clamp(F.coalesce(percent, F.lit(0)), F.lit(100))
    return F.when(count > 0, F.round(percent / 100 * count).cast("long")).otherwise(pages.cast("long")), percent, count


def goal_percentage(done: Column, target: Column) -> Column:
    return F.when(target > 0, F.least(F.lit(100), F.round(done / target * 100).cast("long"))).otherwise(F.lit(0).cast("long"))
