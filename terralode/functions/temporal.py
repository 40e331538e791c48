"""Column functions on dates: ranges that reach the scan as plain comparisons, windows and texts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_year(c: Column, year: int) -> Column:
    """A year's range, which prunes files and row groups as year(c) == year would not."""
    return (c >= F.lit(f"{year}-01-01").cast("timestamp")) & (c < F.lit(f"{year + 1}-01-01").cast("timestamp"))


def around(target: date | Column, days: int) -> tuple[Column, Column]:
    day = target if isinstance(target, Column) else F.lit(target)
    return F.date_sub(day, days), F.date_add(day, days)


def month_bounds(c: Column) -> tuple[Column, Column]:
    """The first day of a month and that of the next."""
    first = F.trunc(c, "month")
    return first, F.add_months(first, 1)


def years_back(c: Column, n: int) -> Column:
    return F.add_months(c, -12 * n)


def buffer_days(start: Column, end: Column, default: int = 10) -> Column:
    return F.coalesce(F.nullif(F.datediff(end, start), F.lit(0)), F.lit(default))


def iso_z(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_of_epoch(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def months_back(day: Column, months: tuple[int, ...] = (6, 12, 18, 24)) -> Column:
    """Days so many months back, of 30 days each."""
    return F.array(*(F.date_sub(day, 30 * m) for m in months))


def ago_text(seconds: Column, older: Column | None = None) -> Column:
    """How long ago something was; from a week on the text `older`, and a dash where it isn't known."""
    def count(unit: int, one: str, more: str) -> Column:
        n = F.floor(seconds / unit)
        return F.concat(F.lit("Hace "), n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {more}"))

    text = F.when(seconds < 60, "Ahora mismo").when(seconds < 3600, count(60, "minuto", "minutos")).when(seconds < 86_400, count(3600, "hora", "horas"))
    text = text.when(seconds < 7 * 86_400, count(86_400, "dia", "dias"))
    return F.coalesce(text.otherwise(older) if older is not None else text, F.lit("-"))
