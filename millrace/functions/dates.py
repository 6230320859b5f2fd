"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_columns(c: Column) -> dict[str, Column]:
    """The eleven calendar columns of a time stamp by name. Weeks of a month start on Monday; quarters of a month end on the 9th, 17th and 24th."""
    day, hour, weekday = F.dayofmonth(c), F.hour(c), F.weekday(c) + 1
    return {
        "hora": hour,
        "dia": day,
        "mes": F.month(c),
        "ano": F.year(c),
        "dia_semana": weekday,
        "dia_ano": F.dayofyear(c),
        "semana_mes": F.ceil((day + F.weekday(F.trunc(c, "MM"))) / 7).cast("int"),
        "quarto_mes": F.when(day <= 9, 1).when(day <= 17, 2).when(day <= 24, 3).otherwise(4),
        "semana_ano": F.weekofyear(c),
        "fds": (weekday >= 6).cast("int"),
        "periodo_dia": F.when(hour <= 6, "madrugada").when(hour <= 12, "manha").when(hour <= 18, "tarde").otherwise("noite"),
    }


def with_date_columns(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns(date_columns(F.col(col)))


def days_to_events(df: DataFrame, col: str, events: dict[str, list[str]]) -> DataFrame:
    """Days to events: dias_para_<event><year> for each date, dias_prox_evento, the least that is not negative, and a boolean for each event's own days.

    The count is the whole days from the time stamp to the event's midnight plus one, so the event's own day and, with a time of day, the day before
    it differ by one, and a day after the event gives 0; that formula is kept. Dates of one event in one year would share a name and are an error.
    """
    at, new = F.col(col).cast("timestamp_ntz"), {}
    for name, dates in events.items():
        for d in dates:
            key = f"dias_para_{name}{d[:4]}"
            if key in new:
                raise ValueError(f"two dates of {name} in {d[:4]}")
            new[key] = (F.floor(F.timestamp_diff("SECOND", at, F.to_timestamp_ntz(F.lit(d))) / 86400) + 1).cast("int")
    ahead = F.array_min(F.filter(F.array(*new.values()), lambda x: x >= 0))
    flags = {name: F.to_date(at).isin(*(F.to_date(F.lit(d)) for d in dates)) for name, dates in events.items()}
    return df.withColumns(new | {"dias_prox_evento": ahead} | flags)


def days_since(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def months_on_book(later: Column, first: Column) -> Column:
    """Calendar months between two dates, whatever their days."""
    return (F.year(later) - F.year(first)) * 12 + F.month(later) - F.month(first)


def horizon(c: Column, minutes: int = 5) -> Column:
    return c + F.make_interval(mins=F.lit(minutes))
