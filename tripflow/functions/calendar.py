"""Calendar columns. Everything works on zone-less wall-clock timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripflow.config import TIME_BANDS, TIMES_OF_DAY


def hour_floor(ts: Column | str) -> Column:
    """Start of the hour, still zone-less (date_trunc would go through the session zone)."""
    return F.make_timestamp_ntz(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0)
    )


def month_start(year: Column | str, month: Column | str) -> Column:
    return F.make_date(year, month, F.lit(1))


def month_label(year: Column | str, month: Column | str) -> Column:
    """``2024`` and ``3`` -> ``2024-03``."""
    return F.date_format(month_start(year, month), "yyyy-MM")


def is_weekend(ts: Column | str) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def day_name(ts: Column | str) -> Column:
    return F.date_format(F.to_date(ts), "EEEE")


def _by_hour(hour: Column, table: dict[str, tuple[int, int]]) -> Column:
    names = list(table)
    first = table[names[0]]
    chain = F.when(hour.between(*first), F.lit(names[0]))
    for name in names[1:]:
        chain = chain.when(hour.between(*table[name]), F.lit(name))
    return chain


def time_band(hour: Column) -> Column:
    """Four bands of six hours."""
    return _by_hour(hour, TIME_BANDS)


def time_of_day(hour: Column) -> Column:
    """Five bands with the two rush hours."""
    return _by_hour(hour, TIMES_OF_DAY)


def add_calendar(df: DataFrame, side: str = "pickup") -> DataFrame:
    """Year, month, day, hour, weekday columns of one side of the trip."""
    ts = f"{side}_datetime"
    return df.withColumns(
        {
            f"{side}_year": F.year(ts),
            f"{side}_month": F.month(ts),
            f"{side}_day": F.dayofmonth(ts),
            f"{side}_hour": F.hour(ts),
            f"{side}_day_of_week": F.dayofweek(ts),
            f"{side}_day_name": day_name(ts),
            f"{side}_is_weekend": is_weekend(ts),
        }
    )


def add_pickup_calendar(df: DataFrame) -> DataFrame:
    return add_calendar(df, "pickup").withColumn("time_of_day", time_of_day(F.col("pickup_hour")))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds; fractions of a second are dropped on both sides first."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def cyclical(value: Column, period: float, name: str) -> dict[str, Column]:
    """Sine and cosine of a periodic value."""
    angle = value.cast("double") * F.lit(2.0) * F.pi() / F.lit(float(period))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def cyclical_calendar(ts: Column | str) -> dict[str, Column]:
    """Hour of day, day of week (Monday = 0) and month on the circle."""
    return {
        **cyclical(F.hour(ts), 24, "hour"),
        **cyclical(F.weekday(ts), 7, "dow"),
        **cyclical(F.month(ts), 12, "month"),
    }


def utc_to_local(ts: Column | str, zone: str) -> Column:
    """Wall clock of ``zone`` for a zone-less UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts) if isinstance(ts, str) else ts)


def relative_day(text: Column, today: Column) -> Column:
    """``today``, ``tomorrow``, ``yesterday``, ``next friday`` or a date literal -> date."""
    word = F.lower(F.trim(text))
    weekday = F.regexp_extract(word, "^next (sunday|monday|tuesday|wednesday|thursday|friday|saturday)$", 1)
    return (
        F.when(word == "today", today)
        .when(word == "tomorrow", F.date_add(today, 1))
        .when(word == "yesterday", F.date_sub(today, 1))
        .when(weekday == "monday", F.next_day(today, "MONDAY"))
        .when(weekday == "tuesday", F.next_day(today, "TUESDAY"))
        .when(weekday == "wednesday", F.next_day(today, "WEDNESDAY"))
        .when(weekday == "thursday", F.next_day(today, "THURSDAY"))
        .when(weekday == "friday", F.next_day(today, "FRIDAY"))
        .when(weekday == "saturday", F.next_day(today, "SATURDAY"))
        .when(weekday == "sunday", F.next_day(today, "SUNDAY"))
        .otherwise(
            F.coalesce(
                F.try_to_timestamp(word, F.lit("yyyy-MM-dd")),
                F.try_to_timestamp(
                    F.regexp_replace(F.initcap(word), "(\\d)(?i:st|nd|rd|th)\\b", "$1"),
                    F.lit("MMMM d yyyy"),
                ),
            ).cast("date")
        )
    )
