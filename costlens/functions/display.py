"""Display texts of report figures."""

from pyspark.sql import Column, functions as F


def money(value: Column, digits: int = 4) -> Column:
    return F.concat(F.lit("$"), F.regexp_replace(F.format_number(value, digits), ",", ""))


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(F.regexp_replace(F.format_number(value, digits), ",", ""), F.lit("%"))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def relative_age(ts: Column, as_of: Column) -> Column:
    """Age rounded at each unit: seconds, minutes, hours, then days."""
    micros = (F.unix_micros(as_of) - F.unix_micros(ts)) / 1_000_000
    seconds = F.greatest(F.lit(0), F.floor(micros + 0.5))
    minutes = F.floor(seconds / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)

    def label(amount: Column, unit: str) -> Column:
        return F.concat(amount.cast("long").cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(seconds < 60, label(seconds, "s"))
        .when(minutes < 60, label(minutes, "m"))
        .when(hours < 24, label(hours, "h"))
        .otherwise(label(days, "d"))
    )
