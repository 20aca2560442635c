"""Human-readable status, time and number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Start, slope and floor of the decay schedule.
SCHEDULE_START, SCHEDULE_STEP, SCHEDULE_FLOOR = 0.5, 0.05, 0.01


def schedule(updates: Column) -> Column:
    """Decay schedule: 0.0 before the first update, then linear down to the floor."""
    value = F.lit(SCHEDULE_START) - F.lit(SCHEDULE_STEP) * updates
    return F.when(updates == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(SCHEDULE_FLOOR), value))


def status_line(updates: Column) -> Column:
    return F.format_string("%d updates, loss=%.3f", updates, schedule(updates))


def ctime(ts: Column) -> Column:
    """C-style time text; the day is padded to two characters with a space."""
    return F.concat(
        F.date_format(ts, "EEE MMM "),
        F.lpad(F.day(ts).cast("string"), 2, " "),
        F.date_format(ts, " HH:mm:ss yyyy"),
    )


def two_decimals(c: Column) -> Column:
    return F.format_string("%.2f", c)
