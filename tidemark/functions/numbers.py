"""Numbers, clocks and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """m:ss; null, NaN, infinite and negative seconds are 0:00."""
    usable = seconds.isNotNull() & ~F.isnan(seconds.cast("double")) & (seconds > 0) & (seconds < 1e12)
    whole = F.floor(F.when(usable, seconds).otherwise(0)).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def clock_seconds(text: Column) -> Column:
    """Seconds of m:ss or h:mm:ss; null for other texts."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("int"))
    return F.when(text.rlike(r"^[0-9]+(:[0-5]?[0-9]){1,2}$"), F.aggregate(parts, F.lit(0), lambda a, p: a * 60 + p))


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage, halves up; 0 where there is no whole."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5).cast("int")).otherwise(0)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def wrapped(index: Column, step: int, n: Column) -> Column:
    """1-based index moved by step on a ring of n."""
    return F.pmod(index - 1 + step, n) + 1


def megabytes(size: Column) -> Column:
    return size / 1048576


def relative_time(at: Column, now: Column) -> Column:
    """Just now, minutes, hours or days ago; from a week on, the date."""
    minutes = F.floor((F.unix_seconds(now) - F.unix_seconds(at)) / 60)
    return (
        F.when(minutes < 1, "Just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .when(minutes < 10080, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )


def to_timestamp(value: Column) -> Column:
    """ISO text or epoch milliseconds as text, tolerantly."""
    return F.coalesce(F.when(value.rlike("^[0-9]{10,}$"), F.timestamp_millis(value.try_cast("long"))), F.try_to_timestamp(value))


#: How dates are shown (fixed values): in lists, without the year, with the time, in full.
DATE_STYLES = {"medium": "MMM d, yyyy", "short": "MMM d", "timed": "MMM d, yyyy, h:mm a", "long": "EEEE, MMMM d, yyyy"}


def shown_date(at: Column, style: str = "medium") -> Column:
    """A time in one of the styles; — where there is none."""
    return F.coalesce(F.date_format(at, DATE_STYLES[style]), F.lit("—"))


def increment(number: Column) -> Column:
    """One more; a missing number counts as 0."""
    return F.coalesce(number, F.lit(0)) + 1


def rounded(x: Column, places: int = 3) -> Column:
    """x to that many decimal places (7 at most) by its exact binary value, a tie to the even digit, as a program that prints the number rounds it.

    F.round goes by the shortest decimal that stands for x, so it takes 2.6745, which is a little less, for a tie. Here the part of x * 10 ** places
    that the product of doubles loses is found by splitting x (Dekker), and decides where the product looks like a tie."""
    by = float(10**places)
    p, c = x * by, x * 134217729.0
    high = c - (c - x)
    lost = (high * by - p) + (x - high) * by
    whole = F.floor(p)
    over = p - whole
    up = (over > 0.5) | ((over == 0.5) & ((lost > 0) | ((lost == 0) & (F.pmod(whole, F.lit(2)) == 1))))
    return (whole + F.when(up, 1).otherwise(0)) / by
