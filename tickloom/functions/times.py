"""Clock and date columns. All timestamps are zone-free exchange wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
# Right-open trading sessions in seconds after midnight.
SESSIONS = ((9 * 3600 + 25 * 60, 11 * 3600 + 30 * 60), (13 * 3600, 15 * 3600))
# Fixed value: archived trade times are eight hours behind the wall clock, in microseconds.
ARCHIVE_SHIFT_US = 28_800_000_000


def plus_micros(day: Column, micros: Column) -> Column:
    """``day`` (date or timestamp) plus a number of microseconds."""
    seconds = (micros.cast("decimal(24,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 read off the wall clock, free of the session zone."""
    days = F.unix_date(F.to_date(ts.cast("timestamp_ntz"))).cast("long")
    return days * F.lit(DAY_SECONDS * 1_000_000) + micros_of_day(ts)


def from_epoch_micros(micros: Column) -> Column:
    return plus_micros(F.lit("1970-01-01").cast("date"), micros)


def micros_of_day(ts: Column) -> Column:
    ts = ts.cast("timestamp_ntz")
    whole = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * F.lit(1_000_000)
    return whole + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def seconds_of_day(ts: Column) -> Column:
    return micros_of_day(ts) / F.lit(1_000_000.0)


def seconds_to_time(day: Column, seconds: Column) -> Column:
    """Seconds after midnight -> timestamp at microsecond steps; negative -> null."""
    return F.when(seconds >= 0, plus_micros(day, F.rint(seconds * 1e6).cast("long")))


def label_hhmmss(ts: Column) -> Column:
    return F.date_format(ts, "HHmmss")


def minute_label(ts: Column) -> Column:
    """Label of the minute a timestamp falls in, ``HHMM00``."""
    return F.concat(F.date_format(ts, "HHmm"), F.lit("00"))


def clock_int_seconds(raw: Column) -> Column:
    """HHMMSSmmm integer -> seconds after midnight (digits may exceed 59)."""
    n = raw.cast("long")
    hour = F.floor(n / F.lit(10_000_000)) % 100
    minute = F.floor(n / F.lit(100_000)) % 100
    second = F.floor(n / F.lit(1_000)) % 100
    return (hour * 3600 + minute * 60 + second).cast("double") + (n % 1000) / F.lit(1000.0)


def _clock_millis(hour: Column, minute: Column, second: Column, milli: Column) -> Column:
    total = ((hour * 60 + minute) * 60 + second) * 1000 + milli
    return F.when(total < DAY_SECONDS * 1000, total)


def parse_clock_text(text: Column, day: Column) -> Column:
    """``H:M:S[.fff]`` with seconds that may run past 59; unreadable text -> null."""
    text = F.trim(text.cast("string"))
    full = r"^(\d+):(\d+):(\d+)(?:\.(\d*))?$"
    part = lambda i: F.regexp_extract(text, full, i).try_cast("long")
    milli = F.rpad(F.regexp_extract(text, full, 4), 3, "0").try_cast("long")
    rolled = _clock_millis(part(1), part(2), part(3), milli)
    short = r"^(\d+):(\d+)$"
    hour = F.regexp_extract(text, short, 1).try_cast("long")
    minute = F.regexp_extract(text, short, 2).try_cast("long")
    brief = F.when(minute < 60, _clock_millis(hour, minute, F.lit(0), F.lit(0)))
    millis = F.when(text.rlike(full), rolled).when(text.rlike(short), brief)
    return plus_micros(day, millis * 1000)


def parse_clock_number(raw: Column, day: Column) -> Column:
    """HHMMSSmmm integer, or epoch milliseconds when the number is that large."""
    n = raw.cast("long")
    millis = _clock_millis(
        F.floor(n / F.lit(10_000_000)), F.floor(n / F.lit(100_000)) % 100,
        F.floor(n / F.lit(1_000)) % 100, n % 1000,
    )
    return F.when(n > 1_000_000_000_000, from_epoch_micros(n * 1000)).otherwise(
        plus_micros(day, millis * 1000)
    )


def compact_date(value: Column) -> Column:
    """Any date text -> ``YYYYMMDD``; null with fewer than eight digits."""
    digits = F.regexp_replace(value.cast("string"), r"\D", "")
    return F.when(F.length(digits) >= 8, F.substring(digits, 1, 8))


def dashed_date(value: Column) -> Column:
    compact = compact_date(value)
    return F.concat_ws(
        "-", F.substring(compact, 1, 4), F.substring(compact, 5, 2), F.substring(compact, 7, 2)
    )


def clock_digits(value: Column) -> Column:
    """First six digits of a clock text as an integer, right-filled with zeros; else 0."""
    digits = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\D", "")
    return F.when(F.length(digits) == 0, F.lit(0)).otherwise(
        F.rpad(F.substring(digits, 1, 6), 6, "0").cast("int")
    )


def in_window(ts: Column, start: str = "09:15", end: str = "15:00") -> Column:
    """Minute-of-day in ``[start, end)``."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (minute >= _minutes(start)) & (minute < _minutes(end))


def in_sessions(ts: Column, sessions=(("09:30", "11:30"), ("13:00", "15:00")), excluded=()) -> Column:
    """Inside any inclusive session and not on an excluded minute."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    inside = F.lit(False)
    for start, end in sessions:
        inside = inside | minute.between(_minutes(start), _minutes(end))
    if excluded:
        inside = inside & ~minute.isin(*[_minutes(m) for m in excluded])
    return inside


def _minutes(text: str) -> int:
    hour, minute = text.split(":")
    return int(hour) * 60 + int(minute)


def slice_seconds(interval: int, sessions=SESSIONS) -> list[int]:
    """Slice ends of one day. At most one per second of a day."""
    return [s for start, end in sessions for s in range(start, end, interval)]


def slice_dimension(spark: SparkSession, interval: int, sessions=SESSIONS) -> DataFrame:
    """(slice, end_second, end_time) rows of one day; one blank label without an interval."""
    if interval <= 0:
        return spark.range(1).select(
            F.lit(0).alias("slice"), F.lit(DAY_SECONDS).alias("end_second"), F.lit("").alias("end_time")
        )
    spans = F.array(*[F.sequence(F.lit(a), F.lit(b - 1), F.lit(interval)) for a, b in sessions])
    seconds = spark.range(1).select(F.posexplode(F.flatten(spans)).alias("slice", "end_second"))
    return seconds.withColumn("end_time", second_label(F.col("end_second")))


def second_label(second: Column) -> Column:
    s = second.cast("int")
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(two(s / 3600), two((s % 3600) / 60), two(s % 60))
