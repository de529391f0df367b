"""Trading calendar derived from the days that have data, and day-offset joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import settle

DAY = "trade_date"


def one_per_day(df: DataFrame) -> DataFrame:
    """Broadcast a table that holds at most one row per calendar date.

    A century of days is under 40,000 rows, so the size is bounded whatever the
    data holds, and the large side of the join is not shuffled.
    """
    return F.broadcast(df)


def trading_days(df: DataFrame, day: str = DAY) -> DataFrame:
    """Distinct days with rows."""
    return df.select(F.col(day).alias(DAY)).where(F.col(DAY).isNotNull()).distinct()


def calendar(df: DataFrame, day: str = DAY) -> DataFrame:
    """(trade_date, ordinal, prev_date, next_date).

    The window has no partition key: it sorts one row per trading day, some
    250 per year of history, after the distinct has run distributed.
    """
    w = W.orderBy(DAY)
    return trading_days(df, day).select(
        DAY, F.row_number().over(w).alias("ordinal"),
        F.lag(DAY).over(w).alias("prev_date"), F.lead(DAY).over(w).alias("next_date"),
    )


def settled_calendar(df: DataFrame, day: str = DAY) -> DataFrame:
    """The calendar as a small written table, for jobs that read it many times.

    Without this each use would repeat the distinct over the source.
    """
    return settle(calendar(df, day))


def weekday_calendar(span: DataFrame) -> DataFrame:
    """Fallback when no panel exists: every Monday to Friday of ``span``, one row of ``lo`` and ``hi``."""
    days = span.select(F.explode(F.sequence("lo", "hi")).alias(DAY))
    return days.where(~F.dayofweek(DAY).isin(1, 7))


def last_days(days: DataFrame, anchor: Column | None, count: int) -> DataFrame:
    """The last ``count`` trading days up to and including ``anchor``."""
    if anchor is not None:
        days = days.where(F.col(DAY) <= anchor)
    return days.select(DAY).orderBy(F.desc(DAY)).limit(count)


def latest_day(df: DataFrame, day: str = DAY) -> DataFrame:
    return df.agg(F.max(day).alias(day))


def latest_snapshot(df: DataFrame, day: str = DAY) -> DataFrame:
    """Rows of the newest day."""
    return df.join(one_per_day(latest_day(df, day)), day, "left_semi")


def expand_over_days(df: DataFrame, days: DataFrame, first: str, stop: str) -> DataFrame:
    """One row per trading day with ordinal in ``[first, stop)``.

    The row count is the size of the result itself; no day is tried and
    rejected, unlike a range-condition join.
    """
    opened = df.where(F.col(first) < F.col(stop)).withColumn(
        "ordinal", F.explode(F.sequence(F.col(first), F.col(stop) - 1))
    ).drop(first, stop)
    return opened.join(one_per_day(days.select(DAY, "ordinal")), "ordinal").drop("ordinal")


def day_lookup(days: DataFrame) -> DataFrame:
    """(date, ordinal) for every calendar date: the first trading day on or after it.

    Covers the first trading day up to the day after the last one, where the
    ordinal is one past the end. One row per calendar date.
    """
    w = W.orderBy(DAY)
    span = days.select(
        DAY, "ordinal",
        F.date_add(F.lag(DAY).over(w), 1).alias("_from"),
    )
    inside = span.select(
        F.explode(F.sequence(F.coalesce("_from", DAY), F.col(DAY))).alias("date"), "ordinal"
    )
    after = days.agg(F.date_add(F.max(DAY), 1).alias("date"), (F.max("ordinal") + 1).alias("ordinal"))
    return inside.unionByName(after)


def ordinal_on_or_after(df: DataFrame, days: DataFrame, date: str, into: str) -> DataFrame:
    """Adds the ordinal of the first trading day on or after ``date``.

    Dates outside the calendar are clamped to its ends, so earlier dates map to
    the first day and later ones to one past the last.
    """
    bounds = days.agg(F.min(DAY).alias("lo"), F.date_add(F.max(DAY), 1).alias("hi"))
    low = bounds.select("lo").scalar()
    high = bounds.select("hi").scalar()
    clamped = F.when(F.col(date).isNotNull(), F.least(F.greatest(F.col(date), low), high))
    lookup = day_lookup(days).select(F.col("date").alias("_clamped"), F.col("ordinal").alias(into))
    return df.withColumn("_clamped", clamped).join(one_per_day(lookup), "_clamped", "left").drop("_clamped")


def running_asof(log: DataFrame, days: DataFrame, keys: list[str], date: str,
                 tie: str, columns: list[str], strict: bool = True) -> DataFrame:
    """Newest log values per key as seen on every trading day.

    ``strict`` uses entries dated before the day, otherwise up to the day. Each
    entry is moved to the first trading day that sees it, entries meeting on
    one day are combined on the map side, and each value is then spread up to
    the day before the next one takes over.
    """
    seen = F.date_add(F.col(date).cast("date"), 1) if strict else F.col(date).cast("date")
    moved = ordinal_on_or_after(log.withColumn("_seen", seen), days, "_seen", "_first")
    last = days.agg(F.max("ordinal")).scalar()
    moved = moved.where(F.col("_first") <= last)
    newest = moved.groupBy(*keys, "_first").agg(
        F.max_by(F.struct(F.col(date), *columns), F.struct(F.col(date), F.col(tie))).alias("_entry")
    )
    following = F.lead("_first").over(W.partitionBy(*keys).orderBy("_first"))
    spans = newest.withColumn("_stop", F.coalesce(following, last + 1))
    return expand_over_days(spans, days, "_first", "_stop").select(DAY, *keys, "_entry.*")


def attach_history(base: DataFrame, history: DataFrame, days: DataFrame, offsets: list[int],
                   code: str = "code", how: str = "left") -> DataFrame:
    """History rows at trading-day offsets (0 = the day itself, 1 = the day before).

    Columns of ``history`` are prefixed ``hist_``. A day without rows leaves
    them null under a left join.
    """
    ordinals = one_per_day(days.select(DAY, "ordinal"))
    asked = base.join(ordinals, DAY).withColumn(
        "day_offset", F.explode(F.array(*[F.lit(int(o)) for o in offsets]))
    ).withColumn("_ordinal", F.col("ordinal") - F.col("day_offset")).drop("ordinal")
    past = history.join(ordinals, DAY).select(
        F.col("ordinal").alias("_ordinal"), F.col(code),
        *[F.col(c).alias(f"hist_{c}") for c in history.columns if c != code],
    )
    return asked.join(past, ["_ordinal", code], how).drop("_ordinal")


def previous_day_values(df: DataFrame, days: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds ``prev_*``: the same key's values on the trading day just before."""
    shifted = (
        df.join(one_per_day(days.select(DAY, "next_date")), DAY)
        .where(F.col("next_date").isNotNull())
        .select(F.col("next_date").alias(DAY), *keys, *[F.col(c).alias(f"prev_{c}") for c in columns])
    )
    return df.join(shifted, [DAY, *keys], "left")


def latest_before(frame: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked ``as_of`` day: the rows of the newest earlier day."""
    known = calendar(frame).select(DAY)
    asked = trading_days(asked, "as_of").withColumnRenamed(DAY, "as_of")
    # Both sides hold one row per day; the union is sorted by day once.
    both = known.select(F.col(DAY).alias("day"), F.col(DAY).alias("known"), F.lit(1).alias("kind")).unionByName(
        asked.select(F.col("as_of").alias("day"), F.lit(None).cast("date").alias("known"), F.lit(0).alias("kind"))
    )
    before = W.orderBy("day", "kind").rowsBetween(W.unboundedPreceding, -1)
    picked = both.withColumn(DAY, F.last("known", ignorenulls=True).over(before)).where("kind = 0")
    pairs = picked.select(F.col("day").alias("as_of"), DAY).where(F.col(DAY).isNotNull())
    return frame.join(one_per_day(pairs.distinct()), DAY).select("as_of", *frame.columns)
