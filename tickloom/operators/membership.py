"""Index membership in time, as-of prices and shares, weights, and their shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import codes, values
from tickloom.operators.calendar import DAY, calendar, expand_over_days, one_per_day, ordinal_on_or_after, running_asof
from tickloom.operators.keyed import share_within

BENCHMARK_MEMBERS_MIN = 4800  # Fixed value: below this a broad benchmark is incomplete.
STALE_PRICES_MIN = 50         # Fixed value: stale prices tolerated before the 1 % rule.


def members_in_time(log: DataFrame, days: DataFrame) -> DataFrame:
    """Membership on each trading day: into_date <= day < out_date, open when null.

    Entry and exit dates become day ordinals through one equi-join each, and a
    membership is spread over exactly the days it covers.
    """
    last = days.agg(F.max("ordinal")).scalar()
    opened = ordinal_on_or_after(log, days, "into_date", "_first")
    closed = ordinal_on_or_after(opened, days, "out_date", "_out")
    spans = closed.withColumn("_stop", F.coalesce("_out", last + 1)).drop("_out", "into_date", "out_date")
    return expand_over_days(spans, days, "_first", "_stop")


def current_members(log: DataFrame) -> DataFrame:
    """Rows flagged as newest, when no day is asked."""
    return log.where(F.col("is_new") == 1)


def newest_close(prices: DataFrame, days: DataFrame, security: str = "security_id") -> DataFrame:
    """For each day T: per security the newest close of the two days before T.

    The first day of the history has no earlier one and uses itself. A price is
    sent forward to the two days that may read it.
    """
    ordinals = days.select(DAY, "ordinal")
    priced = prices.join(one_per_day(ordinals), DAY)
    # The first day serves itself and the two after it; the second day's only
    # earlier day is the first one.
    reach = F.when(F.col("ordinal") == 1, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1), F.lit(2)))
    sent = priced.select(
        F.explode(reach).alias("_ahead"), F.col("ordinal").alias("_from"), security, "close",
        F.col(DAY).alias("price_date"),
    ).withColumn("ordinal", F.col("_from") + F.col("_ahead"))
    newest = sent.groupBy("ordinal", security).agg(
        F.max_by("close", "_from").alias("close"), F.max("price_date").alias("price_date")
    )
    return newest.join(one_per_day(ordinals), "ordinal").drop("ordinal")


def free_shares_asof(log: DataFrame, days: DataFrame, security: DataFrame, tie: str = "tie") -> DataFrame:
    """For each day T: per security the newest share count dated up to the day before T.

    On the first day, which has no earlier one, entries up to the day itself count.
    Parties without a row in ``security`` leave before anything is spread over days.
    """
    log = log.join(security.select("party_id").distinct(), "party_id", "left_semi")
    prev = days.select(DAY, F.coalesce("prev_date", DAY).alias("_cut"), "ordinal")
    # Shares are looked up as of the previous trading day, so build the calendar
    # of cut days and read results back under the day that asks.
    cuts = prev.select(F.col("_cut").alias(DAY)).distinct()
    asof = running_asof(log, calendar(cuts), ["party_id"], "change_date", tie, ["free_shares"], strict=False)
    asked = prev.select(F.col("_cut"), F.col(DAY).alias("_day"))
    per_day = asof.join(one_per_day(asked), asof[DAY] == asked["_cut"]).select(
        F.col("_day").alias(DAY), "party_id", "change_date", "free_shares")
    return per_day.join(security.select("party_id", "security_id"), "party_id")


def index_weights(members: DataFrame, closes: DataFrame, shares: DataFrame,
                  groups: list[str] = [DAY, "index_code", "index_exchange"]) -> DataFrame:
    """Free-float value over its total within each day and index; positive inputs only.

    An index is its code and exchange. A group holds the listed members of one index on one day,
    some thousands at most, so one window serves and the joins are built once.
    """
    joined = members.join(closes, [DAY, "security_id"]).join(
        shares.select(DAY, "security_id", "free_shares"), [DAY, "security_id"]
    ).where((F.col("close") > 0) & (F.col("free_shares") > 0))
    value = F.col("free_shares") * F.col("close")
    return joined.withColumn("weight", F.try_divide(value, F.sum(value).over(W.partitionBy(*groups))))


def membership_flags(composition: DataFrame, index_codes: list[str], keys: list[str]) -> DataFrame:
    """Wide membership: ``in_idx_<code>`` per key. The index list is given, not discovered."""
    counted = composition.groupBy(*keys).pivot("index_code", index_codes).agg(F.count(F.lit(1)))
    return counted.select(*keys, *[
        (F.coalesce(F.col(f"`{c}`"), F.lit(0)) > 0).alias(f"in_idx_{c}") for c in index_codes
    ])


def weight_columns(composition: DataFrame, index_codes: list[str], keys: list[str]) -> DataFrame:
    """Wide weights: ``weight_<code>``, mean over duplicates, zero when absent."""
    wide = composition.groupBy(*keys).pivot("index_code", index_codes).agg(F.avg("weight"))
    return wide.select(*keys, *[
        F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"weight_{c}") for c in index_codes
    ])


def weights_to_rows(wide: DataFrame, keys: list[str], prefix: str = "weight_") -> DataFrame:
    """Wide weights -> (keys, index_code, weight), positive weights only."""
    cols = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot(keys, cols, "index_code", "weight")
    return long.where(F.col("weight") > 0).withColumn("index_code", F.expr(f"substr(index_code, {len(prefix) + 1})"))


def normalised_benchmark(composition: DataFrame, keys: list[str] = [DAY, "index_code"], code: str = "id_qi") -> DataFrame:
    """Positive weights scaled to sum to one per day and index."""
    return share_within(composition.where(F.col("weight") > 0), keys, "weight", "norm_weight", [code])


def weight_freshness(weights: DataFrame, days: DataFrame, benchmark: str) -> DataFrame:
    """Per day: members, stale prices, benchmark size, and the two alerts."""
    dated = weights.join(one_per_day(days.select(DAY, F.coalesce("prev_date", DAY).alias("_prev"))), DAY)
    out = dated.groupBy(DAY).agg(
        F.count("*").alias("members"),
        F.count_if(F.col("price_date") < F.col("_prev")).alias("stale_prices"),
        F.count_if(F.col("index_code") == benchmark).alias("benchmark_members"),
    )
    limit = F.greatest(F.lit(STALE_PRICES_MIN), F.floor(F.col("members") * 0.01))
    return out.withColumns({
        "stale_alert": F.col("stale_prices") > limit,
        "benchmark_alert": F.col("benchmark_members").between(1, BENCHMARK_MEMBERS_MIN - 1),
    })


def benchmark_checks(composition: DataFrame, keys: list[str] = [DAY, "index_code"], code: str = "id_qi") -> DataFrame:
    """Per day and index: invalid weights, bad codes, duplicates, positives, verdict."""
    weight = values.number(F.col("weight"))
    bad = ~values.is_finite(F.col("weight").try_cast("double")) | (weight < 0)
    per_code = composition.withColumn("_code", codes.digits6(F.col(code))).groupBy(*keys, "_code").agg(
        F.count("*").alias("_n"),
        F.sum(F.when(F.coalesce(bad, F.lit(True)), 1).otherwise(0)).alias("_bad"),
        F.sum(F.when(weight > 0, 1).otherwise(0)).alias("_positive"),
    )
    out = per_code.groupBy(*keys).agg(
        F.sum("_n").alias("members"), F.sum("_bad").alias("bad_weights"),
        F.sum(F.when(F.col("_code").isNull(), F.col("_n")).otherwise(0)).alias("bad_codes"),
        F.sum(F.when(F.col("_code").isNotNull(), F.col("_n") - 1).otherwise(0)).alias("duplicates"),
        F.sum("_positive").alias("positive_weights"),
    )
    return out.withColumn(
        "valid", (F.col("bad_weights") == 0) & (F.col("bad_codes") == 0)
        & (F.col("duplicates") == 0) & (F.col("positive_weights") > 0))


def map_codes(feed: DataFrame, security: DataFrame, code: str = "code") -> DataFrame:
    """``600000.XSHG`` rows joined to security numbers on ticker digits and exchange letters."""
    keyed = feed.withColumns({
        "_ticker": F.regexp_extract(code, r"^(\d+)", 1), "_exchange": F.regexp_extract(code, r"\.([A-Z]+)$", 1),
    })
    names = security.select(
        F.col("id_qi").alias("_ticker"), F.col("exchange_cd").alias("_exchange"), "security_id")
    return keyed.join(names, ["_ticker", "_exchange"]).drop("_ticker", "_exchange")

