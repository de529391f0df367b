"""Risk exposures, snapshot selection and target checks, for all days and books at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import codes, values
from tickloom.operators.calendar import DAY

LOOKBACK = 5       # Fixed value: qualifying days that form the baseline.
MAX_DROP = 0.20    # Fixed value: tolerated fall against the baseline median.
MAX_AGE_DAYS = 14  # Fixed value: oldest usable snapshot.


def exposures(weights: DataFrame, risk: DataFrame, keys: list[str], code: str, columns: list[str],
              weight: str = "weight") -> DataFrame:
    """Weighted exposure sums, long: (keys, factor, exposure). ``keys`` join both sides where shared."""
    on = [k for k in keys if k in risk.columns] + [code]
    joined = weights.join(risk.select(*on, *columns), on)
    # Sums stay wide through the shuffle: one row per group, not one per factor and stock.
    wide = joined.groupBy(*keys).agg(*[F.sum(F.col(weight) * F.col(c)).alias(c) for c in columns])
    return wide.unpivot(keys, list(columns), "factor", "exposure")


def benchmark_moments(bench: DataFrame, risk: DataFrame, keys: list[str], code: str, columns: list[str],
                      weight: str = "weight") -> DataFrame:
    """Benchmark exposure and equal-weight sample deviation per factor."""
    on = [k for k in keys if k in risk.columns] + [code]
    joined = bench.join(risk.select(*on, *columns), on)
    wide = joined.groupBy(*keys).agg(*[
        F.struct(F.sum(F.col(weight) * F.col(c)).alias("bench_exposure"), F.stddev_samp(c).alias("bench_std")).alias(c)
        for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(f"`{c}`").alias("m")) for c in columns])
    return wide.select(*keys, F.inline(cells)).select(*keys, "factor", "m.*")


def active_exposures(target: DataFrame, bench: DataFrame, risk: DataFrame, book: list[str], day: list[str],
                     code: str, columns: list[str]) -> DataFrame:
    """Portfolio less benchmark exposure per book, day and factor, with the benchmark deviation."""
    held = exposures(target, risk, [*day, *book], code, columns)
    moments = benchmark_moments(bench, risk, day, code, columns)
    return held.join(moments, [*day, "factor"]).withColumn(
        "active", F.col("exposure") - F.col("bench_exposure"))


def style_breaches(active: DataFrame, tolerance: float, slack: float = 1e-6) -> DataFrame:
    """Factors whose active exposure leaves the band of ``tolerance`` deviations."""
    limit = F.col("bench_std") * tolerance
    return active.withColumn("limit", limit).where(F.abs("active") > F.col("limit") + slack)


def industry_breaches(active: DataFrame, tolerance: float, slack: float = 1e-6) -> DataFrame:
    """Group exposures outside (1 +- tolerance) of a non-empty benchmark exposure."""
    low, high = F.col("bench_exposure") * (1 - tolerance), F.col("bench_exposure") * (1 + tolerance)
    bound = active.withColumns({"low": low, "high": high}).where(F.col("bench_exposure") > 1e-8)
    return bound.where((F.col("exposure") < F.col("low") - slack) | (F.col("exposure") > F.col("high") + slack))


def exposure_gaps(target: DataFrame, risk: DataFrame, keys: list[str], day: list[str], code: str,
                  columns: list[str]) -> DataFrame:
    """Books holding stocks without complete risk values: these fail the check."""
    on = [*day, code]
    complete = risk.where(values.all_of([values.is_finite(F.col(c)) for c in columns])).select(*on)
    return target.where(F.abs("weight") > 1e-10).join(complete, on, "left_anti").groupBy(*keys).agg(
        F.count("*").alias("missing"))


def one_hot_check(panel: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Row check: every value 0 or 1 and the row sums to one."""
    binary = values.all_of([F.coalesce(F.col(c).isin(0.0, 1.0), F.lit(False)) for c in columns])
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))
    return panel.select(*keys, (binary & (F.abs(total - 1) <= 1e-8)).alias("one_hot"))


def coverage(panel: DataFrame, code: str, lookback: int = LOOKBACK) -> DataFrame:
    """Per day: distinct stocks and the median count of the days before it (null until there are enough)."""
    per_code = panel.groupBy(DAY, code).agg(F.lit(1).alias("_one"))
    counts = per_code.groupBy(DAY).agg(F.count("*").alias("stocks"))
    w = W.orderBy(DAY).rowsBetween(-lookback, -1)  # one row per trading day
    return counts.withColumn("baseline", _median_of(F.collect_list("stocks").over(w), lookback))


def _median_of(values_: Column, size: int) -> Column:
    """Median of a window array of at most ``size`` numbers; null unless it is full."""
    ordered = F.array_sort(values_)
    low, high = (size + 1) // 2, (size + 2) // 2
    return F.when(F.size(values_) == size, (F.element_at(ordered, low) + F.element_at(ordered, high)) / 2.0)


def day_quality(panel: DataFrame, bench: DataFrame, code: str, required: list[str], legacy: list[str],
                one_hot: list[str], stale_days: DataFrame | None = None,
                bench_verdict: DataFrame | None = None) -> DataFrame:
    """Per day: counts and the reasons that disqualify it as a risk snapshot.

    ``bench`` holds the dated benchmark members (day, code). Panel rows are
    reduced per (day, code) first, which finds duplicates without a distinct.
    ``bench_verdict`` (day, valid) is the outcome of the benchmark checks; a day
    without one does not qualify.
    """
    c = F.col
    binary = values.all_of([F.coalesce(c(n).isin(0.0, 1.0), F.lit(False)) for n in one_hot])
    total = sum((F.coalesce(c(n), F.lit(0.0)) for n in one_hot[1:]), F.coalesce(c(one_hot[0]), F.lit(0.0)))
    complete = values.all_of([values.is_finite(c(n)) for n in required])
    old = values.any_of([c(n).isNotNull() for n in legacy]) if legacy else F.lit(False)
    flag = lambda e: F.max(F.when(e, 1).otherwise(0))
    rows = panel.groupBy(DAY, code).agg(
        F.count("*").alias("_n"), flag(old).alias("_legacy"), flag(complete).alias("_complete"),
        flag(binary & (F.abs(total - 1) <= 1e-8)).alias("_one_hot"), F.lit(0).alias("_member"))
    members = bench.groupBy(DAY, code).agg(
        F.lit(0).cast("long").alias("_n"), F.lit(0).alias("_legacy"), F.lit(0).alias("_complete"),
        F.lit(0).alias("_one_hot"), F.lit(1).alias("_member"))
    per_code = rows.unionByName(members).groupBy(DAY, code).agg(
        *[F.max(n).alias(n) for n in ("_n", "_legacy", "_complete", "_one_hot", "_member")])
    member = c("_member") == 1
    out = per_code.groupBy(DAY).agg(
        F.count_if(c("_n") > 0).alias("stocks"), F.count_if(member).alias("members"),
        F.count_if(c("_n") > 1).alias("duplicates"), F.sum("_legacy").alias("legacy"),
        F.count_if(member & (c("_complete") == 0)).alias("incomplete"),
        F.count_if(member & (c("_one_hot") == 0)).alias("not_one_hot"))
    if stale_days is None:
        out = out.withColumn("stale", F.lit(0).cast("long"))
    else:
        out = out.join(stale_days.select(DAY, c("count").cast("long").alias("stale")), DAY, "left").withColumn(
            "stale", F.coalesce("stale", F.lit(0).cast("long")))
    good = (
        (c("stocks") > 0) & (c("members") > 0) & (c("duplicates") == 0) & (c("legacy") == 0)
        & (c("incomplete") == 0) & (c("not_one_hot") == 0) & (c("stale") == 0))
    if bench_verdict is not None:
        out = out.join(bench_verdict.select(DAY, c("valid").alias("_valid")), DAY, "left")
        return out.withColumn("qualifies", good & F.coalesce("_valid", F.lit(False))).drop("_valid")
    return out.withColumn("qualifies", good)


def snapshot_candidates(quality: DataFrame, held_ok: DataFrame | None = None, lookback: int = LOOKBACK,
                        max_drop: float = MAX_DROP) -> DataFrame:
    """Per day: baselines over the last qualifying days before it and whether it can serve.

    ``held_ok`` (day, held_complete) adds the held-stock condition, which binds
    the candidate only.
    """
    good = lambda name: F.when(F.col("qualifies"), F.col(name))
    # One row per trading day. Days are numbered by the qualifying days before them, which gives
    # every qualifying day its own number; the last ``lookback`` of them are a range of numbers.
    # collect_list skips the nulls of the other days.
    before = W.orderBy(DAY).rowsBetween(W.unboundedPreceding, -1)
    numbered = quality.withColumn("_number", F.coalesce(F.count_if("qualifies").over(before), F.lit(0)))
    last = W.orderBy("_number").rangeBetween(-lookback, -1)
    tail = lambda name: F.collect_list(good(name)).over(last)
    out = numbered.withColumns({
        "stock_baseline": _median_of(tail("stocks"), lookback),
        "member_baseline": _median_of(tail("members"), lookback),
    }).drop("_number")
    if held_ok is not None:
        out = out.join(held_ok, DAY, "left").withColumn("held_complete", F.coalesce("held_complete", F.lit(False)))
    else:
        out = out.withColumn("held_complete", F.lit(True))
    kept = (F.col("stocks") / F.col("stock_baseline")) > 1 - max_drop + 1e-12
    return out.withColumn("usable", F.coalesce(
        F.col("qualifies") & F.col("held_complete") & kept
        & (F.col("members") > F.col("member_baseline") * (1 - max_drop) + 1e-12), F.lit(False)))


def book_candidates(candidates: DataFrame, held_ok: DataFrame) -> DataFrame:
    """Candidates per book: a usable day serves a book whose held stocks are complete on it.

    ``held_ok`` comes from ``held_complete`` with ``book`` keys and holds complete days only.
    """
    return candidates.drop("held_complete").where("usable").join(held_ok.where("held_complete"), DAY)


def select_snapshot(candidates: DataFrame, asked: DataFrame, max_age: int = MAX_AGE_DAYS,
                    book: list[str] = []) -> DataFrame:
    """For each asked ``as_of`` date (and book): the newest usable day before it that is not too old; null if none."""
    keys = [*book, "as_of"]
    ages = F.explode(F.sequence(F.lit(1), F.lit(max_age)))
    tried = asked.select(*keys, ages.alias("age_days")).withColumn(DAY, F.expr("date_sub(as_of, age_days)"))
    found = tried.join(candidates.where("usable"), [DAY, *book]).groupBy(*keys).agg(
        F.max(DAY).alias("risk_date"), F.min("age_days").alias("age_days"))
    return asked.select(*keys).join(found, keys, "left")


def held_complete(panel: DataFrame, held: DataFrame, code: str, required: list[str], days: DataFrame,
                  one_hot: list[str] = [], book: list[str] = []) -> DataFrame:
    """Per day (and book): whether every held stock has finite risk values and one-hot groups.

    ``held`` has (code), or (book, code) with ``book`` keys. Counting matches avoids pairing every
    day with every stock; with ``book`` keys only days with a match come back, the others fail.
    """
    good = values.all_of([values.is_finite(F.col(c)) for c in required])
    if one_hot:
        checked = one_hot_check(panel.where(good), one_hot, [DAY, code]).where("one_hot")
    else:
        checked = panel.where(good).select(DAY, code)
    own = held.select(*book, code).distinct()
    matched = checked.select(DAY, code).distinct().join(own, code).groupBy(DAY, *book).agg(F.count("*").alias("_have"))
    if book:
        need = own.groupBy(*book).agg(F.count("*").alias("_need"))
        return matched.join(need, book).select(*book, DAY, (F.col("_have") == F.col("_need")).alias("held_complete"))
    need = own.agg(F.count("*")).scalar()
    return days.select(DAY).join(matched, DAY, "left").select(
        DAY, (F.coalesce("_have", F.lit(0)) == need).alias("held_complete"))


def sidecar_verdict(audit: DataFrame, keys: list[str] = [DAY], count: str = "count") -> DataFrame:
    """Stale-row records: invalid or positive counts reject the day."""
    n = F.col(count).try_cast("double")
    state = F.when(~values.is_finite(n) | (n < 0), "invalid").when(n > 0, "stale").otherwise("clean")
    return audit.withColumn("_state", state).groupBy(*keys).agg(
        F.max(F.when(F.col("_state") != "clean", 1).otherwise(0)).alias("_bad"),
        F.max(F.when(F.col("_state") == "invalid", 1).otherwise(0)).alias("_invalid"),
    ).select(*keys, F.when(F.col("_invalid") == 1, "invalid").when(F.col("_bad") == 1, "stale").otherwise("clean").alias("verdict"))


def holdings_check(positions: DataFrame, account: DataFrame, keys: list[str], code: str, amounts: list[str]) -> DataFrame:
    """Per book: invalid amounts, contradictions between amount columns, bad codes, and an
    empty book whose account still shows value."""
    main, *others = amounts
    n = lambda c: F.col(c).try_cast("double")
    contradiction = values.any_of([
        (F.abs(n(main)) <= 1e-10) & (F.abs(n(o)) > 1e-10) for o in others]) if others else F.lit(False)
    live = F.abs(n(main)) > 1e-10
    per = positions.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(live).alias("held"),
        F.count_if(~values.is_finite(n(main))).alias("invalid_amounts"),
        F.count_if(F.coalesce(contradiction, F.lit(False))).alias("contradictions"),
        F.count_if(live & codes.digits6(F.col(code)).isNull()).alias("bad_codes"))
    both = account.select(*keys, F.col("market_value").try_cast("double").alias("_mv")).join(per, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    empty = F.col("rows").isNull()
    unproven = empty & (~values.is_finite(F.col("_mv")) | (F.abs("_mv") > 1e-8))
    return both.select(
        *keys, zero("held").alias("held"), zero("invalid_amounts").alias("invalid_amounts"),
        zero("contradictions").alias("contradictions"), zero("bad_codes").alias("bad_codes"),
        F.coalesce(unproven, F.lit(True)).alias("unproven_empty"),
    ).withColumn("valid", (F.col("invalid_amounts") == 0) & (F.col("contradictions") == 0)
                 & (F.col("bad_codes") == 0) & ~F.col("unproven_empty"))


def holdings_coverage(held: DataFrame, eligible: DataFrame, keys: list[str], code: str,
                      max_share: float = 0.2, min_missing: int = 3) -> DataFrame:
    """Per book: held stocks outside the model inputs; more than max(3, 20 %) fails, fewer are sold."""
    flagged = held.select(*keys, code).distinct().join(
        eligible.select(code).distinct().withColumn("_in", F.lit(1)), code, "left")
    out = flagged.groupBy(*keys).agg(
        F.count("*").alias("held"), F.count_if(F.col("_in").isNull()).alias("missing"))
    limit = F.greatest(F.lit(min_missing), F.floor(F.col("held") * max_share))
    return out.withColumn("failed", F.col("missing") > limit)


def to_liquidate(held: DataFrame, eligible: DataFrame, keys: list[str], code: str) -> DataFrame:
    return held.select(*keys, code).distinct().join(eligible.select(code).distinct(), code, "left_anti")


def target_contract(target: DataFrame, current: DataFrame, keys: list[str], turnover: float,
                    cash: float = 0.0, max_weight: float = 0.05, allow_short: bool = False) -> DataFrame:
    """Per book: validity of the final weights against the budget, turnover and weight limits.

    Sides are stacked and grouped by (book, code): duplicates show as counts
    and no join is needed.
    """
    c = F.col
    lay = lambda df, s, v: df.select(*keys, "code6", F.lit(s).alias("_s"), c(v).try_cast("double").alias("_w"))
    both = lay(target, 1, "position").unionByName(lay(current, 0, "weight"))
    per = both.groupBy(*keys, "code6").agg(
        F.count_if(c("_s") == 1).alias("_nt"), F.count_if(c("_s") == 0).alias("_nc"),
        F.count_if(~values.is_finite(c("_w"))).alias("_bad"),
        F.coalesce(F.sum(F.when(c("_s") == 1, c("_w"))), F.lit(0.0)).alias("t"),
        F.coalesce(F.sum(F.when(c("_s") == 0, c("_w"))), F.lit(0.0)).alias("w"))
    expected = max(0.0, 1.0 - cash)
    out = per.groupBy(*keys).agg(
        F.count_if((c("_nt") > 1) | (c("_nc") > 1)).alias("duplicates"),
        (F.sum("_bad") + F.count_if(c("code6").isNull())).alias("invalid"),
        F.sum("t").alias("target_sum"), F.sum(F.abs(c("t") - c("w"))).alias("turnover"),
        F.sum(F.abs("w")).alias("_gross"), F.count_if(c("t") < -1e-6).alias("shorts"),
        F.count_if(c("t") > F.greatest(F.lit(max_weight), c("w")) + 1e-6).alias("too_large"))
    limit = F.when(c("_gross") < 1e-8, F.lit(max(turnover, expected))).otherwise(F.lit(float(turnover)))
    short_ok = F.lit(True) if allow_short else (c("shorts") == 0) & (c("too_large") == 0)
    return out.withColumn("turnover_limit", limit).withColumn(
        "valid", (c("duplicates") == 0) & (c("invalid") == 0) & (F.abs(c("target_sum") - expected) <= 1e-5)
        & (c("turnover") <= c("turnover_limit") + 1e-5) & short_ok).drop("_gross")
