"""Targets and positions -> order tables, for all accounts and days at once.

Every function takes the book keys (for example ``["account_id"]`` or
``["as_of", "account_id"]``) and works on keyed tables; nothing is looped per
account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import codes, values
from tickloom.operators.keyed import attach_totals
from tickloom.operators.universe import at_limit_up


def _positive(c: Column) -> Column:
    return F.when(values.is_finite(c) & (c > 0), c)


def _first_of(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that exists, as a number; gaps and absence are 0."""
    present = [n for n in names if n in df.columns]
    return F.coalesce(values.number(F.col(present[0])), F.lit(0.0)) if present else F.lit(0.0)


# Column spellings accepted from account and position sources.
VOLUME_NAMES = ["current_volume", "volume", "total_qty", "qty", "quantity", "position_volume"]
AVAILABLE_NAMES = ["available_volume", "available_qty", "available", "sellable_qty", "sellable_volume"]


def standardise_positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Position rows of either upstream spelling -> one set of columns."""
    null = F.lit(None).cast("double")

    def pick(names: list[str], default: Column = null) -> Column:
        present = [n for n in names if n in df.columns]
        return values.number(F.col(present[0])) if present else default

    whole = lambda c: F.floor(F.coalesce(c, F.lit(0.0))).cast("long")
    return df.select(
        *keys, codes.gateway_symbol(F.col("symbol")).alias("code"),
        whole(pick(["qty", "volume"])).alias("current_volume"),
        whole(pick(["available_qty", "available_volume"])).alias("available_volume"),
        pick(["avg_cost", "cost_price"]).alias("cost_price"), pick(["last_price"]).alias("last_price"),
        pick(["market_value"]).alias("market_value"), pick(["unrealized_pnl", "pnl"]).alias("pnl"),
    ).where(F.col("code") != "")


def standardise_account(df: DataFrame, keys: list[str]) -> DataFrame:
    """Account rows of either upstream spelling."""
    def pick(*names: str) -> Column:
        found = [F.col(n).try_cast("double") for n in names if n in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    return df.select(
        *keys, pick("total_asset", "AssetAmt").alias("total_asset"),
        pick("market_value", "MarketAmt").alias("market_value"),
        pick("available_cash", "EnBalance", "CrBalance").alias("available_cash"),
    )


def value_positions(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Fill missing or zero prices from quotes, then missing or zero market values."""
    missing = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) == 0
    quoted = positions.join(quotes.select("code", F.col("price").alias("_quote")), "code", "left")
    price = F.when(missing(F.col("last_price")), F.coalesce(_positive(F.col("_quote")), F.col("last_price"))).otherwise(
        F.col("last_price"))
    priced = quoted.withColumn("last_price", price)
    value = F.coalesce(F.col("last_price"), F.lit(0.0)) * F.col("current_volume")
    return priced.withColumn(
        "market_value", F.when(missing(F.col("market_value")), value).otherwise(F.col("market_value"))
    ).drop("_quote")


def value_accounts(account: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Account totals missing or zero take the summed position value; absent accounts appear."""
    totals = positions.groupBy(*keys).agg(F.sum(F.coalesce("market_value", F.lit(0.0))).alias("_held"))
    both = account.join(totals, keys, "full_outer")
    missing = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) == 0
    known = F.col("_held") > 0
    fill = lambda c: F.when(missing(c) & known, F.col("_held")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, fill("total_asset"), fill("market_value"),
                       F.coalesce("available_cash", F.lit(0.0)).alias("available_cash"))


def price_chain(wanted: DataFrame, realtime: DataFrame, broker: DataFrame | None = None,
                close: DataFrame | None = None, broker_keys: list[str] = ()) -> DataFrame:
    """First positive of realtime, broker and close price per wanted row.

    ``realtime`` and ``close`` are (code6, price); ``broker`` adds its keys.
    """
    out = wanted.join(realtime.select("code6", F.col("price").alias("_p1")), "code6", "left")
    sources = [F.col("_p1")]
    if broker is not None:
        out = out.join(broker.select(*broker_keys, "code6", F.col("price").alias("_p2")), [*broker_keys, "code6"], "left")
        sources.append(F.col("_p2"))
    if close is not None:
        out = out.join(close.select("code6", F.col("price").alias("_p3")), "code6", "left")
        sources.append(F.col("_p3"))
    return out.withColumn("price", F.coalesce(*[_positive(c) for c in sources])).drop("_p1", "_p2", "_p3")


def aggregate_positions(positions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per book and code: volume, available, value, highest usable broker price."""
    have = set(positions.columns)
    last = F.col("last_price").cast("double") if "last_price" in have else F.lit(None).cast("double")
    volume = _first_of(positions, VOLUME_NAMES)
    available = _first_of(positions, [*AVAILABLE_NAMES, *VOLUME_NAMES])
    return positions.select(
        *keys, codes.key6(F.col("code")).alias("code6"), volume.alias("_v"), available.alias("_a"),
        _positive(last).alias("_p"),
    ).groupBy(*keys, "code6").agg(
        F.sum("_v").alias("held_volume"), F.sum("_a").alias("available_volume"),
        F.sum(F.when(F.col("_p").isNotNull(), F.col("_v"))).alias("_priced_volume"),
        F.sum(F.col("_v") * F.col("_p")).alias("_broker_value"), F.max("_p").alias("broker_price"),
    )


def resolve_capital(account: DataFrame, keys: list[str], override: float | None = None) -> DataFrame:
    """Capital per book: the override, else the first positive account figure."""
    if override is not None and override > 0:
        return account.select(*keys, F.lit(float(override)).alias("capital"))
    named = [c for c in ("total_asset", "available_cash", "market_value") if c in account.columns]
    figures = [_positive(F.col(c).try_cast("double")) for c in named]
    return account.select(*keys, F.coalesce(*figures).alias("capital"))


def sized_orders(targets: DataFrame, positions: DataFrame, account: DataFrame, quotes: DataFrame,
                 keys: list[str], *, mode: str = "auto", close: DataFrame | None = None,
                 capital: float | None = None) -> DataFrame:
    """Orders that move each book from its holdings to its target weights, with ``blocked`` marked.

    * ``targets`` (keys, code, position), ``positions`` (keys, code, volumes),
      ``account`` (keys, total_asset, ...), ``quotes`` (code, price, high_limit).
    * Price: realtime, then broker, then ``close`` if given; unpriced targets
      trade nothing and are not exits.
    * Holdings outside the target list are sold in full.
    * Lots of 100; the 200-share board buys at least 200 in single shares.
    * Sells never exceed what is available; unheld buys at the limit are blocked.
    * ``auto`` trades the difference in books with positions and the plain
      weight in books without.
    """
    if mode not in ("auto", "delta", "absolute"):
        raise ValueError(f"mode must be auto, delta or absolute, got {mode!r}")
    c = F.col
    held = aggregate_positions(positions, keys)
    books = held.select(*keys).distinct().withColumn("_has_positions", F.lit(True))
    wanted = targets.withColumn("code6", codes.key6(c("code"))).select(
        *keys, "code6", F.coalesce(values.number(c("position")), F.lit(0.0)).alias("_target"),
        F.lit(True).alias("_is_target"))
    joined = wanted.join(held, [*keys, "code6"], "full_outer").join(books, keys, "left")
    live = quotes.select(codes.key6(c("code")).alias("code6"), _positive(c("price")).alias("_live"),
                         F.col("high_limit").alias("_limit") if "high_limit" in quotes.columns
                         else F.lit(None).cast("double").alias("_limit"))
    joined = joined.join(live, "code6", "left").join(resolve_capital(account, keys, capital), keys, "left")
    # A book without usable capital stops the job rather than trading nothing.
    no_capital = F.raise_error(F.lit("no positive capital for a book with targets or positions"))
    joined = joined.withColumn("capital", F.coalesce("capital", no_capital))
    if close is not None:
        joined = joined.join(close.select("code6", _positive(c("price")).alias("_close")), "code6", "left")
    else:
        joined = joined.withColumn("_close", F.lit(None).cast("double"))

    has_positions = F.coalesce("_has_positions", F.lit(False))
    use_delta = {"auto": has_positions, "delta": F.lit(True), "absolute": F.lit(False)}[mode]
    is_target = F.coalesce("_is_target", F.lit(False))
    # Holdings are valued at the realtime price, else at their own broker prices.
    held_value = F.coalesce(F.when(c("_live").isNotNull(), c("held_volume") * c("_live")), c("_broker_value"), F.lit(0.0))
    current = F.when(use_delta & has_positions, held_value / c("capital")).otherwise(F.lit(0.0))
    price = F.when(is_target, F.coalesce("_live", "broker_price", "_close")).otherwise(
        F.coalesce("_live", "broker_price"))
    available = F.coalesce("available_volume", F.lit(0))
    rows = joined.select(
        *keys, "code6", is_target.alias("_is_target"), F.coalesce("_target", F.lit(0.0)).alias("_weight"),
        current.alias("_current"), price.alias("price"), available.alias("_available"), "capital", "_limit",
        (F.coalesce("held_volume", F.lit(0)) > 0).alias("_held"),
        (use_delta & has_positions).alias("_capped"), c("held_volume").isNotNull().alias("_in_book"),
    ).where(c("_is_target") | (c("_capped") & (c("_available") > 0))).where(c("price").isNotNull())

    delta = c("_weight") - c("_current")
    star = codes.is_star_market(c("code6"))
    raw = c("capital") * F.abs("_delta") / c("price")
    board_lot = (F.floor(c("_raw") / 100) * 100).cast("long")
    single = F.floor("_raw").cast("long")
    buy = c("_delta") >= 0
    sized = F.when(star & buy, F.when(single < 200, F.lit(0)).otherwise(single)).when(star, single).otherwise(board_lot)
    sellable = F.when(star, F.floor("_available")).otherwise(F.floor(c("_available") / 100) * 100).cast("long")
    volume = (
        F.when(~c("_capped") | (c("_delta") >= 0), sized)
        .when(c("_weight") <= 0, F.greatest(sellable, F.lit(0)))
        .otherwise(F.least(sized, sellable))
    )
    orders = (
        rows.withColumn("_delta", delta).withColumn("_raw", raw).withColumn("volume", volume)
        .where((c("volume") > 0) & (c("_delta") != 0))
        .withColumn("side", F.when(c("_delta") > 0, "buy").otherwise("sell"))
    )
    blocked = (c("side") == "buy") & ~c("_held") & at_limit_up(c("price"), c("_limit"))
    return orders.select(*keys, c("code6").alias("code"), "side", "volume", "price", blocked.alias("blocked"))


def positions_to_orders(targets: DataFrame, positions: DataFrame, account: DataFrame, quotes: DataFrame,
                        keys: list[str], *, price_type: str = "latest", strategy: str = "open_position",
                        note: str = "", **sizing) -> DataFrame:
    """Order rows of every book; see ``sized_orders`` for the rules and options."""
    orders = sized_orders(targets, positions, account, quotes, keys, **sizing).where(~F.col("blocked"))
    return orders.select(*keys, "code", "side", "volume", F.lit(price_type).alias("price_type"), "price",
                         F.lit(strategy).alias("strategy"), F.lit(note).alias("note"))


def limit_up_buys(*args, **sizing) -> DataFrame:
    """Buys that the limit rule held back, for the report."""
    return sized_orders(*args, **sizing).where("blocked").drop("blocked")


def unpriced_targets(targets: DataFrame, positions: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Targets without a realtime or broker price, for the report."""
    broker = aggregate_positions(positions, keys).select(*keys, "code6", F.col("broker_price").alias("price"))
    wanted = targets.select(*keys, codes.key6(F.col("code")).alias("code6")).distinct()
    live = quotes.select(codes.key6(F.col("code")).alias("code6"), "price")
    return price_chain(wanted, live, broker, broker_keys=keys).where("price IS NULL").drop("price")


def redistribute_limit_up(targets: DataFrame, held: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Drop unheld targets confirmed at the limit; scale the rest to the old weight sum."""
    marked = targets.join(held.select(*keys, "code6").distinct().withColumn("_held", F.lit(1)), [*keys, "code6"], "left").join(
        quotes.select("code6", F.col("price").alias("_price"), F.col("high_limit").alias("_limit")), "code6", "left")
    dropped = F.col("_held").isNull() & at_limit_up(F.col("_price"), F.col("_limit"), 0.0)
    flagged = marked.withColumn("_dropped", dropped).withColumn(
        "position", F.coalesce(values.number(F.col("position")), F.lit(0.0)))
    totals = attach_totals(
        flagged, keys, ["code6"], _before=F.sum("position"),
        _after=F.sum(F.when(~F.col("_dropped"), F.col("position")).otherwise(0.0)))
    scaled = F.when((F.col("_before") != F.col("_after")) & (F.col("_after") > 0),
                    F.col("position") * (F.col("_before") / F.col("_after"))).otherwise(F.col("position"))
    return totals.where(~F.col("_dropped")).withColumn("position", scaled).select(*targets.columns)


def budget_check(orders: DataFrame, account: DataFrame, keys: list[str], reuse: float = 0.9) -> DataFrame:
    """Per book: bought and sold amounts, static budget, excess. Reports only; cuts nothing."""
    amount = lambda side: F.coalesce(
        F.sum(F.when(F.col("side") == side, F.col("volume") * F.col("price"))), F.lit(0.0))
    sums = orders.groupBy(*keys).agg(amount("buy").alias("buy_amount"), amount("sell").alias("sell_amount"))
    out = sums.join(account.select(*keys, "available_cash"), keys).withColumn(
        "budget", F.col("available_cash") + F.col("sell_amount") * reuse)
    return out.withColumn("excess", F.greatest(F.col("buy_amount") - F.col("budget"), F.lit(0.0))).withColumn(
        "over_budget", F.col("buy_amount") > F.col("budget"))


def invested_fraction(positions: DataFrame, account: DataFrame, keys: list[str]) -> DataFrame:
    """Share of total assets held in positions, per book."""
    sums = positions.groupBy(*keys).agg(F.sum("market_value").alias("held_value"), F.count("*").alias("holdings"))
    return sums.join(account.select(*keys, "total_asset"), keys).withColumn(
        "invested", values.ratio(F.col("held_value"), F.col("total_asset")))


def roll_paper_positions(targets: DataFrame, previous: DataFrame, close: DataFrame,
                         keys: list[str], capital: float) -> DataFrame:
    """Next paper book: targets in whole lots, plus unpriced leftovers of a lot or more."""
    both = targets.select(*keys, "code6", F.col("position").alias("_w")).join(
        previous.select(*keys, "code6", F.col("qty").alias("_qty"), F.col("last_price").alias("_last")),
        [*keys, "code6"], "full_outer",
    ).join(close.select("code6", F.col("price").alias("_close")), "code6", "left")
    price = F.coalesce("_close", F.lit(0.0))
    lots = (F.floor(F.col("_w") * capital / price / 100) * 100).cast("long")
    target = F.col("_w").isNotNull()
    leftover = ~target & (price <= 0) & (F.coalesce("_qty", F.lit(0)) >= 100)
    return both.where(target | leftover).select(
        *keys, F.col("code6").alias("code"), F.coalesce("_w", F.lit(0.0)).alias("weight"),
        F.when(target, price).otherwise(F.coalesce("_last", F.lit(0.0))).alias("last_price"),
        F.when(~target, F.floor("_qty").cast("long")).when(price > 0, lots).otherwise(F.lit(0)).alias("qty"),
    )


def safe_algo_params(text: Column) -> Column:
    """Parameter text without ``price=`` parts; unchanged when there are none."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(raw, r"[:;,&|]"), lambda p: F.trim(p)), lambda p: p != "")
    named_price = lambda p: p.contains("=") & (F.lower(F.trim(F.substring_index(p, "=", 1))) == "price")
    safe = F.filter(parts, lambda p: ~named_price(p))
    return F.when(F.size(safe) == F.size(parts), raw).otherwise(F.array_join(safe, ":"))


def gateway_orders(orders: DataFrame, date: Column, end_time: Column, mode: str, algo: str,
                   keys: list[str] = (), default_strategy: str = "default") -> DataFrame:
    """Outgoing order rows with an id that repeats for the same content.

    The id hashes date, slice, symbol, side, volume, mode, strategy, algorithm
    and parameters; the price is no part of it.
    """
    have = set(orders.columns)
    text = lambda n, default="": F.coalesce(F.col(n).cast("string"), F.lit(default)) if n in have else F.lit(default)
    symbol = codes.gateway_symbol(F.col("symbol") if "symbol" in have else F.col("code"))
    volume = F.coalesce(F.floor(F.col("volume").try_cast("double")), F.lit(0)).cast("long")
    rows = orders.select(
        *keys, symbol.alias("symbol"), codes.order_side(F.col("side")).alias("side"), volume.alias("volume"),
        F.when(text("strategy") != "", text("strategy")).otherwise(default_strategy).alias("strategy"),
        text("note").alias("_note"), safe_algo_params(text("algo_param")).alias("algo_param"),
        text("order_id").alias("_given"), date.alias("_date"), end_time.alias("_end"),
    ).where((F.col("symbol") != "") & (F.col("volume") > 0) & (F.col("side") != ""))
    content = F.concat_ws(
        "|", "_date", "_end", "symbol", "side", F.col("volume").cast("string"), F.lit(mode), "strategy",
        F.lit(algo), "algo_param")
    made = F.concat(F.col("strategy"), F.lit("_"), F.substring(F.md5(content), 1, 12))
    note = F.concat_ws("_", "strategy", F.concat("_date", "_end"), "symbol", "side")
    return rows.select(
        *keys, F.when(F.col("_given") != "", F.col("_given")).otherwise(made).alias("order_id"),
        "symbol", "side", "volume", "strategy",
        F.when(F.col("_note") != "", F.col("_note")).otherwise(note).alias("note"),
        "algo_param", F.lit(algo).alias("algo_strategy"),
    )


def normalise_orders(df: DataFrame) -> DataFrame:
    """Side words and volume spellings -> (side, volume); unreadable volume is zero."""
    names = [n for n in ("order_volume", "volume", "qty", "quantity") if n in df.columns]
    raw = F.coalesce(*[F.col(n).cast("string") for n in names])
    volume = F.coalesce(raw.try_cast("double"), F.lit(0.0))
    toward_zero = F.when(volume >= 0, F.floor(volume)).otherwise(F.ceil(volume)).cast("long")
    side = F.col("side") if "side" in df.columns else F.col("action")
    return df.withColumns({"order_side": codes.order_side(side), "order_volume": toward_zero})


def flatten_all(positions: DataFrame, keys: list[str], strategy: str = "one_time_close") -> DataFrame:
    """Sell every available share of every holding."""
    return positions.where(F.col("available_volume") > 0).select(
        *keys, "code", F.lit("sell").alias("side"), F.col("available_volume").cast("long").alias("volume"),
        F.lit("latest").alias("price_type"), F.lit(strategy).alias("strategy"))


def deal_latency(pushed: DataFrame, deals: DataFrame, feed_latency: DataFrame, keys: list[str],
                 compute_seconds: float = 6.0) -> DataFrame:
    """Market-data-to-deal time of pushed orders, per book.

    The market moment is push time less compute time less the stock's own feed
    latency (one second when unknown); totals outside (0, 180) s are ignored.
    """
    usable = feed_latency.where((F.col("latency_ms") > 100) & (F.col("latency_ms") < 60_000)).groupBy("code6").agg(
        F.max("latency_ms").alias("_ms"))
    joined = deals.join(pushed.select(*keys, "code6", "push_sec").distinct(), [*keys, "code6"]).join(usable, "code6", "left")
    market = F.col("push_sec") - compute_seconds - F.coalesce("_ms", F.lit(1000)) / 1000.0
    timed = joined.withColumn("latency", F.col("deal_sec") - market).where("latency > 0 AND latency < 180")
    # One sample per stock: its last deal.
    last = timed.groupBy(*keys, "code6").agg(F.max_by("latency", "deal_sec").alias("latency"))
    return last.groupBy(*keys).agg(
        F.count("*").alias("deals"), F.sum("latency").alias("total_latency"),
        F.max("latency").alias("max_latency"), F.avg("latency").alias("avg_latency"))


def limit_prices(daily: DataFrame, tick: DataFrame, keys: list[str] = ["code"]) -> DataFrame:
    """Published daily limits; snapshot limits fill only what is missing."""
    d = daily.select(*keys, F.col("high_limit").alias("_dh"), F.col("low_limit").alias("_dl"))
    t = tick.select(*keys, F.col("high_limit").alias("_th"), F.col("low_limit").alias("_tl"))
    pick = lambda a, b: F.coalesce(_positive(F.col(a)), F.col(b), F.lit(0.0))
    out = d.join(t, keys, "full_outer").select(*keys, pick("_dh", "_th").alias("high_limit"), pick("_dl", "_tl").alias("low_limit"))
    return out.where((F.col("high_limit") > 0) | (F.col("low_limit") > 0))


def fallback_limits(df: DataFrame, pre_close: str = "pre_close", band: float = 0.10) -> DataFrame:
    """Ten per cent either side of the previous close where no limit is published."""
    edge = lambda c, sign: F.coalesce(
        _positive(F.col(c)),
        F.when(F.col(pre_close) > 0, F.floor(F.col(pre_close) * (1 + sign * band) * 100 + 0.5) / 100.0), F.lit(0.0))
    return df.withColumns({"high_limit": edge("high_limit", 1), "low_limit": edge("low_limit", -1)})
