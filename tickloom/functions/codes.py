"""Security-code columns: every spelling used by feeds, panels, brokers and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SH, SZ = "XSHG", "XSHE"


def zfill(text: Column, width: int = 6) -> Column:
    """Left-pad with zeros without cutting longer text (``lpad`` would cut)."""
    text = text.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def pad6(code: Column) -> Column:
    """Part before the first dot, zero-padded: the panel join key."""
    return zfill(F.substring_index(code.cast("string"), ".", 1))


def digits6(code: Column) -> Column:
    """Last six digits of the part before the first dot; null when there are none."""
    head = F.regexp_replace(F.substring_index(F.trim(code.cast("string")), ".", 1), r"\D", "")
    return F.when(F.length(head) > 0, zfill(F.right(head, F.lit(6))))


def key6(code: Column) -> Column:
    """Trade key: upper-case, known exchange suffix dropped, zero-padded."""
    bare = F.regexp_replace(F.upper(F.trim(code.cast("string"))), r"\.(XSHE|XSHG|SH|SZ)$", "")
    return zfill(bare)


def is_shanghai(code: Column) -> Column:
    return F.substring(code.cast("string"), 1, 1).isin("6", "9")


def exchange_of(code: Column) -> Column:
    return F.when(is_shanghai(zfill(code)), F.lit(SH)).otherwise(F.lit(SZ))


def full_code(raw: Column, market: Column | str | None = None) -> Column:
    """``1`` -> ``000001.XSHE``; the exchange follows the prefix unless given."""
    code = zfill(raw)
    if market is None:
        market = exchange_of(raw)
    elif isinstance(market, str):
        market = F.lit(market)
    return F.concat(code, F.lit("."), market)


def split_code(code: Column) -> Column:
    """struct(code, market); the market is null unless there is exactly one dot."""
    parts = F.split(code, r"\.")
    two = F.size(parts) == 2
    return F.struct(
        F.when(two, parts[0]).otherwise(code).alias("code"),
        F.when(two, parts[1]).alias("market"),
    )


def universe_symbol(code6: Column) -> Column:
    """``.SH`` / ``.BJ`` / ``.SZ`` form used by the trading universe."""
    first = F.substring(code6, 1, 1)
    suffix = F.when(first == "6", ".SH").when(first.isin("4", "8"), ".BJ").otherwise(".SZ")
    return F.concat(code6, suffix)


def prefixed_symbol(code6: Column) -> Column:
    """``SH600000`` / ``SZ000001`` form used by model order rows."""
    code = zfill(code6)
    return F.concat(F.when(F.substring(code, 1, 1) == "6", F.lit("SH")).otherwise(F.lit("SZ")), code)


def gateway_symbol(code: Column) -> Column:
    """Symbol an order carries; unknown spellings pass through upper-cased."""
    raw = F.upper(F.trim(F.coalesce(code.cast("string"), F.lit(""))))
    first = F.substring(raw, 1, 1)
    eight, six = F.length(raw) == 8, F.length(raw) == 6
    return (
        F.when(raw.endswith(".SH"), F.concat(F.substring(raw, 1, 6), F.lit(".SH")))
        .when(raw.endswith(".SZ"), F.concat(F.substring(raw, 1, 6), F.lit(".SZ")))
        .when(eight & raw.startswith("SH"), F.concat(F.substring(raw, 3, 6), F.lit(".SH")))
        .when(eight & raw.startswith("SZ"), F.concat(F.substring(raw, 3, 6), F.lit(".SZ")))
        .when(six & (first == "6"), F.concat(raw, F.lit(".SH")))
        .when(six & first.isin("0", "3"), F.concat(raw, F.lit(".SZ")))
        .otherwise(raw)
    )


def is_equity_feed_code(code6: Column, market: Column) -> Column:
    """Shares only: first digit 6/9 in Shanghai, 0/3 in Shenzhen."""
    first = F.substring(code6, 1, 1)
    return F.when(market == SH, first.isin("6", "9")).otherwise(first.isin("0", "3"))


def is_equity_or_index(raw: Column, market: Column) -> Column:
    """Shares and indexes; funds, bonds and repos are dropped."""
    code = F.ltrim(raw.cast("string"))
    sh = (F.length(code) >= 3) & code.rlike("^(6|9|000|880)")
    return F.when(market == SH, sh).otherwise(code.rlike("^[03]"))


def is_star_market(code6: Column) -> Column:
    """Board whose lots are 200 shares to open and single shares after."""
    return F.substring(code6, 1, 3).isin("688", "689")


# Spellings of the two order sides.
_BUY_WORDS = ("buy", "b", "long", "1", "23", "买", "买入")
_SELL_WORDS = ("sell", "s", "short", "2", "24", "卖", "卖出")


def order_side(value: Column) -> Column:
    """``buy`` / ``sell`` / empty text."""
    word = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(word.isin(*_BUY_WORDS), "buy").when(word.isin(*_SELL_WORDS), "sell").otherwise("")
