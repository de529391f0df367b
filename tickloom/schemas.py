"""Feed schemas, their header names, and fixed values.

Inside the engine columns are snake_case. ``HEADER`` gives the header name a
feed file or a result consumer expects, so a source or sink renames once at
the edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Book depth and the three per-level fields of the snapshot feed.
LEVELS = 10
LEVEL_FIELDS = ("price", "volume", "num")

# Side and order-type codes of the canonical tables.
SIDE_BUY, SIDE_SELL, SIDE_SPECIAL, SIDE_UNKNOWN = 0, 1, 4, 10
ORDER_ADD, ORDER_CANCEL = 2, 5

_ORDER = [
    ("trade_date", T.DateType()), ("code", T.StringType()),
    ("time", T.TimestampNTZType()), ("update_time", T.TimestampNTZType()),
    ("order_id", T.LongType()), ("side", T.ShortType()),
    ("price", T.DoubleType()), ("volume", T.DoubleType()),
    ("order_type", T.ShortType()), ("channel", T.LongType()), ("seq_num", T.LongType()),
]
_DEAL = [
    ("trade_date", T.DateType()), ("code", T.StringType()),
    ("time", T.TimestampNTZType()), ("update_time", T.TimestampNTZType()),
    ("sale_order_id", T.LongType()), ("buy_order_id", T.LongType()), ("side", T.ShortType()),
    ("price", T.DoubleType()), ("volume", T.DoubleType()), ("money", T.DoubleType()),
    ("channel", T.LongType()), ("seq_num", T.LongType()),
]
TICK_SCALARS = [
    "current_price", "total_volume", "total_money", "pre_close_price", "open_price",
    "highest_price", "lowest_price", "high_limit_price", "low_limit_price", "iopv",
    "trade_num", "total_bid_volume", "total_ask_volume", "avg_bid_price", "avg_ask_price",
]


def level_columns() -> list[str]:
    """Depth columns in header order: all ask fields, then all bid fields."""
    return [f"{side}_{field}{i}" for side in ("ask", "bid") for field in LEVEL_FIELDS
            for i in range(1, LEVELS + 1)]


_TICK = (
    [("trade_date", T.DateType()), ("code", T.StringType()),
     ("time", T.TimestampNTZType()), ("update_time", T.TimestampNTZType())]
    + [(name, T.DoubleType()) for name in TICK_SCALARS + level_columns()]
    + [("channel", T.LongType()), ("seq_num", T.LongType())]
)


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


ORDER = _struct(_ORDER)
DEAL = _struct(_DEAL)
TICK = _struct(_TICK)
FEEDS = {"order": ORDER, "deal": DEAL, "tick": TICK}

# Headers whose spelling does not follow from the engine name.
_IRREGULAR = {
    "trade_date": "TradingDay", "order_id": "OrderID", "sale_order_id": "SaleOrderID",
    "buy_order_id": "BuyOrderID", "iopv": "IOPV",
}


def header_name(column: str) -> str:
    """``ask_price1`` -> ``AskPrice1``."""
    if column in _IRREGULAR:
        return _IRREGULAR[column]
    return "".join(part[:1].upper() + part[1:] for part in column.split("_"))


HEADER = {name: header_name(name) for kind in FEEDS.values() for name in kind.fieldNames()}


def with_headers(df: DataFrame) -> DataFrame:
    """Engine names -> feed headers, for sinks."""
    return df.withColumnsRenamed({c: HEADER[c] for c in df.columns if c in HEADER})


def from_headers(df: DataFrame) -> DataFrame:
    """Feed headers -> engine names, for sources."""
    back = {header: name for name, header in HEADER.items()}
    return df.withColumnsRenamed({c: back[c] for c in df.columns if c in back})


def conform(df: DataFrame, kind: str) -> DataFrame:
    """Project to the canonical columns and types of a feed; absent columns are null."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in FEEDS[kind].fields
    ])


# Risk factor columns of the daily panel.
STYLE_COLUMNS = (
    "BETA", "MOMENTUM", "SIZE", "EARNYILD", "RESVOL",
    "GROWTH", "BTOP", "LEVERAGE", "LIQUIDTY", "SIZENL",
)
# Industry columns in use.
ACTIVE_INDUSTRY_COLUMNS = (
    "Agriculture", "Automobiles", "Banks", "BuildMater", "Computers", "Conglomerates",
    "ConstrDecor", "Defense", "Electronics", "FoodBeverages", "HealthCare",
    "HomeAppliances", "LightIndustry", "MachineEquip", "Media", "NonbankFinan",
    "NonferrousMetals", "RealEstate", "Steel", "Telecoms", "Transportation", "Utilities",
    "BasicChemicals", "BeautyCare", "Coal", "EnvironProtect", "Petroleum", "PowerEquip",
    "RetailTrade", "SocialServices", "TextileApparel",
)
# Retired industry columns, which must stay empty.
LEGACY_INDUSTRY_COLUMNS = (
    "Chemicals", "Commerce", "ElectricalEquip", "Leisure", "Mining", "TextileGarment",
)
