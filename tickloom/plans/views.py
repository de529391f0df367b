"""Stand-in market tables over the supplied tables, in SQL both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLES = ("events", "lineitem", "orders", "customer", "nation", "region", "part", "supplier")

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_DAY = "CAST(ts AS DATE)"
_CODE = "lpad(CAST(user_id AS STRING), 6, '0')"

VIEWS = {
    "v_tick": f"""
        SELECT {_DAY} AS trade_date, {_CODE} AS code, user_id + 100000 AS security_id, ts AS time,
               event_id AS seq_num, event_type,
               CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS current_price,
               CASE WHEN event_type = 'signup' THEN 0.0 ELSE value END AS pre_close_price,
               CASE WHEN event_type = 'view' THEN 0.0 ELSE value * 1.01 END AS ask_price1, value * 0.99 AS bid_price1,
               {_K} AS ask_volume1, 100 - {_K} AS bid_volume1, event_id AS total_volume, 10 * {_K} AS latency_ms
        FROM events""",
    "v_order": f"""
        SELECT {_DAY} AS trade_date, {_CODE} AS code, ts AS time, event_id AS seq_num, event_id AS order_id,
               value AS price, 1 + {_K} AS volume,
               CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 10 END AS side,
               CASE WHEN event_type = 'error' THEN 5 ELSE 2 END AS order_type, user_id % 4 AS channel
        FROM events""",
    "v_deal": """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date,
               lpad(CAST(l_orderkey % 50 AS STRING), 6, '0') AS code, l_shipdate AS time,
               l_orderkey * 8 + l_linenumber AS seq_num, l_suppkey AS sale_order_id, l_partkey AS buy_order_id,
               CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 10 END AS side,
               l_extendedprice / l_quantity AS price, l_quantity AS volume, l_extendedprice AS money,
               l_linenumber AS channel
        FROM lineitem""",
    "v_daily": f"""
        SELECT {_DAY} AS trade_date, {_CODE} AS id_qi, user_id + 100000 AS security_id,
               min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close,
               count(*) * 100 AS volume, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS amount_cents
        FROM events GROUP BY 1, 2, 3""",
    "v_security": """
        SELECT c_custkey + 100000 AS security_id, lpad(CAST(c_custkey AS STRING), 6, '0') AS id_qi,
               CASE WHEN c_custkey % 2 = 0 THEN 'XSHG' ELSE 'XSHE' END AS exchange_cd,
               CASE WHEN c_custkey % 17 = 0 THEN concat('*ST', CAST(c_custkey AS STRING))
                    ELSE concat('N', CAST(c_custkey AS STRING)) END AS sec_short_name,
               c_mktsegment AS industry, c_custkey AS party_id,
               CASE WHEN c_custkey % 23 = 0 THEN 'B' ELSE 'E' END AS asset_class,
               CASE WHEN c_custkey % 19 = 0 THEN 'DE' ELSE 'L' END AS list_status_cd
        FROM customer""",
    "v_idx_cons": """
        SELECT lpad(CAST(n_regionkey AS STRING), 6, '0') AS index_code,
               CASE WHEN n_nationkey % 2 = 0 THEN 'XSHG' ELSE 'XSHE' END AS index_exchange, c_custkey + 100000 AS cons_id,
               DATE '2024-01-01' + CAST(c_custkey % 20 AS INT) AS into_date,
               CASE WHEN c_custkey % 3 = 0 THEN DATE '2024-01-11' + CAST(c_custkey % 20 AS INT) ELSE NULL END AS out_date
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_free_shares": """
        SELECT o_custkey AS party_id, CAST(o_orderdate AS DATE) + 9900 AS change_date, o_orderkey AS tie,
               o_totalprice AS free_shares
        FROM orders""",
    # Holdings are customers with a positive balance; targets skip one segment.
    "v_position": """
        SELECT c_nationkey AS account_id, lpad(CAST(c_custkey AS STRING), 6, '0') AS code,
               CAST(floor(c_acctbal) AS BIGINT) AS current_volume,
               CAST(floor(c_acctbal) AS BIGINT) - CAST(floor(c_acctbal) AS BIGINT) % 7 AS available_volume
        FROM customer WHERE c_acctbal >= 1""",
    "v_account": """
        SELECT c_nationkey AS account_id, CAST(1000000 + c_nationkey * 50000 AS DOUBLE) AS total_asset,
               CAST(200000 AS DOUBLE) AS available_cash
        FROM customer GROUP BY 1""",
    "v_target": """
        SELECT c_nationkey AS account_id, lpad(CAST(c_custkey AS STRING), 6, '0') AS code,
               CAST(c_custkey % 5 AS DOUBLE) / 128 AS position
        FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "v_raw_feed": f"""
        SELECT event_id AS biz_index, CAST(user_id AS STRING) AS security_code,
               (9 + event_id % 6) * 10000000 + (event_id % 60) * 100000 + (event_id % 61) * 1000 + {_K} * 10 AS raw_time,
               CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'D' ELSE 'T' END AS msg_type,
               CASE event_type WHEN 'click' THEN 'B' WHEN 'view' THEN 'S' WHEN 'signup' THEN 'CLOSE' ELSE 'N' END AS bs_flag,
               CAST(floor(value * 1000 + 0.5) AS BIGINT) AS raw_price3, event_id * 2 AS buy_order_no,
               event_id * 2 + 1 AS sell_order_no, 1 + {_K} AS qty,
               CASE WHEN user_id % 2 = 0 THEN concat('6', lpad(CAST(user_id AS STRING), 5, '0'))
                    ELSE lpad(CAST(user_id AS STRING), 6, '0') END AS ticker, event_type, user_id
        FROM events""",
    "v_deal_ev": f"""
        SELECT {_DAY} AS trade_date, {_CODE} AS code, ts AS time, event_id AS seq_num, value AS price, 1 + {_K} AS volume,
               CAST(floor(value * 100 + 0.5) AS BIGINT) * (1 + {_K}) AS money_cents,
               CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS side
        FROM events WHERE event_type IN ('purchase', 'click')""",
    # Quotes: the newest close with a limit built on the close before it.
    "v_quote": f"""
        SELECT code, close AS price, floor(prev * 110 + 0.5) / 100 AS high_limit FROM (
            SELECT {_CODE} AS code, max_by(value, event_id) AS close,
                   max_by(CASE WHEN event_type = 'view' THEN value * 0.95 ELSE value END, event_id) AS prev
            FROM events GROUP BY 1) q""",
}

# Books whose stocks cover both lot rules, some without a realtime or broker price.
_BOOK = "CASE WHEN c_custkey < 200 THEN CAST(688000 + c_custkey AS STRING) ELSE lpad(CAST(c_custkey AS STRING), 6, '0') END"
VIEWS |= {
    "v_book_target": f"""
        SELECT c_nationkey AS account_id, {_BOOK} AS code, CAST(c_custkey % 5 AS DOUBLE) / 128 AS position, c_acctbal AS pred
        FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "v_book_position": f"""
        SELECT c_nationkey AS account_id, {_BOOK} AS code, CAST(floor(c_acctbal) AS BIGINT) AS current_volume,
               CAST(floor(c_acctbal) AS BIGINT) - CAST(floor(c_acctbal) AS BIGINT) % 7 AS available_volume,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE floor(c_acctbal / 64) / 4 + 1 END AS last_price
        FROM customer WHERE c_acctbal >= 1 AND c_nationkey <> 7""",
    "v_price": """
        SELECT code, price, CASE WHEN n % 5 = 0 THEN price WHEN n % 5 = 1 THEN 0.0 ELSE price * 1.1 END AS high_limit FROM (
            SELECT CASE WHEN o_custkey < 200 THEN CAST(688000 + o_custkey AS STRING) ELSE lpad(CAST(o_custkey AS STRING), 6, '0') END AS code,
                   floor(max(o_totalprice) / 4096) / 4 AS price, count(*) AS n
            FROM orders GROUP BY 1) q WHERE n >= 7""",
}

_NAME = re.compile(r"\b(" + "|".join(_TABLES) + r")\b")


def day() -> Column:
    """The trading day as text, the form every result carries."""
    return F.col("trade_date").cast("string").alias("trade_date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view as a lazy DataFrame over the tables in ``sf_dir``."""
    text = VIEWS[name]
    used = {m for m in _NAME.findall(re.split(r"\bFROM\b", text, maxsplit=1)[1])}
    body = re.sub(r"(\bFROM|\bJOIN)\s+(" + "|".join(_TABLES) + r")\b", r"\1 {\2}", text)
    return spark.sql(body, **{t: table(spark, sf_dir, t) for t in used})


def with_views(names: str, sql: str) -> str:
    """Prefix SQL with the views it uses; ``sql`` may go on with its own CTEs (leading comma)."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names.split()]
    if not parts:
        return sql.strip()
    return "WITH " + ", ".join(parts) + " " + sql.strip()
