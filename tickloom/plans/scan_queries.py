"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import times, values
from tickloom.operators import calendar as cal
from tickloom.operators import factors
from tickloom.operators import panel as pan
from tickloom.plans.registry import query
from tickloom.plans.views import day, view
from tickloom.session import scratch_path
from tickloom.sources import archive, results, vendor
from tickloom.sources.hook import NamedFilesHook


def _archived(spark, sf, name="v_tick", kind="tick"):
    """The view written as a day-partitioned table and read back as a scan."""
    root = scratch_path(spark, "table")
    archive.write_partitioned(view(spark, sf, name), root, kind)
    return archive.scan(spark, root, kind)


@query("s1_day_scan", "v_tick", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, seq_num, current_price FROM v_tick
WHERE trade_date = DATE '2024-01-10'""")
def s1(spark, sf):
    rows = archive.load_day(_archived(spark, sf), "2024-01-10")
    return rows.select(day(), "code", "seq_num", "current_price")


@query("s2_code_scan", "v_deal", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, seq_num, volume FROM v_deal
WHERE code IN ('000003', '000007', '000041')""")
def s2(spark, sf):
    return archive.only_codes(view(spark, sf, "v_deal"), ["000003", "000007", "000041"]).select(
        day(), "code", "seq_num", "volume")


@query("s2_code_table_scan", "v_tick v_security", """
SELECT t.code, t.seq_num, t.current_price FROM v_tick t
WHERE t.code IN (SELECT id_qi FROM v_security WHERE industry = 'MACHINERY')""")
def s2_table(spark, sf):
    wanted = view(spark, sf, "v_security").where("industry = 'MACHINERY'").select(F.col("id_qi").alias("code"))
    return archive.only_codes(view(spark, sf, "v_tick"), wanted).select("code", "seq_num", "current_price")


@query("s3_range_scan", "v_deal", """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, count(*) AS n, CAST(sum(volume) AS DOUBLE) AS volume FROM v_deal
WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-06-01' GROUP BY 1, 2""")
def s3(spark, sf):
    rows = archive.load_range(view(spark, sf, "v_deal"), "1997-01-01", "1998-06-01")
    return rows.groupBy(day(), "code").agg(F.count("*").alias("n"), F.sum("volume").cast("double").alias("volume"))


@query("s4_last_days_scan", "v_daily", """
, d AS (SELECT DISTINCT trade_date FROM v_daily WHERE trade_date <= DATE '2024-01-20' ORDER BY 1 DESC LIMIT 5)
SELECT strftime(trade_date, '%Y%m%d') AS _date, id_qi, close FROM v_daily WHERE trade_date IN (SELECT trade_date FROM d)""")
def s4(spark, sf):
    rows = archive.load_last_days(view(spark, sf, "v_daily"), "2024-01-20", 5)
    return rows.select("_date", "id_qi", "close")


@query("s5_trading_calendar", "v_daily", """
, d AS (SELECT DISTINCT trade_date FROM v_daily)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, CAST(dense_rank() OVER (ORDER BY trade_date) AS INTEGER) AS ordinal,
       CAST(lag(trade_date) OVER (ORDER BY trade_date) AS VARCHAR) AS prev_date,
       CAST(lead(trade_date) OVER (ORDER BY trade_date) AS VARCHAR) AS next_date FROM d""")
def s5(spark, sf):
    days = cal.calendar(view(spark, sf, "v_daily"))
    return days.select(day(), "ordinal", *[F.col(c).cast("string").alias(c) for c in ("prev_date", "next_date")])


@query("s5_missing_weekdays", "v_deal", """
SELECT CAST(CAST(g.d AS DATE) AS VARCHAR) AS trade_date
FROM (SELECT unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY)) AS d FROM v_deal) g
WHERE dayofweek(g.d) BETWEEN 1 AND 5 AND CAST(g.d AS DATE) NOT IN (SELECT trade_date FROM v_deal)""")
def s5_weekdays(spark, sf):
    deals = view(spark, sf, "v_deal")
    span = deals.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    return cal.weekday_calendar(span).join(deals.select("trade_date").distinct(), "trade_date", "left_anti").select(day())


@query("s6_heavy_range_guard", "v_tick", """
SELECT 'tick' AS kind, count(DISTINCT trade_date) AS days, count(DISTINCT trade_date) > 1 AS refused FROM v_tick""")
def s6(spark, sf):
    ticks = view(spark, sf, "v_tick")
    try:
        archive.guard_days(ticks, "tick", 1)
        refused = False
    except ValueError:
        refused = True
    return cal.trading_days(ticks).agg(
        F.lit("tick").alias("kind"), F.count("*").alias("days"), F.lit(refused).alias("refused"))


@query("s7_time_range", "v_tick", """
SELECT code, seq_num, epoch_us(time) AS time_us FROM v_tick
WHERE time BETWEEN TIMESTAMP '2024-01-05 09:30:00' AND TIMESTAMP '2024-01-09 15:00:00'""")
def s7(spark, sf):
    rows = archive.load_time_range(view(spark, sf, "v_tick"), "2024-01-09 15:00:00", "2024-01-05 09:30:00")
    return rows.select("code", "seq_num", times.epoch_micros(F.col("time")).alias("time_us"))


def _factors(spark, sf):
    """Daily factor rows: one per stock and day."""
    daily = view(spark, sf, "v_daily")
    return daily.select(
        "trade_date", F.lit("150000").alias("end_time"), F.col("id_qi").alias("code"),
        (F.col("high") - F.col("low")).alias("F_range"), values.ratio(F.col("close"), F.col("open")).alias("F_drift"))


_FACTORS = """
, f AS (SELECT trade_date, '150000' AS end_time, id_qi AS code, high - low AS "F_range", CASE WHEN open > 0 THEN close / open END AS "F_drift" FROM v_daily)"""


@query("s8_result_reader", "v_daily", _FACTORS + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, "F_range" FROM f""")
def s8(spark, sf):
    path = scratch_path(spark, "results") + "/factors.csv"
    _factors(spark, sf).select(day(), "code", "F_range").write.option("header", "true").csv(path)
    schema = T.StructType([T.StructField("trade_date", T.StringType()), T.StructField("code", T.StringType()),
                           T.StructField("F_range", T.DoubleType())])
    return results.read_results(spark, path, schema=schema).select("trade_date", "code", "F_range")


_FILES = """
, n AS (SELECT strftime(trade_date, '%Y%m%d') AS file_date, CAST(CASE WHEN day(trade_date) % 3 = 0 OR seq_num % 4 = 0 THEN NULL ELSE seq_num % 4 END AS INTEGER) AS shard,
  CAST(CASE WHEN day(trade_date) % 3 = 0 OR seq_num % 4 = 0 THEN NULL ELSE seq_num % 2 END AS INTEGER) AS part, seq_num FROM v_tick)"""


def _result_files(spark, sf):
    """Result files on the shared folder: a merged file a day, and shards in parts on two days of three."""
    c, root = F.col, scratch_path(spark, "result-files")
    whole = (F.dayofmonth("trade_date") % 3 == 0) | (c("seq_num") % 4 == 0)
    shard = F.concat(F.lit("_s"), (c("seq_num") % 4).cast("string"), F.lit("_p"), (c("seq_num") % 2).cast("string"))
    rows = view(spark, sf, "v_tick").select("trade_date", F.when(whole, F.lit("")).otherwise(shard).alias("end_time"), "seq_num")
    factors.emit(rows, NamedFilesHook(root))
    return root


@query("s8_result_listing", "v_tick", _FILES + """
SELECT file_date, shard, part, count(*) AS rows FROM n GROUP BY 1, 2, 3""")
def s8_listing(spark, sf):
    root = _result_files(spark, sf)
    counted = results.list_results(results.read_results(spark, root)).select("_file", "rows")
    # Both sides name a file by its path; a scheme may be written with one slash or three.
    name = lambda: F.substring_index(F.col("_file"), "/", -1)
    files = results.list_files(spark, root).where("bytes > 0").withColumn("_name", name())
    return files.join(counted.withColumn("_name", name()).drop("_file"), "_name", "left").select(
        "file_date", "shard", "part", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))


@query("s9_shard_modes", "v_tick", _FILES + """
, d AS (SELECT *, max(CASE WHEN shard IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY file_date) AS sharded FROM n)
SELECT 'auto' AS mode, seq_num FROM d WHERE (shard IS NOT NULL) = (sharded = 1)
UNION ALL SELECT 'shards', seq_num FROM d WHERE shard IS NOT NULL UNION ALL SELECT 'full', seq_num FROM d WHERE shard IS NULL""")
def s9_modes(spark, sf):
    rows = results.read_results(spark, _result_files(spark, sf))
    auto, shards, full = (results.prefer_files(rows, m).select(F.lit(m).alias("mode"), "seq_num") for m in ("auto", "shards", "full"))
    return auto.unionByName(shards).unionByName(full)


@query("s9_json_results", "v_daily", _FACTORS + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, "F_range", "F_drift" FROM f""")
def s9(spark, sf):
    path = scratch_path(spark, "json")
    rows = _factors(spark, sf).select(day(), "code", "F_range", "F_drift")
    even = F.pmod(F.xxhash64("code"), F.lit(2)) == 0
    # Both payload forms: plain records, and objects that hold a list of them.
    rows.where(even).write.json(path + "/plain")
    names = ["trade_date", "code", "F_range", "F_drift"]
    rows.where(~even).select(F.array(F.struct(*names)).alias("records")).write.json(path + "/packed")
    record = T.StructType([T.StructField(n, T.StringType() if i < 2 else T.DoubleType()) for i, n in enumerate(names)])
    return results.read_json_results(spark, path, record, multi_line=False).select(*names)


@query("s9_variant_results", "v_daily", _FACTORS + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, CASE WHEN day(trade_date) % 2 = 0 THEN "F_range" END AS "F_range", CASE WHEN day(trade_date) % 2 = 1 THEN "F_drift" END AS "F_drift" FROM f""")
def s9_variant(spark, sf):
    """One file a day, as a list or as an object with records; odd and even days carry other fields."""
    path, c = scratch_path(spark, "json-variants"), F.col
    rows = _factors(spark, sf).select("trade_date", "code", "F_range", "F_drift")
    even = F.dayofmonth("trade_date") % 2 == 0
    record = F.to_json(F.struct(day(), "code", F.when(even, c("F_range")).alias("F_range"), F.when(~even, c("F_drift")).alias("F_drift")))
    listed = F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]"))
    # A day's stocks in one file: the vendor's form, bounded by the market.
    days = rows.groupBy("trade_date").agg(listed.alias("l")).select(
        c("trade_date").alias("_day"), F.when(F.dayofmonth("trade_date") % 3 == 0, F.concat(F.lit('{"records":'), c("l"), F.lit("}"))).otherwise(c("l")).alias("value"))
    days.repartition("_day").write.partitionBy("_day").text(path)
    got = results.read_json_variants(spark, path)
    field = lambda n, t: F.variant_get("record", f"$.{n}", t).alias(n)
    return got.select(field("trade_date", "string"), field("code", "string"), field("F_range", "double"), field("F_drift", "double"))


@query("s10_source_precedence", "v_daily v_tick", """
, old AS (SELECT trade_date, id_qi AS code, close AS v FROM v_daily WHERE trade_date < DATE '2024-01-15'),
live AS (SELECT trade_date, code, max(seq_num) AS v FROM v_tick WHERE trade_date >= DATE '2024-01-10' GROUP BY 1, 2)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, v, 'history' AS source FROM old
UNION ALL SELECT CAST(trade_date AS VARCHAR), code, CAST(v AS DOUBLE), 'live' FROM live
WHERE trade_date NOT IN (SELECT trade_date FROM old)""")
def s10(spark, sf):
    old = view(spark, sf, "v_daily").where("trade_date < DATE '2024-01-15'").select(
        "trade_date", F.col("id_qi").alias("code"), F.col("close").alias("v"))
    live = view(spark, sf, "v_tick").where("trade_date >= DATE '2024-01-10'").groupBy("trade_date", "code").agg(
        F.max("seq_num").cast("double").alias("v"))
    return results.prefer_source(old, live).select(day(), "code", "v", "source")


@query("s11_vendor_limits", "v_daily v_security", """
SELECT s.id_qi || '.' || s.exchange_cd AS code, CAST(d.trade_date AS VARCHAR) AS trade_date,
       floor(d.close * 110 + 0.5) / 100 AS high_limit, floor(d.close * 90 + 0.5) / 100 AS low_limit, d.close AS pre_close
FROM v_daily d JOIN v_security s USING (security_id)""")
def s11(spark, sf):
    table = view(spark, sf, "v_daily").join(view(spark, sf, "v_security").drop("id_qi"), "security_id").select(
        F.col("id_qi").alias("ticker_symbol"), "exchange_cd", "trade_date",
        (F.floor(F.col("close") * 110 + 0.5) / 100.0).alias("limit_up_price"),
        (F.floor(F.col("close") * 90 + 0.5) / 100.0).alias("limit_down_price"), F.col("close").alias("pre_close_price"))
    return vendor.limit_table(table).select("code", day(), "high_limit", "low_limit", "pre_close")


@query("s11_market_listed", "v_daily v_security", """
SELECT d.id_qi, s.exchange_cd, d.close FROM v_daily d JOIN v_security s USING (security_id)
WHERE d.trade_date = DATE '2024-01-10' AND s.exchange_cd = 'XSHG' AND s.asset_class = 'E' AND s.list_status_cd = 'L'""")
def s11_market(spark, sf):
    listed = vendor.listed_equities(view(spark, sf, "v_security")).select("security_id", "exchange_cd")
    market = view(spark, sf, "v_daily").join(listed, "security_id")
    return vendor.market_on(market, F.lit("2024-01-10").cast("date"), ["XSHG"]).select("id_qi", "exchange_cd", "close")


@query("s12_bad_lines", "v_raw_feed", """
SELECT count(*) AS lines, count(*) FILTER (WHERE msg_type = 'D') AS bad_lines FROM v_raw_feed""")
def s12_bad(spark, sf):
    path = scratch_path(spark, "messages")
    header = ["biz_index", "security_code", "msg_type", "qty"]
    cut = F.when(F.col("msg_type") == "D", F.concat_ws(",", *header[:2])).otherwise(F.concat_ws(",", *header))
    view(spark, sf, "v_raw_feed").select(cut.alias("value")).write.text(path)
    return vendor.message_line_counts(spark, path, header, titled=False)


@query("s12_message_csv", "v_raw_feed", """
SELECT CAST(biz_index AS VARCHAR) AS biz_index, security_code, msg_type, CAST(qty AS VARCHAR) AS qty FROM v_raw_feed""")
def s12(spark, sf):
    path = scratch_path(spark, "messages")
    header = ["biz_index", "security_code", "raw_time", "msg_type", "bs_flag", "qty"]
    view(spark, sf, "v_raw_feed").select(*header).write.option("header", "true").csv(path)
    return vendor.read_message_csv(spark, path, header, ["biz_index", "security_code", "msg_type", "qty"])


@query("s14_result_sink", "v_daily", _FACTORS + """
SELECT CAST(trade_date AS VARCHAR) AS trade_date, end_time, count(*) AS n FROM f GROUP BY 1, 2""")
def s14(spark, sf):
    root = scratch_path(spark, "sink")
    results.write_results(_factors(spark, sf), root, "minutes")
    back = spark.read.option("basePath", root + "/minutes-feature").schema(
        "code STRING, F_range FLOAT, F_drift FLOAT, trade_date DATE, end_time STRING").parquet(root + "/minutes-feature")
    return back.groupBy(day(), "end_time").agg(F.count("*").alias("n"))


@query("s14_text_sinks", "v_daily", _FACTORS + """
SELECT k.fmt, CAST(trade_date AS VARCHAR) AS trade_date, end_time, count(*) AS n, count("F_drift") AS filled FROM f CROSS JOIN (SELECT unnest(['csv', 'json']) AS fmt) k GROUP BY 1, 2, 3""")
def s14_text(spark, sf):
    root, rows = scratch_path(spark, "sink"), _factors(spark, sf)
    schema = "code STRING, F_range FLOAT, F_drift FLOAT, trade_date DATE, end_time STRING"
    out = []
    for fmt, category in (("csv", "daily"), ("json", "positions")):
        results.write_results(rows, root, category, fmt)
        back = spark.read.schema(schema).option("header", "true").format(fmt).load(f"{root}/{results.CATEGORIES[category]}")
        out.append(back.groupBy(F.lit(fmt).alias("fmt"), day(), "end_time").agg(F.count("*").alias("n"), F.count("F_drift").alias("filled")))
    return out[0].unionByName(out[1])


@query("s15_compact_floats", "v_deal", """
SELECT code, seq_num, channel, sale_order_id, buy_order_id, CAST(round_even(price * 1000000, 0) / 1000000 AS FLOAT) AS price FROM v_deal""")
def s15(spark, sf):
    return values.compact_floats(view(spark, sf, "v_deal").select(
        "code", "seq_num", "channel", "sale_order_id", "buy_order_id", "price"))


@query("s16_archive_sink", "v_deal", """
, r AS (SELECT *, row_number() OVER (PARTITION BY trade_date, code, seq_num
        ORDER BY time, buy_order_id, sale_order_id, money, volume, side) AS rn FROM v_deal)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, seq_num, money FROM r WHERE rn = 1""")
def s16(spark, sf):
    root = scratch_path(spark, "archive")
    order = ["time", "buy_order_id", "sale_order_id", "money", "volume", "side"]
    archive.write_archive(view(spark, sf, "v_deal"), root, "deal", order=order)
    return archive.scan(spark, root, "deal").select(day(), "code", "seq_num", "money")


@query("s17_shard_summary", "v_deal", """
SELECT count(DISTINCT trade_date) AS day_count, CAST(min(trade_date) AS VARCHAR) AS first_day,
       CAST(max(trade_date) AS VARCHAR) AS last_day, count(*) AS total_records, count(DISTINCT code) AS stock_count FROM v_deal""")
def s17(spark, sf):
    out = results.shard_summary(view(spark, sf, "v_deal"))
    return out.select("day_count", F.col("first_day").cast("string").alias("first_day"),
                      F.col("last_day").cast("string").alias("last_day"), "total_records", "stock_count")


@query("s18_shard_merge", "v_tick", """
, r AS (SELECT trade_date, code, seq_num, current_price,
               row_number() OVER (PARTITION BY trade_date, code ORDER BY seq_num DESC) AS rn FROM v_tick),
m AS (SELECT * FROM r WHERE rn = 1)
SELECT CAST(trade_date AS VARCHAR) AS trade_date, code, current_price AS "F_last",
       count(*) OVER (PARTITION BY trade_date) >= 130 AS passed FROM m""")
def s18(spark, sf):
    shards = view(spark, sf, "v_tick").select(
        "trade_date", "code", F.col("seq_num").alias("shard"), F.col("current_price").alias("F_last"))
    merged = results.merge_shards(shards, ["trade_date", "code"], ["shard"])
    gate = results.merge_gate(merged, min_rows=130, min_columns=1).select("trade_date", "passed")
    return merged.join(gate, "trade_date").select(day(), "code", "F_last", "passed")


@query("s19_audit_rows", "v_daily", """
, c AS (SELECT trade_date, count(*) AS n, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM v_daily GROUP BY 1)
SELECT CAST(c.trade_date AS VARCHAR) AS trade_date, CAST(c.prev AS VARCHAR) AS stale_from, count(*) AS count FROM c
JOIN v_daily p ON p.trade_date = c.prev
WHERE c.n < 135 AND NOT EXISTS (SELECT 1 FROM v_daily x WHERE x.trade_date = c.trade_date AND x.id_qi = p.id_qi)
GROUP BY 1, 2""")
def s19(spark, sf):
    path = scratch_path(spark, "audit")
    audit = pan.backfill_audit(view(spark, sf, "v_daily"), "id_qi", min_rows=135)
    results.write_audit(audit.select(day(), F.col("stale_from").cast("string").alias("stale_from"), "count"), path)
    return spark.read.schema("trade_date STRING, stale_from STRING, count BIGINT").json(path)
