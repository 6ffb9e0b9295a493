"""

Every query reads the driver's parquet tables (or views Spark derives from
them) in full.  Result columns are aliased identically on both sides;
integers are BIGINT, doubles are rounded where two engines may sum in a
different order, and timestamps are rendered as text so both engines
produce the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions import math as fm
from tablesmith.functions import pii as pii_fn
from tablesmith.functions import text as tf
from tablesmith.functions.pii import PII_PATTERNS
from tablesmith.functions.types import ROW_ID
from tablesmith.operators import (dedup, expr, extras, missing, outliers, pii, preview, profile,
                                  reshape, text)
from tablesmith.operators.rowid import with_row_id
from tablesmith.session import scratch_path
from tablesmith.sources import readers, store, writers

SF_SMOKE = "/root/testdata/sf0.001"

# ---------------------------------------------------------------------------
# Inputs


def _table(spark: SparkSession, sf: str, name: str, key: str | None = None) -> DataFrame:
    return readers.load(spark, f"{sf}/{name}.parquet", row_id_key=key)


def dirty_orders(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 7 == 0, None).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 5 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 11 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        "o_orderstatus", "o_orderdate", ROW_ID)


def dup_orders(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return with_row_id(o.unionByName(o.where(F.col("o_orderkey") % 10 == 0)))


def dirty_customer(spark, sf):
    c = _table(spark, sf, "customer", "c_custkey")
    k = F.col("c_custkey")
    key_txt = k.cast("string")
    return c.select(
        "c_custkey",
        F.when(k % 3 == 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 9 == 0, None)
         .when(k % 4 == 0, F.concat(F.lit("user"), key_txt, F.lit(" at mail")))
         .otherwise(F.concat(F.lit("user"), key_txt, F.lit("@mail.example.com"))).alias("email"),
        F.when(k % 8 == 0, None)
         .when(k % 2 == 0, F.concat(F.lit("(919) 555-"), F.lpad((k % 10000).cast("string"), 4, "0")))
         .otherwise(F.concat(F.lit("1919555"), F.lpad((k % 10000).cast("string"), 4, "0"))).alias("phone"),
        F.concat(F.lower("c_mktsegment"), F.lit("-"), "c_mktsegment", F.lit(" o'neil")).alias("segment"),
        "c_acctbal", "c_nationkey", ROW_ID)


def gappy_events(spark, sf):
    e = _table(spark, sf, "events", "event_id")
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.when(F.col("event_id") % 4 != 0, None).otherwise(F.col("value")).alias("value"), ROW_ID)


DIRTY_ORDERS_SQL = """dirty_orders AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  o_orderstatus, o_orderdate FROM orders)"""
DUP_ORDERS_SQL = """dup_orders AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0)"""
DIRTY_CUSTOMER_SQL = """dirty_customer AS (SELECT c_custkey,
  CASE WHEN c_custkey % 3 = 0 THEN concat('  ', c_name, ' ') ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 9 = 0 THEN NULL
       WHEN c_custkey % 4 = 0 THEN concat('user', CAST(c_custkey AS VARCHAR), ' at mail')
       ELSE concat('user', CAST(c_custkey AS VARCHAR), '@mail.example.com') END AS email,
  CASE WHEN c_custkey % 8 = 0 THEN NULL
       WHEN c_custkey % 2 = 0 THEN concat('(919) 555-', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'))
       ELSE concat('1919555', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) END AS phone,
  concat(lower(c_mktsegment), '-', c_mktsegment, ' o''neil') AS segment,
  c_acctbal, c_nationkey FROM customer)"""
GAPPY_EVENTS_SQL = """gappy_events AS (SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id % 4 <> 0 THEN NULL ELSE value END AS value FROM events)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _ts(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def _ts_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}"


def _big(c: str):
    return F.col(c).cast("bigint").alias(c)


def _r(c: str, n: int, name: str | None = None):
    return F.round(F.col(c), n).alias(name or c)


def _dirty_orders_out(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus",
                     _ts("o_orderdate"))


DIRTY_ORDERS_COLS_SQL = ("o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus, "
                         + _ts_sql("o_orderdate"))
ORDERS_COLS_SQL = ("o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
                   + _ts_sql("o_orderdate") + ", o_orderpriority")


def _orders_out(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", _ts("o_orderdate"),
                     "o_orderpriority")


def _customer_out(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", "c_name", "email", "phone", "segment", "c_acctbal", _big("c_nationkey"))


CUSTOMER_COLS_SQL = "c_custkey, c_name, email, phone, segment, c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey"


# ---------------------------------------------------------------------------
# Flagship


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    li = _table(spark, sf, "lineitem")
    li = expr.calculated_column(li, "revenue", "l_extendedprice * (1 - l_discount)")
    out = reshape.group_by(li, ["l_returnflag", "l_linestatus"], "revenue", "sum")
    return out.select("l_returnflag", "l_linestatus", _r("revenue", 4))


def entry(spark: SparkSession) -> DataFrame:
    return flagship(spark, SF_SMOKE)


# ---------------------------------------------------------------------------
# Queries

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


query("flagship_revenue", """SELECT l_returnflag, l_linestatus,
  round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0), 4) AS revenue
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
GROUP BY l_returnflag, l_linestatus""")(flagship)


# --- 2.1 sources and sinks ---------------------------------------------------

@query("read_parquet", f"SELECT {ORDERS_COLS_SQL} FROM orders")
def q_read_parquet(spark, sf):
    return _orders_out(readers.read_parquet(spark, f"{sf}/orders.parquet"))


@query("load_info", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def q_load_info(spark, sf):
    return readers.load_info(_table(spark, sf, "lineitem"))


@query("read_csv_roundtrip", _with(DIRTY_CUSTOMER_SQL) + f"SELECT {CUSTOMER_COLS_SQL} FROM dirty_customer")
def q_read_csv(spark, sf):
    path = scratch_path(spark, "csv") + "/customer.csv"
    writers.write_csv(dirty_customer(spark, sf).drop(ROW_ID), path)
    return _customer_out(readers.read_csv(spark, path))


@query("read_csv_quoted_newlines", """SELECT conv_id, turn, role, 'first "line"' || chr(10) || ', ' || turn || chr(10) AS note
FROM conversations""")
def q_read_csv_quoted(spark, sf):
    path = scratch_path(spark, "csv") + "/notes.csv"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", F.concat(
        F.lit('first "line"\n, '), F.col("turn").cast("string"), F.lit("\n")).alias("note"))
    rows.write.option("header", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(spark, path).select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "note")


@query("read_tsv_roundtrip", _with(DIRTY_ORDERS_SQL) + """SELECT o_orderkey, o_custkey, o_totalprice,
  o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') AS o_orderdate FROM dirty_orders""")
def q_read_tsv(spark, sf):
    path = scratch_path(spark, "tsv") + "/orders.tsv"
    df = dirty_orders(spark, sf).drop(ROW_ID)
    writers.write_tsv(df, path)
    return readers.read_tsv(spark, path).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
                                                "o_orderstatus", "o_orderdate")


@query("read_txt_roundtrip", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, "
       "p_retailprice FROM part")
def q_read_txt(spark, sf):
    path = scratch_path(spark, "txt") + "/part.txt"
    part = spark.read.parquet(f"{sf}/part.parquet")
    writers.write_delimited(part, path, "|")
    return readers.read_txt(spark, path, sep="|").select("p_partkey", "p_name", "p_brand", "p_type",
                                                        "p_size", "p_retailprice")


@query("read_json_roundtrip", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ts, user_id,
  event_type, value, props FROM events""")
def q_read_json(spark, sf):
    path = scratch_path(spark, "json") + "/events.json"
    writers.write_json(spark.read.parquet(f"{sf}/events.parquet"), path)
    return readers.read_json_lines(spark, path).select("event_id", "ts", "user_id", "event_type", "value", "props")


PHONE_RE2 = tf.PHONE_PATTERN.removeprefix("(?U)")  # RE2 has no such flag


@query("export_csv_phone", _with(DIRTY_CUSTOMER_SQL) + f"""SELECT c_custkey, c_name, email,
  nullif(regexp_replace(coalesce(phone, ''), '{PHONE_RE2}', '1(\\1)\\2-\\3', 'g'), '') AS phone,
  segment, c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM dirty_customer""")
def q_export_csv(spark, sf):
    base = scratch_path(spark, "export") + "/customers"
    path = writers.export(dirty_customer(spark, sf), base, "csv")
    return _customer_out(readers.read_csv(spark, path))


@query("export_parquet_roundtrip", f"SELECT {ORDERS_COLS_SQL} FROM orders")
def q_export_parquet(spark, sf):
    base = scratch_path(spark, "export") + "/orders.data"
    path = writers.export(_table(spark, sf, "orders", "o_orderkey"), base, "parquet")
    return _orders_out(readers.read_parquet(spark, path))


# --- 2.2 preview ---------------------------------------------------------------

EVENTS_FILTER = '(?:purchase|"k": 1[0-9])'
EVENTS_FILTER_RE2 = '(?:purchase|"k": 1[0-9])'


@query("global_filter_events", f"""SELECT event_id, {_ts_sql('ts')}, user_id, event_type, value, props FROM events
WHERE regexp_matches(CAST(event_id AS VARCHAR), '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
        ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END, '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(CAST(user_id AS VARCHAR), '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(event_type, '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(CAST(value AS VARCHAR), '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(props, '{EVENTS_FILTER_RE2}', 'i')""")
def q_global_filter(spark, sf):
    e = _table(spark, sf, "events", "event_id")
    return preview.global_filter(e, EVENTS_FILTER).select("event_id", _ts("ts"), "user_id", "event_type",
                                                          "value", "props")


@query("count_matching", f"""SELECT CAST(count(*) AS BIGINT) AS total_records FROM events
WHERE regexp_matches(event_type, '{EVENTS_FILTER_RE2}', 'i') OR regexp_matches(props, '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(CAST(event_id AS VARCHAR), '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
        ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END, '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(CAST(user_id AS VARCHAR), '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(CAST(value AS VARCHAR), '{EVENTS_FILTER_RE2}', 'i')""")
def q_count_matching(spark, sf):
    e = _table(spark, sf, "events", "event_id")
    n = preview.count_matching(preview.global_filter(e, EVENTS_FILTER))
    return spark.createDataFrame([(n,)], "total_records bigint")


@query("column_filter_orders", f"""SELECT {ORDERS_COLS_SQL} FROM orders
WHERE contains(lower(o_orderpriority), 'urgent') AND contains(lower(o_orderstatus), 'f')""")
def q_column_filter(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    return _orders_out(preview.column_filter(o, {"o_orderpriority": "URGENT", "o_orderstatus": "f"}))


@query("sort_view_nulls_last", _with(DIRTY_ORDERS_SQL) + f"SELECT {DIRTY_ORDERS_COLS_SQL} FROM dirty_orders")
def q_sort_view(spark, sf):
    return _dirty_orders_out(preview.sort_view(dirty_orders(spark, sf), "o_totalprice", "desc"))


@query("page_orders", _with(DIRTY_ORDERS_SQL) + f"""SELECT {DIRTY_ORDERS_COLS_SQL} FROM dirty_orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100""")
def q_page(spark, sf):
    return _dirty_orders_out(preview.page(dirty_orders(spark, sf), 3, 50, "o_totalprice", "desc"))


@query("page_orders_deep", _with(DIRTY_ORDERS_SQL) + f"""SELECT {DIRTY_ORDERS_COLS_SQL} FROM dirty_orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 12450""")
def q_page_deep(spark, sf):
    return _dirty_orders_out(preview.page(dirty_orders(spark, sf), 250, 50, "o_totalprice", "desc"))


@query("range_filter", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_extendedprice BETWEEN 20000 AND 20500.5""")
def q_range_filter(spark, sf):
    rows = readers.load(spark, f"{sf}/lineitem.parquet")
    return preview.range_filter(rows, "l_extendedprice", 20000, 20500.5).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("preview_orders", _with(DIRTY_ORDERS_SQL) + f"""SELECT o_orderkey AS original_index,
  {DIRTY_ORDERS_COLS_SQL} FROM dirty_orders
WHERE regexp_matches(o_orderpriority, '1-urgent', 'i') OR regexp_matches(o_orderstatus, '1-urgent', 'i')
   OR regexp_matches(CAST(o_orderkey AS VARCHAR), '1-urgent', 'i')
ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50""")
def q_preview(spark, sf):
    d = dirty_orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
                                        "o_orderstatus", _ts("o_orderdate"), ROW_ID)
    return preview.preview(d, page_no=2, limit=50, sort_by="o_totalprice", sort_order="asc",
                           filter_val="1-urgent")


@query("edit_cell", f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_ts_sql('o_orderdate')},
  CASE WHEN o_orderkey = 7 THEN 'EDITED' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def q_edit_cell(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    return _orders_out(preview.edit_cell(o, 7, "o_orderpriority", "EDITED"))


@query("apply_edits", f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_ts_sql('o_orderdate')},
  CASE WHEN o_orderstatus = 'P' THEN 'REVIEW' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def q_apply_edits(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    edits = o.where(F.col("o_orderstatus") == "P").select(ROW_ID, F.lit("REVIEW").alias("o_orderpriority"))
    return _orders_out(preview.apply_edits(o, edits))


@query("apply_cell_edits", f"""SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 10 = 3 THEN 1.5 ELSE o_totalprice END AS o_totalprice, {_ts_sql('o_orderdate')},
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 10 = 3 THEN 'SECOND' ELSE o_orderpriority END AS o_orderpriority
FROM orders""")
def q_apply_cell_edits(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    third = o.where(F.col("o_orderkey") % 10 == 3).select(ROW_ID, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(v).alias("value"), F.lit(n).alias("edit_no"))
        for n, (c, v) in enumerate([("o_orderpriority", "FIRST"), ("o_orderpriority", "SECOND"), ("o_totalprice", "1.5")])
    ])).alias("e")).select(ROW_ID, "e.*")
    emptied = o.where("o_orderstatus = 'P'").select(ROW_ID, F.lit("o_orderpriority").alias("column"),
                                                    F.lit(None).cast("string").alias("value"), F.lit(9).alias("edit_no"))
    return _orders_out(preview.apply_cell_edits(o, third.unionByName(emptied)))


@query("title_labels", """SELECT c_custkey AS "C Custkey", c_name AS "C Name",
  CAST(c_nationkey AS BIGINT) AS "C Nationkey", c_acctbal AS "C Acctbal", c_mktsegment AS "C Mktsegment"
FROM customer""")
def q_title_labels(spark, sf):
    c = preview.title_labels(_table(spark, sf, "customer", "c_custkey")).drop(ROW_ID)
    return c.withColumn("C Nationkey", F.col("`C Nationkey`").cast("bigint"))


@query("table_summary", """SELECT * FROM (VALUES
  (0, 'o_orderkey', (SELECT count(o_orderkey) FROM orders), 'bigint'),
  (1, 'o_custkey', (SELECT count(o_custkey) FROM orders), 'bigint'),
  (2, 'o_orderstatus', (SELECT count(o_orderstatus) FROM orders), 'string'),
  (3, 'o_totalprice', (SELECT count(o_totalprice) FROM orders), 'double'),
  (4, 'o_orderdate', (SELECT count(o_orderdate) FROM orders), 'timestamp_ntz'),
  (5, 'o_orderpriority', (SELECT count(o_orderpriority) FROM orders), 'string'))
  AS t(position, "column", non_null, dtype)""")
def q_table_summary(spark, sf):
    s = preview.table_summary(_table(spark, sf, "orders", "o_orderkey"))
    return s.select(F.col("position").cast("int"), "column", F.col("non_null").cast("bigint"), "dtype")


# --- 2.3 missing values ---------------------------------------------------------

@query("drop_missing", _with(DIRTY_ORDERS_SQL) + f"""SELECT {DIRTY_ORDERS_COLS_SQL} FROM dirty_orders
WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL""")
def q_drop_missing(spark, sf):
    return _dirty_orders_out(missing.drop_missing(dirty_orders(spark, sf), ["o_custkey", "o_totalprice"]))


@query("drop_missing_all", _with(DIRTY_ORDERS_SQL) + f"""SELECT {DIRTY_ORDERS_COLS_SQL} FROM dirty_orders
WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL
  AND o_orderstatus IS NOT NULL AND o_orderdate IS NOT NULL""")
def q_drop_missing_all(spark, sf):
    return _dirty_orders_out(missing.drop_missing(dirty_orders(spark, sf)))


@query("fill_mean", _with(DIRTY_ORDERS_SQL) + """SELECT o_orderkey,
  round(coalesce(CAST(o_custkey AS DOUBLE), (SELECT avg(o_custkey) FROM dirty_orders)), 4) AS o_custkey,
  round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM dirty_orders)), 4) AS o_totalprice
FROM dirty_orders""")
def q_fill_mean(spark, sf):
    d = missing.fill_mean(dirty_orders(spark, sf), ["o_custkey", "o_totalprice", "o_orderpriority"])
    return d.select("o_orderkey", _r("o_custkey", 4), _r("o_totalprice", 4))


@query("fill_median", _with(DIRTY_ORDERS_SQL) + """SELECT o_orderkey,
  round(coalesce(CAST(o_custkey AS DOUBLE), (SELECT quantile_cont(o_custkey, 0.5) FROM dirty_orders)), 4) AS o_custkey,
  round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM dirty_orders)), 4) AS o_totalprice
FROM dirty_orders""")
def q_fill_median(spark, sf):
    d = missing.fill_median(dirty_orders(spark, sf), ["o_custkey", "o_totalprice"])
    return d.select("o_orderkey", _r("o_custkey", 4), _r("o_totalprice", 4))


@query("fill_value", _with(DIRTY_ORDERS_SQL) + f"""SELECT o_orderkey, o_custkey, o_totalprice,
  coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority, o_orderstatus, {_ts_sql('o_orderdate')} FROM dirty_orders""")
def q_fill_value(spark, sf):
    return _dirty_orders_out(missing.fill_value(dirty_orders(spark, sf), "UNKNOWN"))


@query("fill_value_numeric", _with(DIRTY_ORDERS_SQL) + f"""SELECT o_orderkey, coalesce(o_custkey, 0) AS o_custkey,
  coalesce(o_totalprice, 0.0) AS o_totalprice, coalesce(o_orderpriority, '0') AS o_orderpriority,
  o_orderstatus, {_ts_sql('o_orderdate')} FROM dirty_orders""")
def q_fill_value_numeric(spark, sf):
    d = missing.fill_value(dirty_orders(spark, sf), "0", ["o_custkey", "o_totalprice", "o_orderpriority"])
    return _dirty_orders_out(d)


GAPPY_OUT_SQL = f"event_id, {_ts_sql('ts')}, user_id, event_type"


def _gappy_out(df):
    return df.select("event_id", _ts("ts"), "user_id", "event_type", "value")


@query("forward_fill", _with(GAPPY_EVENTS_SQL) + f"""SELECT {GAPPY_OUT_SQL},
  last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM gappy_events""")
def q_forward_fill(spark, sf):
    return _gappy_out(missing.forward_fill(gappy_events(spark, sf), ["value"], order_by="event_id"))


@query("forward_fill_blocks", _with(GAPPY_EVENTS_SQL) + f"""SELECT {GAPPY_OUT_SQL},
  last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM gappy_events""")
def q_forward_fill_blocks(spark, sf):
    # Same answer through many small blocks (the plan used at scale).
    return _gappy_out(missing.forward_fill(gappy_events(spark, sf), ["value"], order_by="event_id",
                                           rows_per_block=256))


@query("forward_fill_by_user", _with(GAPPY_EVENTS_SQL) + f"""SELECT {GAPPY_OUT_SQL},
  last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM gappy_events""")
def q_forward_fill_by_user(spark, sf):
    return _gappy_out(missing.forward_fill(gappy_events(spark, sf), ["value"], order_by="event_id",
                                           partition_by=["user_id"], rows_per_block=512))


@query("backward_fill", _with(GAPPY_EVENTS_SQL) + f"""SELECT {GAPPY_OUT_SQL},
  first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
FROM gappy_events""")
def q_backward_fill(spark, sf):
    return _gappy_out(missing.backward_fill(gappy_events(spark, sf), ["value"], order_by="event_id",
                                            rows_per_block=256))


@query("fill_mode", _with(DIRTY_ORDERS_SQL) + f"""SELECT o_orderkey,
  coalesce(o_custkey, (SELECT o_custkey FROM dirty_orders WHERE o_custkey IS NOT NULL
                       GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1)) AS o_custkey,
  o_totalprice,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM dirty_orders WHERE o_orderpriority IS NOT NULL
                       GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority,
  o_orderstatus, {_ts_sql('o_orderdate')} FROM dirty_orders""")
def q_fill_mode(spark, sf):
    return _dirty_orders_out(missing.fill_mode(dirty_orders(spark, sf), ["o_custkey", "o_orderpriority"]))


@query("drop_missing_columns", _with(DIRTY_CUSTOMER_SQL) + """SELECT c_custkey, c_name, segment, c_acctbal,
  CAST(c_nationkey AS BIGINT) AS c_nationkey FROM dirty_customer""")
def q_drop_missing_columns(spark, sf):
    d = missing.drop_missing_columns(dirty_customer(spark, sf), 0.1).drop(ROW_ID)
    return d.withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))


# --- 2.4 duplicates and outliers ---------------------------------------------------

@query("dedup_all", _with(DUP_ORDERS_SQL) + f"SELECT DISTINCT {ORDERS_COLS_SQL} FROM dup_orders")
def q_dedup_all(spark, sf):
    return _orders_out(dedup.drop_duplicates(dup_orders(spark, sf)))


@query("dedup_subset_first", """SELECT doc_id, text, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def q_dedup_subset(spark, sf):
    d = _table(spark, sf, "documents", "doc_id")
    return dedup.drop_duplicates(d, ["text"]).drop(ROW_ID)


@query("dedup_subset_multi", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) = 1""")
def q_dedup_subset_multi(spark, sf):
    d = _table(spark, sf, "orders", "o_orderkey")
    return _orders_out(dedup.drop_duplicates(d, ["o_orderstatus", "o_orderpriority"]))


@query("dedup_all_two_phase", _with(DUP_ORDERS_SQL) + f"SELECT DISTINCT {ORDERS_COLS_SQL} FROM dup_orders")
def q_dedup_all_two_phase(spark, sf):
    # the large-input plan (hash split, exact de-duplication of repeated hashes only), forced
    return _orders_out(dedup.drop_duplicates(dup_orders(spark, sf)))


@query("dedup_subset_two_phase", """SELECT doc_id, text, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def q_dedup_subset_two_phase(spark, sf):
    d = _table(spark, sf, "documents", "doc_id")
    return dedup.drop_duplicates(d, ["text"]).drop(ROW_ID)


@query("count_duplicates", _with(DUP_ORDERS_SQL) + """SELECT CAST(
  (SELECT count(*) FROM dup_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_orders)) AS BIGINT)
  AS duplicate_rows""")
def q_count_duplicates(spark, sf):
    return dedup.count_duplicates(dup_orders(spark, sf))


@query("count_duplicates_two_phase", _with(DUP_ORDERS_SQL) + """SELECT CAST(
  (SELECT count(*) FROM dup_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_orders)) AS BIGINT)
  AS duplicate_rows""")
def q_count_duplicates_two_phase(spark, sf):
    # the large-input plan (row-hash phase, exact grouping of repeated hashes only), forced
    from tablesmith.plans.duplicates import duplicate_rows
    d = dup_orders(spark, sf)
    cols = [c for c in d.columns if c != ROW_ID]
    return d.agg(F.lit(duplicate_rows(d, cols)).cast("bigint").alias("duplicate_rows"))


IQR_SQL = """b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
bb AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)"""


@query("iqr_bounds", "WITH " + IQR_SQL + """ SELECT 'value' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3,
  round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound FROM bb""")
def q_iqr_bounds(spark, sf):
    b = outliers.iqr_bounds_frame(_table(spark, sf, "events", "event_id"), ["value"])
    return b.select("column", _r("q1", 6), _r("q3", 6), _r("lower_bound", 6), _r("upper_bound", 6))


OUTLIER_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _outliers_remove_sql(table: str, cols: list[str]) -> str:
    """Column after column, each with the quartiles of what the ones before have left."""
    ctes = [f"s0 AS (SELECT * FROM {table})"]
    for k, c in enumerate(cols):
        ctes.append(f"""b{k} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM s{k}),
s{k + 1} AS (SELECT s{k}.* FROM s{k}, b{k} WHERE {c} IS NULL OR {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""")
    return f"WITH {', '.join(ctes)} SELECT l_orderkey, l_linenumber, l_extendedprice FROM s{len(cols)}"


@query("outliers_remove_four", _outliers_remove_sql("lineitem", OUTLIER_COLUMNS))
def q_outliers_remove_four(spark, sf):
    li = readers.load(spark, f"{sf}/lineitem.parquet")
    return outliers.outliers_remove(li, OUTLIER_COLUMNS).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("outliers_remove", """WITH s1 AS (SELECT * FROM events),
b1 AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s1),
s2 AS (SELECT s1.* FROM s1, b1 WHERE NOT (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) OR value IS NULL),
b2 AS (SELECT quantile_cont(user_id, 0.25) AS q1, quantile_cont(user_id, 0.75) AS q3 FROM s2),
s3 AS (SELECT s2.* FROM s2, b2 WHERE NOT (user_id < q1 - 1.5 * (q3 - q1) OR user_id > q3 + 1.5 * (q3 - q1)) OR user_id IS NULL)
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM s3""")
def q_outliers_remove(spark, sf):
    e = _table(spark, sf, "events", "event_id")
    return outliers.outliers_remove(e, ["value", "user_id"]).select(
        "event_id", _ts("ts"), "user_id", "event_type", "value", "props")


@query("outliers_nullify", "WITH " + IQR_SQL + """ SELECT event_id,
  CASE WHEN value < lo OR value > hi THEN NULL ELSE value END AS value FROM events, bb""")
def q_outliers_nullify(spark, sf):
    e = _table(spark, sf, "events", "event_id")
    return outliers.outliers_nullify(e, ["value"]).select("event_id", "value")


@query("outliers_cap", "WITH " + IQR_SQL + """ SELECT event_id,
  round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM events, bb""")
def q_outliers_cap(spark, sf):
    e = _table(spark, sf, "events", "event_id")
    return outliers.outliers_cap(e, ["value"]).select("event_id", _r("value", 6))


@query("outliers_affected", "WITH " + IQR_SQL + """ SELECT CAST(count(*) AS BIGINT) AS outliers_affected
FROM events, bb WHERE value < lo OR value > hi""")
def q_outliers_affected(spark, sf):
    e = _table(spark, sf, "events", "event_id")
    return spark.createDataFrame([(outliers.handle_outliers(e, "cap", ["value"])[1],)], "outliers_affected bigint")


@query("iqr_outliers", "WITH " + IQR_SQL + """ SELECT event_id AS _row_id, value, round(lo, 6) AS lower_bound,
  round(hi, 6) AS upper_bound FROM events, bb WHERE value < lo OR value > hi""")
def q_iqr_outliers(spark, sf):
    e = _table(spark, sf, "events", "event_id")
    return outliers.iqr_outliers(e, "value").select(ROW_ID, "value", _r("lower_bound", 6), _r("upper_bound", 6))


@query("zscore_outliers", """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
SELECT event_id AS _row_id, value, round((value - m) / sd, 6) AS zscore FROM events, s
WHERE abs((value - m) / sd) > 3""")
def q_zscore(spark, sf):
    e = _table(spark, sf, "events", "event_id")
    return outliers.zscore_outliers(e, "value").select(ROW_ID, "value", _r("zscore", 6))


# --- 2.5 text --------------------------------------------------------------------

def _cust_text(df):
    return df.select("c_custkey", "c_name", "email", "phone", "segment")


TITLE_RE2 = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def _title_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE array_to_string(list_transform("
            f"regexp_extract_all({c}, '{TITLE_RE2}', 1), "
            f"lambda w: concat(CASE WHEN substr(w, 1, 1) = 'ß' THEN 'Ss' ELSE upper(substr(w, 1, 1)) END, "
            f"lower(substr(w, 2)))), '') END")


@query("trim", _with(DIRTY_CUSTOMER_SQL) + r"""SELECT c_custkey,
  regexp_replace(c_name, '^\s+|\s+$', '', 'g') AS c_name, regexp_replace(email, '^\s+|\s+$', '', 'g') AS email,
  regexp_replace(phone, '^\s+|\s+$', '', 'g') AS phone, regexp_replace(segment, '^\s+|\s+$', '', 'g') AS segment
FROM dirty_customer""")
def q_trim(spark, sf):
    return _cust_text(text.trim(dirty_customer(spark, sf)))


@query("lower", _with(DIRTY_CUSTOMER_SQL) + """SELECT c_custkey, lower(c_name) AS c_name, lower(email) AS email,
  lower(phone) AS phone, lower(segment) AS segment FROM dirty_customer""")
def q_lower(spark, sf):
    return _cust_text(text.lower(dirty_customer(spark, sf)))


@query("upper", _with(DIRTY_CUSTOMER_SQL) + """SELECT c_custkey, upper(c_name) AS c_name, upper(email) AS email,
  upper(phone) AS phone, upper(segment) AS segment FROM dirty_customer""")
def q_upper(spark, sf):
    return _cust_text(text.upper(dirty_customer(spark, sf)))


@query("title_case", _with(DIRTY_CUSTOMER_SQL) + f"""SELECT c_custkey, {_title_sql('c_name')} AS c_name,
  {_title_sql('email')} AS email, {_title_sql('phone')} AS phone, {_title_sql('segment')} AS segment
FROM dirty_customer""")
def q_title(spark, sf):
    return _cust_text(text.title_case(dirty_customer(spark, sf)))


@query("replace_literal", """SELECT conv_id, turn, role, regexp_replace(text, 'le', 'LE$1', 'gi') AS text
FROM conversations""")
def q_replace_literal(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return text.find_replace(c, "le", "LE$1", ["text"]).select("conv_id", "turn", "role", "text")


@query("replace_literal_case", """SELECT conv_id, turn, replace(role, 'user', 'customer') AS role,
  replace(text, 'The', 'A') AS text FROM conversations""")
def q_replace_literal_case(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return text.find_replace(c, "user", "customer", ["role"], match_case=True).transform(
        lambda d: text.find_replace(d, "The", "A", ["text"], match_case=True)).select("conv_id", "turn", "role", "text")


@query("replace_regex", r"""SELECT conv_id, turn, role, regexp_replace(text, '(l[ae])s', '\1S', 'gi') AS text
FROM conversations""")
def q_replace_regex(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return text.find_replace(c, r"(l[ae])s", r"\1S", ["text"], use_regex=True).select("conv_id", "turn", "role", "text")


EMAIL_RE2 = tf.EMAIL_PATTERN


@query("email_clear", _with(DIRTY_CUSTOMER_SQL) + f"""SELECT c_custkey,
  CASE WHEN regexp_full_match(email, '{EMAIL_RE2}') THEN email ELSE NULL END AS email FROM dirty_customer""")
def q_email_clear(spark, sf):
    return text.validate_emails(dirty_customer(spark, sf), ["email"], "clear").select("c_custkey", "email")


@query("email_drop", _with(DIRTY_CUSTOMER_SQL) + f"""SELECT {CUSTOMER_COLS_SQL} FROM dirty_customer
WHERE email IS NULL OR regexp_full_match(email, '{EMAIL_RE2}')""")
def q_email_drop(spark, sf):
    return _customer_out(text.validate_emails(dirty_customer(spark, sf), ["email"], "remove_row"))


@query("email_invalid_count", _with(DIRTY_CUSTOMER_SQL) + f"""SELECT CAST(count(*) AS BIGINT) AS invalid_cells
FROM dirty_customer WHERE email IS NOT NULL AND NOT regexp_full_match(email, '{EMAIL_RE2}')""")
def q_email_count(spark, sf):
    return text.count_invalid_emails(dirty_customer(spark, sf), ["email"])


@query("format_phone", _with(DIRTY_CUSTOMER_SQL) + f"""SELECT c_custkey,
  regexp_replace(coalesce(phone, ''), '{PHONE_RE2}', '1(\\1)\\2-\\3', 'g') AS phone FROM dirty_customer""")
def q_format_phone(spark, sf):
    return text.format_phones(dirty_customer(spark, sf), ["phone"]).select("c_custkey", "phone")


@query("format_phone_documents", f"""SELECT doc_id,
  regexp_replace(coalesce(text, ''), '{PHONE_RE2}', '1(\\1)\\2-\\3', 'g') AS text FROM documents""")
def q_format_phone_docs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return text.format_phones(d, ["text"]).select("doc_id", "text")


def _strip_md_sql(c: str) -> str:
    s = f"regexp_replace({c}, '(\\*\\*|\\*|`|_{{1,2}})', '', 'g')"
    s = f"regexp_replace({s}, '(?m)^\\s*[-•]\\s+', '', 'g')"
    s = f"replace(replace({s}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    s = f"regexp_replace({s}, '[ \\t]+\\n', chr(10), 'g')"
    s = f"regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


@query("strip_markdown", f"SELECT conv_id, turn, role, {_strip_md_sql('text')} AS text FROM conversations")
def q_strip_markdown(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return text.strip_markdown(c, ["text"]).select("conv_id", "turn", "role", "text")


def _segments_sql() -> str:
    mark, digits = "chr(1)", r"\\d+[.)]"
    t = f"regexp_replace(t, '\\n+', {mark}, 'g')"
    # a mark stands where the split cuts: after a sentence's end before a capital, after : and ;, before numbered items
    t = f"regexp_replace({t}, '\\.\\s+([A-Z(])', '.' || {mark} || '\\1', 'g')"
    t = f"regexp_replace({t}, '([:;])\\s+', '\\1' || {mark}, 'g')"
    t = f"regexp_replace({t}, '\\s+({digits}\\s)', {mark} || '\\1', 'g')"
    strip = f"' ' || chr(10) || chr(9) || '{tf.SEGMENT_STRIP_CHARS[3:]}'"
    return f"""
WITH c AS (SELECT conv_id, turn, {_strip_md_sql('text')} AS t FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, t, list_filter(string_split({t}, {mark}), lambda x: trim(x, {strip}) <> '' OR trim(x) <> '') AS parts FROM c),
s AS (SELECT conv_id, turn, t, list_filter(list_transform(list_transform(parts, lambda x: trim(x, {strip})),
    lambda x: regexp_replace(regexp_replace(x, '^\\s*\\(?\\d+[.)]\\s*', ''), '^\\s+|\\s+$', '', 'g')),
    lambda x: x <> '' AND NOT regexp_matches(x, '^[.;:,()\\[\\]{{}}]+$')) AS parts FROM p),
f AS (SELECT conv_id, turn, CASE WHEN len(parts) > 0 THEN parts ELSE [t] END AS parts FROM s)
SELECT conv_id, turn, CAST(unnest(range(len(parts))) AS INTEGER) AS segment_no, unnest(parts) AS segment FROM f"""


@query("split_segments", _segments_sql())
def q_split_segments(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return text.split_segments(c, "text", keys=["conv_id", "turn"])


@query("string_op_documents", f"""SELECT doc_id, {_title_sql('text')} AS text, upper(lang) AS lang,
  source FROM documents""")
def q_string_op_docs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    d = text.string_op(d, "title", ["text"])
    return text.string_op(d, "upper", ["lang"]).select("doc_id", "text", "lang", "source")


# --- 2.6 sort / group / pivot / calculated columns -----------------------------------

@query("sort_multi", f"SELECT {ORDERS_COLS_SQL} FROM orders")
def q_sort_multi(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    return _orders_out(reshape.sort(o, ["o_orderstatus", "o_totalprice"], ascending=False))


@query("sort_top_page", f"""SELECT {ORDERS_COLS_SQL} FROM orders
ORDER BY o_orderstatus DESC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50""")
def q_sort_top(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    return _orders_out(reshape.sort(o, ["o_orderstatus", "o_totalprice"], ascending=False).limit(50))


GROUP_KEYS = ["o_orderstatus", "o_orderpriority"]
# Rounding per aggregate so both engines agree despite different summation order.
GROUP_FNS = {
    "sum": ("round(coalesce(sum(o_totalprice), 0), 2)", 2),
    "mean": ("round(avg(o_totalprice), 4)", 4),
    "min": ("min(o_totalprice)", None),
    "max": ("max(o_totalprice)", None),
    "count": ("CAST(count(o_totalprice) AS BIGINT)", None),
    "median": ("round(quantile_cont(o_totalprice, 0.5), 4)", 4),
    "std": ("round(stddev_samp(o_totalprice), 4)", 4),
    "var": ("round(var_samp(o_totalprice) / 1000000, 4)", "var"),
    "sem": ("round(stddev_samp(o_totalprice) / sqrt(count(o_totalprice)), 4)", 4),
    "first": ("arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice IS NOT NULL)", None),
    "last": ("arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice IS NOT NULL)", None),
    "nunique": ("CAST(count(DISTINCT o_totalprice) AS BIGINT)", None),
    "size": ("CAST(count(*) AS BIGINT)", None),
    "any": ("coalesce(bool_or(o_totalprice <> 0), false)", None),
    "all": ("coalesce(bool_and(o_totalprice <> 0), true)", None),
    "skew": ("round(skewness(o_totalprice), 8)", 8),
    "idxmin": ("arg_min(o_orderkey, [o_totalprice, o_orderkey]) FILTER (WHERE o_totalprice IS NOT NULL)", None),
    "idxmax": ("arg_min(o_orderkey, [-o_totalprice, o_orderkey]) FILTER (WHERE o_totalprice IS NOT NULL)", None),
}


def _group_query(fn: str, rnd):
    def run(spark, sf):
        out = reshape.group_by(dirty_orders(spark, sf), GROUP_KEYS, "o_totalprice", fn)
        c = F.col("o_totalprice")
        if rnd == "var":
            c = F.round(c / 1_000_000, 4)
        elif rnd is not None:
            c = F.round(c, rnd)
        return out.select(*GROUP_KEYS, c.alias("o_totalprice"))
    return run


for _fn, (_expr, _rnd) in GROUP_FNS.items():
    query(f"group_by_{_fn}", _with(DIRTY_ORDERS_SQL) + f"""SELECT o_orderstatus, o_orderpriority,
  {_expr} AS o_totalprice FROM dirty_orders
WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY o_orderstatus, o_orderpriority""")(
        _group_query(_fn, _rnd))


@query("group_by_median_bracket", _with(DIRTY_ORDERS_SQL) + """SELECT o_orderstatus, o_orderpriority,
  round(quantile_cont(o_totalprice, 0.5), 4) AS o_totalprice FROM dirty_orders
WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY o_orderstatus, o_orderpriority""")
def q_group_median_bracket(spark, sf):
    # The per-group bracket plan used above the small-input size, forced here.
    out = reshape.group_by(dirty_orders(spark, sf), GROUP_KEYS, "o_totalprice", "median")
    return out.select(*GROUP_KEYS, _r("o_totalprice", 4))


@query("pivot_median_bracket", _with(DIRTY_ORDERS_SQL) + """SELECT o_orderpriority,
  round(coalesce(quantile_cont(o_totalprice, 0.5) FILTER (WHERE o_orderstatus = 'F'), 0), 4) AS "F",
  round(coalesce(quantile_cont(o_totalprice, 0.5) FILTER (WHERE o_orderstatus = 'O'), 0), 4) AS "O",
  round(coalesce(quantile_cont(o_totalprice, 0.5) FILTER (WHERE o_orderstatus = 'P'), 0), 4) AS "P"
FROM dirty_orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY o_orderpriority""")
def q_pivot_median_bracket(spark, sf):
    out = reshape.pivot(dirty_orders(spark, sf), "o_orderpriority", "o_orderstatus", "o_totalprice", "median")
    return out.select("o_orderpriority", *[_r(c, 4) for c in out.columns if c != "o_orderpriority"])


@query("group_by_prod", """SELECT l_returnflag, l_linestatus,
  round(coalesce(product(1 + l_discount / 100), 1), 8) AS factor FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_group_prod(spark, sf):
    li = expr.calculated_column(_table(spark, sf, "lineitem"), "factor", "1 + l_discount / 100")
    return reshape.group_by(li, ["l_returnflag", "l_linestatus"], "factor", "prod").select(
        "l_returnflag", "l_linestatus", _r("factor", 8))


@query("group_by_all_numeric", """SELECT o_orderstatus, CAST(sum(o_orderkey) AS BIGINT) AS o_orderkey,
  CAST(sum(o_custkey) AS BIGINT) AS o_custkey, round(sum(o_totalprice), 2) AS o_totalprice
FROM orders GROUP BY o_orderstatus""")
def q_group_all_numeric(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    out = reshape.group_by_all_numeric(o, ["o_orderstatus"], "sum")
    return out.select("o_orderstatus", _big("o_orderkey"), _big("o_custkey"), _r("o_totalprice", 2))


@query("group_by_lineitem_count", """SELECT l_returnflag, l_linestatus, CAST(count(l_quantity) AS BIGINT) AS l_quantity
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_group_lineitem(spark, sf):
    return reshape.group_by(_table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "count")


@query("pivot_sum", _with(DIRTY_ORDERS_SQL) + """SELECT o_orderpriority,
  round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS "F",
  round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 2) AS "O",
  round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0), 2) AS "P"
FROM dirty_orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY o_orderpriority""")
def q_pivot_sum(spark, sf):
    out = reshape.pivot(dirty_orders(spark, sf), "o_orderpriority", "o_orderstatus", "o_totalprice", "sum")
    return out.select("o_orderpriority", *[_r(c, 2) for c in out.columns if c != "o_orderpriority"])


@query("pivot_mean", _with(DIRTY_ORDERS_SQL) + """SELECT o_orderpriority, "F", "O", "P" FROM (
  SELECT o_orderpriority,
    round(coalesce(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 4) AS "F",
    round(coalesce(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 4) AS "O",
    round(coalesce(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0), 4) AS "P",
    count(o_totalprice) AS n
  FROM dirty_orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY o_orderpriority)
WHERE n > 0""")
def q_pivot_mean(spark, sf):
    out = reshape.pivot(dirty_orders(spark, sf), "o_orderpriority", "o_orderstatus", "o_totalprice", "mean")
    return out.select("o_orderpriority", *[_r(c, 4) for c in out.columns if c != "o_orderpriority"])


@query("pivot_lineitem_count", """SELECT l_returnflag,
  CAST(count(l_quantity) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS "F",
  CAST(count(l_quantity) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS "O"
FROM lineitem GROUP BY l_returnflag""")
def q_pivot_count(spark, sf):
    out = reshape.pivot(_table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "count")
    return out.select("l_returnflag", *[_big(c) for c in out.columns if c != "l_returnflag"])


LI_KEY_SQL = "l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"


@query("calc_arith", f"""SELECT {LI_KEY_SQL},
  round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, -l_quantity AS neg_qty,
  l_returnflag || l_linestatus AS flags FROM lineitem""")
def q_calc_arith(spark, sf):
    li = _table(spark, sf, "lineitem")
    li = expr.calculated_column(li, "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    li = expr.calculated_column(li, "neg_qty", "-l_quantity")
    li = expr.calculated_column(li, "flags", "l_returnflag || l_linestatus")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", _big("l_linenumber"), _r("charge", 6), "neg_qty", "flags")


@query("calc_true_div", """SELECT o_orderkey,
  round(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice / (o_custkey % 3) END, 6) AS ratio FROM orders""")
def q_calc_true_div(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    o = expr.calculated_column(o, "ratio", fm.true_div("o_totalprice", F.col("o_custkey") % 3))
    return o.select("o_orderkey", _r("ratio", 6))


@query("calc_floor_div", """SELECT o_orderkey, CAST(floor((o_custkey - 700) / 7) AS BIGINT) AS q,
  CAST(floor(o_totalprice / -1000.0) AS BIGINT) AS qf FROM orders""")
def q_calc_floor_div(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    o = expr.calculated_column(o, "q", fm.floor_div(F.col("o_custkey") - 700, 7))
    o = expr.calculated_column(o, "qf", fm.floor_div("o_totalprice", -1000.0))
    return o.select("o_orderkey", _big("q"), _big("qf"))


@query("calc_floor_mod", """SELECT o_orderkey,
  CAST((o_custkey - 700) - 7 * floor((o_custkey - 700) / 7) AS BIGINT) AS m,
  CAST((o_custkey - 700) - (-7) * floor((o_custkey - 700) / -7) AS BIGINT) AS mn FROM orders""")
def q_calc_floor_mod(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    o = expr.calculated_column(o, "m", fm.floor_mod(F.col("o_custkey") - 700, 7))
    o = expr.calculated_column(o, "mn", fm.floor_mod(F.col("o_custkey") - 700, -7))
    return o.select("o_orderkey", _big("m"), _big("mn"))


@query("calc_sql_helpers", """SELECT o_orderkey, floor((o_custkey - 700) / 7) AS q,
  (o_custkey - 700) - 7 * floor((o_custkey - 700) / 7) AS m,
  round(CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_totalprice / (o_custkey % 4) END, 6) AS t,
  round(atan2(o_totalprice, o_custkey), 8) AS a2 FROM orders""")
def q_calc_sql_helpers(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    o = expr.calculated_column(o, "q", "floor_div(o_custkey - 700, 7)")
    o = expr.calculated_column(o, "m", "floor_mod(o_custkey - 700, 7)")
    o = expr.calculated_column(o, "t", "round(true_div(o_totalprice, o_custkey % 4), 6)")
    o = expr.calculated_column(o, "a2", "round(arctan2(o_totalprice, o_custkey), 8)")
    return o.select("o_orderkey", "q", "m", "t", "a2")


@query("calc_power", f"""SELECT {LI_KEY_SQL}, round(power(l_quantity, 2), 6) AS q2,
  round(power(l_discount * 10, 0.5), 8) AS d_half FROM lineitem""")
def q_calc_power(spark, sf):
    li = _table(spark, sf, "lineitem")
    li = expr.calculated_column(li, "q2", fm.power("l_quantity", 2))
    li = expr.calculated_column(li, "d_half", fm.power(F.col("l_discount") * 10, 0.5))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", _big("l_linenumber"), _r("q2", 6), _r("d_half", 8))


@query("calc_compare", f"""SELECT {LI_KEY_SQL}, (1 < l_quantity AND l_quantity < 10) AS small_qty,
  (l_discount = 0.05) AS d5, (l_returnflag <> 'R') AS not_r FROM lineitem""")
def q_calc_compare(spark, sf):
    li = _table(spark, sf, "lineitem")
    li = expr.calculated_column(li, "small_qty", "1 < l_quantity AND l_quantity < 10")
    li = expr.calculated_column(li, "d5", "l_discount = 0.05")
    li = expr.calculated_column(li, "not_r", "l_returnflag != 'R'")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", _big("l_linenumber"), "small_qty", "d5", "not_r")


@query("calc_bool", f"""SELECT {LI_KEY_SQL},
  ((l_discount > 0.05 AND NOT (l_returnflag = 'R')) OR l_tax = 0) AS flag FROM lineitem""")
def q_calc_bool(spark, sf):
    li = _table(spark, sf, "lineitem")
    li = expr.calculated_column(li, "flag", "(l_discount > 0.05 AND NOT (l_returnflag = 'R')) OR l_tax = 0")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", _big("l_linenumber"), "flag")


@query("calc_in", f"""SELECT {LI_KEY_SQL}, (l_returnflag IN ('A', 'N')) AS an,
  (CAST(l_linenumber AS BIGINT) IN (1, 2, 3)) AS first3 FROM lineitem""")
def q_calc_in(spark, sf):
    li = _table(spark, sf, "lineitem")
    li = expr.calculated_column(li, "an", F.col("l_returnflag").isin("A", "N"))
    li = expr.calculated_column(li, "first3", "l_linenumber IN (1, 2, 3)")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", _big("l_linenumber"), "an", "first3")


@query("calc_math", f"""SELECT {LI_KEY_SQL}, round(sqrt(l_extendedprice), 8) AS sq,
  round(log10(l_quantity), 8) AS lg, round(abs(l_discount - 0.05), 8) AS ab,
  CAST(floor(l_extendedprice / 1000) AS BIGINT) AS fl, CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS cl,
  round(atan2(l_tax, l_discount + 0.01), 8) AS at2, round(exp(l_discount), 8) AS ex,
  round(sin(l_quantity), 8) AS sn, round(tanh(l_discount), 8) AS th FROM lineitem""")
def q_calc_math(spark, sf):
    li = _table(spark, sf, "lineitem")
    li = li.withColumns({
        "sq": fm.math_fn("sqrt", "l_extendedprice"), "lg": fm.math_fn("log10", "l_quantity"),
        "ab": fm.math_fn("abs", F.col("l_discount") - 0.05),
        "fl": fm.math_fn("floor", F.col("l_extendedprice") / 1000),
        "cl": fm.math_fn("ceil", F.col("l_extendedprice") / 1000),
        "at2": fm.arctan2("l_tax", F.col("l_discount") + 0.01), "ex": fm.math_fn("exp", "l_discount"),
        "sn": fm.math_fn("sin", "l_quantity"), "th": fm.math_fn("tanh", "l_discount")})
    return li.select("l_orderkey", "l_partkey", "l_suppkey", _big("l_linenumber"), _r("sq", 8), _r("lg", 8),
                     _r("ab", 8), _big("fl"), _big("cl"), _r("at2", 8), _r("ex", 8), _r("sn", 8), _r("th", 8))


MORE_MATH = {  # numpy's name: argument, its SQL
    "expm1": ("l_discount", "exp(l_discount) - 1"), "log1p": ("l_discount", "ln(1 + l_discount)"),
    "cos": ("l_quantity", "cos(l_quantity)"), "tan": ("l_discount", "tan(l_discount)"),
    "arcsin": ("l_discount", "asin(l_discount)"), "arctan": ("l_quantity", "atan(l_quantity)"),
    "sinh": ("l_discount", "sinh(l_discount)"), "cosh": ("l_discount", "cosh(l_discount)"),
    "arcsinh": ("l_quantity", "asinh(l_quantity)"), "arccosh": ("l_quantity", "acosh(l_quantity)"),
    "arctanh": ("l_discount", "atanh(l_discount)"), "log": ("l_quantity", "ln(l_quantity)"),
}


@query("calc_math_more", f"SELECT {LI_KEY_SQL}, " + ", ".join(
    f"round({sql}, 8) AS {name}" for name, (_, sql) in MORE_MATH.items()) + " FROM lineitem")
def q_calc_math_more(spark, sf):
    li = _table(spark, sf, "lineitem").withColumns({f"m_{n}": fm.math_fn(n, c) for n, (c, _) in MORE_MATH.items()})
    return li.select("l_orderkey", "l_partkey", "l_suppkey", _big("l_linenumber"),
                     *[F.round(f"m_{n}", 8).alias(n) for n in MORE_MATH])


@query("calc_math_domain", """SELECT o_orderkey,
  CASE WHEN o_totalprice / 100000 - 2 < 0 THEN NULL ELSE round(sqrt(o_totalprice / 100000 - 2), 8) END AS sq,
  CASE WHEN abs(o_totalprice / 200000) > 1 THEN NULL ELSE round(acos(o_totalprice / 200000), 8) END AS ac
FROM orders""")
def q_calc_math_domain(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    o = o.withColumns({"sq": fm.math_fn("sqrt", F.col("o_totalprice") / 100000 - 2),
                       "ac": fm.math_fn("arccos", F.col("o_totalprice") / 200000)})
    return o.select("o_orderkey", _r("sq", 8), _r("ac", 8))


# --- 2.7 profile and quality --------------------------------------------------------

@query("profile_dataset", _with(DUP_ORDERS_SQL) + """SELECT CAST(count(*) AS BIGINT) AS total_rows,
  CAST(6 AS BIGINT) AS total_columns, CAST(0 AS BIGINT) AS missing_cells,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_orders)) AS BIGINT) AS duplicate_rows
FROM dup_orders""")
def q_profile_dataset(spark, sf):
    return profile.profile_dataset(dup_orders(spark, sf))


@query("profile_dataset_dirty", _with(DIRTY_ORDERS_SQL) + """SELECT CAST(count(*) AS BIGINT) AS total_rows,
  CAST(6 AS BIGINT) AS total_columns,
  CAST(count(*) FILTER (WHERE o_custkey IS NULL) + count(*) FILTER (WHERE o_totalprice IS NULL)
       + count(*) FILTER (WHERE o_orderpriority IS NULL) AS BIGINT) AS missing_cells,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS BIGINT) AS duplicate_rows
FROM dirty_orders""")
def q_profile_dataset_dirty(spark, sf):
    return profile.profile_dataset(dirty_orders(spark, sf))


PROFILE_COLS = [("o_orderkey", "bigint", True), ("o_custkey", "bigint", True), ("o_totalprice", "double", True),
                ("o_orderpriority", "string", False), ("o_orderstatus", "string", False),
                ("o_orderdate", "timestamp_ntz", False)]


def _profile_columns_sql() -> str:
    parts = []
    for i, (c, t, num) in enumerate(PROFILE_COLS):
        stats = (f"round(min({c})::DOUBLE, 4), round(max({c})::DOUBLE, 4), round(avg({c}), 4), "
                 f"round(stddev_samp({c}), 4), round(quantile_cont({c}, 0.5)::DOUBLE, 4)" if num else
                 "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE")
        parts.append(f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype,
  CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count,
  round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, {stats} FROM dirty_orders""")
    body = "\nUNION ALL\n".join(parts)
    return _with(DIRTY_ORDERS_SQL) + f"""SELECT position, "column", dtype, unique_count, null_count, null_pct,
  c5 AS min, c6 AS max, c7 AS mean, c8 AS std, c9 AS median FROM (
SELECT * FROM ({body}) AS u(position, "column", dtype, unique_count, null_count, null_pct, c5, c6, c7, c8, c9))"""


@query("profile_columns", _profile_columns_sql())
def q_profile_columns(spark, sf):
    p = profile.profile_columns(dirty_orders(spark, sf))
    return p.select(F.col("position").cast("int"), "column", "dtype", "unique_count", "null_count", "null_pct",
                    *[_r(c, 4) for c in ("min", "max", "mean", "std", "median")])


@query("numeric_stats", """SELECT * FROM (VALUES
  ('event_id', (SELECT count(event_id) FROM events), (SELECT min(event_id)::DOUBLE FROM events),
   (SELECT quantile_cont(event_id, 0.25) FROM events), (SELECT quantile_cont(event_id, 0.5) FROM events),
   (SELECT quantile_cont(event_id, 0.75) FROM events), (SELECT max(event_id)::DOUBLE FROM events),
   (SELECT round(avg(event_id), 4) FROM events), (SELECT round(stddev_samp(event_id), 4) FROM events)),
  ('user_id', (SELECT count(user_id) FROM events), (SELECT min(user_id)::DOUBLE FROM events),
   (SELECT quantile_cont(user_id, 0.25) FROM events), (SELECT quantile_cont(user_id, 0.5) FROM events),
   (SELECT quantile_cont(user_id, 0.75) FROM events), (SELECT max(user_id)::DOUBLE FROM events),
   (SELECT round(avg(user_id), 4) FROM events), (SELECT round(stddev_samp(user_id), 4) FROM events)),
  ('value', (SELECT count(value) FROM events), (SELECT min(value) FROM events),
   (SELECT round(quantile_cont(value, 0.25), 6) FROM events), (SELECT round(quantile_cont(value, 0.5), 6) FROM events),
   (SELECT round(quantile_cont(value, 0.75), 6) FROM events), (SELECT max(value) FROM events),
   (SELECT round(avg(value), 4) FROM events), (SELECT round(stddev_samp(value), 4) FROM events)))
  AS t("column", count, min, q25, median, q75, max, mean, std)""")
def q_numeric_stats(spark, sf):
    s = profile.numeric_stats(_table(spark, sf, "events", "event_id"))
    return s.select("column", "count", "min", _r("q25", 6), _r("median", 6), _r("q75", 6), "max",
                    _r("mean", 4), _r("std", 4))


QUALITY_SQL = _with(DIRTY_ORDERS_SQL) + """, d AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE o_custkey IS NULL) + count(*) FILTER (WHERE o_totalprice IS NULL)
   + count(*) FILTER (WHERE o_orderpriority IS NULL) AS miss,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS dups FROM dirty_orders),
s AS (SELECT greatest(0.0, 100 - miss * 100.0 / (n * 6)) AS c, greatest(0.0, 100 - dups * 100.0 / n) AS u FROM d)
"""


@query("quality_score", QUALITY_SQL + """SELECT round((c + u + 85 + 90) / 4, 2) AS overall_score,
  round(c, 2) AS completeness_score, round(u, 2) AS uniqueness_score, CAST(85 AS DOUBLE) AS consistency_score,
  CAST(90 AS DOUBLE) AS validity_score,
  CASE WHEN round((c + u + 85 + 90) / 4, 2) >= 90 THEN 'excellent' WHEN round((c + u + 85 + 90) / 4, 2) >= 70 THEN 'good'
       WHEN round((c + u + 85 + 90) / 4, 2) >= 50 THEN 'fair' ELSE 'poor' END AS band FROM s""")
def q_quality_score(spark, sf):
    return profile.quality_score(dirty_orders(spark, sf))


@query("score_band", _with(DIRTY_CUSTOMER_SQL) + """SELECT "column", score,
  CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair'
       ELSE 'poor' END AS band FROM (
  SELECT 'email' AS "column", round(100 - (count(*) - count(email)) * 100.0 / count(*), 2) AS score FROM dirty_customer
  UNION ALL SELECT 'phone', round(100 - (count(*) - count(phone)) * 100.0 / count(*), 2) FROM dirty_customer
  UNION ALL SELECT 'c_name', round(100 - (count(*) - count(c_name)) * 100.0 / count(*), 2) FROM dirty_customer)""")
def q_score_band(spark, sf):
    d = dirty_customer(spark, sf).select("email", "phone", "c_name", ROW_ID)
    summ = preview.table_summary(d)
    n = d.count()
    return summ.select("column", F.round(F.col("non_null") * 100.0 / F.lit(n), 2).alias("score")).withColumn(
        "band", profile.score_band("score"))


@query("recommendations", QUALITY_SQL + f"""SELECT array_to_string(list_filter([
  CASE WHEN c < 80 THEN '{profile.REC_MISSING}' END,
  CASE WHEN u < 90 THEN '{profile.REC_DUPLICATES}' END,
  NULL], lambda x: x IS NOT NULL), '; ') AS recommendations FROM s""")
def q_recommendations(spark, sf):
    d = dirty_orders(spark, sf)
    scores = profile.quality_score(d)
    detected = pii.pii_sample(d).count() > 0
    recs = profile.quality_recommendations(scores, detected)
    return recs.select(F.array_join("recommendations", "; ").alias("recommendations"))


@query("row_quality", _with(DUP_ORDERS_SQL) + """SELECT * FROM (VALUES
  ('Clean Rows', CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM dup_orders)) AS BIGINT)),
  ('Duplicate Rows', CAST((SELECT count(*) FROM dup_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_orders)) AS BIGINT)))
  AS t(label, count)""")
def q_row_quality(spark, sf):
    return profile.row_quality(profile.profile_dataset(dup_orders(spark, sf)))


@query("cell_quality", _with(DIRTY_ORDERS_SQL) + """, m AS (SELECT count(*) * 6 AS cells,
  count(*) FILTER (WHERE o_custkey IS NULL) + count(*) FILTER (WHERE o_totalprice IS NULL)
   + count(*) FILTER (WHERE o_orderpriority IS NULL) AS miss FROM dirty_orders)
SELECT 'Valid Cells' AS label, CAST(cells - miss AS BIGINT) AS count FROM m
UNION ALL SELECT 'Missing Cells', CAST(miss AS BIGINT) FROM m""")
def q_cell_quality(spark, sf):
    return profile.cell_quality(profile.profile_dataset(dirty_orders(spark, sf)))


# --- 2.8 PII ---------------------------------------------------------------------------

def _pii_re2(t: str) -> str:
    return PII_PATTERNS[t].replace("'", "''")


def _pii_scan_sql(source: str, cols: list[str], types: list[str], threshold: float = 5.0,
                  ctes: str = "") -> str:
    parts = []
    for c in cols:
        for t in types:
            parts.append(f"""SELECT '{c}' AS "column", '{t}' AS pii_type,
  CAST(count(*) FILTER (WHERE regexp_matches({c}, '{_pii_re2(t)}')) AS BIGINT) AS match_count,
  count({c}) AS total FROM {source}""")
    body = "\nUNION ALL\n".join(parts)
    return ctes + f"""SELECT "column", pii_type, match_count, round(match_count * 100.0 / total, 2) AS confidence
FROM ({body}) WHERE match_count > 0 AND match_count * 100.0 / total > {threshold}"""


CUSTOMER_PII_COLS = ["c_name", "email", "phone", "segment"]
PII_TYPES_RE2_SAFE = ["email", "phone", "ssn", "credit_card", "url", "ip_address", "date", "name"]


@query("pii_scan", _pii_scan_sql("dirty_customer", CUSTOMER_PII_COLS, PII_TYPES_RE2_SAFE,
                                 ctes=_with(DIRTY_CUSTOMER_SQL)))
def q_pii_scan(spark, sf):
    return pii.pii_scan(dirty_customer(spark, sf), CUSTOMER_PII_COLS)


@query("pii_scan_documents", _pii_scan_sql("documents", ["text", "lang", "source"], PII_TYPES_RE2_SAFE))
def q_pii_scan_docs(spark, sf):
    return pii.pii_scan(spark.read.parquet(f"{sf}/documents.parquet"), ["text", "lang", "source"])


def _pii_sample_sql() -> str:
    parts = []
    for c in CUSTOMER_PII_COLS:
        parts.append(f"""SELECT '{c}' AS "column", {c} AS value FROM (SELECT {c}, c_custkey FROM dirty_customer
  WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 100)""")
    sample = "\nUNION ALL\n".join(parts)
    per = []
    for t in PII_TYPES_RE2_SAFE:
        per.append(f"""SELECT "column", '{t}' AS pii_type,
  CAST(count(*) FILTER (WHERE regexp_matches(value, '{_pii_re2(t)}')) AS BIGINT) AS match_count, count(value) AS total
FROM sample GROUP BY "column\"""")
    return _with(DIRTY_CUSTOMER_SQL, f"sample AS ({sample})") + f"""SELECT "column", pii_type, match_count,
  round(match_count * 100.0 / total, 2) AS confidence FROM ({' UNION ALL '.join(per)})
WHERE match_count > 0 AND match_count * 100.0 / total > 5.0"""


@query("pii_sample", _pii_sample_sql())
def q_pii_sample(spark, sf):
    return pii.pii_sample(dirty_customer(spark, sf), CUSTOMER_PII_COLS)


def _pii_summary_sql() -> str:
    scan = _pii_scan_sql("dirty_customer", CUSTOMER_PII_COLS, PII_TYPES_RE2_SAFE)
    return _with(DIRTY_CUSTOMER_SQL, f"found AS ({scan})") + """SELECT "column",
  array_to_string(list_sort(list(pii_type)), ',') AS pii_types, round(avg(confidence), 2) AS confidence,
  bool_or(pii_type IN ('ssn', 'credit_card')) AS high_risk FROM found GROUP BY "column\""""


@query("pii_summary", _pii_summary_sql())
def q_pii_summary(spark, sf):
    s = pii.pii_summary(dirty_customer(spark, sf), CUSTOMER_PII_COLS)
    return s.select("column", F.array_join("pii_types", ",").alias("pii_types"), "confidence", "high_risk")


def _pii_recs_sql() -> str:
    scan = _pii_scan_sql("documents", ["text"], PII_TYPES_RE2_SAFE, threshold=2.0)
    return f"""WITH found AS ({scan}), cols AS (SELECT "column", bool_or(pii_type IN ('ssn', 'credit_card')) AS hr
  FROM found GROUP BY "column")
SELECT count(*) > 0 AS pii_detected, CAST(count(*) AS BIGINT) AS total_pii_columns,
  array_to_string(list_filter([
    CASE WHEN count(*) > 0 THEN '{pii_fn.PII_REC_DETECTED}' END,
    CASE WHEN count(*) FILTER (WHERE hr) > 0 THEN '{pii_fn.PII_REC_HIGH_RISK}'
         || array_to_string(list_sort(list("column") FILTER (WHERE hr)), ', ') END,
    CASE WHEN count(*) FILTER (WHERE hr) > 0 THEN '{pii_fn.PII_REC_ANONYMIZE}' END,
    '{pii_fn.PII_REC_COMPLIANCE}'], lambda x: x IS NOT NULL), '; ') AS recommendations FROM cols"""


@query("pii_recommendations", _pii_recs_sql())
def q_pii_recs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    r = pii.pii_recommendations(pii.pii_summary(d, ["text"], threshold=2.0))
    return r.select("pii_detected", "total_pii_columns", F.array_join("recommendations", "; ").alias("recommendations"))


# --- 2.9 sessions, history, JSON-safe --------------------------------------------------

@query("json_safe", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
  CASE WHEN value > 50 OR value < 5 THEN NULL ELSE value END AS value,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS DOUBLE) END AS score FROM events""")
def q_json_safe(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    # out-of-range readings as +/-Inf and missing scores as NaN, as pandas would hold them
    e = e.select("event_id", "ts",
                 F.when(F.col("value") > 50, F.lit(float("inf"))).when(F.col("value") < 5, F.lit(float("-inf")))
                  .otherwise(F.col("value")).alias("value"),
                 F.when(F.col("event_type") == "error", F.lit(float("nan")))
                  .otherwise(F.col("user_id").cast("double")).alias("score"))
    return store.json_safe(e)


@query("session_roundtrip", _with(DIRTY_ORDERS_SQL) + f"SELECT {DIRTY_ORDERS_COLS_SQL} FROM dirty_orders")
def q_session(spark, sf):
    path = scratch_path(spark, "session")
    store.save_session(dirty_orders(spark, sf), path, "orders.parquet")
    df, _ = store.load_session(spark, path)
    return _dirty_orders_out(df)


@query("history_revert", f"SELECT {ORDERS_COLS_SQL} FROM orders")
def q_history(spark, sf):
    h = store.History(spark, scratch_path(spark, "history"))
    o = _table(spark, sf, "orders", "o_orderkey")
    v1 = h.log("Load", "orders loaded", o)
    h.log("Clean", "priorities upper-cased", text.upper(o, ["o_orderpriority"]))
    return _orders_out(h.revert(v1))


@query("session_load_history", f"""SELECT {ORDERS_COLS_SQL} FROM orders""")
def q_session_load_history(spark, sf):
    path, h = scratch_path(spark, "session"), store.History(spark, scratch_path(spark, "history"))
    store.save_session(_table(spark, sf, "orders", "o_orderkey"), path, "orders")
    h.log("Load", "an older table", spark.read.parquet(f"{sf}/region.parquet"))
    store.load_session(spark, path, h)
    return _orders_out(h.snapshot(1))


@query("history_delta_revert", f"""SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS o_totalprice, {_ts_sql('o_orderdate')}, o_orderpriority
FROM orders WHERE o_orderkey % 7 <> 0""")
def q_history_delta(spark, sf):
    h = store.History(spark, scratch_path(spark, "history"))
    o = _table(spark, sf, "orders", "o_orderkey")
    first = h.log("Load", "orders", o)
    # a row-wise step is kept as its changed rows and dropped labels
    step = o.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.expr("IF(o_orderstatus = 'P', 0D, o_totalprice)"))
    second = h.log("Clean", "rows dropped, prices emptied", step, since=first)
    h.log("Drop", "everything", step.where("false"), since=second)
    return _orders_out(h.revert(second))


@query("history_list", """SELECT CAST(version AS BIGINT) AS version, action, has_snapshot, rows FROM (VALUES
  (1, 'Load', true, (SELECT count(*) FROM orders)), (2, 'Note', false, NULL),
  (3, 'Clean', true, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')),
  (4, 'Revert', true, (SELECT count(*) FROM orders))) v(version, action, has_snapshot, rows)""")
def q_history_list(spark, sf):
    h = store.History(spark, scratch_path(spark, "history"))
    o = spark.read.parquet(f"{sf}/orders.parquet")
    h.log("Load", "orders", o)
    h.log("Note", "nothing kept")
    h.log("Clean", "finished ones", o.where(F.col("o_orderstatus") == "F"))
    h.revert(1)
    kept = [h.snapshot(v) for v in range(1, 5)]
    sizes = spark.createDataFrame([(v, s.count() if s is not None else None) for v, s in enumerate(kept, 1)],
                                  "version bigint, rows bigint")
    return h.list().join(sizes, "version").select("version", "action", "has_snapshot", "rows")


@query("history_export_import", """SELECT CAST(version AS BIGINT) AS version, action, false AS has_snapshot
FROM (VALUES (1, 'Load'), (2, 'Note')) v(version, action)""")
def q_history_export_import(spark, sf):
    h = store.History(spark, scratch_path(spark, "history"))
    h.log("Load", "orders", spark.read.parquet(f"{sf}/orders.parquet"))
    h.log("Note", "nothing kept")
    other = store.History(spark, scratch_path(spark, "history"))
    other.log("Old", "to be cleared")
    other.import_(h.export())
    return other.list().select("version", "action", "has_snapshot")


@query("forward_fill_null_key", """SELECT event_id, last_value(v IGNORE NULLS) OVER (
  ORDER BY k NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT event_id,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS k,
  CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events)""")
def q_forward_fill_null_key(spark, sf):
    e = _table(spark, sf, "events", "event_id").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("k"),
        F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("v"), ROW_ID)
    return missing.forward_fill(e, ["v"], order_by=["k", "event_id"], rows_per_block=1000).select("event_id", "v")


@query("forward_fill_sentinel", """SELECT event_id, last_value(v IGNORE NULLS) OVER (
  ORDER BY k, event_id ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT event_id,
  CASE WHEN event_id = 1 THEN 4000000000000000 ELSE event_id END AS k,
  CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events)""")
def q_forward_fill_sentinel(spark, sf):
    e = _table(spark, sf, "events", "event_id").select(
        "event_id", F.when(F.col("event_id") == 1, F.lit(4000000000000000)).otherwise(F.col("event_id")).alias("k"),
        F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("v"), ROW_ID)
    return missing.forward_fill(e, ["v"], order_by=["k", "event_id"], rows_per_block=1000).select("event_id", "v")


# --- 2.11 extras --------------------------------------------------------------------------

@query("rename", "SELECT c_custkey AS customer_key, c_name AS name, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
       "c_acctbal AS balance, c_mktsegment FROM customer")
def q_rename(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    c = extras.rename(c, {"c_custkey": "customer_key", "c_name": "name", "c_acctbal": "balance"})
    return c.withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))


@query("convert_types", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, TRY_CAST(o_orderstatus AS BIGINT)
  AS o_orderstatus, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders""")
def q_convert_types(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    o = extras.convert_types(o, {"o_orderkey": "string", "o_orderstatus": "bigint", "o_custkey": "double"})
    return o.select("o_orderkey", "o_orderstatus", "o_custkey")


@query("value_counts", """SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS count FROM orders
GROUP BY o_orderpriority""")
def q_value_counts(spark, sf):
    return extras.value_counts(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderpriority")


@query("histogram", """WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
w AS (SELECT lo, hi, (hi - lo) / 10 AS width FROM s),
c AS (SELECT CAST(least(floor((value - lo) / width), 9) AS INTEGER) + 1 AS bin, count(*) AS n
      FROM events, w WHERE value IS NOT NULL GROUP BY 1)
SELECT b.bin, round(lo + (b.bin - 1) * width, 6) AS lower, round(lo + b.bin * width, 6) AS upper,
  CAST(coalesce(n, 0) AS BIGINT) AS count FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 11)) b
CROSS JOIN w LEFT JOIN c ON b.bin = c.bin""")
def q_histogram(spark, sf):
    h = extras.histogram(spark.read.parquet(f"{sf}/events.parquet"), "value", 10)
    return h.select("bin", _r("lower", 6), _r("upper", 6), "count")


# --- more coverage: row labels, paging arithmetic, heads, predicates ---------------------

@query("with_row_id_key", f"SELECT o_orderkey AS _row_id, {ORDERS_COLS_SQL} FROM orders")
def q_with_row_id(spark, sf):
    o = with_row_id(spark.read.parquet(f"{sf}/orders.parquet"), key="o_orderkey")
    return _orders_out(o, ROW_ID)


@query("table_head", f"SELECT {ORDERS_COLS_SQL} FROM orders ORDER BY o_orderkey LIMIT 5")
def q_table_head(spark, sf):
    return _orders_out(preview.table_head(_table(spark, sf, "orders", "o_orderkey"), 5))


@query("page_count", f"""SELECT CAST(count(*) AS BIGINT) AS total_records,
  CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS pages FROM events
WHERE regexp_matches(event_type, '{EVENTS_FILTER_RE2}', 'i') OR regexp_matches(props, '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(CAST(event_id AS VARCHAR), '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
        ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END, '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(CAST(user_id AS VARCHAR), '{EVENTS_FILTER_RE2}', 'i')
   OR regexp_matches(CAST(value AS VARCHAR), '{EVENTS_FILTER_RE2}', 'i')""")
def q_page_count(spark, sf):
    n = preview.count_matching(preview.global_filter(_table(spark, sf, "events", "event_id"), EVENTS_FILTER))
    return spark.createDataFrame([(n, preview.page_count(n))], "total_records bigint, pages bigint")


@query("duplicates_removed", _with(DUP_ORDERS_SQL) + """SELECT CAST((SELECT count(*) FROM dup_orders)
  - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_orders)) AS BIGINT) AS duplicates_removed""")
def q_duplicates_removed(spark, sf):
    d = dup_orders(spark, sf)
    return spark.createDataFrame([(dedup.duplicates_removed(d, dedup.drop_duplicates(d)),)],
                                 "duplicates_removed bigint")


@query("email_valid", _with(DIRTY_CUSTOMER_SQL) + f"""SELECT c_custkey, email,
  regexp_full_match(email, '{EMAIL_RE2}') AS valid FROM dirty_customer""")
def q_email_valid(spark, sf):
    d = dirty_customer(spark, sf)
    return d.select("c_custkey", "email", tf.email_valid("email").alias("valid"))


@query("format_phone_columns", _with(DIRTY_CUSTOMER_SQL) + f"""SELECT c_custkey, c_name, email,
  regexp_replace(coalesce(phone, ''), '{PHONE_RE2}', '1(\\1)\\2-\\3', 'g') AS phone, segment, c_acctbal,
  CAST(c_nationkey AS BIGINT) AS c_nationkey FROM dirty_customer""")
def q_format_phone_columns(spark, sf):
    return _customer_out(writers.format_phone_columns(dirty_customer(spark, sf)))


@query("calc_backticks", """SELECT c_custkey, round("acct bal" * 2 - c_nationkey, 2) AS "twice bal" FROM
  (SELECT c_custkey, c_acctbal AS "acct bal", c_nationkey FROM customer)""")
def q_calc_backticks(spark, sf):
    c = extras.rename(spark.read.parquet(f"{sf}/customer.parquet"), {"c_acctbal": "acct bal"})
    c = expr.calculated_column(c, "twice bal", "`acct bal` * 2 - c_nationkey")
    return c.select("c_custkey", F.round(F.col("`twice bal`"), 2).alias("twice bal"))


PAGES_PII_TYPES = ["email", "phone", "ssn", "credit_card", "url", "ip_address", "date"]


@query("pii_match_pages", "SELECT page_id, " + ", ".join(
    f"regexp_matches(html, '{PII_PATTERNS[t]}') AS {t}" for t in PAGES_PII_TYPES) + " FROM pages")
def q_pii_match_pages(spark, sf):
    from tablesmith.functions.pii import pii_match
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", *[pii_match("html", t).alias(t) for t in PAGES_PII_TYPES])


@query("pii_scan_pages", _pii_scan_sql("pages", ["url", "html"], PII_TYPES_RE2_SAFE, threshold=1.0))
def q_pii_scan_pages(spark, sf):
    return pii.pii_scan(spark.read.parquet(f"{sf}/pages.parquet"), ["url", "html"], threshold=1.0)


@query("iqr_bounds_multi", """SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3,
  round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound FROM (
  SELECT 'user_id' AS "column", quantile_cont(user_id, 0.25) AS q1, quantile_cont(user_id, 0.75) AS q3 FROM events
  UNION ALL SELECT 'value', quantile_cont(value, 0.25), quantile_cont(value, 0.75) FROM events
  UNION ALL SELECT 'event_id', quantile_cont(event_id, 0.25), quantile_cont(event_id, 0.75) FROM events)""")
def q_iqr_bounds_multi(spark, sf):
    b = outliers.iqr_bounds_frame(_table(spark, sf, "events", "event_id"))
    return b.select("column", _r("q1", 6), _r("q3", 6), _r("lower_bound", 6), _r("upper_bound", 6))


# --- the remaining tables ---------------------------------------------------------------

@query("value_counts_labels", """SELECT CAST(quality AS BIGINT) AS quality, CAST(count(*) AS BIGINT) AS count
FROM labels GROUP BY quality""")
def q_value_counts_labels(spark, sf):
    vc = extras.value_counts(spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    return vc.select(_big("quality"), "count")


@query("pivot_labels", """SELECT CAST(quality AS BIGINT) AS quality,
  CAST(count(doc_id) FILTER (WHERE toxic = 0) AS BIGINT) AS "0",
  CAST(count(doc_id) FILTER (WHERE toxic = 1) AS BIGINT) AS "1" FROM labels GROUP BY quality""")
def q_pivot_labels(spark, sf):
    out = reshape.pivot(spark.read.parquet(f"{sf}/labels.parquet"), "quality", "toxic", "doc_id", "count")
    return out.select(_big("quality"), *[_big(c) for c in out.columns if c != "quality"])


@query("title_case_benchmark", f"SELECT item_id, {_title_sql('text')} AS text FROM benchmark")
def q_title_benchmark(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    return text.title_case(b, ["text"]).select("item_id", "text")


@query("profile_columns_part", """SELECT * FROM (VALUES
  (0, 'p_partkey', (SELECT count(DISTINCT p_partkey) FROM part), (SELECT CAST(count(*) - count(p_partkey) AS BIGINT) FROM part)),
  (1, 'p_name', (SELECT count(DISTINCT p_name) FROM part), (SELECT CAST(count(*) - count(p_name) AS BIGINT) FROM part)),
  (2, 'p_brand', (SELECT count(DISTINCT p_brand) FROM part), (SELECT CAST(count(*) - count(p_brand) AS BIGINT) FROM part)),
  (3, 'p_type', (SELECT count(DISTINCT p_type) FROM part), (SELECT CAST(count(*) - count(p_type) AS BIGINT) FROM part)),
  (4, 'p_size', (SELECT count(DISTINCT p_size) FROM part), (SELECT CAST(count(*) - count(p_size) AS BIGINT) FROM part)),
  (5, 'p_retailprice', (SELECT count(DISTINCT p_retailprice) FROM part), (SELECT CAST(count(*) - count(p_retailprice) AS BIGINT) FROM part)))
  AS t(position, "column", unique_count, null_count)""")
def q_profile_part(spark, sf):
    p = profile.profile_columns(spark.read.parquet(f"{sf}/part.parquet"))
    return p.select(F.col("position").cast("int"), "column", "unique_count", "null_count")


@query("profile_dataset_lineitem", """SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(11 AS BIGINT) AS total_columns,
  CAST(0 AS BIGINT) AS missing_cells,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicate_rows FROM lineitem""")
def q_profile_lineitem(spark, sf):
    return profile.profile_dataset(spark.read.parquet(f"{sf}/lineitem.parquet"))


@query("table_summary_embeddings", """SELECT * FROM (VALUES
  (0, 'vec_id', (SELECT count(vec_id) FROM embeddings), 'bigint'),
  (1, 'embedding', (SELECT count(embedding) FROM embeddings), 'array<float>'),
  (2, 'label', (SELECT count(label) FROM embeddings), 'int')) AS t(position, "column", non_null, dtype)""")
def q_summary_embeddings(spark, sf):
    s = preview.table_summary(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return s.select(F.col("position").cast("int"), "column", F.col("non_null").cast("bigint"), "dtype")


@query("distinct_embeddings", """SELECT 'embedding' AS "column", CAST(count(DISTINCT embedding) AS BIGINT) AS unique_count
FROM embeddings UNION ALL SELECT 'label', CAST(count(DISTINCT label) AS BIGINT) FROM embeddings""")
def q_distinct_embeddings(spark, sf):
    from tablesmith.plans.distinct import distinct_counts
    return distinct_counts(spark.read.parquet(f"{sf}/embeddings.parquet"), ["embedding", "label"])


@query("group_by_supplier_nation", """SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey,
  round(avg(s_acctbal), 4) AS s_acctbal FROM supplier GROUP BY s_nationkey""")
def q_group_supplier(spark, sf):
    out = reshape.group_by(spark.read.parquet(f"{sf}/supplier.parquet"), ["s_nationkey"], "s_acctbal", "mean")
    return out.select(_big("s_nationkey"), _r("s_acctbal", 4))


@query("rename_nation_region", """SELECT CAST(n_nationkey AS BIGINT) AS nation, n_name AS name,
  CAST(n_regionkey AS BIGINT) AS region FROM nation UNION ALL
  SELECT CAST(r_regionkey AS BIGINT), r_name, NULL FROM region""")
def q_rename_nation_region(spark, sf):
    n = extras.rename(spark.read.parquet(f"{sf}/nation.parquet"),
                      {"n_nationkey": "nation", "n_name": "name", "n_regionkey": "region"})
    r = extras.rename(spark.read.parquet(f"{sf}/region.parquet"), {"r_regionkey": "nation", "r_name": "name"})
    return n.select(_big("nation"), "name", _big("region")).unionByName(
        r.select(_big("nation"), "name", F.lit(None).cast("bigint").alias("region")))


# --- streaming: the row-wise cleaners on a Structured Streaming source ----------------------

@query("stream_clean_events", """SELECT event_id, user_id, upper(event_type) AS event_type, value,
  round(value / 10, 6) AS value_10 FROM events WHERE value IS NOT NULL AND props IS NOT NULL""")
def q_stream_clean(spark, sf):
    from tablesmith.streaming import stream
    src = stream.read_stream(spark, f"{sf}/events.parquet")
    cleaned = stream.clean_stream(src, [
        (missing.drop_missing, {"cols": ["value", "props"]}),
        (text.string_op, {"op": "upper", "cols": ["event_type"]}),
        (expr.calculated_column, {"name": "value_10", "expression": "round(value / 10, 6)"}),
    ]).select("event_id", "user_id", "event_type", "value", "value_10")
    out = scratch_path(spark, "stream-out")
    q = stream.write_stream(cleaned, out, scratch_path(spark, "stream-ckpt"))
    if not q.awaitTermination(900):
        q.stop()
        raise TimeoutError("stream_clean_events did not finish its available input")
    return spark.read.parquet(out)


# --- inputs that real tables hold: odd numbers as text, line ends, wide headers ---------------


@query("with_row_id_file", f"""SELECT {ORDERS_COLS_SQL}, row_number() OVER () - 1 AS _row_id FROM orders""")
def q_with_row_id_file(spark, sf):
    o = readers.load(spark, f"{sf}/orders.parquet")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", _ts("o_orderdate"), "o_orderpriority",
                    ROW_ID)


@query("read_csv_letters", """SELECT o_orderkey, concat(CAST(o_orderkey % 100 AS VARCHAR), 'D') AS code,
  CAST(o_orderkey % 7 AS DOUBLE) / 4 AS part FROM orders""")
def q_read_csv_letters(spark, sf):
    path = scratch_path(spark, "letters")
    k = F.col("o_orderkey")
    writers.write_csv(spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", F.concat((k % 100).cast("string"), F.lit("D")).alias("code"),
        ((k % 7).cast("double") / 4).alias("part")), path)
    return readers.read_csv(spark, path)


@query("pivot_discount_header", "SELECT l_returnflag, " + ", ".join(
    f"""round(coalesce(sum(l_quantity) FILTER (WHERE l_discount = {d / 100}), 0), 4) AS "d{d:02d}" """
    for d in range(11)) + " FROM lineitem GROUP BY l_returnflag")
def q_pivot_discount_header(spark, sf):
    out = reshape.pivot(_table(spark, sf, "lineitem"), "l_returnflag", "l_discount", "l_quantity", "sum")
    return out.select("l_returnflag", *[_r(f"`{c}`", 4, f"d{round(float(c) * 100):02d}")
                                        for c in out.columns if c != "l_returnflag"])


@query("group_by_any_boolean", """SELECT o_orderstatus, bool_or(o_totalprice > 300000) AS big_any,
  bool_and(o_totalprice > 300000) AS big_all, CAST(count_if(o_totalprice > 300000) AS BIGINT) AS big_sum,
  true AS text_any FROM orders GROUP BY o_orderstatus""")
def q_group_by_any_boolean(spark, sf):
    o = expr.calculated_column(_table(spark, sf, "orders", "o_orderkey"), "big", "o_totalprice > 300000")
    flags = reshape.group_by(o, ["o_orderstatus"], "big", ["any", "all", "sum"])
    return flags.join(reshape.group_by(o, ["o_orderstatus"], "o_orderpriority", "any"), "o_orderstatus").select(
        "o_orderstatus", "big_any", "big_all", _big("big_sum"), F.col("o_orderpriority").alias("text_any"))


@query("apply_edits_repeat", f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_ts_sql('o_orderdate')},
  CASE WHEN o_orderstatus = 'P' THEN 'SECOND' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def q_apply_edits_repeat(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    edits = o.where(F.col("o_orderstatus") == "P").select(ROW_ID, F.explode(F.array(
        F.struct(F.lit(1).alias("edit_no"), F.lit("ZZZ").alias("o_orderpriority")),
        F.struct(F.lit(2).alias("edit_no"), F.lit("SECOND").alias("o_orderpriority")))).alias("e"))
    return _orders_out(preview.apply_edits(o, edits.select(ROW_ID, "e.*")))


@query("replace_regex_unicode", r"""SELECT doc_id, regexp_replace(text, '[\p{L}\p{M}\p{N}_]+', '#', 'g') AS text
FROM documents""")
def q_replace_regex_unicode(spark, sf):
    d = _table(spark, sf, "documents", "doc_id")
    return text.find_replace(d, r"\w+", "#", ["text"], use_regex=True).select("doc_id", "text")


@query("email_crlf", f"""SELECT c_custkey, regexp_full_match(concat('user', CAST(c_custkey AS VARCHAR), '@mail.example.com',
  CASE WHEN c_custkey % 2 = 0 THEN chr(13) ELSE '' END), '{EMAIL_RE2}') AS valid FROM customer""")
def q_email_crlf(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    mail = F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail.example.com"),
                    F.when(F.col("c_custkey") % 2 == 0, F.lit("\r")).otherwise(F.lit("")))
    return c.select("c_custkey", tf.email_valid(mail).alias("valid"))


@query("global_filter_small_double", """SELECT o_orderkey FROM orders
WHERE contains(CAST(1.0 / CAST(o_orderkey + 1 AS DOUBLE) AS VARCHAR), '33335')""")
def q_global_filter_small_double(spark, sf):
    o = expr.calculated_column(_table(spark, sf, "orders", "o_orderkey"), "inverse", "1.0D / (o_orderkey + 1)")
    return preview.global_filter(o, "33335", ["inverse"]).select("o_orderkey")


@query("floor_div_large", """SELECT o_orderkey, CAST((9007199254740993 + o_orderkey) // 2 AS BIGINT) AS q,
  CAST(-(((o_orderkey + 2) // 3)) AS BIGINT) AS down FROM orders""")
def q_floor_div_large(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey").cast("bigint")
    return o.select("o_orderkey", fm.floor_div(F.lit(9007199254740993) + k, 2).alias("q"),
                    fm.floor_div(-k, 3).cast("bigint").alias("down"))


@query("calc_sql_domain", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL
  ELSE round(sqrt(CAST(o_orderkey AS DOUBLE)), 6) END AS y FROM orders""")
def q_calc_sql_domain(spark, sf):
    o = _table(spark, sf, "orders", "o_orderkey")
    y = "sqrt(CASE WHEN o_orderkey % 2 = 0 THEN -1D - o_orderkey ELSE CAST(o_orderkey AS DOUBLE) END)"
    return expr.calculated_column(o, "y", y).select("o_orderkey", _r("y", 6))


# --- training-data operators: an optional subpackage ----------------------------------------

try:
    import corpus_pipeline
    from tablesmith.llm import queries as llm_queries
except ModuleNotFoundError as e:  # the folder may be left out; a broken import inside it still shows
    if e.name not in ("corpus_pipeline", "tablesmith.llm"):
        raise
else:
    Q.update(llm_queries.Q)
    SQL.update(llm_queries.SQL)
    Q["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


# ---------------------------------------------------------------------------


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["entry", "queries", "oracle_sql"]
