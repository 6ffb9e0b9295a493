import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from tablesmith.operators import dedup, expr, missing, text
from tablesmith.streaming import stream


def test_stream_clean_to_parquet(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    spark.read.parquet(f"{SF001}/customer.parquet").write.parquet(src)
    s = stream.read_stream(spark, src)
    cleaned = stream.clean_stream(s, [
        (text.string_op, {"op": "title", "cols": ["c_mktsegment"]}),
        (expr.calculated_column, {"name": "bal_k", "expression": "c_acctbal / 1000"}),
        (missing.drop_missing, {"cols": ["c_name"]}),
    ])
    out = os.path.join(tmpdir_path, "out")
    q = stream.write_stream(cleaned, out, checkpoint=os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    batch = spark.read.parquet(f"{SF001}/customer.parquet")
    assert got.count() == batch.count()
    assert sorted(r.c_mktsegment for r in got.select("c_mktsegment").distinct().collect()) == \
        sorted({r[0].title() for r in batch.select("c_mktsegment").collect()})
    with pytest.raises(ValueError):
        stream.clean_stream(s, [(dedup.drop_duplicates, {})])


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["l_returnflag", "l_linestatus", "revenue"]
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 100
    no_oracle = sorted(set(qs) - set(sql))
    # the optional subpackage's queries are tested in its own folder
    assert [n for n in no_oracle if not n.startswith("op") and n != "pipeline"] == []


@pytest.mark.parametrize("name", ["group_by_median", "forward_fill_blocks", "pivot_sum", "dedup_subset_first"])
def test_selected_queries_run_at_sf001(spark, name):
    import __spark_entry__ as E
    assert E.queries()[name](spark, SF01).count() > 0


def test_stream_safe_text_operators_match_batch(spark, tmpdir_path):
    from tablesmith.operators import preview
    from tablesmith.sources.writers import format_phone_columns
    src = os.path.join(tmpdir_path, "cust")
    base = spark.read.parquet(f"{SF01}/customer.parquet").select(
        "c_custkey", "c_name", F.concat(F.lit("user"), F.col("c_custkey").cast("string"),
                                        F.when(F.col("c_custkey") % 3 == 0, F.lit(" at mail"))
                                        .otherwise(F.lit("@mail.example.com"))).alias("email"),
        F.concat(F.lit("919555"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")).alias("phone"))
    base.write.parquet(src)
    steps = [
        (preview.global_filter, {"pattern": "customer#0000001"}),
        (text.find_replace, {"find": "customer", "replace": "client", "cols": ["c_name"]}),
        (text.validate_emails, {"cols": ["email"], "action": "clear"}),
        (format_phone_columns, {}),
    ]
    out = os.path.join(tmpdir_path, "out")
    q = stream.write_stream(stream.clean_stream(stream.read_stream(spark, src), steps), out,
                            checkpoint=os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(120)
    batch = base
    for fn, kw in steps:
        batch = fn(batch, **kw)
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())


def test_row_id_key_query_returns_whole_orders(spark, tmpdir_path):
    import __spark_entry__ as E
    rows = [(7, 1, "O", 2.5, "1-URGENT"), (None, 2, "F", None, None), (3, None, "P", 1.0, "5-LOW")]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                                         "o_totalprice double, o_orderpriority string")
    orders.withColumn("o_orderdate", F.expr("TIMESTAMP_NTZ '2024-05-06 07:08:09'")).write.parquet(
        os.path.join(tmpdir_path, "orders.parquet"))
    got = E.queries()["with_row_id_key"](spark, tmpdir_path)
    assert got.columns == ["_row_id", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                           "o_orderpriority"]
    at = "2024-05-06 07:08:09.000000"
    assert set(map(tuple, got.collect())) == {(k, k, c, s, t, at, p) for k, c, s, t, p in rows}
