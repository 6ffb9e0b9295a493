import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablesmith.operators import missing
from tablesmith.operators.rowid import with_row_id


def frame(spark, rows, schema):
    return with_row_id(spark.createDataFrame(rows, schema), key="id")


def col(df, c, order="id"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_ffill_fixture(spark):
    df = frame(spark, [(1, None), (2, 1.0), (3, None), (4, 2.0), (5, None)], "id int, v double")
    assert col(missing.forward_fill(df, ["v"]), "v") == [None, 1.0, 1.0, 2.0, 2.0]
    assert col(missing.backward_fill(df, ["v"]), "v") == [1.0, 1.0, 2.0, 2.0, None]


@pytest.mark.parametrize("block", [1, 3, 17, 1 << 20])
@pytest.mark.parametrize("backward", [False, True])
def test_block_fill_equals_pandas(spark, block, backward):
    rng = random.Random(block + backward)
    rows = [(i, rng.choice([None, None, None, rng.random()]), rng.choice([None, "a", "b"]), rng.randint(0, 3))
            for i in range(400)]
    rng.shuffle(rows)
    df = frame(spark, rows, "id int, v double, s string, g int")
    fn = missing.backward_fill if backward else missing.forward_fill
    got = fn(df, ["v", "s"], order_by="id", rows_per_block=block).orderBy("id").toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "v", "s", "g"]).sort_values("id").reset_index(drop=True)
    exp = pdf[["v", "s"]].bfill() if backward else pdf[["v", "s"]].ffill()
    assert got["v"].tolist() == pytest.approx(exp["v"].tolist(), nan_ok=True)
    assert [None if pd.isna(x) else x for x in got["s"]] == [None if pd.isna(x) else x for x in exp["s"]]
    # grouped variant equals pandas groupby ffill/bfill
    got_g = fn(df, ["v"], order_by="id", partition_by=["g"], rows_per_block=block).orderBy("id").toPandas()
    grp = pdf.groupby("g")["v"]
    exp_g = grp.bfill() if backward else grp.ffill()
    assert got_g["v"].tolist() == pytest.approx(exp_g.tolist(), nan_ok=True)


def test_ffill_idempotent(spark):
    df = frame(spark, [(i, None if i % 3 else float(i)) for i in range(50)], "id int, v double")
    once = missing.forward_fill(df, ["v"], rows_per_block=7)
    twice = missing.forward_fill(once, ["v"], rows_per_block=5)
    assert col(once, "v") == col(twice, "v")


def test_fill_mean_median_types(spark):
    df = frame(spark, [(1, 1, 10.0), (2, None, None), (3, 4, 20.0), (4, 5, 40.0)], "id int, a bigint, b double")
    m = missing.fill_mean(df)
    assert dict(m.dtypes)["a"] == "double"          # gappy int column becomes float, as in pandas
    assert col(m, "a") == [1.0, 10 / 3, 4.0, 5.0]
    assert col(m, "b") == [10.0, 70 / 3, 20.0, 40.0]
    md = missing.fill_median(df, ["b"])
    assert col(md, "b") == [10.0, 20.0, 20.0, 40.0]
    # a column without missing values keeps its type
    full = frame(spark, [(1, 1), (2, 3)], "id int, a bigint")
    assert dict(missing.fill_mean(full).dtypes)["a"] == "bigint"


def test_fill_value_casts_or_skips(spark):
    df = frame(spark, [(1, None, None), (2, 3, "x")], "id int, n bigint, s string")
    got = missing.fill_value(df, "7")
    assert col(got, "n") == [7, 3] and col(got, "s") == ["7", "x"]
    got = missing.fill_value(df, "abc")
    assert col(got, "n") == [None, 3] and col(got, "s") == ["abc", "x"]
    assert missing.fill_value(df, None) is df


def test_drop_missing_and_columns(spark):
    df = frame(spark, [(1, None, "a"), (2, 2, None), (3, 3, "c")], "id int, n int, s string")
    assert col(missing.drop_missing(df, ["n"]), "id") == [2, 3]
    assert col(missing.drop_missing(df), "id") == [3]
    assert "n" in missing.drop_missing_columns(df, 0.5).columns
    assert "n" not in missing.drop_missing_columns(df, 0.2).columns


def test_fill_mode_ties_smallest(spark):
    df = frame(spark, [(1, "b"), (2, "a"), (3, None), (4, "b"), (5, "a")], "id int, s string")
    assert col(missing.fill_mode(df, ["s"]), "s") == ["b", "a", "a", "b", "a"]


def test_handle_missing_dispatch(spark):
    df = frame(spark, [(1, None)], "id int, v double")
    with pytest.raises(ValueError):
        missing.handle_missing(df, "nope")
    assert missing.handle_missing(df, "remove").count() == 0


def test_block_fill_plan_has_no_global_window(spark):
    from conftest import SF01
    e = with_row_id(spark.read.parquet(f"{SF01}/events.parquet"), key="event_id")
    e = e.withColumn("value", F.when(F.col("event_id") % 4 == 0, F.col("value")))
    plan = missing.forward_fill(e, ["value"], order_by="event_id", rows_per_block=1000)._jdf \
        .queryExecution().executedPlan().toString()
    # the window over all rows is partitioned by block; only the small
    # per-block summary (one row per block) is gathered for the carry window
    assert "hashpartitioning(__blk" in plan
    for line in plan.splitlines():
        if "Exchange SinglePartition" in line:
            assert "Aggregate" in plan.split(line, 1)[1].splitlines()[1]


def test_fill_with_text_order_key(spark):
    rows = [(f"k{i:04d}", None if i % 4 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows[::-1], "k string, v double")
    got = [r.v for r in missing.forward_fill(df, ["v"], order_by="k", rows_per_block=9).orderBy("k").collect()]
    exp = pd.Series([v for _, v in rows]).ffill().tolist()
    assert got == pytest.approx(exp, nan_ok=True)


def test_fill_mode_typed_columns(spark):
    import datetime
    t1, t2 = datetime.datetime(2024, 1, 2, 3, 4, 5, 678000), datetime.datetime(2024, 5, 6)
    rows = [(1, 0.1 + 0.2, t1), (2, 0.1 + 0.2, t1), (3, 2.5, t2), (4, None, None)]
    df = frame(spark, rows, "id int, d double, t timestamp")
    got = missing.fill_mode(df, ["d", "t"]).orderBy("id").collect()
    assert got[3].d == 0.1 + 0.2 and got[3].t == t1


def test_modes_of_two_hundred_columns_in_one_job(spark):
    df = spark.range(300).selectExpr("id", *[f"IF(id % 3 = 0, NULL, (id * {k}) % 7) AS c{k}" for k in range(1, 201)])
    plan = missing._modes(df, df.columns[1:])
    assert len(plan) == 200
    pdf = df.toPandas()
    modes = missing.mode_values(df, df.columns[1:])
    assert modes == {c: int(pdf[c].mode().iloc[0]) for c in df.columns[1:]}


def test_modes_of_every_type(spark):
    import datetime
    import decimal
    at = datetime.datetime(2024, 5, 1, 12)
    rows = [(1, 1.5, "x", decimal.Decimal("2.50"), True, at, at.date(), bytearray(b"q"), [1, 2], (1, "a")),
            (2, -2.5, "y", decimal.Decimal("-1.00"), False, at.replace(year=2023), at.date().replace(year=2020), bytearray(b"p"), [1], (0, "z")),
            (None,) * 10]
    df = spark.createDataFrame(rows, "i int, d double, s string, n decimal(10,2), b boolean, t timestamp, y date, x binary, "
                                     "a array<int>, r struct<k:int,v:string>")
    modes = missing.mode_values(df, df.columns)
    assert modes == {"i": 1, "d": -2.5, "s": "x", "n": decimal.Decimal("-1.00"), "b": False, "t": at.replace(year=2023),
                     "y": at.date().replace(year=2020), "x": bytearray(b"p"), "a": [1], "r": (0, "z")}
    filled = missing.fill_mode(df)
    assert filled.dtypes == df.dtypes and filled.where("i IS NULL OR r IS NULL OR t IS NULL").count() == 0


def test_small_blocks_share_tasks(spark):
    from tablesmith.plans import fill
    df = spark.range(2000).repartition(5).selectExpr("id", "IF(id % 300 = 0, id, NULL) AS v")
    tmp = fill.in_blocks(df, ["id"], 4)
    assert len(tmp.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))   # not one a block
    rows = tmp.orderBy("id").select(fill.BLOCK, fill.PLACE).collect()
    assert rows == sorted(rows)
    sizes = tmp.groupBy(fill.BLOCK).count()
    assert sizes.agg(F.max("count")).first()[0] <= 4 and sizes.count() >= 500
    got = missing.backward_fill(df, ["v"], order_by="id", rows_per_block=4).orderBy("id").collect()
    assert [r.v for r in got] == [-(-i // 300) * 300 if i <= 1800 else None for i in range(2000)]


def test_small_blocks_null_and_repeated_keys(spark):
    rows = [(None, 7.0)] * 9 + [(k, None if k % 5 else float(k)) for k in range(60) for _ in range(3)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    got = missing.forward_fill(df, ["v"], order_by="k", rows_per_block=2)
    assert sorted((-1 if r.k is None else r.k, r.v) for r in got.collect()) == sorted(
        (-1 if k is None else k, 7.0 if k is None else float(k - k % 5)) for k, _ in rows)


def test_backward_fill_reads_no_frame_anew_for_every_row(spark):
    df = spark.range(100).selectExpr("id", "IF(id % 7 = 0, id, NULL) AS v")
    plan = missing.backward_fill(df, ["v"], order_by="id")._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
