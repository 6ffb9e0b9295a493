import json
import os

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import preview
from tablesmith.sources import readers, store, writers

CSV = 'id,name,score,flag,code,day,note\n1,ann,1.5,True,007,2024-01-02,"multi\nline ""quoted"""\n' \
      '2,NA,n/a,False,12,2024-01-03,\n3,,2.5,True,,2024-01-04,plain\n'


def test_read_csv_pandas_semantics(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.csv")
    with open(p, "w") as f:
        f.write(CSV)
    df = readers.load(spark, p)
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["score"] == "double" and types["flag"] == "boolean"
    assert types["code"] == "bigint" and types["day"] == "string" and "_row_id" in df.columns
    rows = {r.id: r for r in df.collect()}
    assert rows[1].code == 7 and rows[1].note == 'multi\nline "quoted"'
    assert rows[2].name is None and rows[2].score is None and rows[3].name is None and rows[2].note is None
    tsv = os.path.join(tmpdir_path, "a.tsv")
    with open(tsv, "w") as f:
        f.write("a\tb\n1\tx y\nNA\tz\n")
    t = readers.load(spark, tsv)
    assert [(r.a, r.b) for r in t.orderBy("_row_id").collect()] == [(1, "x y"), (None, "z")]


def test_load_dispatch(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.PARQUET")
    spark.createDataFrame([(1, [1, 2], None)], "a int, arr array<int>, d decimal(10,2)").write.parquet(p)
    assert readers.load(spark, p).count() == 1
    with pytest.raises(ValueError):
        readers.load(spark, os.path.join(tmpdir_path, "a.xyz"))
    j = os.path.join(tmpdir_path, "a.json")
    with open(j, "w") as f:
        f.write('{"a": 1, "s": "1", "o": {"x": [1, 2]}, "d": "2024-01-01"}\n{"a": 2}\n')
    df = readers.load(spark, j)
    assert dict(df.dtypes)["s"] == "string" and df.count() == 2


def test_writers_roundtrip_and_export(spark, tmpdir_path):
    df = spark.createDataFrame([(1, " padded ", "(919) 555-0012", float("nan")), (2, None, None, 2.0)],
                               "id bigint, name string, phone string, v double")
    out = writers.export(df, os.path.join(tmpdir_path, "out.txt"), "csv")
    assert out.endswith("out.csv")
    back = {r.id: r for r in readers.read_csv(spark, out).collect()}
    assert back[1].name == " padded " and back[1].phone == "(1(919)555-0012" and back[2].phone is None
    js = os.path.join(tmpdir_path, "o.json")
    writers.write_json(df, js)
    again = readers.read_json_lines(spark, js)
    assert again.count() == 2 and "name" in again.columns
    with pytest.raises(ValueError):
        writers.export(df, os.path.join(tmpdir_path, "x"), "xlsx")


def test_json_safe_fixture(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (float("nan"),)], "v double")
    assert [r.v for r in store.json_safe(df).collect()] == [1.0, None, None, None]
    ts = spark.sql("SELECT TIMESTAMP'2024-01-02 03:04:05.678' AS t, INTERVAL '1' DAY AS d")
    r = store.json_safe(ts).collect()[0]
    assert r.t == "2024-01-02T03:04:05" and isinstance(r.d, str)


def test_session_roundtrip_and_history(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "id bigint, s string, v double")
    meta = store.save_session(df, os.path.join(tmpdir_path, "sess"), "x.csv")
    assert meta["shape"] == {"rows": 2, "cols": 3} and meta["version"] == 1
    back, m2 = store.load_session(spark, os.path.join(tmpdir_path, "sess"))
    assert sorted(back.collect()) == sorted(df.collect()) and back.schema == df.schema
    with open(os.path.join(tmpdir_path, "bad.json"), "w") as f:
        json.dump({"nope": 1}, f)
    with pytest.raises(ValueError):
        store.load_session(spark, os.path.join(tmpdir_path, "missing"))
    h = store.History(spark, os.path.join(tmpdir_path, "hist"))
    v1 = h.log("Load", "first", df)
    h.log("Edit", "changed", preview.edit_cell(df.withColumn("_row_id", F.col("id")), 1, "s", "z"))
    assert [r.version for r in h.list().collect()] == [2, 1]
    assert sorted(h.revert(v1).collect()) == sorted(df.collect())
    assert [r.action for r in h.list().collect()][0] == "Revert"
    assert h.snapshot(99) is None
    exported = h.export()
    h.import_(exported)
    assert h.list().count() == 3 and h.snapshot(1) is None      # snapshots are not imported


def test_csv_type_inference_matches_pandas(spark, tmpdir_path):
    import io

    import pandas as pd
    text_ = "a,b,c,d,e,f,g\n1.5,1.0, 7 ,1e3,+5,True,2024-01-02\n2,2,8,2e3,6,False,2024-01-03\n,NA,9,,7,,\n"
    p = os.path.join(tmpdir_path, "types.csv")
    with open(p, "w") as f:
        f.write(text_)
    got = dict(readers.read_csv(spark, p).dtypes)
    kinds = {"float64": "double", "int64": "bigint", "bool": "boolean", "object": "string"}
    exp = {c: kinds[str(t)] for c, t in pd.read_csv(io.StringIO(text_)).dtypes.items()}
    # pandas holds a gappy int column as float and a gappy bool column as object;
    # Spark keeps NULLs in bigint / boolean columns
    exp.update({"c": "bigint", "e": "bigint", "f": "boolean"})
    assert got == exp


def test_two_writers_keep_both_entries(spark, tmpdir_path):
    from concurrent.futures import ThreadPoolExecutor
    base = os.path.join(tmpdir_path, "shared")
    first = store.History(spark, base)
    first.log("Load", "start")
    late = store.History(spark, base)
    late._next_version = lambda: 1            # reads the entries before the other one writes
    assert late.log("Clean", "late") == 2
    with ThreadPoolExecutor(4) as pool:
        taken = list(pool.map(lambda k: store.History(spark, base).log("Step", str(k)), range(4)))
    versions = [r.version for r in first.entries().collect()]
    assert sorted(versions) == [1, 2, 3, 4, 5, 6] and sorted(taken) == [3, 4, 5, 6]


def test_snapshots_as_changes(spark, tmpdir_path):
    from tablesmith.operators.rowid import with_row_id
    h = store.History(spark, os.path.join(tmpdir_path, "delta"))
    h.FULL_EVERY = 3
    df = with_row_id(spark.range(1000).selectExpr("id", "CAST(id AS string) AS s", "map('k', id) AS m"), key="id")
    versions, states, last = [], [], None
    for k in range(6):
        if k:
            df = df.where(F.col("id") != k).withColumn("s", F.expr(f"IF(id = {100 + k}, NULL, s)"))
            df = df.unionByName(with_row_id(spark.range(5000 + k, 5001 + k).selectExpr("id", "'new' AS s", "map('k', id) AS m"), key="id"))
        last = h.log("Step", str(k), df, since=last)
        versions.append(last)
        states.append(sorted((r.id, r.s, r.m["k"]) for r in df.collect()))
    held = {r.version: r.since for r in h.entries().collect()}
    assert [held[v] for v in versions] == [None, 1, 2, None, 4, 5]
    changed = spark.read.parquet(f"{h.base}/snapshots/v=2/changed")
    assert sorted(r.id for r in changed.collect()) == [101, 5001]          # bytes follow the change
    for v, want in zip(versions, states):
        assert sorted((r.id, r.s, r.m["k"]) for r in h.snapshot(v).collect()) == want
    back = h.revert(2)
    assert sorted((r.id, r.s, r.m["k"]) for r in back.collect()) == states[1]
    assert h.snapshot(7).count() == back.count() and h.snapshot(99) is None
    other = h.log("Columns", "other columns", df.drop("m"), since=6)
    assert h.entries().where(F.col("version") == other).first().since is None
