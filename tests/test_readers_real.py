"""Reading as users do: folders, odd numbers, one large file, line ends inside quotes."""

import os

import pytest

from tablesmith.functions.types import settled
from tablesmith.operators import dedup, missing, outliers, preview, profile, reshape, text
from tablesmith.sources import readers


def test_folder_without_suffix(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "orders")
    spark.range(20).write.parquet(out)
    assert readers.load(spark, out).count() == 20
    texts = os.path.join(tmpdir_path, "lines")
    spark.range(5).selectExpr("id", "'x' AS s").write.option("header", True).option("compression", "gzip").csv(texts)
    assert readers.load(spark, texts).select("id").dtypes == [("id", "bigint")]
    with pytest.raises(ValueError, match="fmt="):
        readers.load(spark, tmpdir_path)


def test_letters_and_numbers(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "a.csv")
    with open(path, "w") as f:
        f.write("code,part,big,flag\n12D,1e3,9007199254740993,true\n3F,.5,-7,False\n")
    df = readers.read_csv(spark, path)
    assert df.dtypes == [("code", "string"), ("part", "double"), ("big", "bigint"), ("flag", "boolean")]
    assert [tuple(r) for r in df.collect()] == [("12D", 1000.0, 9007199254740993, True), ("3F", 0.5, -7, False)]
    typed = readers.read_csv(spark, path, schema="code string, part double, big string, flag string")
    assert typed.first()["big"] == "9007199254740993"


def test_large_file_is_split(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "large.csv")
    with open(path, "w") as f:
        f.write("id,t\n" + "".join(f"{i},{'x' * 90}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        assert readers.read_csv(spark, path).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_row_order_is_kept(spark):
    d = readers.load(spark, "/root/testdata/sf0.01/documents.parquet")
    ids = list(range(1000))
    assert [r.doc_id for r in text.string_op(d, "trim", ["text"]).select("doc_id").collect()] == ids
    assert [r.doc_id for r in preview.global_filter(d, ".", ["text"]).select("doc_id").collect()] == ids


def test_floats_are_filtered_in_the_file_and_their_nan_is_missing(spark, tmpdir_path):
    nan = float("nan")
    path = os.path.join(tmpdir_path, "f.parquet")
    rows = [(1, 5.0), (2, nan), (3, None), (4, -1.0), (5, nan), (6, 7.5), (7, 5.0)]
    spark.createDataFrame(rows, "id int, `a.x` double").coalesce(1).write.parquet(path)
    df = readers.load(spark, path)

    def pushed(d):
        plan = d._jdf.queryExecution().executedPlan().toString()
        return plan[plan.index("PushedFilters"):plan.index("ReadSchema")]

    assert "GreaterThan(`a.x`,4.0)" in pushed(df.where("`a.x` > 4"))
    ids = lambda d: [r.id for r in d.orderBy("id").collect()]
    big = preview.range_filter(df, "a.x", low=0)
    assert ids(big) == [1, 6, 7] and "GreaterThanOrEqual(`a.x`" in pushed(big)
    kept = missing.drop_missing(df, ["a.x"])
    assert ids(kept) == [1, 4, 6, 7] and "IsNotNull(`a.x`)" in pushed(kept)
    assert ids(missing.drop_missing(reshape.sort(df, ["id"]))) == [1, 4, 6, 7]
    # every operator takes NaN for missing, and so does what follows it
    assert [r.id for r in reshape.sort(df, ["a.x"]).collect()] == [4, 1, 7, 6, 2, 3, 5]
    assert [r.id for p in (1, 2, 3) for r in preview.page(df, p, 3, "a.x", "desc").collect()] == [6, 1, 7, 4, 2, 3, 5]
    assert missing.fill_value(df, 0.0, ["a.x"]).where("`a.x` = 0").count() == 3
    assert missing.fill_median(df, ["a.x"]).where("isnan(`a.x`)").count() == 0
    stats = profile.profile_columns(df).where("column = 'a.x'").first()
    assert (stats.null_count, stats.unique_count, stats.median, stats["max"]) == (3, 3, 5.0, 7.5)
    assert outliers.iqr_bounds(df, ["a.x"])["a.x"][:2] == (3.5, 5.625)
    assert dedup.drop_duplicates(df, ["a.x"]).count() == 4
    assert ids(preview.global_filter(df, "nan", ["a.x"])) == []
    assert settled(df).where("isnan(`a.x`)").count() == 0
    with pytest.raises(ValueError, match="nope"):
        preview.range_filter(df, "nope", 1)
