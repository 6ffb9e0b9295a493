import pytest
from pyspark.sql import functions as F

from conftest import SF01
from tablesmith.operators import dedup, missing, preview, reshape, text
from tablesmith.operators.rowid import with_row_id
from tablesmith.sources import readers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def orders(spark):
    return readers.load(spark, f"{SF01}/orders.parquet", row_id_key="o_orderkey")


def test_page_is_top_k(spark):
    for page_no in (1, 3, 250):
        p = preview.page(orders(spark), page_no, 50, "o_totalprice", "desc")
        assert "TakeOrderedAndProject(limit=50" in plan_of(p)
        assert p.count() == 50


def test_preview_pipeline(spark):
    df = spark.createDataFrame([(i, f"r{i}", "9195551234" if i % 2 else None) for i in range(120)],
                               "id bigint, s string, phone string")
    df = with_row_id(df, key="id")
    out = preview.preview(df, page_no=2, limit=50, sort_by="id", sort_order="desc", filter_val="R1")
    rows = out.collect()
    assert out.columns[0] == "original_index"
    ids = [r.original_index for r in rows]
    expected = sorted([i for i in range(120) if "r1" in f"r{i}"], reverse=True)[50:100]
    assert ids == expected
    assert all(r.phone in ("1(919)555-1234", "") for r in rows)
    assert preview.page_count(0) == 1 and preview.page_count(101, 50) == 3 and preview.clamp_page(9, 101) == 3


def test_global_and_column_filters(spark):
    df = spark.createDataFrame([(1, "Alpha", None), (2, "beta", "x"), (3, None, "ALPHA")], "id int, a string, b string")
    assert sorted(r.id for r in preview.global_filter(df, "alp").collect()) == [1, 3]
    assert sorted(r.id for r in preview.global_filter(df, "^b").collect()) == [2]
    assert sorted(r.id for r in preview.global_filter(df, "nan|none").collect()) == []     # D2
    with pytest.raises(ValueError):
        preview.global_filter(df, "(unclosed")
    flags = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, b boolean")
    assert [r.id for r in preview.global_filter(flags, "^True$").collect()] == [1]
    assert sorted(r.id for r in preview.global_filter(df, "(?P<x>alp)").collect()) == [1, 3]
    assert sorted(r.id for r in preview.column_filter(df, {"a": "ALP", "b": ""}).collect()) == [1]


def test_edits(spark):
    df = with_row_id(spark.createDataFrame([(1, 10), (2, 20)], "id int, v int"), key="id")
    got = {r.id: r.v for r in preview.edit_cell(df, 2, "v", "25").collect()}
    assert got == {1: 10, 2: 25}
    assert {r.id: r.v for r in preview.edit_cell(df, 9, "v", 1).collect()} == {1: 10, 2: 20}
    with pytest.raises(ValueError):
        preview.edit_cell(df, 1, "nope", 1)
    edits = spark.createDataFrame([(1, 11), (3, 33)], "_row_id bigint, v int")
    assert {r.id: r.v for r in preview.apply_edits(df, edits).collect()} == {1: 11, 2: 20}


def test_title_labels_and_summary(spark):
    df = with_row_id(spark.createDataFrame([(1, None)], "order_id int, ship_mode_2x string"))
    assert preview.title_labels(df).columns[:2] == ["Order Id", "Ship Mode 2x"]
    s = {r.column: (r.non_null, r.dtype) for r in preview.table_summary(df).collect()}
    assert s == {"order_id": (1, "int"), "ship_mode_2x": (0, "string")}


def test_no_python_in_plans(spark):
    o = orders(spark)
    plans = [text.title_case(o, ["o_orderpriority"]), missing.drop_missing(o), dedup.drop_duplicates(o, ["o_custkey"]),
             reshape.group_by(o, ["o_orderstatus"], "o_totalprice", "first"),
             preview.global_filter(o, "urgent")]
    for p in plans:
        s = plan_of(p)
        assert "BatchEvalPython" not in s and "ArrowEvalPython" not in s


def test_pushdown_and_pruning(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    p = missing.drop_missing(o.select("o_orderkey", "o_custkey"), ["o_custkey"])
    s = p._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey)]" in s
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in s


def test_subset_dedup_has_partial_aggregate(spark):
    d = spark.read.parquet(f"{SF01}/documents.parquet")
    s = plan_of(dedup.drop_duplicates(with_row_id(d, key="doc_id"), ["text"]))
    assert "partial_min_by" in s


def test_sort_spreads_hot_key(spark):
    # a single hot sort value still splits across range partitions thanks to the row label
    df = with_row_id(spark.range(0, 4000).select(F.col("id"), F.lit(1).alias("k")), key="id")
    sorted_df = reshape.sort(df, ["k"])
    sizes = sorted_df.rdd.glom().map(len).collect()
    assert max(sizes) < 4000


def test_keyless_parquet_load_keeps_pushdown_and_labels(spark, tmpdir_path):
    import os
    li = readers.load(spark, f"{SF01}/lineitem.parquet")
    plan = li.where(F.col("l_linenumber") > 3)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_linenumber,3)" in plan            # not blocked by the row label
    assert li.select("_row_id").distinct().count() == li.count()
    out = os.path.join(tmpdir_path, "multi.parquet")
    spark.read.parquet(f"{SF01}/orders.parquet").repartition(3).write.parquet(out)
    m = readers.load(spark, out)
    ids = [r._row_id for r in m.select("_row_id").collect()]
    assert len(set(ids)) == len(ids) == 15000
    # deterministic: a second load gives the same label to the same row
    again = {r.o_orderkey: r._row_id for r in readers.load(spark, out).select("o_orderkey", "_row_id").collect()}
    assert again == {r.o_orderkey: r._row_id for r in m.select("o_orderkey", "_row_id").collect()}


@pytest.mark.parametrize("page_no", [1, 2, 7, 300, 301])
@pytest.mark.parametrize("sort_by", ["o_totalprice", "o_orderdate", "o_orderstatus", ["o_orderstatus", "o_totalprice"], None])
def test_any_page_equals_offset(spark, page_no, sort_by):
    o = orders(spark).withColumn("o_totalprice", F.expr("IF(o_orderkey % 5 = 0, NULL, o_totalprice)"))
    for order in ("asc", "desc"):
        by = [F.col(c).asc_nulls_last() if order == "asc" else F.col(c).desc_nulls_last()
              for c in ([sort_by] if isinstance(sort_by, str) else sort_by or [])]
        want = [r.o_orderkey for r in o.orderBy(*by, "_row_id").offset((page_no - 1) * 50).limit(50).collect()]
        got = [r.o_orderkey for r in preview.page(o, page_no, 50, sort_by, order).collect()]
        assert got == want and len(got) == (50 if page_no <= 300 else 0)


def test_a_deep_page_reads_its_range_and_writes_keys(spark, monkeypatch):
    written = []
    honest = preview.stored_table
    monkeypatch.setattr(preview, "stored_table", lambda df, name: written.append(df.columns) or honest(df, name))
    plan = plan_of(preview.page(orders(spark), 200, 50, "o_totalprice"))
    assert written == [["__k0", "__label", "__part"]]
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(o_totalprice" in pushed and "LessThanOrEqual(o_totalpric" in pushed


def test_pages_of_odd_keys(spark):
    rows = [(k, [None, float("nan"), 1.5, float("inf"), -0.0][k % 5], bytes([k % 3]), [k % 2]) for k in range(100)]
    df = with_row_id(spark.createDataFrame(rows, "id int, d double, b binary, a array<int>"), key="id")
    for key in ("d", "b", "a"):
        want = [r.id for r in preview.sort_view(df, key, "desc").collect()]
        got = [r.id for p in range(1, 12) for r in preview.page(df, p, 10, key, "desc").collect()]
        assert got == want
    assert preview.page(df.where("false"), 2, 10, "d").collect() == []
    assert preview.page(df, 2, 10, "nope").first().id == 10


def test_row_labels_through_listing_join(spark, tmpdir_path):
    import os
    out = os.path.join(tmpdir_path, "many.parquet")
    spark.read.parquet(f"{SF01}/orders.parquet").repartition(5).write.parquet(out)
    again = {r.o_orderkey: r._row_id for r in readers.load(spark, out).select("o_orderkey", "_row_id").collect()}
    joined = readers.load(spark, out)
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    by_join = {r.o_orderkey: r._row_id for r in joined.select("o_orderkey", "_row_id").collect()}
    assert again == by_join and len(set(by_join.values())) == 15000


def test_title_label_rule():
    # underscores become spaces; an ASCII word character after a word boundary is upper-cased
    cases = {"order_id": "Order Id", "a-b": "A-B", "ship_mode_2x": "Ship Mode 2x", "é_x": "é X",
             "already Title": "Already Title", "__x": "  X"}
    assert {k: preview.title_label(k) for k in cases} == cases


def test_cell_edits_empty_cells_and_keep_the_last(spark):
    df = with_row_id(spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5), (3, "c", 3.5)], "id int, s string, v double"), key="id")
    edits = spark.createDataFrame([(1, "s", None, 2), (1, "s", "x", 1), (2, "v", "7", 1), (2, "v", "bad", 2), (9, "s", "y", 1),
                                   (3, "s", "late", 5), (3, "s", None, 4)], "_row_id long, column string, value string, edit_no int")
    got = {r.id: (r.s, r.v) for r in preview.apply_cell_edits(df, edits).collect()}
    assert got == {1: (None, 1.5), 2: ("b", None), 3: ("late", 3.5)}
    by_order = edits.drop("edit_no").coalesce(1)
    assert {r.id: r.s for r in preview.apply_cell_edits(df, by_order).collect()} == {1: "x", 2: "b", 3: None}
    last = spark.createDataFrame([(1, "z"), (1, "b")], "_row_id long, s string").coalesce(1)
    assert preview.apply_edits(df, last).where("id = 1").first().s == "b"
    with pytest.raises(ValueError, match="nope"):
        preview.apply_cell_edits(df, spark.createDataFrame([(1, "nope", "1")], "_row_id long, column string, value string"))
