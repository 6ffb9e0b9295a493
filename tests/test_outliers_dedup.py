import random

import numpy as np
import pandas as pd
import pytest

from tablesmith.operators import dedup, outliers
from tablesmith.operators.rowid import with_row_id


def test_cap_fixture(spark):
    df = with_row_id(spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 3, 4, 100])], "id int, v bigint"),
                     key="id")
    out = outliers.outliers_cap(df, ["v"])
    assert [r.v for r in out.orderBy("id").collect()] == [1, 2, 3, 4, 7]
    assert dict(out.dtypes)["v"] == "bigint"      # integral bound keeps the integer type


def test_cap_fractional_becomes_double(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 100]], "v bigint")
    out = outliers.outliers_cap(df, ["v"])
    assert dict(out.dtypes)["v"] == "double"
    s = pd.Series([1, 2, 3, 4, 5, 100])
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert sorted(r.v for r in out.collect()) == sorted(s.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))


def test_remove_is_sequential_like_pandas(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1) * (10 if i % 17 == 0 else 1), rng.gauss(5, 2) + (50 if i % 23 == 0 else 0))
            for i in range(500)]
    df = with_row_id(spark.createDataFrame(rows, "id int, a double, b double"), key="id")
    got, affected = outliers.outliers_remove(df, ["a", "b"], with_count=True)
    pdf = pd.DataFrame(rows, columns=["id", "a", "b"])
    n_aff = 0
    for c in ["a", "b"]:
        q1, q3 = pdf[c].quantile(0.25), pdf[c].quantile(0.75)
        m = (pdf[c] < q1 - 1.5 * (q3 - q1)) | (pdf[c] > q3 + 1.5 * (q3 - q1))
        n_aff += int(m.sum())
        pdf = pdf[~m]
    assert sorted(r.id for r in got.collect()) == sorted(pdf["id"])
    assert affected == n_aff


def test_nullify_and_zscore(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    df = with_row_id(spark.createDataFrame(list(enumerate(vals)), "id int, v double"), key="id")
    got = [r.v for r in outliers.outliers_nullify(df, ["v"]).orderBy("id").collect()]
    assert got == [1.0, 2.0, 3.0, 4.0, None, None]
    const = with_row_id(spark.createDataFrame([(0, 1.0), (1, 1.0)], "id int, v double"), key="id")
    assert outliers.zscore_outliers(const, "v").count() == 0
    big = with_row_id(spark.createDataFrame([(i, 0.0) for i in range(30)] + [(99, 50.0)], "id int, v double"),
                      key="id")
    assert [r._row_id for r in outliers.zscore_outliers(big, "v").collect()] == [99]
    with pytest.raises(ValueError):
        outliers.handle_outliers(df, "explode")


def test_iqr_bounds_match_pandas(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=999), 3)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    q1, q3, lo, hi = outliers.iqr_bounds(df, ["v"])["v"]
    s = pd.Series(v)
    assert (q1, q3) == pytest.approx((s.quantile(0.25), s.quantile(0.75)), rel=1e-12)
    assert lo == pytest.approx(q1 - 1.5 * (q3 - q1)) and hi == pytest.approx(q3 + 1.5 * (q3 - q1))


def test_dedup_keep_first_and_idempotent(spark):
    rows = [(1, "a", 1), (2, "b", 2), (3, "a", 3), (4, None, 4), (5, None, 5), (6, "b", 6)]
    df = with_row_id(spark.createDataFrame(rows, "id int, t string, x int"), key="id")
    got = sorted((r.id, r.t) for r in dedup.drop_duplicates(df, ["t"]).collect())
    assert got == [(1, "a"), (2, "b"), (4, None)]            # missing equals missing
    once = dedup.drop_duplicates(df, ["t"])
    assert sorted(once.collect()) == sorted(dedup.drop_duplicates(once, ["t"]).collect())
    full = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, t string")
    assert dedup.drop_duplicates(full).count() == 3
    assert dedup.count_duplicates(full).collect()[0].duplicate_rows == 2


def test_dedup_partition_count_invariance(spark):
    rows = [(i, i % 7, f"t{i % 5}") for i in range(200)]
    base = with_row_id(spark.createDataFrame(rows, "id int, g int, t string"), key="id")
    a = sorted(dedup.drop_duplicates(base.repartition(1), ["g", "t"]).collect())
    b = sorted(dedup.drop_duplicates(base.repartition(8), ["g", "t"]).collect())
    assert a == b and len(a) == 35


def test_duplicate_rows_exact(spark):
    from tablesmith.plans import duplicates
    rng = random.Random(5)
    rows = [(rng.randint(0, 30), rng.choice(["a", "b", None]), rng.choice([1.5, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, s string, v double")
    pdf = pd.DataFrame(rows, columns=["k", "s", "v"])
    assert duplicates.duplicate_rows(df, ["k", "s", "v"]) == int(pdf.duplicated().sum())
    assert duplicates.duplicate_rows(df, ["k"]) == int(pdf.duplicated(subset=["k"]).sum())
    uniq = spark.range(0, 1000).selectExpr("id", "cast(id as string) AS t")
    assert duplicates.duplicate_rows(uniq, ["id", "t"]) == 0


def test_dedup_hash_plan_equals_direct(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 40), rng.choice(["a", "b", None])) for i in range(500)]
    df = with_row_id(spark.createDataFrame(rows, "id int, g int, t string"), key="id")
    for subset in (["g", "t"], ["g"], None):
        a = sorted(dedup.drop_duplicates(df, subset).collect())
        b = sorted(dedup._drop_duplicates_direct(df, subset).collect())
        assert a == b
    uniq = with_row_id(spark.range(0, 100).selectExpr("cast(id as int) AS id"), key="id")
    assert dedup.drop_duplicates(uniq, ["id"]).count() == 100


def test_cap_leaves_no_outlier_against_same_bounds(spark):
    rng = random.Random(21)
    vals = [rng.gauss(0, 1) * (25 if i % 13 == 0 else 1) for i in range(700)]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    _, _, lo, hi = outliers.iqr_bounds(df, ["v"])["v"]
    capped = [r.v for r in outliers.outliers_cap(df, ["v"]).collect()]
    assert all(lo <= v <= hi for v in capped) and len(capped) == len(vals)
    assert outliers.outlier_counts(outliers.outliers_cap(df, ["v"]), {"v": (None, None, lo, hi)})["v"] == (0, 0)


def test_interval_columns_are_skipped_by_numeric_defaults(spark):
    from tablesmith.operators import missing
    df = spark.sql("SELECT id, CAST(id AS DOUBLE) AS v, make_dt_interval(0, 0, 0, id) AS d FROM range(20)")
    assert set(outliers.iqr_bounds(df)) == {"id", "v"}
    assert outliers.outliers_cap(df).count() == 20
    assert missing.fill_mean(df).count() == 20


def test_handle_outliers_dispatch_counts(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0, -50.0, None]
    df = with_row_id(spark.createDataFrame(list(enumerate(vals)), "id int, v double"), key="id")
    capped, n_cap = outliers.handle_outliers(df, "cap", ["v"])
    nulled, n_null = outliers.handle_outliers(df, "nullify", ["v"])
    removed, n_rem = outliers.handle_outliers(df, "remove", ["v"])
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    expected = int(((s < lo) | (s > hi)).sum())
    assert n_cap == n_null == n_rem == expected
    assert sorted(r.v for r in capped.collect() if r.v is not None) == sorted(s.dropna().clip(lo, hi))
    assert removed.count() == len(vals) - expected


def test_outliers_of_four_columns_read_the_table_once(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({c: rng.standard_t(2, 2000) * k for k, c in enumerate("abcd", 1)})
    reads = spark.sparkContext.accumulator(0)

    def note(batches):
        reads.add(1)
        yield from batches

    df = spark.createDataFrame(pdf).coalesce(1)
    noted = df.mapInArrow(note, df.schema)
    got, affected = outliers.outliers_remove(noted, with_count=True)
    assert reads.value == 1
    left = pdf
    for c in "abcd":
        q1, q3 = left[c].quantile(0.25), left[c].quantile(0.75)
        left = left[(left[c] >= q1 - 1.5 * (q3 - q1)) & (left[c] <= q3 + 1.5 * (q3 - q1))]
    assert affected == len(pdf) - len(left) > 100
    assert sorted(got.toPandas()["a"]) == sorted(left["a"])
