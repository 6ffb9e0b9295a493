import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablesmith.functions.pii import PII_PATTERNS, pii_match
from tablesmith.operators import pii, profile
from tablesmith.operators.rowid import with_row_id


def test_profile_dataset_and_scores(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, 3.0), (3, "c", 4.0)]
    df = spark.createDataFrame(rows, "k int, s string, v double")
    ds = profile.profile_dataset(df).collect()[0].asDict()
    pdf = pd.DataFrame(rows, columns=["k", "s", "v"])
    assert ds == {"total_rows": 4, "total_columns": 3, "missing_cells": int(pdf.isnull().sum().sum()),
                  "duplicate_rows": int(pdf.duplicated().sum())}
    q = profile.quality_score(df).collect()[0].asDict()
    comp = max(0, 100 - 3 / 12 * 100)
    uniq = max(0, 100 - 1 / 4 * 100)
    assert q["completeness_score"] == round(comp, 2) and q["uniqueness_score"] == round(uniq, 2)
    assert q["overall_score"] == round((comp + uniq + 85 + 90) / 4, 2) and q["band"] == "good"
    recs = profile.quality_recommendations(profile.quality_score(df), True).collect()[0].recommendations
    assert recs == ["Consider handling missing values", "Remove duplicate rows to improve data quality",
                    "PII data detected - consider anonymization"]
    series = {r.label: r["count"] for r in profile.row_quality(profile.profile_dataset(df)).collect()}
    assert series == {"Clean Rows": 3, "Duplicate Rows": 1}
    cells = {r.label: r["count"] for r in profile.cell_quality(profile.profile_dataset(df)).collect()}
    assert cells == {"Valid Cells": 9, "Missing Cells": 3}


def test_score_band_limits(spark):
    df = spark.createDataFrame([(95.0,), (90.0,), (70.0,), (69.99,), (50.0,), (10.0,)], "s double")
    assert [r[0] for r in df.select(profile.score_band("s")).collect()] == \
        ["excellent", "excellent", "good", "fair", "fair", "poor"]


def test_profile_columns_match_pandas(spark):
    rows = [(1, "x", 1.5, True), (2, None, 2.5, False), (3, "x", None, True), (3, "y", 7.0, None)]
    df = spark.createDataFrame(rows, "a bigint, s string, v double, b boolean")
    got = {r.column: r.asDict() for r in profile.profile_columns(df).collect()}
    pdf = pd.DataFrame(rows, columns=["a", "s", "v", "b"])
    for c in ["a", "s", "v", "b"]:
        assert got[c]["unique_count"] == pdf[c].nunique()
        assert got[c]["null_count"] == int(pdf[c].isnull().sum())
        assert got[c]["null_pct"] == round(pdf[c].isnull().sum() / len(pdf) * 100, 2)
    for c in ["a", "v"]:
        d = pdf[c].describe()
        assert got[c]["min"] == d["min"] and got[c]["max"] == d["max"]
        assert got[c]["mean"] == pytest.approx(d["mean"]) and got[c]["std"] == pytest.approx(d["std"])
        assert got[c]["median"] == d["50%"]
    assert got["b"]["mean"] is None and got["s"]["median"] is None     # booleans are not numeric (Q7)


def test_pii_patterns_match_python_re(spark):
    import re
    samples = ["mail me at john.doe@example.com", "call (919) 555-1234 now", "ssn 123-45-6789",
               "card 4111 1111 1111 1111", "see https://example.org/x?y=1", "ip 10.0.0.1",
               "on 12/31/2024 or 2024-01-05", "John Smith met Ana", "nothing here", "élan Été Zoë Ann"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    for t, pat in PII_PATTERNS.items():
        got = [r[0] for r in df.select(pii_match(F.col("t"), t)).collect()]
        assert got == [bool(re.search(pat, s)) for s in samples], t


def test_pii_scan_threshold_and_summary(spark):
    vals = [f"user{i}@mail.com" if i % 10 == 0 else f"word {i}" for i in range(100)]
    df = with_row_id(spark.createDataFrame([(i, v, "plain") for i, v in enumerate(vals)],
                                           "id int, t string, u string"), key="id")
    found = {(r.column, r.pii_type): (r.match_count, r.confidence) for r in pii.pii_scan(df).collect()}
    assert found == {("t", "email"): (10, 10.0)}
    summ = pii.pii_summary(df).collect()
    assert [(r.column, list(r.pii_types), r.confidence, r.high_risk) for r in summ] == [("t", ["email"], 10.0, False)]
    recs = pii.pii_recommendations(pii.pii_summary(df)).collect()[0]
    assert recs.pii_detected and recs.recommendations == ["PII data detected in your dataset",
                                                          "Review data privacy compliance requirements"]
    # the profile's sample: first n non-missing values in row order only
    assert [(r.column, r.match_count, r.confidence) for r in pii.pii_sample(df, n=3).collect()] == [("t", 1, 33.33)]
    assert pii.pii_sample(df, n=10).collect()[0].confidence == 10.0
    assert pii.pii_sample(df.where(F.col("id") > 0), n=9).count() == 0
