import random

import numpy as np
import pytest

from tablesmith.plans import quantile as Q


@pytest.mark.parametrize("widths", [Q.HALF_WIDTHS, (0.01,), (0.0,)])
def test_exact_quantiles_match_numpy(spark, widths, monkeypatch):
    monkeypatch.setattr(Q, "HALF_WIDTHS", widths)       # (0.0,): no bracket is safe, all values are counted
    rng = random.Random(7)
    hot = [5.0] * 700                                  # one value holds a third of the rows
    vals = hot + [round(rng.gauss(0, 10), 2) for _ in range(1300)]
    ints = [rng.randint(-50, 50) for _ in range(2000)]
    rows = [(vals[i], ints[i], None if i % 3 else float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b bigint, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0, 0.333]
    got = Q.quantiles(df, ["a", "b", "c"], probs)
    for name, data in (("a", vals), ("b", ints), ("c", [float(i) for i in range(2000) if i % 3 == 0])):
        exp = np.quantile(np.array(data, dtype=float), probs, method="linear")
        assert got[name] == pytest.approx(list(exp), rel=1e-12, abs=1e-12)


def test_all_null_and_approx(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    got = Q.quantiles(df, ["a", "b"], [0.5])
    assert got == {"a": [None], "b": [1.5]}
    assert Q.quantiles(df, ["b"], [0.5], exact=False)["b"][0] in (1.0, 2.0)


def test_ranks_outside_their_brackets_are_found(spark, monkeypatch):
    honest = Q.brackets
    monkeypatch.setattr(Q, "brackets", lambda row, cols, probs: {
        c: [(10.0, 20.0), (30.5, 30.5)] for c in honest(row, cols, probs)})
    df = spark.range(1000).selectExpr("CAST(id AS double) AS a", "id % 7 AS b")
    assert Q.quantiles(df, ["a", "b"], [0.0, 0.015, 0.5]) == {
        "a": pytest.approx([0.0, 14.985, 499.5]), "b": pytest.approx([0.0, 0.0, 3.0])}


def test_two_scans_for_any_number_of_columns(spark, tmp_path):
    df = spark.range(5000).selectExpr(*[f"CAST(hash(id, {k}) AS double) AS c{k}" for k in range(12)])
    df.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    seen = []
    counted = Q._counted
    row = df.agg(*Q.sketches(df.columns, [0.25, 0.75])).first()

    def once(d, of):
        out = counted(d, of)
        seen.append(out._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return out

    got = Q.from_sketches(df, row, df.columns, [0.25, 0.75], once)
    assert seen == [1]                                  # with the sketches: two
    pdf = df.toPandas()
    for c in df.columns:
        assert got[c] == pytest.approx([pdf[c].quantile(0.25), pdf[c].quantile(0.75)], rel=1e-12)
