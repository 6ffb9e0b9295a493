"""Distinct counts by hash keys, and how often a profile reads its table."""
import datetime
import decimal

from pyspark.sql import functions as F

from tablesmith.operators import profile
from tablesmith.plans import cells, distinct

SCHEMA = ("i int, s string, d double, f float, n decimal(30,2), b boolean, t timestamp, y date, "
          "a array<int>, m map<string,int>, x binary")


def odd_rows():
    at = datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(60):
        rows.append((k % 7, f"t{k % 11}" if k % 5 else None, [0.0, -0.0, 1.5, float("nan"), None][k % 5], float(k % 3),
                     decimal.Decimal(k % 4), k % 2 == 0, at + datetime.timedelta(microseconds=k % 9),
                     (at + datetime.timedelta(days=k % 6)).date(), [k % 3, None] if k % 4 else None,
                     {"k": k % 2}, bytes([k % 8])))
    return rows + rows[:10]


WANT = {"i": 7, "s": 11, "d": 3, "f": 3, "n": 4, "b": 2, "t": 9, "y": 6, "a": 3, "m": 2, "x": 8}


def counts(df):
    return {r["column"]: r["unique_count"] for r in distinct.distinct_counts(df, df.columns).collect()}


def test_every_type(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    assert counts(df) == WANT
    assert counts(df.where("false")) == dict.fromkeys(WANT, 0)


def test_values_that_share_a_key_are_resolved(spark, monkeypatch):
    honest = cells.keys

    def weak(df, name):     # texts of one length share a key
        a, b = honest(df, name)
        return (F.octet_length(F.col(name)).cast("long"), b) if name in ("s", "x") else (a, b)

    monkeypatch.setattr(cells, "keys", weak)
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    assert counts(df) == WANT
    monkeypatch.setattr(distinct, "row_key", lambda df, cols: (F.lit(1).cast("long"), F.xxhash64(*cols[:2])))
    a, b = distinct.row_key(df, ["i", "s"])
    grouped = df.select(a.alias("a"), b.alias("b")).groupBy("a").agg(
        F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n"))
    want = df.count() - df.select("i", "s").distinct().count()
    assert distinct.repeated_rows(df, ["i", "s"], grouped) == want > 0


def test_texts_are_no_shuffle_key(spark, tmp_path):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    found = cells.unpivoted(df, [dict(zip("ab", cells.keys(df, c))) for c in df.columns])
    plan = found.groupBy("slot", "a").agg(F.min("b"), F.max("b"))._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.split("\n") if "Exchange" in line)
    assert "hashpartitioning(slot" in exchange and "a#" in exchange and "Generate" not in plan and "Expand" in plan
    assert dict(found.dtypes) == {"slot": "int", "a": "bigint", "b": "bigint"}


def test_a_profile_reads_its_table_twice(spark, tmp_path):
    spark.createDataFrame(odd_rows(), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/t")
    reads = spark.sparkContext.accumulator(0)

    def note(batches):
        reads.add(1)
        yield from batches

    df = spark.read.parquet(f"{tmp_path}/t").drop("m")
    noted = df.mapInArrow(note, df.schema)
    facts, found, middle, repeated = profile.statistics(noted, [0.5], rows=True)
    assert reads.value == 2
    assert found == {c: n for c, n in WANT.items() if c != "m"} and repeated == 10
    assert middle["i"] == [3.0] and facts["__rows"] == 70
    before = reads.value
    assert profile.profile_dataset(noted).first()["duplicate_rows"] == 10
    assert reads.value == before + 1
