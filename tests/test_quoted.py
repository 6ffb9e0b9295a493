"""Delimited files with line ends inside quoted fields."""
import os
import random

import pandas as pd
import pytest

from tablesmith.sources import quoted, readers


def text_of(seed, n=3000):
    rng = random.Random(seed)
    fields = ["plain", "two\nlines", 'a "quote"', "many\n\n\nlines, and commas", "", "x" * 50, '"', "\n", "long\n" * 40]
    rows = [(k, rng.choice(fields), rng.choice([1.5, None]), rng.choice(fields)) for k in range(n)]
    return pd.DataFrame(rows, columns=["id", "a b", "v", "z"])


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


@pytest.mark.parametrize("sep,seed", [(",", 1), ("\t", 2)])
def test_one_large_file_is_read_by_many_tasks(spark, tmpdir_path, small_splits, sep, seed):
    want = text_of(seed)
    path = os.path.join(tmpdir_path, "t.csv")
    want.to_csv(path, index=False, sep=sep)
    df = readers.load(spark, path, sep=sep, fmt="txt")
    assert quoted.lines(spark, path).rdd.getNumPartitions() > 10
    assert df.dtypes[:4] == [("id", "bigint"), ("a b", "string"), ("v", "double"), ("z", "string")]
    got = [tuple(r)[:4] for r in df.orderBy("_row_id").collect()]
    want = want.astype(object).where(want.notna() & (want != ""), None)
    assert got == [tuple(r) for r in want.itertuples(index=False)]
    typed = readers.read_txt(spark, path, sep=sep, schema="id int, a string, v float, z string")
    assert typed.dtypes == [("id", "int"), ("a", "string"), ("v", "float"), ("z", "string")] and typed.count() == 3000


def test_a_field_over_many_splits(spark, tmpdir_path, small_splits):
    long = "\n".join(f"line {k}" for k in range(6000))
    folder = os.path.join(tmpdir_path, "f")
    os.mkdir(folder)
    for k in range(2):
        pd.DataFrame({"k": [2 * k, "k"], "t": [long, "t"]}).to_csv(f"{folder}/{k}.csv", index=False)  # a row like the header
    got = sorted(tuple(r) for r in readers.read_csv(spark, folder).collect())
    assert got == [("0", long), ("2", long), ("k", "t"), ("k", "t")]


def test_parity_of_splits():
    facts = [{"file": "f", "block": b, "n_odd": n, "last_odd": last} for b, n, last in
             [(0, 1, 0), (10, 0, 0), (20, 1, 1), (30, 2, 1), (40, 1, 0), (50, 2, 0)]]
    assert quoted.split_starts(facts) == [("f", 0, 0, 0), ("f", 10, 1, 0), ("f", 20, 1, 0), ("f", 30, 0, 0),
                                          ("f", 40, 0, 30), ("f", 50, 1, 40)]
