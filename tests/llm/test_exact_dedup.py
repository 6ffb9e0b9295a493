import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablesmith.llm import exact_dedup


def brute(rows, best=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = best(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


LONG = "long text " * 300_000
ROWS = ([(i, f"text {i % 37}") for i in range(200)] + [(1000 + i, "hot") for i in range(150)] +
        [(2000, None), (2001, ""), (2002, " "), (2003, "é"), (2004, "é"), (2005, "text 1\n"), (2006, "\x00"),
         (3000, LONG), (3001, LONG), (3002, LONG + "."), (7, "text 7"), (7, "text 7"), (7, "else"),
         (None, "no id"), (None, "hot"), (None, "nobody"), (None, "nobody"), (4000, "no id")])


def frame(spark, rows, parts=23):
    df = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows], "doc_id long, text string, key string, run int, id string")
    return df.repartition(parts)


def test_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)  # 23 runs take five rounds
    found = exact_dedup.duplicate_report(frame(spark, ROWS))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(ROWS)


def test_smallest_and_rows_that_stay(spark):
    df = frame(spark, ROWS)
    found = exact_dedup.exact_duplicates(df, largest=False)
    got = found.select("id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted((r[:4] for r in brute(ROWS, min)), key=str)
    left = exact_dedup.without_copies(df)
    assert left.columns == df.columns
    want = [(i, t) for (i, t) in ROWS if (i, True) in {(r[0], r[3]) for r in brute([(i, t)] + ROWS) if
                                                       r[4] == hashlib.sha256((t or "").encode()).hexdigest()}]
    assert sorted(map(tuple, left.select("doc_id", "text").collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("weak", [lambda t: F.substring(t.cast("binary"), 1, 1), lambda t: F.lit(b"same")])
def test_texts_under_one_key_are_told_apart(spark, weak):
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 100]
    got = exact_dedup.exact_duplicates(frame(spark, rows, 5), key=weak).select("id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted((r[:4] for r in brute(rows)), key=str)


def test_no_rows_and_no_python(spark, capsys):
    empty = frame(spark, [], 1)
    found = exact_dedup.duplicate_report(empty)
    assert found.collect() == [] and exact_dedup.without_copies(empty).collect() == []
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = exact_dedup._rows(docs, "doc_id", "text", exact_dedup.text_key)
    rows = rows.select(F.spark_partition_id().alias("run"), "id", "key")
    runs = exact_dedup._first_runs(rows, F.max)
    exact_dedup._round(runs, F.max).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
    # a round: one range exchange, no further one for its aggregate
    assert plan.count("rangepartitioning(run") == 1
