"""

Prints ONE JSON line:
  {"metric": "total_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

without a yardstick row are timed too and listed under ``extra_queries``.

Each query runs its full plan into Spark's ``noop`` sink (everything is
computed, nothing is collected) or, for scalar results, collects one row.
Median of ``BENCH_REPS`` runs (default 3) after one warm-up run.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tablesmith.operators import dedup, expr, missing, outliers, pii, preview, profile, reshape, text  # noqa: E402
from tablesmith.plans.distinct import distinct_counts  # noqa: E402
from tablesmith.session import get_spark  # noqa: E402
from tablesmith.sources import readers  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPS = int(os.environ.get("BENCH_REPS", "3"))


def _sink(df):
    df.write.format("noop").mode("overwrite").save()


def build(spark):
    def t(name, key=None, **kw):
        return readers.load(spark, f"{SF_DIR}/{name}.parquet", row_id_key=key, **kw)

    wide = {"partitions": int(CPUS)}   # one file of one row group: deal its rows out for work per row
    return {
        # read the whole table (all columns) into Spark
        "read_parquet": lambda: _sink(t("lineitem")),
        # keep-first drop of fully duplicated rows
        "drop_duplicates": lambda: _sink(dedup.drop_duplicates(t("lineitem"))),
        # Q1 and Q3 of one column (exact)
        "quartiles": lambda: outliers.iqr_bounds(t("lineitem"), ["l_extendedprice"]),
        # group by two keys, one sum
        "group_by_sum": lambda: reshape.group_by(t("lineitem"), ["l_returnflag", "l_linestatus"],
                                                 "l_quantity", "sum").collect(),
        # global sort by one column
        "sort": lambda: _sink(reshape.sort(t("lineitem"), ["l_extendedprice"])),
        # pivot table, sum
        "pivot_sum": lambda: reshape.pivot(t("lineitem"), "l_returnflag", "l_linestatus",
                                           "l_quantity", "sum").collect(),
        # calculated column (arithmetic) over the whole table
        "calculated_column": lambda: _sink(expr.calculated_column(
            t("lineitem"), "revenue", "l_extendedprice * (1 - l_discount)").select("revenue")),
        # distinct count of every column
        "distinct_every_column": lambda: (lambda li: distinct_counts(li, li.columns).collect())(
            t("lineitem").drop("_row_id")),
        # literal, case-insensitive find/replace over whole texts
        "replace_literal": lambda: _sink(text.find_replace(t("documents", **wide), "the", "THE", ["text"])
                                         .select("text")),
        # str.title() over whole texts
        "title_case": lambda: _sink(text.title_case(t("documents", **wide), ["text"]).select("text")),
        # global filter (any column matches a case-insensitive regex) over three columns
        "global_filter": lambda: preview.global_filter(
            t("events"), "click", ["event_type", "props", "user_id"]).count(),
    }


def build_extra(spark):
    def t(name, key=None):
        return readers.load(spark, f"{SF_DIR}/{name}.parquet", row_id_key=key)

    return {
        # operators without a yardstick row, exercised at the same scale
        "median_per_group": lambda: reshape.group_by(t("lineitem"), ["l_returnflag", "l_linestatus"],
                                                     "l_extendedprice", "median").collect(),
        "forward_fill": lambda: _sink(missing.forward_fill(
            t("events").withColumn("value", F.when(F.col("event_id") % 4 == 0, F.col("value"))),
            ["value"], order_by="event_id")),
        "profile_dataset": lambda: profile.profile_dataset(t("orders")).collect(),
        "pii_scan_documents": lambda: pii.pii_scan(t("documents"), ["text"]).collect(),
    }


def _measure(qs, times, failed):
    for name, fn in qs.items():
        try:
            fn()  # warm-up (JIT, file listing, codegen cache)
            runs = []
            for _ in range(REPS):
                t0 = time.perf_counter()
                fn()
                runs.append(time.perf_counter() - t0)
            times[name] = round(statistics.median(runs), 4)
        except Exception as e:  # noqa: BLE001 - report, keep measuring the rest
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"


def main():
    spark = get_spark(master=f"local[{CPUS}]", shuffle_partitions=int(CPUS))
    times, extra, failed = {}, {}, {}
    _measure(build(spark), times, failed)
    _measure(build_extra(spark), extra, failed)
    m = re.search(r"sf([0-9.]+)", SF_DIR)
    out = {"metric": "total_median_sec", "value": round(sum(times.values()), 4), "unit": "sec",
           "queries": times, "extra_queries": extra, "sf": float(m.group(1)) if m else SF_DIR,
           "cpus": int(CPUS)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
