"""Delimited text whose quoted fields hold line ends, read by many tasks.

A line end belongs to a field if the quotes before it are odd in number, so a split
cannot tell by itself which of its line ends close a record.  Quote parity is a
prefix sum, though:

1. One pass counts the lines with an odd number of quotes in every split (one small row each).
2. A running exclusive-or over the splits of a file gives each split the parity it starts
   with, and the split in which a record that reaches into it began.
3. Inside a split a running sum gives every line its parity.  Lines that open and close
   on even parity are records; the others are joined to their record, which may begin some splits before.

Line ends inside fields become ``\\n``, as in Spark's own reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "block"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block (the split's offset), at (order of the lines) and odd (quotes of the line, modulo 2)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), (quotes % 2).cast("int").alias("odd"))


def split_facts(text: DataFrame) -> list:
    """One row per split of lines(): n_odd, and whether its last line is odd."""
    return text.groupBy(*SPLIT).agg(F.sum("odd").alias("n_odd"), F.max_by("odd", "at").alias("last_odd")).collect()


def split_starts(facts: list) -> list[tuple]:
    """(file, block, parity at its start, split in which the record before its first own one begins)."""
    out, file, parity, origin = [], None, 0, None
    for r in sorted(facts, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, parity, origin = r["file"], 0, r["block"]
        out.append((file, r["block"], parity, origin))
        # a record begins here unless a field that is open at the start stays open up to the last line
        if parity == 0 or r["n_odd"] - r["last_odd"] >= 1:
            origin = r["block"]
        parity ^= r["n_odd"] % 2
    return out


def records(text: DataFrame, facts: list) -> DataFrame:
    """value, at (of its first line) and top (it is its file's first) of every record, those of several lines included."""
    starts = text.sparkSession.createDataFrame(split_starts(facts), "file string, block bigint, parity int, origin bigint")
    own = Window.partitionBy(*SPLIT)
    before = own.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = text.join(starts, SPLIT)
    rows = rows.withColumn("opens", ((F.col("parity") + F.coalesce(F.sum("odd").over(before), F.lit(0))) % 2 == 0).cast("int"))
    # records are numbered from a split's end, so that the one that leaves it has number 0
    rows = rows.withColumn("begun", F.sum("opens").over(upto)).withColumn("left", F.sum("opens").over(own) - F.col("begun"))
    rows = rows.withColumn("top", (F.col("block") == 0) & (F.count("*").over(upto) == 1))
    alone = (F.col("opens") == 1) & (F.col("odd") == 0)
    inner = F.col("begun") > 0
    parts = rows.where(~alone).select(
        "file", F.when(inner, F.col("block")).otherwise(F.col("origin")).alias("from"),
        F.when(inner, F.col("left")).otherwise(F.lit(0)).alias("no"), F.struct("block", "at", "value").alias("line"), "top")
    joined = parts.groupBy("file", "from", "no").agg(
        F.array_sort(F.collect_list("line")).alias("l"), F.max("top").alias("top")).select(
        F.array_join("l.value", "\n").alias("value"), F.col("l")[0]["at"].alias("at"), "top")
    return rows.where(alone).select("value", "at", "top").unionByName(joined)
