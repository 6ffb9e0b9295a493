"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame functions only.

A document's key joins the SHA-256 of its text, its MD5 and its length in bytes,
so entries merge only where two independent digests and the length agree.

1. Runs: each input partition is a run.  Partial aggregation leaves one entry
   (key, retained id, rows) for each text of a run before anything moves.
2. Rounds: run numbers are divided by ``FAN_IN``, a power of two, until one run
   is left (a binomial tree, ``log2(FAN_IN)`` of its rounds at a time).  A round
   range-partitions the entries by (run, key), sorts them, merges up to FAN_IN
   entries of each key and retains the better id.  A text that a third
   of all rows share has one entry a run, so no round sees a hot key.
3. Verification: the texts of keys that several rows share are compared as they
   are.  Copies collapse before the shuffle (keys with over a thousandth of the
   rows by broadcast of the keys, the others by a shuffle of their texts).  Rows
   whose texts differ under one key are grouped again by their texts.

Defined cases: a null text counts as empty, so null and empty texts are copies
of each other; a null id is never retained over another one, and a group with
null ids only has a null keep_id; rows that repeat a document in full, id and all, are
kept or dropped together and count as rows of their group; ids of any type with
an order; extra columns are left behind; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, scratch, stored
from .components import join_by_key

FAN_IN = 16  # runs that a round merges into one
DIGEST_BYTES = 32


def text_key(text: Column) -> Column:
    """SHA-256, MD5 and length of a text, 56 bytes."""
    data = text.cast("binary")
    length = F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")
    return F.concat(F.unhex(F.sha2(data, 256)), F.unhex(F.md5(data)), F.unhex(length))


def _rows(docs: DataFrame, doc_id: str, text: str, key: Callable[[Column], Column]) -> DataFrame:
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return own.withColumn("key", key(F.col("text")))


def _first_runs(rows: DataFrame, retain: Callable) -> DataFrame:
    """Entries of FAN_IN input partitions each; every partition's own run is made by partial aggregation."""
    run = F.floor(F.col("run") / FAN_IN).cast("int").alias("run")
    return rows.groupBy(run, "key").agg(retain("id").alias("keep"), F.count("*").alias("size"))


def _round(entries: DataFrame, retain: Callable) -> DataFrame:
    """Merge every FAN_IN neighbouring runs: one range exchange, one sort, one pass over equal keys."""
    up = entries.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int"))
    merged = (up.repartitionByRange(partitions(entries.sparkSession), "run", "key")
              .sortWithinPartitions("run", "key"))
    return merged.groupBy("run", "key").agg(retain("keep").alias("keep"), F.sum("size").alias("size"))


def merged_runs(rows: DataFrame, retain: Callable) -> DataFrame:
    """Stored (key, keep, size) over all ``rows`` (stored: run, id, key)."""
    top = rows.agg(F.max("run")).first()[0] or 0
    level = stored(_first_runs(rows, retain), "runs")
    top //= FAN_IN
    while top:
        level = stored(_round(level, retain), "runs")
        top //= FAN_IN
    return level.select("key", "keep", "size")


def _members(texts: DataFrame, several: DataFrame, total: int, by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by key and text of the rows whose key is in ``several`` (key, size).

    As in join_by_key, but copies under a hot key collapse before they move.
    """
    hot = F.col("size") * 1000 > F.lit(total)
    is_hot = F.broadcast(several.where(hot).select("key"))  # at most 1,000 keys
    # always by a shuffle, so that small and large inputs take one plan
    few = texts.join(is_hot, "key", "left_anti").join(several.where(~hot).select("key").hint("merge"), "key")
    many = texts.join(is_hot, "key")
    return many.groupBy(*by).agg(*aggregates).unionByName(few.groupBy(*by).agg(*aggregates))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", largest: bool = True,
                     key: Callable[[Column], Column] = text_key, verify_texts: bool = True) -> DataFrame:
    """Stored id, keep_id, group_size, kept, key of every row of ``docs`` (read up to three times).

    Of equal texts the row with the largest (or smallest) id stays.  ``key`` may be any
    deterministic digest: what it confuses is told apart by the texts.  Without
    ``verify_texts`` keys alone decide, which saves reading and moving texts again.
    """
    retain = F.max if largest else F.min
    with scratch(docs.sparkSession):
        texts = _rows(docs, doc_id, text, key)
        rows = stored(texts.select(F.spark_partition_id().alias("run"), "id", "key"), "digests")
        groups = merged_runs(rows, retain)
        several = stored(groups.where("size > 1"), "several")
        total = rows.count()
        alone = groups.where("size = 1").select(F.col("keep").alias("id"), F.col("keep").alias("keep_id"),
                                                F.col("size").alias("group_size"), "key")
        confused = None
        if verify_texts:
            seen = _members(texts, several, total, ["key", "text"], F.count("*").alias("n"))
            confused = stored(seen.groupBy("key").agg(F.count("*").alias("texts"), F.sum("n").alias("size"))
                              .where("texts > 1"), "confused")
            if confused.isEmpty():
                confused = None
        if confused is not None:
            several = several.join(confused, "key", "left_anti")
        shared = several.withColumn("__n", F.col("size"))
        copies = join_by_key(rows.select("id", "key"), shared, "key", total).select(
            "id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "key")
        out = alone.unionByName(copies)
        if confused is not None:
            own = stored(_members(texts, confused, total, ["key", "text"], retain("id").alias("keep_id"),
                                  F.count("*").alias("group_size")), "told-apart")
            again = texts.join(own, ["key", "text"]).select("id", "keep_id", "group_size", "key")
            out = out.unionByName(again)
        return stored(out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id"))), "exact", keep=True)


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", largest: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = exact_duplicates(docs, doc_id, text, largest)
    gone = found.where("NOT kept").select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct()
    own = text_key(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (own == F.col("__key")), "left_anti")


def duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text)."""
    found = exact_duplicates(docs)
    sha = F.lower(F.hex(F.substring("key", 1, DIGEST_BYTES)))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", sha.alias("text_sha256"))
