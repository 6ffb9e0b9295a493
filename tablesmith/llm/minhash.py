"""b-bit MinHash near-duplicates of documents on word shingles.

A document's set holds its distinct 5-word shingles (words are runs of
anything but ASCII white space, A-Z lower-cased); with fewer words, the whole
sequence as one.  Documents are linked when 100 * intersection >= 75 * union;
components are the closure of the links.

Signatures keep the low 4 bits of 128 minima, packed into longs; bands of four
minima propose candidates, bit counts estimate their similarity corrected for
chance agreement, and full sets confirm the links (see similar.py).  A pair
at the threshold shares no band with probability 5e-6.  Shingles
are compared by 64-bit hashes.

Defined cases: null and empty texts and texts of white space have an empty
set and are linked with nothing; equal sets are one class; repeated rows fall
into one class and get the same component; a null doc_id counts as larger
than all others; extra columns are left behind; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, similar
from .common import scratch, stored
from .components import join_by_key

WORDS = 5
PERCENT = 75


def word_shingles(data, offsets):
    """Hashed 5-word shingles of a batch of texts."""
    starts, ends, bounds = hashing.words(data, offsets)
    values = hashing.mix(hashing.Prefix(data, hashing.BYTE_LOWER).spans(starts, ends))
    return hashing.windows(values, bounds, WORDS)


PLAN = similar.Plan(word_shingles, bands=32, rows=4, percent=PERCENT)


def _grouped(items: DataFrame) -> DataFrame:
    """id, n_shingles, set_hash and component_id of ``items`` (id, text)."""
    rows = stored(similar.features(items, PLAN), "features")
    slim = rows.select("id", "n_shingles", "set_hash")
    sizes = slim.groupBy("set_hash").agg(F.count("*").alias("__n"))
    groups = stored(similar.grouped(rows, items, PLAN).drop("shared").join(sizes, "set_hash"), "sized")
    found = join_by_key(slim, groups, "set_hash", slim.count())
    return found.unionByName(slim.where("set_hash IS NULL").withColumn("component_id", F.col("id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) of ``docs`` (doc_id, text)."""
    with scratch(docs.sparkSession):
        found = _grouped(docs.select(F.col("doc_id").alias("id"), "text"))
        return stored(found.select(
            F.col("id").alias("doc_id"), "n_shingles", "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), "near", keep=True)


def _document(doc_id, text):
    """A document's identity: rows that repeat a doc_id with another text are documents of their own."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.length(text), text).alias("h2"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The first document of each component (smallest doc_id, null last, then by its text's hash), with the
    input's columns; rows that repeat a document in full come once."""
    items = docs.select(_document(F.col("doc_id"), F.col("text")).alias("id"), "text")
    # null ids last: a struct with a null first field would be the smallest
    items = items.select(F.struct(F.col("id.doc_id").isNull().alias("none"), "id.doc_id", "id.h1", "id.h2").alias("id"), "text")
    with scratch(docs.sparkSession):
        found = _grouped(items)
        kept = stored(found.where(F.col("id") == F.col("component_id")).groupBy("id").agg(F.count("*").alias("n")),
                      "kept", keep=True)
    again = kept.where("n > 1").select("id").withColumn("__again", F.lit(True))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       _document(F.col("doc_id"), F.col("text")).alias("own"))
    rows = rows.select("row", F.struct(F.col("own.doc_id").isNull().alias("none"), "own.doc_id", "own.h1", "own.h2").alias("id"))
    rows = rows.join(kept.select("id"), "id", "left_semi")
    if not again.isEmpty():
        rows = rows.join(again, "id", "left")
        rows = rows.where("__again IS NULL").drop("__again").unionByName(
            rows.where("__again").drop("__again").dropDuplicates(["id"]))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
