"""Repeated windows of sequences: content-defined runs and their first occurrences.

A window (so many bytes or words) belongs to its minimizer, the least hashed
gram inside it; windows in a row with one minimizer form a run.  Equal windows
have equal minimizers, so repeats are found among runs with the same
minimizer, and equal runs are settled as a whole.

Places are (doc, place): ``place`` holds 32 bits of the text's hash above the
position, so rows that repeat a doc_id with another text stay apart, and rows
repeated in full are one document.  An earlier place is a smaller (doc, place).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import partitions, stored

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_INDEX_BITS = np.uint64(31)  # a Spark row holds no longer text


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, doc (null first), mark (the text's hash, shifted up) and text (null: empty)."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"),
                       F.expr("(xxhash64(coalesce(text, '')) & 2147483647) << 32").alias("mark"),
                       F.coalesce("text", F.lit("")).alias("text"))


def minimizer_runs(grams, valid_grams, bounds, size: int, gram: int):
    """Runs of windows of ``size`` symbols with one minimizer (a gram of ``gram`` symbols).

    ``grams`` has a hash for each symbol position (of the gram that starts there), ``valid_grams``
    tells which lie inside their group, ``bounds`` are the groups' symbol bounds.  Returns the first
    window of each run, its count of windows, its minimizer's hash and place, and its group.
    """
    n = len(grams)
    index = np.arange(n, dtype=np.uint64)
    least = np.where(valid_grams, (grams >> _INDEX_BITS << _INDEX_BITS) | index, _TOP)
    width, have = size - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:len(least) - have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:len(least) - (width - have)], least[width - have:])
    counts = np.diff(bounds)
    per = np.maximum(counts - size + 1, 0)
    group = np.repeat(np.arange(len(counts)), per)
    if not len(group):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z, z
    window = np.arange(len(group)) - np.repeat(np.cumsum(per) - per, per) + bounds[group]
    at = (least[window] & ((np.uint64(1) << _INDEX_BITS) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    return window[first], np.diff(np.append(first, len(window))), grams[at[first]], at[first], group[first]


def _streamed(rows: DataFrame, order: list[str], outer: int, same: int, sources: bool = False) -> DataFrame:
    """Range-partition and sort ``rows`` by ``order`` and stream them; see the two users below.

    The first ``outer`` columns of the order name a group, the first ``same`` a content.  Groups spread
    over as many tasks as their rows need.  Given are the rows with an earlier equal one in their task
    (``later``), firsts of contents whose group has other contents, and firsts at a partition's bounds
    (``edge``), as those may go on beyond it.  With ``sources`` every row also has the place of its content's
    first row in the task (``first_doc``, ``first_place``).
    """
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    names = rows.columns
    at = [names.index(c) for c in order]
    places = [names.index(c) for c in ("doc", "place")] if sources else []
    added = ["later", "edge"] + ["first_doc", "first_place"] * sources
    schema = StructType([*rows.schema, *(StructField(c, LongType() if "_" in c else BooleanType()) for c in added)])

    def run(batches):
        import pyarrow as pa

        def out(batch, later, edge, first):
            more = [pa.array(later), pa.array(edge), *map(pa.array, first)]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, *added])

        def alone(batch, i):
            return out(batch.slice(i, 1), [False], [True], [f[i:i + 1] for f in first])

        before = None  # the keys of the row before
        waiting = None  # the last first, while its company or its end is not known
        first = []  # for every row, the place of its content's first one
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy() for i in at]
            differs = np.ones((len(at), batch.num_rows), bool)
            for d, k, previous in zip(differs, keys, before or [None] * len(at)):
                d[1:] = k[1:] != k[:-1]
                d[0] = previous is None or k[0] != previous
            # the same place of a row that is repeated in full counts once
            once = differs.any(axis=0)
            first_batch, before = before is None, [k[-1] for k in keys]
            batch, differs = batch.filter(pa.array(once)), differs[:, once]
            n = batch.num_rows
            if not n:
                continue
            new_content = differs[:same].any(axis=0)
            new_group = differs[:outer].any(axis=0) if outer else np.zeros(n, bool)
            firsts = np.flatnonzero(new_content)
            begun = np.cumsum(new_content)  # contents that began in this batch
            place = [batch.column(i).to_numpy() for i in places]
            first = [np.append(f[-1:], x[firsts])[begun + len(f[-1:]) - 1]
                     for f, x in zip(first or [np.zeros(0, np.int64)] * 2, place)]
            take, edge = ~new_content, np.zeros(n, bool)
            if outer:
                joins = ~new_group[firsts]  # a first that follows another content of its group
                take[firsts[joins]] = True
                take[firsts[:-1][joins[1:]]] = True
                if waiting is not None and len(firsts) and joins[0]:
                    yield waiting
            if len(firsts):
                waiting = None if take[firsts[-1]] else alone(batch, firsts[-1])
            if first_batch:  # the partition's first row
                take[0] = edge[0] = True
                if firsts[-1] == 0 and outer:
                    waiting = None
            kept = np.flatnonzero(take)
            if len(kept):
                yield out(batch.take(pa.array(kept)), ~new_content[kept], edge[kept], [f[kept] for f in first])
        if waiting is not None:
            yield waiting

    return spread.mapInArrow(run, schema)


def compared_runs(runs: DataFrame, content=("h1", "h2"), sources: bool = False) -> DataFrame:
    """Runs (minimizer, the columns of ``content``, doc, place, ...): ``later`` ones repeat an earlier run as a whole; the others
    are the first of each content where a minimizer has (or may have) several contents.  With ``sources``
    a later one has the place of an earlier equal one."""
    return _streamed(runs, ["minimizer", *content, "doc", "place"], 1, 1 + len(content), sources)


def later_windows(windows: DataFrame, content=("h1", "h2"), sources: bool = False) -> DataFrame:
    """(doc, place) of the windows (``content``, doc, place) that an equal one precedes; with ``sources`` all
    their columns and the place of an earlier equal one (first_doc, first_place)."""
    found = stored(_streamed(windows, [*content, "doc", "place"], 0, len(content), sources), "windows", large=True)
    edges = found.where("edge")  # at most two a partition
    least = edges.groupBy(*content).agg(F.min(F.struct("doc", "place")).alias("first"))
    over = edges.join(F.broadcast(least), list(content)).where(F.struct("doc", "place") != F.col("first"))
    if sources:
        over = over.withColumns({"first_doc": F.col("first.doc"), "first_place": F.col("first.place")})
    names = [*windows.columns, "first_doc", "first_place"] if sources else ["doc", "place"]
    return found.where("later").select(*names).unionByName(over.select(*names)).distinct()


def with_spans(docs: DataFrame, spans: DataFrame, identity: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the spans (array of start, length; null if none) of
    ``spans`` (doc, place, length): doc_id, text, spans, or doc, mark, text, spans with ``identity``."""
    per = spans.select("doc", F.expr("place & -4294967296").alias("mark"),
                       F.struct(F.expr("place & 4294967295").alias("start"), "length").alias("span"))
    per = per.groupBy("doc", "mark").agg(F.collect_list("span").alias("spans"))
    names = ["doc", "mark"] if identity else ["doc_id"]
    return identified(docs).join(per, ["doc", "mark"], "left").select(*names, "text", "spans")


def covered(spans, n: int):
    """Mask of n positions covered by the (start, length) rows."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, spans[:, 0], 1)
    np.add.at(steps, spans[:, 0] + spans[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0
