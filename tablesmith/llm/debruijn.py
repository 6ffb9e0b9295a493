r"""Repeated word spans by compaction of a de Bruijn graph of word k-mers.

Every window of 20 words is an edge of the graph from its first 19 words to
its last 19.  Edges that an equal one precedes are found first, many at a time:
edges of a document in a row with the same minimizer (an 8-word gram; at most 13 of them) travel
as one arc, named by the hashes of its end nodes (which hold all its words) and its length, and equal
arcs meet by minimizer.  Where arcs with one minimizer differ,
documents part inside them: the edges of the first arc of each content are compared one by one, and
such arcs and edges count as branches.

The repeated arcs make the graph that is compacted by Spark joins (``compacted``):
degrees of the nodes are aggregates; an arc follows another one where their node has one way in and
one way out.  Arcs that also follow each other at their source become a
segment, and segments find the start of their path by pointer doubling, in as many joins as
the logarithm of the segments of a path.  Arcs of a path without branches keep their distance to its start.

Occurrences on one path, at one distance to it and to their earlier source, join into
long spans.  Each is verified: digests of all its words at its own and at its source's
coordinates must agree, or it is not removed.

Words are runs of anything but ASCII white space, unchanged.  Defined cases: a
null text has no words; documents of fewer than 20 words lose nothing; rows
repeated in full (same doc_id and text) are one document and share its
result; rows that repeat a doc_id with another text are compared in the order of
their texts' hashes; a null doc_id comes first; extra columns are left
behind; an empty table gives an empty result; paths that are a cycle stay in segments.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing, repeats
from .common import scratch, slices, stored
from .components import join_by_key

WORDS = 20
GRAM = 8
SLICE_BYTES = 2 << 20
SPANS_AT_ONCE = 4096  # spans of one document that a row of texts to verify holds, about
EDGE = "head long, tail long, doc long, place long"
RUN = f"minimizer long, {EDGE}, n long"


class _Words:
    """The words of a batch of texts and hashes of their sequences."""

    def __init__(self, column):
        data, offsets = hashing.texts(column)
        self.starts, self.ends, self.bounds = hashing.words(data, offsets)
        word = hashing.mix(hashing.Prefix(data).spans(self.starts, self.ends))
        self.sums = hashing.Prefix(word, None, 1)

    def grams(self, starts, ends):
        """A hash of the words from ``starts`` to ``ends``."""
        length = (ends - starts).astype(np.uint64)
        return hashing.mix(self.sums.spans(starts, ends) + length * hashing.ORDER[20])

    def nodes(self, starts):
        """A hash of the words of the node that begins at each of ``starts``."""
        return hashing.mix(self.sums.spans(starts, starts + WORDS - 1)).view(np.int64)


def _runs(docs: DataFrame) -> DataFrame:
    rows = repeats.identified(docs).select("doc", "mark", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                words = _Words(part.column(2))
                n = len(words.starts)
                first = np.arange(n)
                last = np.minimum(first + GRAM, n)
                grams = words.grams(first, last)
                text_end = np.repeat(words.bounds[1:], np.diff(words.bounds))
                start, count, minimizer, _, group = repeats.minimizer_runs(
                    grams, first + GRAM <= text_end, words.bounds, WORDS, GRAM)
                doc, mark = part.column(0).to_numpy(), part.column(1).to_numpy()
                place = mark[group] + start - words.bounds[group]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (minimizer.view(np.int64), words.nodes(start), words.nodes(start + count),
                                           doc[group], place, count)],
                    names=["minimizer", "head", "tail", "doc", "place", "n"])

    return rows.mapInArrow(run, RUN)


def _edges(docs: DataFrame, arcs: DataFrame) -> DataFrame:
    """The single edges (head, tail, doc, place) of ``arcs`` (doc, place, n)."""
    joined = repeats.with_spans(docs, arcs.withColumnRenamed("n", "length"), True).where("spans IS NOT NULL")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                words = _Words(part.column(2))
                lists = part.column(3)
                spans = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                start, n = (spans.field(k).to_numpy() for k in (0, 1))
                edge = np.repeat(np.arange(len(n)), n)
                position = start[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
                at = words.bounds[row[edge]] + position
                doc, mark = part.column(0).to_numpy(), part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (words.nodes(at), words.nodes(at + 1), doc[row[edge]],
                                           mark[row[edge]] + position)],
                    names=["head", "tail", "doc", "place"])

    return joined.mapInArrow(run, EDGE)


def _later_arcs(docs: DataFrame) -> DataFrame:
    """Stored occurrences (arc, head, tail, n, doc, place, first_doc, first_place) of arcs of ``n`` edges that
    equal ones precede."""
    with scratch(docs.sparkSession):
        found = stored(repeats.compared_runs(_runs(docs), ("head", "tail", "n"), True), "arcs", large=True)
        branching = found.where("NOT later").select("doc", "place", "n").distinct()
        edges = repeats.later_windows(_edges(docs, branching), ("head", "tail"), True).withColumn(
            "n", F.lit(1).cast("long"))
        names = ["head", "tail", "n", "doc", "place", "first_doc", "first_place"]
        later = found.where("later").select(*names).unionByName(edges.select(*names))
        return stored(later.select(F.xxhash64("head", "tail", "n").alias("arc"), *names), "later", keep=True, large=True)


def compacted(arcs: DataFrame) -> DataFrame:
    """Stored (arc, path, at): the path without branches that each arc belongs to and its first edge's number there.

    ``arcs`` has a row for every arc: arc (its number), head and tail (nodes), n (edges), and doc and place of
    one of its occurrences.  A path has the number of its first arc.
    """
    with scratch(arcs.sparkSession):
        leaving = arcs.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("out"), F.min("arc").alias("arc"))
        entering = arcs.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("in"), F.min("arc").alias("before"))
        through = (leaving.where(F.col("out") == 1).join(entering.where(F.col("in") == 1), "node")
                   .where("arc <> before").select("arc", "before"))

        here = Window.partitionBy("doc", F.expr("place >> 32")).orderBy("place", "arc")
        follows = (F.lag("arc").over(here) == F.col("before")) & (
            F.lag(F.col("place") + F.col("n")).over(here) == F.col("place"))
        segments = arcs.join(through, "arc", "left").withColumn("new", ~F.coalesce(follows, F.lit(False)))
        start = F.last(F.when(F.col("new"), F.struct("arc", "place")), True).over(here)
        segments = segments.withColumn("start", start).select(
            "arc", "n", "before", "new", F.col("start.arc").alias("segment"),
            (F.col("place") - F.col("start.place")).alias("at"))
        segments = stored(segments, "segments")

        ends = segments.select(F.col("arc").alias("before"), F.col("segment").alias("to"),
                               (F.col("at") + F.col("n")).alias("far"))
        jumps = segments.where("new").select("segment", "before").join(ends, "before", "left").select(
            "segment", F.coalesce("to", "segment").alias("to"), F.coalesce("far", F.lit(0)).alias("far"),
            F.col("to").isNull().alias("done"))
        left = None
        while True:
            jumps = stored(jumps, "jumps")
            still = jumps.where("NOT done").count()
            if still in (0, left):  # what no longer gets less are cycles
                break
            left = still
            beyond = jumps.select(F.col("segment").alias("to"), F.col("to").alias("__to"),
                                  F.col("far").alias("__far"), F.col("done").alias("__done"))
            jumps = jumps.where("done").unionByName(jumps.where("NOT done").join(beyond, "to").select(
                "segment", F.col("__to").alias("to"), (F.col("far") + F.col("__far")).alias("far"),
                F.col("__done").alias("done")))
        paths = segments.join(jumps, "segment").select(
            "arc", F.when(F.col("done"), F.col("to")).otherwise(F.col("segment")).alias("path"),
            (F.col("at") + F.when(F.col("done"), F.col("far")).otherwise(0)).alias("at"))
        return stored(paths, "compacted", keep=True)


def _long_spans(later: DataFrame) -> DataFrame:
    """Spans (doc, place, length, first_doc, first_place) of words: occurrences in a row on one path."""
    arcs = stored(later.groupBy("arc").agg(
        F.min("head").alias("head"), F.min("tail").alias("tail"), F.min("n").alias("n"),
        F.min(F.struct("doc", "place")).alias("least"), F.count("*").alias("__n")), "contents", large=True)
    paths = compacted(arcs.select("arc", "head", "tail", "n", "least.*"))
    paths = stored(paths.join(arcs.select("arc", "__n"), "arc"), "paths")
    placed = join_by_key(later.drop("head", "tail"), paths, "arc", later.count())
    way = ["doc", "path", "first_doc", "diagonal", "shift"]
    placed = placed.select("doc", "path", "first_doc", "place", "n", (F.col("place") - F.col("at")).alias("diagonal"),
                           (F.col("first_place") - F.col("place")).alias("shift"))
    here = Window.partitionBy(*way).orderBy("place")
    end = F.max(F.col("place") + F.col("n")).over(here.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("new", (end.isNull() | (F.col("place") > end)).cast("long"))
    placed = placed.withColumn("part", F.sum("new").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    spans = placed.groupBy(*way, "part").agg(F.min("place").alias("start"),
                                             F.max(F.col("place") + F.col("n")).alias("end"))
    return spans.select("doc", F.col("start").alias("place"), (F.col("end") - F.col("start") + WORDS - 1).alias("length"),
                        "first_doc", (F.col("start") + F.col("shift")).alias("first_place"))


def _digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Stored (doc, place, length, digest): the digest of the words of each of ``spans`` (doc, place, length).

    A document that is the source of many spans has a row of its text for some thousands of them."""
    with scratch(docs.sparkSession):
        spans = spans.withColumn("mark", F.expr("place & -4294967296"))
        spans = stored(spans.withColumn("text_id", F.xxhash64("doc", "mark")), "wanted")
        texts = stored(spans.groupBy("text_id").agg(F.count("*").alias("__n"))
                       .withColumn("rows", F.expr("1 + __n div " + str(SPANS_AT_ONCE))), "texts")
        per = join_by_key(spans, texts, "text_id", spans.count())
        per = per.groupBy("doc", "mark", F.expr("pmod(xxhash64(place, length), rows)").alias("row")).agg(
            F.collect_list(F.struct("place", "length")).alias("spans"))
        joined = repeats.identified(docs).select("doc", "mark", "text").distinct().join(per.drop("row"), ["doc", "mark"])

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for part in slices(batch, 2, SLICE_BYTES):
                    mark, texts = part.column(1).to_numpy(), part.column(2).cast(pa.binary())
                    lists = part.column(3)
                    row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                    place, length = (lists.flatten().field(k).to_numpy() for k in (0, 1))
                    digests, now = [], -1
                    for r, start, n in zip(row.tolist(), (place - mark[row]).tolist(), length.tolist()):
                        if r != now:
                            words, now = texts[r].as_py().split(), r
                        digests.append(hashlib.blake2b(b" ".join(words[start:start + n]), digest_size=16).digest())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part.column(0).to_numpy()[row]), pa.array(place), pa.array(length),
                         pa.array(digests, pa.binary())], names=["doc", "place", "length", "digest"])

        return stored(joined.mapInArrow(run, "doc long, place long, length long, digest binary"), "digests", keep=True)


def _verified(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The ``spans`` (doc, place, length) whose words are those at their source."""
    source = ["first_doc", "first_place", "length"]
    wanted = spans.select("doc", "place", "length").union(spans.select(*source)).distinct()
    digests = _digests(docs, wanted)
    own = stored(spans.join(digests, ["doc", "place", "length"]).withColumn("source", F.xxhash64(*source, "digest")), "own")
    # a source and its digest have one number, so a hot source is one key, and equal digests meet
    sources = digests.select(F.xxhash64("doc", "place", "length", "digest").alias("source"),
                             F.col("digest").alias("there"))
    counts = own.groupBy("source").agg(F.count("*").alias("__n"))
    known = stored(sources.join(counts, "source").dropDuplicates(["source"]), "sources")
    return join_by_key(own, known, "source", own.count()).where("digest = there").select("doc", "place", "length")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Stored (doc, place, length): long spans of words, each of which is found again at an earlier place."""
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):  # the arcs go before texts are read again
            spans = stored(_long_spans(_later_arcs(docs)), "long", keep=True)
        return stored(_verified(docs, spans), "spans", keep=True)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words joined by one space) of every row."""
    rows = repeats.with_spans(docs, repeated_spans(docs)).select("doc_id", "text", "spans")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                texts = part.column(1).cast(pa.binary())
                n_words, n_removed, kept = [], [], []
                for text, spans in zip(texts, part.column(2)):
                    words = text.as_py().split()  # bytes split at ASCII white space
                    n_words.append(len(words))
                    if spans.is_valid:
                        pairs = np.stack([spans.values.field(k).to_numpy() for k in (0, 1)], axis=1)
                        gone = repeats.covered(pairs, len(words))
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    schema = rows.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("text", "string")
    return rows.mapInArrow(run, schema)
