"""Repeated byte strings by a hash-compared suffix sort.

Every 100-byte string (a window) of the corpus is a suffix cut to 100 bytes.
Windows belong to their minimizer, a 32-byte gram, so equal windows meet by
it; windows in a row with one minimizer form a run, about one to 35 bytes.
Runs that equal an earlier run as a whole repeat it as a whole.  Where runs with one
minimizer differ, the windows of the first run of each content are sorted as
suffixes: a merge sort whose comparisons find the longest common extension by
binary search on prefix polynomial hashes (seven steps for 100 bytes) and then look
at one byte.  Neighbours with 100 bytes in common are verified byte by byte against
collisions; the earliest of equal windows stays, bytes of the others go.

Minimizers with more than ``SORTED_RUNS`` contents are not sorted in one task: their
runs are cut once more by 80-byte minimizers and settled as above, and the
windows that are left are range-sorted by Spark.  There, and for whole runs,
one hash brings equals together and an independent second one verifies them.

Texts are taken as UTF-8.  Defined cases: a null text is empty; documents
of fewer than 100 bytes lose nothing; rows repeated in full (same
doc_id and text) are one document and share its result; rows that repeat a
doc_id with another text are compared in the order of their texts' hashes; a null
doc_id comes first; what is left may split a character, so it is binary; extra
columns are left behind; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, repeats
from .common import scratch, slices, stored
from .components import join_by_key

BYTES = 100
GRAM = 32
LONG_GRAM = 80
SORTED_RUNS = 4096  # their windows (at most 283,000) and what sorts them take about 30 MB
SLICE_BYTES = 1 << 20
RUN = "minimizer long, h1 long, h2 long, doc long, place long, n int, lead int"


def _hashes(prefixes, starts, ends):
    """Two hashes of the spans, with their lengths."""
    length = (ends - starts).astype(np.uint64)
    return [hashing.mix(p.spans(starts, ends) + length * hashing.ORDER[30 + k]).view(np.int64)
            for k, p in enumerate(prefixes)]


def _runs(docs: DataFrame) -> DataFrame:
    rows = repeats.identified(docs).select("doc", "mark", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                data, bounds = hashing.texts(part.column(2))
                prefixes = hashing.Rolling(data), hashing.Prefix(data)
                first = np.arange(len(data))
                grams = hashing.mix(prefixes[0].spans(first, np.minimum(first + GRAM, len(data))))
                inside = first + GRAM <= np.repeat(bounds[1:], np.diff(bounds))
                start, n, minimizer, at, group = repeats.minimizer_runs(grams, inside, bounds, BYTES, GRAM)
                h1, h2 = _hashes(prefixes, start, start + n + BYTES - 1)
                doc, mark = part.column(0).to_numpy(), part.column(1).to_numpy()
                place = mark[group] + start - bounds[group]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (minimizer.view(np.int64), h1, h2, doc[group], place, n.astype(np.int32),
                                           (at - start).astype(np.int32))],
                    names=["minimizer", "h1", "h2", "doc", "place", "n", "lead"])

    return rows.mapInArrow(run, RUN)


def _contents(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` (minimizer, doc, place, n, lead, hot) with their bytes."""
    per = runs.select("doc", F.expr("place & -4294967296").alias("mark"), F.struct(
        F.expr("place & 4294967295").alias("start"), "n", "lead", "minimizer", "hot").alias("run"))
    per = per.groupBy("doc", "mark").agg(F.collect_list("run").alias("runs"))
    joined = repeats.identified(docs).select("doc", "mark", "text").join(per, ["doc", "mark"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                data, bounds = hashing.texts(part.column(2))
                lists = part.column(3)
                runs = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                start, n = runs.field("start").to_numpy(), runs.field("n").to_numpy()
                doc, mark = part.column(0).to_numpy(), part.column(1).to_numpy()
                size = n.astype(np.int64) + BYTES - 1
                ends = np.cumsum(size)
                take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[row] + start - (ends - size), size)
                binary = pa.Array.from_buffers(pa.binary(), len(row), [
                    None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[take])])
                yield pa.RecordBatch.from_arrays(
                    [runs.field("minimizer"), pa.array(doc[row]), pa.array(mark[row] + start), runs.field("n"),
                     runs.field("lead"), runs.field("hot"), binary],
                    names=["minimizer", "doc", "place", "n", "lead", "hot", "content"])

    return joined.mapInArrow(run, "minimizer long, doc long, place long, n int, lead int, hot boolean, content binary")


# --- sorting ---------------------------------------------------------------------------------


def common_extension(prefix, x, y, most: int = BYTES):
    """Longest common prefix, up to ``most`` bytes, of the suffixes at x and y: binary search on hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), most, np.int64)
    for _ in range(most.bit_length()):
        middle = (low + high + 1) >> 1
        same = prefix.spans(x, x + middle) == prefix.spans(y, y + middle)
        low = np.where(same, middle, low)
        high = np.where(same, high, middle - 1)
        high = np.maximum(high, low)
    return low


def _before(prefix, data, x, y, or_equal):
    """Whether the suffix at x sorts before that at y (or equals it, where ``or_equal``)."""
    same = common_extension(prefix, x, y)
    ends = same >= BYTES
    a, b = data[np.where(ends, x, x + same)], data[np.where(ends, y, y + same)]
    return np.where(ends, or_equal, a < b)


def sort_suffixes(prefix, data, suffixes, segments):
    """Stable merge sort of the suffixes inside each segment (segment numbers ascend); returns the order.

    All segments are merged together, level by level: each member finds its rank in
    the run beside its own by binary search.
    """
    n = len(suffixes)
    order = np.arange(n)
    bounds = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1], [True]])) if n else np.zeros(1, int)
    size = np.diff(bounds)
    begin, size = np.repeat(bounds[:-1], size), np.repeat(size, size)
    index = np.arange(n) - begin
    width = 1
    while n and width < size.max():
        side = index // width
        other = side ^ 1
        other_at = begin + other * width
        other_size = np.clip(size - other * width, 0, width)
        low, high = np.zeros(n, np.int64), other_size.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            mine, its = suffixes[order[todo]], suffixes[order[other_at[todo] + middle]]
            # the left run's equals come first
            less = _before(prefix, data, its, mine, side[todo] % 2 == 1)
            low[todo] = np.where(less, middle + 1, low[todo])
            high[todo] = np.where(less, high[todo], middle)
            todo = todo[low[todo] < high[todo]]
        place = begin + (side // 2) * 2 * width + (index - side * width) + low
        merged = np.empty(n, np.int64)
        merged[place] = order
        order = merged
        width *= 2
    return order


def _same_bytes(data, x, y, at_once: int = 20_000):
    out = np.empty(len(x), bool)
    window = np.arange(BYTES)
    for k in range(0, len(x), at_once):
        part = slice(k, k + at_once)
        out[part] = (data[x[part, None] + window] == data[y[part, None] + window]).all(axis=1)
    return out


def later_spans(minimizer, doc, place, n, lead, data, bounds):
    """Spans (doc, place, length) of windows that an equal one precedes.

    Runs come with all runs of their minimizer, in order of minimizer, doc and place.
    """
    # the same run of a row that is repeated in full gives no windows of its own
    again = np.zeros(len(n), bool)
    again[1:] = (minimizer[1:] == minimizer[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
    n = np.where(again, 0, n).astype(np.int64)
    run = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    group = np.cumsum(np.concatenate([[0], minimizer[1:] != minimizer[:-1]]))
    # equal windows hold their minimizer at the same distance
    segment = group[run] * (2 * BYTES) + (lead[run] - k)
    order = np.argsort(segment, kind="stable")
    segment = segment[order]
    alone = np.ones(len(order), bool)
    same = segment[1:] == segment[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    order, segment = order[~alone], segment[~alone]
    suffixes = bounds[run[order]] + k[order]
    prefix = hashing.Rolling(data)  # of 100 bytes at most, and verified
    sorted_ = sort_suffixes(prefix, data, suffixes, segment)
    order, suffixes, segment = order[sorted_], suffixes[sorted_], segment[sorted_]
    near = np.flatnonzero(segment[1:] == segment[:-1])
    near = near[common_extension(prefix, suffixes[near], suffixes[near + 1]) >= BYTES]
    near = near[_same_bytes(data, suffixes[near], suffixes[near + 1])]
    later = np.sort(order[near + 1])  # equal windows stand in order of their places
    new = np.ones(len(later), bool)
    new[1:] = (later[1:] != later[:-1] + 1) | (run[later[1:]] != run[later[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(later)))
    at = later[first]
    return doc[run[at]], place[run[at]] + k[at], count + BYTES - 1


def _sorted_spans(runs: DataFrame) -> DataFrame:
    """Later spans among ``runs`` with contents, minimizer by minimizer."""
    spread = runs.repartition("minimizer").sortWithinPartitions("minimizer", "doc", "place")
    spread = spread.select("minimizer", "doc", "place", "n", "lead", "content")

    def run(batches):
        import pyarrow as pa

        rest = None  # the last minimizer's runs so far
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            last = table.column(0).to_numpy()
            cut = int(np.searchsorted(last, last[-1])) if len(last) else 0
            rest = table.slice(cut)
            if cut:
                yield spans(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield spans(rest)

    def spans(table):
        import pyarrow as pa

        table = table.combine_chunks()
        columns = [table.column(c).to_numpy() for c in range(5)]
        content = table.column(5)
        content = content.combine_chunks() if hasattr(content, "combine_chunks") else content
        doc, place, length = later_spans(*columns, *hashing.texts(content))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(length)],
                                          names=["doc", "place", "length"])

    return spread.mapInArrow(run, "doc long, place long, length long")


def _cut_again(runs: DataFrame) -> DataFrame:
    """``runs`` with contents cut into runs of windows with one long minimizer, with their contents."""
    rows = runs.select("doc", "place", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                data, bounds = hashing.texts(part.column(2))
                prefixes = hashing.Rolling(data), hashing.Prefix(data)
                first = np.arange(len(data))
                grams = hashing.mix(prefixes[0].spans(first, np.minimum(first + LONG_GRAM, len(data))))
                inside = first + LONG_GRAM <= np.repeat(bounds[1:], np.diff(bounds))
                start, n, minimizer, _, group = repeats.minimizer_runs(grams, inside, bounds, BYTES, LONG_GRAM)
                size = n + BYTES - 1
                h1, h2 = _hashes(prefixes, start, start + size)
                ends = np.cumsum(size)
                take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
                content = pa.Array.from_buffers(pa.binary(), len(start), [
                    None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[take])])
                doc, place = part.column(0).to_numpy(), part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x) for x in (minimizer.view(np.int64), h1, h2, doc[group],
                                             place[group] + start - bounds[group], n.astype(np.int32))), content],
                    names=["minimizer", "h1", "h2", "doc", "place", "n", "content"])

    return rows.mapInArrow(run, "minimizer long, h1 long, h2 long, doc long, place long, n int, content binary")


def _windows(runs: DataFrame) -> DataFrame:
    """The single windows (h1, h2, doc, place) of ``runs`` with contents."""
    rows = runs.select("doc", "place", "n", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 3, SLICE_BYTES):
                data, bounds = hashing.texts(part.column(3))
                doc, place, n = (part.column(c).to_numpy() for c in range(3))
                row = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = bounds[row] + k
                h1, h2 = _hashes((hashing.Rolling(data), hashing.Prefix(data)), start, start + BYTES)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, doc[row], place[row] + k)],
                                                 names=["h1", "h2", "doc", "place"])

    return rows.mapInArrow(run, "h1 long, h2 long, doc long, place long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Stored (doc, place, length): byte spans, each covered by windows that start earlier elsewhere."""
    with scratch(docs.sparkSession):
        found = stored(repeats.compared_runs(_runs(docs)).select("minimizer", "doc", "place", "n", "lead", "later"), "runs", large=True)
        differing = found.where("NOT later").drop("later").distinct()
        sizes = stored(differing.groupBy("minimizer").agg(F.count("*").alias("__n")).where("__n > 1").withColumn(
            "hot", F.col("__n") > SORTED_RUNS), "sizes")
        differing = join_by_key(differing, sizes, "minimizer", found.count())
        runs = stored(_contents(docs, differing), "contents", large=True)
        by_sort = _sorted_spans(runs.where("NOT hot"))
        cut = stored(repeats.compared_runs(_cut_again(runs.where("hot"))), "cut-runs")
        by_hash = repeats.later_windows(_windows(cut.where("NOT later"))).withColumn("length", F.lit(BYTES).cast("long"))
        whole = found.select("doc", "place", "n", "later").unionByName(cut.select("doc", "place", "n", "later"))
        spans = whole.where("later").select("doc", "place", (F.col("n") + BYTES - 1).cast("long").alias("length"))
        return stored(spans.unionByName(by_sort).unionByName(by_hash), "spans", keep=True)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row."""
    rows = repeats.with_spans(docs, repeated_spans(docs)).select("doc_id", "text", "spans")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                texts = part.column(1).cast(pa.binary())
                out = []
                for text, spans in zip(texts, part.column(2)):
                    text = text.as_py()
                    if not spans.is_valid:
                        out.append((len(text), 0, 0, text))
                        continue
                    pairs = np.stack([spans.values.field(k).to_numpy() for k in (0, 1)], axis=1)
                    gone = repeats.covered(pairs, len(text))
                    begins = gone.copy()
                    begins[1:] &= ~gone[:-1]
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    out.append((len(text), len(text) - len(kept), int(begins.sum()), kept))
                columns = list(zip(*out)) if out else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = rows.select("doc_id").schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema.add("kept", "binary"))
