r"""Fuzzy line deduplication by MinHash on character shingles.

Lines are the parts of a text between ``\n``, compared without outer spaces
and with A-Z lower-cased.  A line's set holds its 8-character shingles;
signatures of 128 minima in 32 bands propose pairs (a pair at 0.75 shares no
band with probability 5e-6), b-bit estimates sieve them,
the exact Jaccard similarity (0.75 or more) confirms them, and a distributed
union-find joins them.  Of each component only the first line stays: smallest
doc_id, then smallest line number.

Defined cases: lines of fewer than 8 characters are no evidence of a copy and
always stay; a null text has no lines and stays null; rows repeated in full
(same doc_id and text) are one document and share its decisions; a null
doc_id comes first; extra columns pass through; an empty table gives an
empty result.  A document all of whose lines go keeps an empty text.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import hashing, similar
from .common import scratch, slices, stored
from .components import join_by_key

CHARS = 8
PERCENT = 75


def char_shingles(data, offsets, size: int = CHARS):
    """Hashed shingles of ``size`` characters of a batch of lines; a shorter line is one shingle.

    A shingle of eight bytes is mixed as it stands, others by a rolling hash of their bytes.
    """
    data = np.take(hashing.LOWER, data)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.searchsorted(chars, offsets) if len(chars) < len(data) else np.asarray(offsets)
    counts = np.diff(bounds)
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(per)])
    if len(counts) and counts.min() >= size:
        # windows are taken over the whole batch, side by side; those that run over a line's end go
        inside = np.ones(len(chars) - size + 1, bool)
        for k in range(1, size):
            inside[bounds[1:-1] - k] = False
        if len(chars) == len(data) and size == 8:
            return hashing.mix(_words(data)[inside]), out
        first = np.flatnonzero(inside)
        last = first + size
    else:
        group = np.repeat(np.arange(len(counts)), per)
        first = np.arange(out[-1]) - out[group] + bounds[group]
        last = np.minimum(first + size, bounds[group + 1])
    chars = np.append(chars, len(data))
    starts, ends = chars[first], chars[last]
    values = _words(np.append(data, np.zeros(8, np.uint8)))[starts]
    odd = np.flatnonzero(ends - starts != 8)
    if len(odd):
        # only the bytes of their lines are summed up
        line, index = np.unique(np.searchsorted(out, odd, "right") - 1, return_inverse=True)
        sizes = np.diff(offsets)[line]
        moved = np.cumsum(sizes) - sizes - offsets[line]
        own = data[np.arange(sizes.sum()) - np.repeat(moved, sizes)]
        values[odd] = hashing.Rolling(own).spans(starts[odd] + moved[index], ends[odd] + moved[index])
    return hashing.mix(values), out


def _words(data):
    """The eight bytes from every position on, as one number."""
    for kind, step in ((np.uint16, 1), (np.uint32, 2), (np.uint64, 4)):
        data = data.astype(kind)
        data = data[:-step] | (data[step:] << kind(8 * step))
    return data


PLAN = similar.Plan(char_shingles, bands=32, rows=4, percent=PERCENT, short=True)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes inside a character
_PAD = [bytes(n) for n in range(8)]


def _lines(docs: DataFrame) -> DataFrame:
    """id (doc_id, text_hash, line) and compared text of every line of at least CHARS characters, as _cut() finds them."""
    lines = _documents(docs).select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    # the length is asked of the line as it stands: a filter on the lowered one would lower every line twice
    lines = lines.select(F.struct("doc_id", "text_hash", "line").alias("id"), F.trim("text").alias("text"))
    return lines.where(F.length("text") >= CHARS).select("id", _lowered("text").alias("text"))


def _lowered(name: str):
    """A-Z lower-cased: lower() does just this to plain ASCII, at a fraction of the cost of translate()."""
    text = F.col(name)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _cut(texts):
    """The lines of at least CHARS characters of an Arrow array of texts, lower-cased, without outer spaces.

    Gives, for some SHORT_SLICE bytes of lines at a time, each line's text (its position), line number, first byte and
    size in the text, and the lines themselves.
    """
    data, offsets = hashing.texts(texts)
    raw = data.tobytes().translate(_LOWERED)
    ends = np.flatnonzero(data == 10)
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(ends, offsets)) + 1)
    start = np.sort(np.concatenate([offsets[:-1], ends + 1]))
    end = np.sort(np.concatenate([ends, offsets[1:]]))
    line = np.arange(len(text)) - np.searchsorted(text, text)
    full = np.flatnonzero(end > start)
    text, line, start, end = text[full], line[full], start[full], end[full]
    for k in np.flatnonzero((data[start] == 32) | (data[end - 1] == 32)).tolist():
        own = raw[start[k]:end[k]].rstrip(b" ")
        end[k] = start[k] + len(own)
        start[k] = end[k] - len(own.lstrip(b" "))
    size = end - start
    # fewer characters than bytes matter where these are few
    for k in np.flatnonzero((size >= CHARS) & (size < 4 * CHARS)).tolist() if not raw.isascii() else ():
        if len(raw[start[k]:end[k]].translate(None, _CONTINUED)) < CHARS:
            size[k] = 0
    long = np.flatnonzero(size >= CHARS)
    if not raw.isascii():
        # plain lines first: slices of these alone are hashed faster
        plain = [raw[i:j].isascii() for i, j in zip(start[long].tolist(), end[long].tolist())]
        long = long[np.argsort(~np.array(plain, bool), kind="stable")]
    text, line, start, size = text[long], line[long], start[long], size[long]
    bounds, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + similar.SHORT_SLICE, "right")) - 1)
        part = slice(at, stop)
        first = start[part].tolist()
        yield (text[part], line[part], start[part] - offsets[text[part]], size[part],
               [raw[i:i + n] for i, n in zip(first, size[part].tolist())])
        at = stop


def _shingles(lines, size):
    return char_shingles(np.frombuffer(b"".join(lines), np.uint8), np.concatenate([[0], np.cumsum(size)]))


def _named(lines, size, seed: int, count: int):
    """``count`` times 64 bits that tell lines (bytes of some ``size``) apart; another ``seed`` gives others."""
    words = np.frombuffer(b"".join([x + _PAD[n] for x, n in zip(lines, (-size & 7).tolist())]), np.uint64)
    counts = (size + 7) >> 3
    starts = np.cumsum(counts) - counts
    at = (np.arange(len(words)) - np.repeat(starts, counts)).astype(np.uint64)
    words = words ^ hashing.mix(at * hashing.ORDER[0] + np.uint64(seed))
    size = size.astype(np.uint64)
    return [(np.add.reduceat(hashing.mix(words ^ hashing.ORDER[40 + k]), starts) + hashing.mix(size ^ hashing.ORDER[42 + k]))
            .view(np.int64) for k in range(count)]


def _line_table(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, text_hash, line, first byte, size, node (64 bits of the compared line) and check (64 others) of all lines."""
    rows = _documents(docs).where("text IS NOT NULL")
    schema = StructType(rows.select("doc_id", "text_hash").schema.fields + StructType.fromDDL(
        "line int, start int, size int, node long, check long").fields)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                found = []
                for text, line, start, size, lines in _cut(part.column(2)):
                    found.append((text, line, start, size, *_named(lines, size, seed, 2)))
                if found:
                    text, line, start, size, node, check = (np.concatenate(c) for c in zip(*found))
                    ids = part.select([0, 1]).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays(
                        [*ids.columns, *(pa.array(c.astype(np.int32)) for c in (line, start, size)),
                         pa.array(node), pa.array(check)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _met(docs: DataFrame, lines: int, seed: int) -> DataFrame:
    """Stored meetings (key, a, b) of the nodes of all ``lines`` lines in the bands' buckets."""
    def hashed(batch):
        for part in slices(batch, 0, 2 << 20):
            for *_, size, lines in _cut(part.column(0)):
                yield *_named(lines, size, seed, 1), *_shingles(lines, size)

    return similar.packed_buckets(docs.select("text").where("text IS NOT NULL"), hashed, lines, PLAN)


def _texts(docs: DataFrame, lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored (node, text) of the lines ``nodes`` (node), each cut out of the first document that has it."""
    first = lines.join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash", "start", "size")).alias("id"))
    first = first.select("node", F.col("id.doc_id").alias("__doc"), F.col("id.text_hash").alias("__hash"), "id.start", "id.size")
    on = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash"))
    found = _documents(docs).join(first, on).select("node", F.substring(
        F.col("text").cast("binary"), F.col("start") + 1, F.col("size")).cast("string").alias("text"))
    return stored(found.dropDuplicates(["node"]), "texts", large=True)


def _told_apart(docs: DataFrame):
    """The stored line table, the stored (node, n) of nodes with several lines, and the seed of the nodes.

    Equal lines get equal nodes.  Should two others get one, their checks tell, and the nodes are made anew.
    """
    for seed in itertools.count(PLAN.seed):
        lines = stored(_line_table(docs, seed), "lines")
        copies = stored(lines.groupBy("node").agg(
            F.count("*").alias("n"), F.min("check").alias("low"), F.max("check").alias("high")).where("n > 1"), "copies")
        if copies.where("low <> high").isEmpty():
            return lines.drop("check"), copies.select("node", "n"), seed


def removed_lines(docs: DataFrame) -> DataFrame:
    """Stored doc_id, text_hash, removed (sorted line numbers) of every document that loses lines.

    ``docs`` (doc_id, text) is read three times: for the names of all lines, for the keys of their bands, and for the
    texts of lines that meet others.  Then every line with copies or links finds the first line of its component.
    """
    with scratch(docs.sparkSession):
        lines, copies, seed = _told_apart(docs)
        total = lines.count()
        comps = similar.linked_classes(
            PLAN, lambda: _met(docs, total, seed), lambda nodes: _texts(docs, lines, nodes),
            lambda texts: stored(similar.signatures(texts, PLAN), "signatures"))
        # lines that stand alone need no decision: only those with copies or links count
        several = stored(copies.join(comps, "node", "full").select(
            "node", F.coalesce("component", "node").alias("component"), F.coalesce("n", F.lit(1)).alias("__n")), "several")
        mine = join_by_key(lines.select("node", F.struct("doc_id", "text_hash", "line").alias("id")), several, "node", total)
        mine = stored(mine.select("id", "component"), "several-lines")
        first = stored(mine.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("__n")), "first")
        gone = join_by_key(mine, first, "component", total).where("id <> component_id")
        return stored(gone.groupBy("id.doc_id", "id.text_hash").agg(
            F.array_sort(F.collect_set("id.line")).alias("removed")), "removed", keep=True)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed line numbers (from 0) of every document."""
    gone = removed_lines(docs)
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    n = F.when(F.col("text").isNull(), 0).otherwise(breaks + 1)
    own = _documents(docs).select("doc_id", "text_hash", n.cast("long").alias("n_lines"))
    joined = _with_removed(own, gone)
    return joined.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def _with_removed(rows: DataFrame, gone: DataFrame) -> DataFrame:
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"),
                       F.col("removed").alias("__removed"))
    on = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash"))
    return (rows.join(gone, on, "left").drop("__doc", "__hash")
            .withColumn("removed", F.coalesce("__removed", F.array().cast("array<int>"))).drop("__removed"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text`` (and ``n_chars``, if there, counted anew)."""
    names = docs.columns
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                       F.xxhash64("text").alias("text_hash"))
    out = _with_removed(rows, removed_lines(docs)).withColumn("text", F.col("row.text"))
    left = F.expr(r"array_join(filter(split(text, '\n', -1), (x, i) -> NOT array_contains(removed, i)), '\n')")
    out = out.withColumn("left", F.when(F.size("removed") == 0, F.col("text")).otherwise(left))
    changed = {"text": F.col("left"),
               "n_chars": F.when(F.size("removed") == 0, F.col("row.n_chars")).otherwise(F.length("left"))
               if "n_chars" in names else None}
    return out.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in names])
