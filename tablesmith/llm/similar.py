"""MinHash similarity joins: banding, b-bit estimates, exact verification, components.

The steps work on *classes* of identical shingle sets, one representative each:

1. ``buckets``: band keys are range-partitioned and streamed in order.  Every
   member of a bucket is paired with the bucket's first member.  A bucket
   may run over partition bounds (a hot one over many); its parts are
   stitched by pairing their first members.
2. Pairs whose b-bit estimate can still reach the threshold are verified on
   full sets and united into components.
3. Buckets that still hold two or more components are looked at again, member
   against member across components, inside the tasks: first by b-bit estimates,
   then short texts by their exact sets, long ones by long one-bit sketches; buckets
   of any size are cut into block pairs of bounded size.  Only pairs
   that link (or whose sketches can reach the threshold, to be verified) leave the task.

Bands are taken ``at_once`` at a time.  Keys of short texts, which outweigh them, travel packed
instead (``packed_buckets``).

So a component costs about one pair per member and bucket, and pairs inside
a component are never listed.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import hashing
from .common import partitions, scratch, slices, stored
from .components import components, join_by_key

BITS = 4  # retained bits of each mixed minimum
SKETCH = 4096  # one-bit minima of the second look: 0.01 standard deviation at 0.75
SKETCH_BLOCK = 2000  # members of a block of a large bucket
PAIRS_AT_ONCE = 1 << 16  # of the second look
SHORT_SLICE = 1 << 17  # bytes of short texts hashed at once: arrays of eight bytes a byte stay in the cache
PACKED = 1 << 15  # short texts whose keys are packed at once (16 MB with 32 bands)
PART_BYTES = 1 << 22  # of packed keys and nodes in a range of keys


@dataclass(frozen=True)
class Plan:
    """``shingle(data, offsets)`` gives a batch's hashed shingles and their bounds."""
    shingle: Callable
    bands: int
    rows: int
    percent: int  # link when 100 * intersection >= percent * union
    seed: int = 1
    short: bool = False  # texts short enough to travel with every bucket they are in
    at_once: int = 32  # bands in a pass; fewer where the keys of a text outweigh it

    def sets(self, data, offsets):
        """A batch's distinct sets, their bounds, 16 bytes that identify each, and which have members."""
        values, bounds = distinct_sorted(*self.shingle(data, offsets))
        return values, bounds, set_hash(values, bounds), np.flatnonzero(np.diff(bounds))

    @property
    def minima(self):
        return self.bands * self.rows

    def slack(self, count: int, bits: int, sigmas: float = 4.5) -> float:
        """Least estimate that a pair at the threshold stays above, but for 4.5 standard deviations."""
        j, chance = self.percent / 100, 2.0 ** -bits
        agree = j + (1 - j) * chance
        return j - sigmas * (agree * (1 - agree) / count) ** 0.5 / (1 - chance)


def distinct_sorted(values, bounds):
    """Each group's distinct values in order, with their bounds."""
    values, edges = values.copy(), bounds.tolist()
    for a, b in zip(edges[:-1], edges[1:]):
        values[a:b].sort()
    new = np.ones(len(values) + 1, bool)
    new[1:-1] = values[1:] != values[:-1]
    new[bounds] = True
    return values[new[:-1]], np.concatenate([[0], np.cumsum(new[:-1])])[bounds]


def set_hash(values, bounds):
    """16 bytes per group that depend on the set only."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    for k in range(2):
        if len(full):
            out[full, k] = np.add.reduceat(hashing.mix(values ^ hashing.ORDER[40 + k]), bounds[:-1][full])
    return out


def _pack(minima):
    """BITS of the mixed minima, packed into 64-bit words, one row per group."""
    low = (hashing.mix32(minima).T & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    per = 64 // BITS
    pad = -low.shape[1] % per
    low = np.pad(low, ((0, 0), (0, pad))).reshape(len(low), -1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def _sketch(minima):
    """One bit of each mixed minimum, packed into bytes, one row per group."""
    return np.packbits((hashing.mix32(minima).T & np.uint32(1)).astype(np.uint8), axis=1)


def _binary(rows):
    """Arrow binary array of the rows of a 2-d array."""
    import pyarrow as pa

    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def _longs(rows):
    import pyarrow as pa

    flat = pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


def _signed(values, bounds, has, hasher, plan: Plan):
    """Band keys and packed b-bit minima of the groups ``has``; zeros for the others."""
    keys = np.zeros((len(bounds) - 1, plan.bands), np.uint64)
    bits = np.zeros((len(bounds) - 1, -(-plan.minima * BITS // 64)), np.uint64)
    if len(has):
        minima = hasher.minima(values, np.append(bounds[:-1][has], len(values)))
        keys[has] = hashing.band_keys(minima, plan.rows).T
        bits[has] = _pack(minima)
    return [_longs(keys), _longs(bits)]


def features(items: DataFrame, plan: Plan) -> DataFrame:
    """``items`` (id, text) as id, n_shingles, set_hash, band keys and b-bit signature.

    Texts without shingles have a null set_hash.
    """
    schema = StructType(items.select("id").schema.fields + StructType.fromDDL(
        "n_shingles long, set_hash binary, keys array<bigint>, bits array<bigint>").fields)
    items = items.select("id", F.coalesce("text", F.lit("")).alias("text"))
    hasher = hashing.MinHasher(plan.minima, plan.seed)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                data, offsets = hashing.texts(part.column(1))
                values, bounds, hashes, has = plan.sets(data, offsets)
                empty = np.ones(len(hashes), bool)
                empty[has] = False
                null = pa.array(empty)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(bounds)),
                     pa.compute.if_else(null, pa.scalar(None, pa.binary()), _binary(hashes)),
                     *_signed(values, bounds, has, hasher, plan)], names=schema.names)

    import pyarrow.compute  # noqa: F401  (loaded before the function travels)
    return items.mapInArrow(run, schema)


def signatures(texts: DataFrame, plan: Plan) -> DataFrame:
    """Band keys and b-bit signature of every text of ``texts`` (node, text), each with a shingle at least.

    Keys are those of packed_buckets().
    """
    hasher = hashing.BinnedMinHasher(plan.bands, plan.rows, plan.seed)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1, SHORT_SLICE):
                values, bounds = plan.shingle(*hashing.texts(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *_signed(values, bounds, np.arange(part.num_rows), hasher, plan)],
                    names=["node", "keys", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, keys array<bigint>, bits array<bigint>")


def classes(rows: DataFrame) -> DataFrame:
    """One stored row per distinct set: node, set_hash, its smallest id, n_shingles, keys, bits."""
    found = (rows.where("set_hash IS NOT NULL").groupBy("set_hash")
             .agg(F.min("id").alias("id"), F.first(F.struct("n_shingles", "keys", "bits")).alias("f"))
             .select(F.monotonically_increasing_id().alias("node"), "set_hash", "id", "f.*"))
    return stored(found, "classes", large=True)


BUCKET_PAIRS = "key long, a long, b long, edge boolean"


def stored_bands(found: DataFrame, plan: Plan, band: int) -> DataFrame:
    """As band_rows(), from the keys of ``found``."""
    return found.select(F.explode(F.slice("keys", band + 1, plan.at_once)).alias("key"), "node")


def buckets(rows_of: Callable[[int], DataFrame], plan: Plan) -> DataFrame:
    """Stored (key, a, b, edge): b meets the first member a of its part of the bucket ``key``."""
    parts = []
    for at in range(0, plan.bands, plan.at_once):
        with scratch(SparkSession.getActiveSession()):
            parts.append(_buckets(rows_of(at)))
    return functools.reduce(DataFrame.unionByName, parts)


def _buckets(found: DataFrame) -> DataFrame:
    """The buckets of some bands (key, node).

    Rows with ``edge`` name the first member of a bucket's part at a partition's bound (b is null).
    """
    rows = (found
            .repartitionByRange(partitions(found.sparkSession), "key", "node").sortWithinPartitions("key", "node"))

    def stream(batches):
        import pyarrow as pa

        last, pivot, start, waiting = None, None, True, None
        for batch in batches:
            key, node = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            new = np.concatenate([[key[0] != last if last is not None else True], key[1:] != key[:-1]])
            group = np.cumsum(new)
            pivots = np.concatenate([[0 if pivot is None else pivot], node[new]])[group]
            out = np.flatnonzero(~new)
            columns = [key[out], pivots[out], node[out], np.zeros(len(out), bool)]
            if start:  # the partition's first bucket
                columns = [np.concatenate([c, [v]]) for c, v in zip(columns, (key[0], node[0], -1, True))]
                start = False
            last, pivot = key[-1], pivots[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], mask=columns[3].astype(bool)),
                 pa.array(columns[3].astype(bool))], names=["key", "a", "b", "edge"])
        if last is not None:  # and its last
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([pivot], pa.int64()),
                                              pa.array([None], pa.int64()), pa.array([True])],
                                             names=["key", "a", "b", "edge"])

    met = stored(rows.mapInArrow(stream, BUCKET_PAIRS), "buckets", keep=True, large=True)
    # parts of one bucket in neighbouring partitions: at most two edges a partition
    edges = met.where("edge")
    first = edges.groupBy("key").agg(F.min("a").alias("p"))
    stitched = (edges.join(F.broadcast(first), "key").where("a <> p").distinct()
                .select("key", F.col("p").alias("a"), F.col("a").alias("b"), F.lit(False).alias("edge")))
    return met.where("NOT edge").unionByName(stitched)


def packed_buckets(rows: DataFrame, hashed: Callable, texts: int, plan: Plan) -> DataFrame:
    """Stored (key, a, b): b meets a in the bucket ``key``, over all bands of some ``texts`` short texts.

    ``hashed`` turns a batch of ``rows`` into (node, shingles, bounds) of its texts, some at a time; equal texts have
    equal nodes.  Keys travel packed, by ranges of keys of some PART_BYTES each: a row holds those of PACKED texts in one
    range.  Members of a bucket that meet before need not travel with its key, so a hot bucket brings a range no more
    than one member per PACKED texts.
    """
    parts = max(partitions(rows.sparkSession), -(-texts * plan.bands * 16 // PART_BYTES))
    hasher = hashing.BinnedMinHasher(plan.bands, plan.rows, plan.seed)

    def pack(batches):
        held, count = [], 0
        for batch in batches:
            for node, values, bounds in hashed(batch):
                held.append((node, hashing.band_keys(hasher.minima(values, bounds), plan.rows)))
                count += len(node)
                if count >= PACKED:
                    yield _packed(held, parts)
                    held, count = [], 0
        if count:
            yield _packed(held, parts)

    packed = rows.mapInArrow(pack, "part int, key binary, a binary, b binary")
    return stored(packed.groupBy("part").applyInArrow(_unpacked, "key long, a long, b long"), "buckets", large=True)


def _meetings(key, node):
    """Keys in order with their least nodes, and the meetings (key, a, b) of these with other nodes."""
    order = np.argsort(key)
    key, node = key[order], node[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
    several = np.flatnonzero(~(new & np.append(new[1:], True)[:len(key)]))
    node[several] = node[several][np.lexsort((node[several], key[several]))]
    least = node[new][np.cumsum(new) - 1]
    meets = ~new & (node != least) & np.concatenate([[True], node[1:] != node[:-1]])[:len(key)]
    return (key[new], node[new]), (key[meets], least[meets], node[meets])


def _packed(held, parts: int):
    """Rows of packed_buckets() of some (node, keys): one per range of keys, and one per 4096 meetings (with b)."""
    import pyarrow as pa

    node, at = np.unique(np.concatenate([n for n, _ in held]), return_index=True)
    keys = np.concatenate([k for _, k in held], axis=1)[:, at]
    (key, first), met = _meetings(keys.reshape(-1), np.tile(node, len(keys)))
    edges = np.arange(1, parts, dtype=np.float64) * (2.0 ** 64 / parts)
    cuts = np.concatenate([[0], np.searchsorted(key, edges.astype(np.uint64)), [len(key)]])
    steps = np.append(np.arange(0, len(met[0]), 4096), len(met[0]))
    more = len(steps) - 1
    offsets = np.concatenate([cuts, steps[1:] + len(key)]).astype(np.int32) * np.int32(8)
    both = [np.concatenate(c) for c in zip((key, first), met)]
    columns = [pa.Array.from_buffers(pa.binary(), parts + more, [None, pa.py_buffer(offsets), pa.py_buffer(c)]) for c in both]
    b = [None] * parts + [met[2][i:j].tobytes() for i, j in zip(steps[:-1], steps[1:])]
    part = np.concatenate([np.arange(parts), (np.arange(more) + int(node[0]) % parts) % parts]).astype(np.int32)
    rows = pa.RecordBatch.from_arrays([pa.array(part), *columns, pa.array(b, pa.binary())], names=["part", "key", "a", "b"])
    return rows.filter(pa.array(np.diff(offsets) > 0))


def _unpacked(table):
    """Meetings of one range of keys."""
    import pyarrow as pa

    met = np.array(table.column(3).is_valid())

    def joined(column, rows, kind=np.int64):
        return np.frombuffer(b"".join(table.column(column).filter(pa.array(rows)).to_pylist()), kind)

    here = _meetings(joined(1, ~met, np.uint64), joined(2, ~met))[1]
    before = joined(1, met, np.uint64), joined(2, met), joined(3, met)
    return pa.table([pa.array(np.concatenate(c).view(np.int64)) for c in zip(here, before)], names=["key", "a", "b"])


def _agreeing(a: str, b: str, minima: int) -> F.Column:
    """Minima whose retained bits agree, counted on packed words."""
    ones = sum(1 << BITS * k for k in range(64 // BITS))  # the lowest bit of each retained group
    fold = "x" + "".join(f" | shiftrightunsigned(x, {k})" for k in range(1, BITS))
    diff = f"transform(zip_with({a}, {b}, (x, y) -> x ^ y), x -> ({fold}) & {ones}L)"
    return F.expr(f"{minima} - aggregate({diff}, 0, (s, x) -> s + CAST(bit_count(x) AS INT))")


def estimated(pairs: DataFrame, found: DataFrame, plan: Plan) -> DataFrame:
    """The pairs whose collision-corrected b-bit estimate can reach the threshold."""
    bits = found.select("node", "bits")
    p = (pairs.join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b")
         .join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a"))
    chance = 2.0 ** -BITS
    j = (_agreeing("bits_a", "bits_b", plan.minima) / F.lit(plan.minima) - chance) / (1 - chance)
    return p.where(j >= plan.slack(plan.minima, BITS)).select("a", "b")


def node_texts(items: DataFrame, found: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """Stored (node, text) of the classes ``nodes`` (node), from the rows of their ids."""
    wanted = found.join(nodes, "node", "left_semi").select("node", "set_hash", F.col("id").alias("__id"))
    rows = items.join(wanted, F.col("id").eqNullSafe(F.col("__id"))).select("node", "set_hash", "text")

    def own(batches):
        # an id that is repeated brings other texts as well: only those of the class stay
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                hashes = plan.sets(*hashing.texts(part.column(2)))[2]
                yield part.filter(pc.equal(_binary(hashes), part.column(1))).select([0, 2])

    import pyarrow.compute as pc
    return stored(rows.mapInArrow(own, "node long, text string").dropDuplicates(["node"]), "texts", large=True)


def verified(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (stored table a, b) that reach the threshold on their full sets."""
    joined = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
              .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
              .select("a", "b", "text_a", "text_b"))
    percent = plan.percent

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                keep = np.zeros(part.num_rows, bool)
                # rows come by a: its set is made once for all of them
                a = part.column(0).to_numpy()
                new = np.concatenate([[True], a[1:] != a[:-1]])
                (va, ba), (vb, bb) = (distinct_sorted(*plan.shingle(*hashing.texts(c)))
                                      for c in (part.column(2).filter(pa.array(new)), part.column(3)))
                for i, k in enumerate((np.cumsum(new) - 1).tolist()):
                    x, y = va[ba[k]:ba[k + 1]], vb[bb[i]:bb[i + 1]]
                    keep[i] = _reach(x, y, percent)
                yield part.select([0, 1]).filter(pa.array(keep))

    return joined.mapInArrow(run, "a long, b long")


def _active(met: DataFrame, comps: DataFrame) -> DataFrame:
    """Stored (key, i, j, block, node, comp): members of buckets with several components, by pairs of blocks."""
    members = met.select("key", F.col("a").alias("node")).unionByName(met.select("key", F.col("b").alias("node")))
    members = (members.distinct().join(comps.withColumnRenamed("component", "comp"), "node", "left")
               .withColumn("comp", F.coalesce("comp", "node")))
    members = stored(members, "members", large=True)
    active = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("__n"))
    active = stored(active.where("lo <> hi").select("key", "__n"), "active")
    total = members.count()
    # a hot bucket is cut into blocks; each pair of blocks meets in a group of its own
    blocks = F.ceil(F.col("__n") / SKETCH_BLOCK).cast("int")
    rows = join_by_key(members, active.withColumn("blocks", blocks), "key", total)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                       "block", "node", "comp")
    return stored(rows, "rows", large=True)


def _sketches(texts: DataFrame, rows: DataFrame, plan: Plan) -> DataFrame:
    """Stored (node, made): the long one-bit sketches of the nodes of ``rows``."""
    hasher = hashing.MinHasher(SKETCH, plan.seed + 1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                minima = hasher.minima(*plan.shingle(*hashing.texts(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), _binary(_sketch(minima))], names=["node", "made"])

    members = texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", "text")
    return stored(members.mapInArrow(run, "node long, made binary"), "sketches")


def _pairs(group, block, i, j):
    """Pairs (p, q) of positions to be compared, some PAIRS_AT_ONCE at a time.

    Rows come by group and block: inside a block all pairs, else those of block i with block j.
    """
    n = len(group)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    end = np.repeat(edge[1:], np.diff(edge))
    right = np.minimum.reduceat(np.where(block == j, np.arange(n), n), edge[:-1])
    inside = i == j
    start = np.where(inside, np.arange(n) + 1, np.repeat(right, np.diff(edge)))
    count = np.where(inside | (block == i), end - start, 0)
    upto = np.cumsum(count)
    at = 0
    while at < n:
        before = upto[at] - count[at]
        stop = max(at + 1, int(np.searchsorted(upto, before + PAIRS_AT_ONCE, "right")))
        c = count[at:stop]
        p = np.repeat(np.arange(at, stop), c)
        yield p, np.repeat(start[at:stop], c) + np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        at = stop


def _near(bits, p, q, minima: int, least: float):
    """Whether the corrected b-bit estimates of the pairs reach ``least``."""
    differ = bits[p] ^ bits[q]
    fold = differ.copy()
    for k in range(1, BITS):
        fold |= differ >> np.uint64(k)
    ones = np.uint64(sum(1 << BITS * k for k in range(64 // BITS)))
    agree = minima - np.bitwise_count(fold & ones).sum(axis=1, dtype=np.int64)
    chance = 2.0 ** -BITS
    return (agree / minima - chance) / (1 - chance) >= least


def _link(values, bounds, p, q, percent: int):
    """Whether the sets of the pairs, sorted by p, reach the threshold."""
    # members are marked by 16 bits, which count no less than there are in common; who passes is counted in full
    index = (values & np.uint64(0xFFFF)).astype(np.int64)
    size, mark = np.diff(bounds), np.zeros(1 << 16, bool)
    out = np.zeros(len(p), bool)
    edge = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]])) if len(p) else [0]
    for a, b in zip(edge[:-1], edge[1:]):
        mine = index[bounds[p[a]]:bounds[p[a] + 1]]
        mark[mine] = True
        its = q[a:b]
        n = size[its]
        at = np.arange(n.sum()) + np.repeat(bounds[its] - (np.cumsum(n) - n), n)
        common = np.minimum(np.add.reduceat(mark[index[at]].astype(np.int64), np.cumsum(n) - n), np.minimum(n, len(mine)))
        out[a:b] = 100 * common >= percent * (len(mine) + n - common)
        mark[mine] = False
    for k in np.flatnonzero(out).tolist():
        x, y = (values[bounds[i]:bounds[i + 1]] for i in (p[k], q[k]))
        out[k] = _reach(x, y, percent)
    return out


def _reach(x, y, percent: int) -> bool:
    """Whether two sets (distinct values in order) reach the threshold."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _linked_texts(texts, p, q, plan: Plan):
    """As _link(), of the ``texts`` at the pairs' positions; only theirs are hashed."""
    import pyarrow as pa

    if not len(p):
        return np.zeros(0, bool)
    own, index = np.unique(np.concatenate([p, q]), return_inverse=True)
    sets = distinct_sorted(*plan.shingle(*hashing.texts(texts.take(pa.array(own)))))
    return _link(*sets, *index.reshape(2, -1), plan.percent)


def _second_look(met: DataFrame, comps: DataFrame, texts: DataFrame, found: DataFrame, plan: Plan) -> DataFrame:
    """Pairs across components inside buckets: links of short texts, else pairs at the sketch's slack."""
    rows = _active(met, comps)
    extra = texts.select("node", F.col("text").alias("made")) if plan.short else _sketches(texts, rows, plan)
    rows = rows.join(extra.join(found.select("node", "keys", "bits"), "node"), "node").select(
        "key", "i", "j", "block", "node", "comp", "keys", "bits", "made")
    rows = rows.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "block")
    least_agree = int(np.ceil(SKETCH * (1 + plan.slack(SKETCH, 1)) / 2))
    least = plan.slack(plan.minima, BITS)

    def compared(table):
        import pyarrow as pa

        table = table.combine_chunks()
        key, i, j, block, node, comp = (table.column(c).to_numpy() for c in range(6))
        keys, bits = (np.array(table.column(c).combine_chunks().flatten()).reshape(len(key), -1) for c in (6, 7))
        bits = bits.view(np.uint64)
        made = table.column(8).combine_chunks()
        if not plan.short:
            sketch = np.frombuffer(b"".join(made.to_pylist()), np.uint64).reshape(len(key), -1)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        near = [np.zeros((2, 0), np.int64)]
        for p, q in _pairs(group, block, i, j):
            for test in (lambda: comp[p] != comp[q], lambda: _near(bits, p, q, plan.minima, least),
                         # a pair that shares several bands counts in the first
                         lambda: keys[p, (keys[p] == keys[q]).argmax(axis=1)] == key[p]):
                keep = test()
                p, q = p[keep], q[keep]
            if not plan.short:
                differ = np.concatenate([np.zeros(0, np.int64)] + [
                    np.bitwise_count(sketch[p[k:k + 4096]] ^ sketch[q[k:k + 4096]]).sum(axis=1, dtype=np.int64)
                    for k in range(0, len(p), 4096)])
                keep = SKETCH - differ >= least_agree
                p, q = p[keep], q[keep]
            near.append(np.stack([p, q]))
        p, q = np.concatenate(near, axis=1)
        if plan.short:
            keep = _linked_texts(made, p, q, plan)
            p, q = p[keep], q[keep]
        a, b = node[p], node[q]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def run(batches):
        import pyarrow as pa

        rest = None  # the last group so far
        for batch in batches:
            for part in slices(batch, 8, 1 << 20):
                table = pa.Table.from_batches([part])
                if rest is not None:
                    table = pa.concat_tables([rest, table])
                ends = [table.column(c).to_numpy() for c in range(3)]
                other = np.flatnonzero((ends[0] != ends[0][-1]) | (ends[1] != ends[1][-1]) | (ends[2] != ends[2][-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                rest = table.slice(cut)
                if cut:
                    yield compared(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield compared(rest)

    return rows.mapInArrow(run, "a long, b long").distinct()


def linked_classes(plan: Plan, met_of: Callable[[], DataFrame], texts_of: Callable[[DataFrame], DataFrame],
                   found_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of every class linked to another.

    ``met_of`` gives the stored meetings (key, a, b) in buckets, ``texts_of`` the stored (node, text) of a table of
    nodes, and ``found_of`` the stored (node, keys, bits) of such texts.
    """
    with scratch(SparkSession.getActiveSession()):
        met = met_of()
        pairs = stored(met.select("a", "b").distinct(), "met-pairs", large=True)
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        texts = texts_of(nodes)
        found = found_of(texts)
        pairs = stored(estimated(pairs, found, plan), "pairs")
        comps = components(verified(pairs, texts, plan))
        more = stored(_second_look(met, comps, texts, found, plan), "pairs", large=True)
        new = more if plan.short else verified(more, texts, plan)
        # the components so far are stars already; the new links join some of them
        return stored(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
                                 .unionByName(new)), "components", keep=True)


def grouped(rows: DataFrame, items: DataFrame, plan: Plan) -> DataFrame:
    """Stored (set_hash, component_id, shared): each class's smallest linked id, and whether other classes share it.

    ``rows`` are features(); ``items`` gives texts again for the classes to be verified.
    """
    with scratch(items.sparkSession):
        found = classes(rows)
        comps = linked_classes(plan, lambda: buckets(lambda band: stored_bands(found, plan, band), plan),
                               lambda nodes: node_texts(items, found, nodes, plan), lambda texts: found)
        mine = found.select("node", "set_hash", "id").join(comps, "node", "left")
        mine = mine.withColumn("component", F.coalesce("component", "node"))
        smallest = mine.where("component IS NOT NULL").groupBy("component").agg(
            F.min("id").alias("component_id"), (F.count("*") > 1).alias("shared"))
        return stored(mine.join(smallest, "component").select("set_hash", "component_id", "shared"), "groups", keep=True)
