"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets.

A vector is rotated by random signs and fast Hadamard transforms (three of
each) and hashed to the vertex of the cross-polytope nearest to it, the signed index
of its largest coordinate.  A table's key joins ``HASHES`` such vertices; a
vector enters the bucket of its best key and of the next best ones, got by
changing single vertices to their runners-up (multiprobe on both sides).

Vectors that are equal component by component form a class, and only one of
each is hashed.  Buckets with two or more classes are verified inside tasks: cosines in double
precision, blocks of bounded size for large buckets.  A pair that meets
in several buckets counts in the first.  What leaves a task is one row per
member: how many vectors it links to there, and a root of its part of the
links; so pairs are never listed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths do not link;
repeated rows are vectors of their own (equal ones link); a null vec_id counts
as larger than all others; extra columns are left behind; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import scratch, slices, stored
from .components import components, join_by_key, unite

COSINE = 0.95
TABLES, HASHES, PROBES = 6, 3, 4  # a pair at 0.95 in 64 dimensions misses all tables with probability 4e-4
BLOCK = 2000  # members of a block of a large bucket
SEED = 5


def _hadamard(x):
    """Fast Walsh-Hadamard transform of the rows (their length is a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def bucket_keys(vectors, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES):
    """Keys of each vector, (rows, tables * probes): the best key of each table first."""
    n, dim = vectors.shape
    d = 1 << max(1, (dim - 1).bit_length())
    rng = np.random.Generator(np.random.PCG64([SEED, dim]))
    padded = np.zeros((n, d))
    padded[:, :dim] = vectors
    out = np.empty((n, tables, probes), np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        total = np.full(n, (dim << 20) + t + 1, np.uint64) * hashing.ORDER[-3]
        swaps, losses = [], []
        for k in range(hashes):
            x = padded
            for _ in range(3):
                x = _hadamard(x * rng.choice([-1.0, 1.0], d))
            size = np.abs(x)
            best = np.argsort(-size, axis=1)[:, :4]  # the nearest vertex and three runners-up
            vertex = best * 2 + (x[rows[:, None], best] < 0)
            code = (vertex.astype(np.uint64) + np.uint64(1)) * hashing.ORDER[k]
            reach = size[rows[:, None], best]
            total = total + code[:, 0]
            for r in range(1, best.shape[1]):
                swaps.append(code[:, r] - code[:, 0])
                losses.append(reach[:, 0] - reach[:, r])
        swaps, losses = np.stack(swaps, axis=1), np.stack(losses, axis=1)
        order = np.argsort(losses, axis=1)[:, :probes - 1]
        out[:, t, 0] = total
        for p in range(1, probes):
            # fewer swaps than probes (very short vectors): the best key once more
            out[:, t, p] = total + swaps[rows, order[:, p - 1]] if p <= order.shape[1] else total
    return hashing.mix(out).reshape(n, -1)


def _binary_rows(vectors: DataFrame, embedding: str) -> DataFrame:
    """id and vec: the components as little-endian doubles, null for vectors that link with nothing."""
    rows = vectors.select(F.col("vec_id").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    schema = rows.select("id").schema.add("vec", "binary")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for v in batch.column(1):
                x = np.array(v.values, float) if v.is_valid and len(v) and not v.values.null_count else np.zeros(1)
                x = x + 0.0  # no negative zeros
                out.append(x.astype("<f8").tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    return rows.mapInArrow(run, schema)


def _unit(vecs):
    """Unit rows of vectors of one length, scaled first so that no square overflows."""
    x = np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keyed(classes: DataFrame) -> DataFrame:
    """``classes`` with the keys of each."""
    schema = classes.select("*", F.array().cast("array<bigint>").alias("keys")).schema
    at = classes.columns.index("vec")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                vecs = part.column(at).to_pylist()
                keys = [None] * len(vecs)
                for size in {len(v) for v in vecs}:
                    rows = [i for i, v in enumerate(vecs) if len(v) == size]
                    made = bucket_keys(_unit([vecs[i] for i in rows])).view(np.int64)
                    for i, k in zip(rows, made):
                        keys[i] = k
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.list_(pa.int64()))],
                                                 names=schema.names)

    return classes.mapInArrow(run, schema)


def _first_here(keys_p, keys_q, key):
    """Whether ``key`` is the first key that the pairs have in common (by table, then by value)."""
    a = keys_p.reshape(len(keys_p), TABLES, PROBES, 1)
    b = keys_q.reshape(len(keys_q), TABLES, 1, PROBES)
    same = (a == b).any(axis=3)
    table = same.any(axis=2).argmax(axis=1)
    rows = np.arange(len(table))
    first = np.where(same[rows, table], a[rows, table, :, 0], np.iinfo(np.int64).max).min(axis=1)
    return first == key


def links(keyed: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Stored (node, n, root): vectors linked to a class in one bucket, and its root there.

    ``keyed`` is a stored table (node, vec, w, keys); w counts the class's rows.
    """
    entries = keyed.select(F.explode(F.array_distinct("keys")).alias("key"), "node")
    active = stored(entries.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1"), "active")
    total = active.agg(F.sum("__n")).first()[0] or 0
    active = active.withColumn("blocks", F.ceil(F.col("__n") / BLOCK).cast("int"))
    rows = join_by_key(entries, active, "key", total)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node")
    rows = rows.join(keyed.select("node", "vec", "w", "keys"), "node")

    def compare(group):
        import pyarrow as pa

        key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
        node, block, w = (group.column(c).to_numpy() for c in ("node", "block", "w"))
        keys = np.array(group.column("keys").combine_chunks().flatten()).reshape(len(node), -1)
        vecs = group.column("vec").to_pylist()
        n, roots = np.zeros(len(node), np.int64), np.arange(len(node))
        if len({len(v) for v in vecs}) == 1:
            unit = _unit(vecs)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            for at in range(0, len(left), 128):
                x = left[at:at + 128]
                p, q = np.nonzero(unit[x] @ unit[right].T >= cosine)
                p, q = x[p], right[q]
                if i == j:
                    p, q = p[p < q], q[p < q]
                for start in range(0, len(p), 10_000):
                    a, b = p[start:start + 10_000], q[start:start + 10_000]
                    here = _first_here(keys[a], keys[b], key)
                    a, b = a[here], b[here]
                    np.add.at(n, a, w[b])
                    np.add.at(n, b, w[a])
                    roots = unite(roots, a, b)
        out = n > 0
        return pa.table({"node": node[out], "n": n[out], "root": node[roots[out]]})

    return stored(rows.groupBy("key", "i", "j").applyInArrow(compare, "node long, n long, root long"), "vector-links")


def near_vectors(vectors: DataFrame, embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Stored vec_id, n_links, component_id, kept (vec_id = component_id) of every row."""
    with scratch(vectors.sparkSession):
        rows = stored(_binary_rows(vectors, embedding), "vectors")
        classes = (rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("w"))
                   .select(F.monotonically_increasing_id().alias("node"), "vec", "id", "w"))
        keyed = stored(_keyed(stored(classes, "vector-classes")), "vector-keys")
        found = links(keyed, cosine)
        linked = found.groupBy("node").agg(F.sum("n").alias("n"))
        comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        mine = (keyed.select("node", "vec", "id", "w").join(linked, "node", "left").join(comps, "node", "left")
                .withColumn("component", F.coalesce("component", "node")))
        smallest = mine.groupBy("component").agg(F.min("id").alias("component_id"))
        mine = mine.join(smallest, "component").select(
            "vec", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id", F.col("w").alias("__n"))
        out = join_by_key(rows, stored(mine, "vector-groups"), "vec", rows.count())
        alone = rows.where("vec IS NULL").select("*", F.lit(0).cast("long").alias("n_links"),
                                                 F.col("id").alias("component_id"))
        return stored(out.unionByName(alone).select(
            F.col("id").alias("vec_id"), "n_links", "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), "near-vectors", keep=True)
