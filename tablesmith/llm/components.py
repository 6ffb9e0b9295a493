"""Distributed union-find: connected components of a table of links.

The links are stored, then read in no more partitions than cores or AT_ONCE links each
need, and each contracts its own to a forest (a bounded number at a time);
then large-star and small-star steps (each node's larger or smaller neighbours
move to its smallest one) until nothing changes.  A node's links are never
gathered: its smallest neighbour is a partial aggregate, joined back to the
links; the few nodes that hold more than a thousandth of all links each get it
by broadcast, the others by a shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

AT_ONCE = 1 << 19  # links (8 MB) that a task unites before it passes their forest on
HOT_SHARE = 1000  # a key is hot beyond total/HOT_SHARE rows, so there are at most HOT_SHARE hot keys


def join_by_key(rows: DataFrame, per_key: DataFrame, key: str, total: int, count: str = "__n") -> DataFrame:
    """Inner join of ``rows`` to one row per key that also has its row count in ``count``.

    Rows of hot keys take the broadcast way: at most HOT_SHARE keys are that hot.
    ``per_key`` is read twice, so it should be stored.
    """
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    is_hot = F.broadcast(per_key.where(hot))
    by_broadcast = rows.join(is_hot, key)
    by_shuffle = rows.join(is_hot.select(key), key, "left_anti").join(per_key.where(~hot), key)
    return by_broadcast.unionByName(by_shuffle).drop(count)


def _dealt(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (some ``total``) in as few partitions as keep every core at work and hold AT_ONCE rows each.

    A session's shuffle partitions are for its large tables: a step on links would mostly start tasks.
    """
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // AT_ONCE)))


def _star(links: DataFrame, total: int, large: bool) -> DataFrame:
    """One star step on links (a, b), a > b."""
    if large:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("__n"))
    least = stored(_dealt(least, total), "star")
    moved = join_by_key(near, least, "u", total)
    if large:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return _dealt(out.distinct(), total)


def _state(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def unite(roots, p, q):
    """Union of the pairs (p, q) in the forest ``roots`` (each entry points at its root, the smallest)."""
    while True:
        a, b = roots[p], roots[q]
        if (a == b).all():
            return roots
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while (roots[roots] != roots).any():
            roots = roots[roots]


def _forest(parts):
    """Links (a, b), a > b, of every node of some links to the smallest one of its part of them."""
    import pyarrow as pa

    nodes, index = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = index.reshape(2, -1)
    roots = unite(np.arange(len(nodes)), a, b)
    moved = roots != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[roots[moved]])], names=["a", "b"])


def _contracted(batches):
    parts, held = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            parts.append(np.stack([c.to_numpy() for c in batch.slice(at, AT_ONCE).columns]))
            held += parts[-1].shape[1]
            if held >= AT_ONCE:
                yield _forest(parts)
                parts, held = [], 0
    if held:
        yield _forest(parts)


def components(links: DataFrame) -> DataFrame:
    """Stored (node, component) for every node of ``links`` (longs a, b), its component's smallest node.
    """
    with scratch(links.sparkSession):
        links = stored(links.where("a <> b")
                       .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
        links = stored(_dealt(links, links.count()).mapInArrow(_contracted, "a long, b long"), "links")
        state = _state(links)
        while True:
            links = stored(_star(links, 2 * state[0], large=True), "links")
            links = stored(_star(links, links.count(), large=False), "links")
            new = _state(links)
            if new == state:
                break
            state = new
        found = links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
            links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        return stored(_dealt(found, 2 * state[0]), "components", keep=True)
