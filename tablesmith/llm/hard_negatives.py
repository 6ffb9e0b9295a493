"""Hard-negative mining with rotated one-bit codes.

Vectors are integers, floor(256 * x).  A vector v is rotated (random signs and fast
Hadamard transforms, three of each) to v'.  Its code is b = sign(v') / sqrt(D), stored with
the alignment a = <v', b>; the rest v' - a b is coded in the same way, and again, ``CODES``
times in all, and the length r of the last rest is stored.  For an anchor w:

    <v, w> = sum_k a_k <b_k, w'> + <rest, w'>,  |<rest, w'>| <= r * sqrt(|w|^2 - <b_last, w'>^2)

by Cauchy-Schwarz, as the last rest is orthogonal to the last code.  <b_k, w'> itself comes from
popcounts: w' is rounded to ``PLANES`` bit planes, and its rounding error's length widens the
interval.  So every score has an interval that holds it for certain.  Rows whose
interval cannot reach an anchor's first places (or a positive's window) are dropped; the
others are scored in integers, so the result is exact.  (With one code only, rests of 0.6 of a
vector's length leave almost all rows of 64 dimensions in; with four, of 0.13.)

Anchors and rows are dealt into blocks by hash, whatever their labels; every block of
anchors meets every block of rows in a task of its own, and leaves a few rows for each anchor:
first its best positives, then, with their scores known, the negatives of each.

Defined cases: rows with a null label, id or vector, or with any null or non-finite component
take no part, nor do vectors of a length over 2**27.5 after scaling (their scores
could pass a long); vectors of different dimensions are not compared; an empty
vector scores 0 with others; rows that repeat in full count once; rows that share an id are
rows of their own, but no positives or negatives of an anchor of that id, and ties between them go by
a hash of label and vector; a positive score below zero has an empty window; extra columns are
left behind; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored
from .embeddings import _hadamard

SCALE = 256
CODES = 4  # one-bit codes of a row, each of what the ones before leave
PLANES = 6  # bits of an anchor's rotated components
ANCHOR_BLOCK = 2048
ROW_BLOCK = 2048
STRIP = 64  # anchors whose intervals are held at once
MOST = 2.0 ** 55  # squared length; 100 * score stays a long
SLACK = 1e-9  # of the product of two lengths, for rounding in doubles
SEED = 11


def rotated(v):
    """The rows of ``v`` (as doubles) in rotated coordinates, padded to a power of two of at least 64."""
    n, dim = v.shape
    d = max(64, 1 << max(0, (dim - 1).bit_length()))
    rng = np.random.Generator(np.random.PCG64([SEED, dim]))
    x = np.zeros((n, d))
    x[:, :dim] = v
    for _ in range(3):
        x = _hadamard(x * rng.choice([-1.0, 1.0], d))
    return x


def packed(bits):
    """Rows of bits as rows of 64-bit words."""
    return np.packbits(bits, axis=-1).view(np.uint64)


def codes(v):
    """Sign bits and alignments of each row of ``v`` by code, length of the rest, squared length."""
    x = rotated(v)
    bits, align = [], []
    for _ in range(CODES):
        sign = x > 0
        a = np.abs(x).sum(axis=1) / np.sqrt(x.shape[1])
        x = x - np.where(sign, 1.0, -1.0) * (a / np.sqrt(x.shape[1]))[:, None]
        bits.append(packed(sign))
        align.append(a)
    return np.stack(bits, axis=1), np.stack(align, axis=1), np.sqrt((x * x).sum(axis=1)), (v * v).sum(axis=1)


class Anchors:
    """Rotated anchors in bit planes."""

    def __init__(self, v):
        x = rotated(v)
        self.width = x.shape[1]
        self.low = x.min(axis=1, initial=0)
        self.step = np.maximum((x.max(axis=1, initial=0) - self.low) / ((1 << PLANES) - 1), 1e-300)
        level = np.clip(np.rint((x - self.low[:, None]) / self.step[:, None]), 0, (1 << PLANES) - 1)
        error = x - (self.low[:, None] + level * self.step[:, None])
        self.error = np.sqrt((error * error).sum(axis=1))
        self.total = level.sum(axis=1)
        self.planes = np.stack([packed(level.astype(np.int64) >> k & 1 == 1) for k in range(PLANES)], axis=1)
        self.length = np.sqrt((v * v).sum(axis=1))

    def products(self, at, bits):
        """<b, w'> of the anchors ``at`` (a slice) with the codes ``bits``, but for the rounding of w'."""
        weighted = np.zeros((self.planes[at].shape[0], len(bits)), np.int64)
        for k in range(PLANES):
            both = np.bitwise_count(bits[None] & self.planes[at, k][:, None]).sum(axis=2, dtype=np.int64)
            weighted += both << k
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        low, step = self.low[at, None], self.step[at, None]
        return (low * (2 * ones - self.width) + step * (2 * weighted - self.total[at, None])) / np.sqrt(self.width)

    def intervals(self, at, bits, align, rest, square):
        """Least and greatest possible score of the anchors ``at`` (a slice) with each row of codes()."""
        error, length = self.error[at, None], self.length[at, None]
        middle = 0
        for k in range(CODES):
            t = self.products(at, bits[:, k])
            middle = middle + align[:, k] * t
        off = np.maximum(0, np.abs(t) - error)
        spread = rest * np.sqrt(np.maximum(0, length * length - off * off))
        # the coded part's own length bounds what the rounding of w' moves
        coded = np.sqrt(np.maximum(0, square)) + rest
        spread += np.minimum(align.sum(axis=1), coded) * error + SLACK * (np.sqrt(square) * length + 1)
        return middle - spread, middle + spread


def prepared(vectors: DataFrame, embedding: str) -> DataFrame:
    """vec_id, label, dim, vec (32-bit integers) and codes of the rows of ``vectors`` that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND NOT exists(e, x -> x IS NULL)")
    schema = "vec_id long, label long, dim int, vec binary, bits binary, align binary, rest double, square double"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            e = batch.column(2).to_pylist()
            sizes = np.array([len(x) for x in e], np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                with np.errstate(over="ignore", invalid="ignore"):
                    v = np.floor(np.array([e[i] for i in at], float).reshape(len(at), size) * SCALE)
                    fits = np.isfinite(v).all(axis=1) & ((v * v).sum(axis=1) <= MOST)
                at, v = pa.array(at[fits]), v[fits]
                bits, align, *facts = codes(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(v), size, np.int32)),
                     pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary()),
                     *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (bits, align)), *map(pa.array, facts)],
                    names=["vec_id", "label", "dim", "vec", "bits", "align", "rest", "square"])

    return rows.mapInArrow(run, schema)


def _grid(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every block of anchors (stored, with an array ``goals``) beside every block of rows (stored)."""
    n_rows, n_anchors = rows.count(), anchors.count()
    i, j = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))
    own = rows.select(F.lit(False).alias("anchor"), "*", F.array().cast("array<bigint>").alias("goals"),
                      F.explode(F.sequence(F.lit(0), F.lit(i - 1))).alias("i"),
                      F.pmod(F.xxhash64("vec_id", "tie"), F.lit(j)).cast("int").alias("j"))
    theirs = anchors.select(F.lit(True).alias("anchor"), *rows.columns, "goals",
                            F.pmod(F.xxhash64("tie", "vec_id"), F.lit(i)).cast("int").alias("i"),
                            F.explode(F.sequence(F.lit(0), F.lit(j - 1))).alias("j"))
    return own.unionByName(theirs)


def _block(group):
    """For each dimension of a group: its anchors and rows, as (table, vectors) each."""
    import pyarrow.compute as pc

    for dim in pc.unique(group.column("dim")).to_pylist():
        same = group.filter(pc.equal(group.column("dim"), dim))
        sides = []
        for anchor in (True, False):
            t = same.filter(pc.equal(same.column("anchor"), anchor))
            v = np.frombuffer(b"".join(t.column("vec").to_pylist()), "<i4").reshape(t.num_rows, dim)
            sides.append((t, v))
        if sides[0][0].num_rows and sides[1][0].num_rows:
            yield sides


def _scores(v, w):
    """Integer inner products of the rows of ``v`` with ``w``."""
    if float(np.abs(v).max(initial=0)) * float(np.abs(w).max(initial=0)) * len(w) < 2 ** 53:
        return (v.astype(float) @ w.astype(float)).astype(np.int64)  # sums of integers that doubles hold
    return v.astype(np.int64) @ w.astype(np.int64)


def _first(score, ids, ties, k):
    """Positions of the first ``k``: higher scores first, then smaller ids, then ties."""
    return np.lexsort((ties, ids, -score))[:k]


def _kth(values, k):
    """The k-th largest value, or none below all."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _compare(choose, schema):
    """A group function: ``choose`` picks (rows, score, more columns) for one anchor from intervals."""
    def compare(group):
        import pyarrow as pa

        out = [[] for _ in range(len(schema))]
        for (anchors, w), (rows, v) in _block(group):
            bits, align = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t).reshape(rows.num_rows, CODES, -1)
                           for c, t in (("bits", np.uint64), ("align", float)))
            facts = [align[:, :, 0], *(rows.column(c).to_numpy() for c in ("rest", "square"))]
            label, ids, ties = (rows.column(c).to_numpy() for c in ("label", "vec_id", "tie"))
            own = [anchors.column(c).to_pylist() for c in ("vec_id", "tie", "label", "goals")]
            made = Anchors(w.astype(float))
            for start in range(0, len(w), STRIP):
                low, high = made.intervals(slice(start, start + STRIP), bits, *facts)
                for k, (lo, hi) in enumerate(zip(low, high), start):
                    a_id, a_tie, a_label, goals = (c[k] for c in own)
                    for found in choose(lo, hi, (label == a_label), ids != a_id, ids, ties, v, w[k], goals):
                        n = len(found[0])
                        for column, x in zip(out, [np.full(n, a_id), np.full(n, a_tie), *found]):
                            column.append(x)
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(schema, columns)})
    return compare


def _positives(count):
    def choose(lo, hi, same, other, ids, ties, v, w, goals):
        at = np.flatnonzero(same & other)
        at = at[hi[at] >= _kth(lo[at], count)]
        score = _scores(v[at], w)
        best = _first(score, ids[at], ties[at], count)
        yield ids[at[best]], ties[at[best]], score[best]
    return choose


def _negatives(count, low, high):
    def choose(lo, hi, same, other, ids, ties, v, w, goals):
        """``goals`` are the anchor's distinct positive scores."""
        rows = np.flatnonzero(~same & other)
        lo, hi = lo[rows], hi[rows]
        wanted = []
        for p in goals:
            least, most = low * p / 100, high * p / 100
            sure = (lo >= least) & (hi <= most)
            wanted.append((hi >= max(least, _kth(lo[sure], count))) & (lo <= most))
        any_goal = np.logical_or.reduce(wanted) if wanted else np.zeros(len(rows), bool)
        score = np.zeros(len(rows), np.int64)
        score[any_goal] = _scores(v[rows[any_goal]], w)
        for p, near in zip(goals, wanted):
            at = np.flatnonzero(near & (low * p <= 100 * score) & (100 * score <= high * p))
            best = at[_first(score[at], ids[rows[at]], ties[rows[at]], count)]
            yield np.full(len(best), p), ids[rows[best]], ties[rows[best]], score[best]
    return choose


def _ranked(found: DataFrame, by: list[str], count: int) -> DataFrame:
    """The first ``count`` of each group; a task's own first ones are picked before they move."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "tie")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(vectors: DataFrame, embedding: str = "embedding", anchor_every: int = 100, positives: int = 5,
                   negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Stored anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` (vec_id, label, an array).  Anchors are rows whose vec_id ``anchor_every`` divides; negatives
    are rows of other labels that score ``low`` to ``high`` percent of the positive.
    """
    with scratch(vectors.sparkSession):
        rows = prepared(vectors, embedding).distinct().withColumn("tie", F.xxhash64("label", "vec"))
        rows = stored(rows, "coded")
        none = F.array().cast("array<bigint>")
        anchors = stored(rows.where(F.col("vec_id") % anchor_every == 0).withColumn("goals", none), "anchors")
        names = ["anchor_id", "anchor_tie", "id", "tie", "score"]
        met = _grid(rows, anchors).groupBy("i", "j").applyInArrow(
            _compare(_positives(positives), names), ", ".join(f"{c} long" for c in names))
        chosen = stored(_ranked(met, ["anchor_id", "anchor_tie"], positives).drop("rank"), "positives")

        goals = chosen.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_tie").alias("tie")).agg(
            F.collect_set("score").alias("goals"))  # at most ``positives``
        aimed = stored(anchors.drop("goals").join(goals, ["vec_id", "tie"]), "aimed")
        names = ["anchor_id", "anchor_tie", "positive_score", "id", "tie", "score"]
        met = _grid(rows, aimed).groupBy("i", "j").applyInArrow(
            _compare(_negatives(negatives, low, high), names), ", ".join(f"{c} long" for c in names))
        by = ["anchor_id", "anchor_tie", "positive_score"]
        mined = stored(_ranked(met, by, negatives), "mined")
        pairs = chosen.select("anchor_id", "anchor_tie", F.col("score").alias("positive_score"),
                              F.col("id").alias("positive_id"))
        return stored(pairs.join(mined, by).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), "hard-negatives", keep=True)
