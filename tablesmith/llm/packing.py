"""Best-fit packing of token pieces into fixed-length sequences, with dominance reduction.

The instance is the histogram of piece lengths: at most ``capacity`` rows,
whatever the corpus.  On it the driver plans in bulk:

1. Reduction by dominance (Martello and Toth): for a length j, a set of up
   to three pieces that provably is at least as good as every other feasible set
   holding j becomes a fixed sequence, as often as its lengths allow.
2. Best-fit decreasing on what remains: each piece goes to the fullest
   sequence that takes it; equal sequences move together as one group.

The plan is a list of patterns (which lengths, how many sequences).  Spark
numbers the pieces of each length in salted buckets (no length's pieces ever
meet in one task) and every piece finds its place by its number alone.

Defined cases: a null text is an empty one (one piece holding only the end
token); repeated rows are packed as documents of their own; extra columns are
left behind; an empty table packs into no sequences.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, stored

CAPACITY = 4096
END_ID = 1
PIECES = "row_id long, doc_id long, piece int, start long, length long, ids binary"

# Words kept with their ids by one task; the memory starts anew when it is full.
WORD_MEMORY = 1_000_000

# --- tokenizing ------------------------------------------------------------------------------


class WordTokenizer:
    """Whole-text ids from ids of white-space separated chunks.

    The vocabulary lower-cases, drops white space and never joins a letter with
    a punctuation mark that follows it, so a text's ids are its chunks' ids in
    order.  Chunks repeat, and each is tokenized once while it is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self):
        self.known: dict = {}
        self.counts = np.zeros(1 << 16, np.int32)  # ids per known chunk
        self.starts = np.zeros(1 << 16, np.int64)  # where they start in flat
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, chunks, at_once: int = 2000):
        for i in range(0, len(chunks), at_once):
            self._learn_joined(chunks[i:i + at_once])

    def _learn_joined(self, chunks):
        # one text for all of them: an id belongs to the chunk its offset falls in
        e = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(lengths + 1) - lengths - 1
        at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
        counts = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(chunks))
        first, ids = len(self.known), np.array(e.ids, np.uint32)
        while first + len(chunks) > len(self.counts):
            self.counts, self.starts = (np.concatenate([a, np.zeros_like(a)]) for a in (self.counts, self.starts))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.known.update(zip(chunks, range(first, first + len(chunks))))
        self.counts[first:first + len(chunks)] = counts
        self.starts[first:first + len(chunks)] = self.used + np.cumsum(counts) - counts
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, texts):
        """Of an Arrow string array without nulls: all ids in a row, and the count of each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        # texts that may spell a special token are left as they are
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), _LETTER_MARK, r"\1 \2")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, plain)
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        if len(self.known) > WORD_MEMORY:
            self.forget()
        chunks = words.dictionary.to_pylist()
        numbers = np.fromiter(map(self.known.get, chunks, _UNKNOWN), np.int64, len(chunks))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = len(self.known) + np.arange(len(new))
            self._learn([chunks[i] for i in new])
        index = numbers[words.indices.to_numpy()] if len(chunks) else np.zeros(0, np.int64)
        counts, starts = self.counts[index], self.starts[index]
        ends = np.cumsum(counts, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(starts - (ends - counts), counts)
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        return self.flat[take], np.diff(bounds)


_LETTER_MARK = r"(\p{L})([!-/:-@\[-`{-~])"
_UNKNOWN = repeat(-1)
_ENCODERS: dict = {}


def encoder(path: str) -> WordTokenizer:
    """The Python worker's tokenizer; what it remembers serves the worker's later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordTokenizer(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids; ``ids`` holds them as little-endian unsigned 32-bit."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def cut(batches):
        import pyarrow as pa

        words = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                ids, counts = words.encode(part.column(2))
                # the end token closes every document
                ids = np.insert(ids, np.cumsum(counts), END_ID).astype("<u4")
                counts = counts + 1
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, counts[row] - start)
                ends = np.cumsum(length) * 4
                binary = pa.Array.from_buffers(pa.binary(), len(row), [
                    None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(ids)])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), binary],
                    names=["row_id", "doc_id", "piece", "start", "length", "ids"])

    return rows.mapInArrow(cut, PIECES)


# --- planning on the histogram ---------------------------------------------------------------


class _Counts:
    """Counts by length with the present lengths in order."""

    def __init__(self, counts):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def largest(self, most: int, but=()):
        """The largest present length of at most ``most``, the lengths of ``but`` taken out."""
        at = bisect_right(self.order, most)
        while at:
            at -= 1
            w = self.order[at]
            if self.n[w] - but.count(w) > 0:
                return w
        return None

    def smallest(self, k: int, but=(), over: int = 0):
        """The ``k`` smallest present lengths above ``over`` (with repeats), ``but`` taken out."""
        out = []
        for w in self.order[bisect_right(self.order, over):]:
            out += [w] * min(k - len(out), self.n[w] - but.count(w))
            if len(out) == k:
                break
        return out

    def take(self, pieces, times: int):
        for w in pieces:
            self.n[w] -= times
        for w in set(pieces):
            if not self.n[w]:
                del self.n[w]
                self.order.pop(bisect_right(self.order, w) - 1)


def _dominating(left: _Counts, j: int, capacity: int):
    """A set with ``j`` that dominates every feasible set with ``j``, or None."""
    room = capacity - j
    least = left.smallest(3, but=(j,))
    if not least or least[0] > room:
        return (j,)  # nothing fits beside it
    best = left.largest(room, but=(j,))
    if best == room or len(least) < 2 or least[0] + least[1] > room:
        return (j, best)  # a full sequence, or no two pieces fit: the largest partner is best
    if len(least) > 2 and sum(least) <= room:
        return None  # three may fit: no rule
    second = left.largest(room - best, but=(j, best))
    if second is None:
        # the best partner leaves no room: it dominates if every feasible pair is within it
        pair = _best_pair(left, j, room)
        return (j, best) if pair <= best else None
    # {best, second} dominates {x, y} where x <= best and y <= second; a pair with both
    # above second must not fit, and single pieces are within best
    above = left.smallest(2, but=(j,), over=second)
    if len(above) < 2 or sum(above) > room:
        return (j, best, second)
    return None


def _best_pair(left: _Counts, j: int, room: int) -> int:
    """The largest sum of two present lengths within ``room``."""
    top = 0
    for a in left.order:
        if 2 * a > room:
            break
        if left.n[a] - (a == j) > 0:
            b = left.largest(room - a, but=(j, a))
            if b is not None:
                top = max(top, a + b)
    return top


def reduce_by_dominance(counts: dict, capacity: int):
    """Fix dominating sets until no rule applies; return (patterns, remaining counts)."""
    left, fixed, changed = _Counts(counts), [], True
    while changed and left.order:
        changed = False
        for j in reversed(list(left.order)):
            while left.n.get(j):
                chosen = _dominating(left, j, capacity)
                if chosen is None:
                    break
                # the rules hold on as long as the chosen lengths last: other pieces only leave
                times = min(left.n[w] // chosen.count(w) for w in set(chosen))
                fixed.append((chosen, times))
                left.take(chosen, times)
                changed = True
    return fixed, left.n


def best_fit(counts: dict, capacity: int):
    """Best-fit decreasing on a histogram; groups of equal sequences stay together."""
    groups: dict = defaultdict(list)  # room left -> [(lengths, sequences)]
    rooms: list = []

    def put(room, group):
        if not groups[room]:
            insort(rooms, room)
        groups[room].append(group)

    done = []
    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_right(rooms, w - 1)
            if at == len(rooms):
                per = capacity // w
                whole, rest = divmod(n, per)
                for times, k in ((whole, per), (1, rest)):
                    if times and k:
                        put(capacity - k * w, (((w, k),), times))
                break
            room = rooms[at]
            lengths, times = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            per = room // w
            full = min(times, n // per)
            if full:
                put(room - per * w, (lengths + ((w, per),), full))
                n -= full * per
                times -= full
            if times and n:
                put(room - n * w, (lengths + ((w, n),), 1))
                n, times = 0, times - 1
            if times:
                put(room, (lengths, times))
        for group in groups.pop(0, ()):
            done.append(group)
        if rooms and rooms[0] == 0:
            rooms.pop(0)
    return done + [g for gs in groups.values() for g in gs]


def plan(counts: dict, capacity: int = CAPACITY):
    """Arrays by (length, first number): where a piece of that length and number goes.

    Bounded by the capacity, not by the corpus: every pattern uses up a length or splits one group.
    """
    fixed, rest = reduce_by_dominance(counts, capacity)
    patterns = [(tuple((w, chosen.count(w)) for w in sorted(set(chosen), reverse=True)), times)
                for chosen, times in fixed] + best_fit(rest, capacity)
    used, sequence, rows = defaultdict(int), 0, []
    for lengths, times in patterns:
        offset = 0
        for w, k in lengths:
            rows.append((w, used[w], sequence, k, offset))
            used[w] += k * times
            offset += w * k
        sequence += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5), sequence


# --- placing ---------------------------------------------------------------------------------


def numbered(pieces: DataFrame, number: str) -> DataFrame:
    """Pieces of each length numbered from 0, by salted buckets with offsets."""
    salts = max(64, partitions(pieces.sparkSession))
    p = pieces.withColumn("__salt", F.pmod(F.xxhash64("row_id", "piece"), F.lit(salts)))
    sizes = p.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(
        Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("row_id", "piece")) - 1
    return (p.withColumn("__within", within)
            .join(before.drop("__n"), ["length", "__salt"])
            .withColumn(number, F.col("__within") + F.coalesce("__before", F.lit(0)))
            .drop("__salt", "__within", "__before"))


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (row_id, piece, length, ...) with ``sequence_id`` and ``offset``.

    ``pieces`` is read twice and must be a stored table.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table, _ = plan(counts, capacity)
    shared = spark.sparkContext.broadcast(table)
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    numbered_ = numbered(pieces.select(*names), "__number").select(*names, "__number")
    schema = numbered_.drop("__number").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        import pyarrow as pa

        rows = shared.value
        width = int(rows[:, 1].max()) + 1 if len(rows) else 1
        keys = rows[:, 0].astype(object) * width + rows[:, 1] if width > 1 << 48 else rows[:, 0] * width + rows[:, 1]
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            number = batch.column(len(names)).to_numpy()
            # a piece's pattern is the last of its length that starts at or before its number
            at = np.searchsorted(keys, length * width + np.minimum(number, width - 1), side="right") - 1
            _, first, sequence, per, offset = rows[at].T
            k = number - first
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence + k // per, pa.int64()),
                 pa.array(offset + k % per * length, pa.int64())], names=[*names, "sequence_id", "offset"])

    return numbered_.mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ids and its place: row_id, doc_id, piece, start, length, ids, sequence_id, offset."""
    return placed(stored(tokenized(docs, tokenizer_path, capacity), "pack-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids in order and its documents (at most ``capacity`` ids each)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.expr("concat_ws('', transform(parts, p -> hex(p.ids)))").alias("hex"), "parts")
            .select("sequence_id", F.unhex("hex").alias("ids"),
                    F.expr("transform(parts, p -> struct(p.offset, p.doc_id, p.piece, p.length))").alias("parts")))
