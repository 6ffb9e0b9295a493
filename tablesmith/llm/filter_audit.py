r"""Filter interaction audit with radix text tries.

Five filters are judged on every whole text; for every order in which they may be
applied the audit says what each step removes, alone or again.

Failure conditions (words are maximal ``[^\x20\x09-\x0D]+``, case-sensitive):
A under 200 words; B 100 * distinct words < 50 * words; C 100 * ``[A-Z]``
characters > 3 * code points; D holds any of ``#$%&*|``; E identical to the text of
a document with a smaller id anywhere in the table, removed or not.

1. A task reads its texts once, judges A to D (a bit mask) and inserts the
   texts into a compressed trie whose terminals hold the smallest id.  Only the texts of
   terminals travel on, so copies collapse before the shuffle.  A trie is emptied when it holds
   ``TRIE_BYTES`` of texts.
2. Those texts are range-partitioned by adaptive prefixes: a prefix that begins
   more texts than a quarter of a partition takes is made four times as long, until it does not or
   its texts end.  All equal texts have equal prefixes.
3. Inside a partition the texts of one prefix fill one trie; traversing it gives the smallest
   id of every text.  A document that is not such a first one fails E.
4. Masks are counted by part, quality and toxicity, and each part's counts (at most 128)
   are summed up for all orders and steps in one projection.

Defined cases: a null text counts as empty, a null part as the empty string;
a null id counts as larger than all others; rows that share id and text are no copies of
each other (no id is smaller); a document is good (toxic) if any of its label rows says 1,
and neither if it has none or a null id; extra columns are left behind; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import partitions, scratch, slices, stored

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
CONTINUED = bytes(range(128, 192))  # bytes of UTF-8 that begin no code point
SPACES = re.compile(rb"[\x20\x09-\x0D]")

TRIE_BYTES = 32 << 20  # texts that one task's trie may hold
FIRST_PREFIX = 16  # bytes
LEAST_GROUP = 1 << 20  # bytes of texts below which a prefix need not grow
WORD_CHUNK = 8 << 20  # bytes of a text whose words are listed at once


class Trie:
    """A compressed trie of byte strings; a terminal holds the smallest value put there."""

    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes = b""):
        self.label, self.children, self.value = label, {}, None

    def put(self, text: bytes, value) -> None:
        node, at = self, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                leaf = node.children[text[at]] = Trie(text[at:])
                leaf.value = value
                return
            if not text.startswith(child.label, at):
                same = shared_prefix(text, at, child.label)
                middle = node.children[text[at]] = Trie(child.label[:same])
                child.label = child.label[same:]
                middle.children[child.label[0]] = child
                child = middle
            node, at = child, at + len(child.label)
        if node.value is None or value < node.value:
            node.value = value

    def values(self):
        """The values of all terminals."""
        todo = [self]
        while todo:
            node = todo.pop()
            if node.value is not None:
                yield node.value
            todo.extend(node.children.values())


def shared_prefix(text: bytes, at: int, label: bytes) -> int:
    """How many bytes of ``label`` stand in ``text`` from ``at`` on, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text[at + low:at + middle] == label[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words; bytes.split() splits at just the white space of the definition."""
    if len(text) <= WORD_CHUNK:
        words = text.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = SPACES.search(text, at + WORD_CHUNK)
        end = cut.end() if cut else len(text)
        words = text[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, distinct = word_counts(text)
    upper = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, CONTINUED))
    return ((n < MIN_WORDS) | (100 * distinct < DISTINCT_PERCENT * n) << 1 |
            (100 * upper > UPPER_PERCENT * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def _order(doc_id):
    """Null ids after all others."""
    return (doc_id is None, doc_id if doc_id is not None else 0)


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, part, text) as doc_id, part, mask, digest and, for the first of a task's copies, the text."""
    schema = StructType(docs.select("doc_id").schema.fields + StructType.fromDDL(
        "part string, mask int, digest binary, text binary").fields)
    docs = docs.select("doc_id", F.coalesce("part", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches):
        import pyarrow as pa

        def emptied():
            firsts = {row for _, row in trie.values()}
            columns = list(zip(*(r[:4] for r in rows)))
            texts = [r[4] if k in firsts else None for k, r in enumerate(rows)]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip([*columns, texts], types)], names=schema.names)

        trie, rows, held = Trie(), [], 0
        for batch in batches:
            types = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.binary(), pa.binary()]
            for part in slices(batch, 2, TRIE_BYTES):
                for doc_id, name, text in zip(*(c.to_pylist() for c in part.columns)):
                    trie.put(text, (_order(doc_id), len(rows)))
                    rows.append((doc_id, name, failures(text), hashlib.blake2b(text, digest_size=16).digest(), text))
                    held += len(text) + 64
                if held >= TRIE_BYTES:
                    yield emptied()
                    trie, rows, held = Trie(), [], 0
        if rows:
            yield emptied()

    return docs.mapInArrow(run, schema)


def with_prefixes(texts: DataFrame) -> DataFrame:
    """``texts`` (stored, with a binary text) with the adaptive prefix of each.

    A round measures the prefixes that are too heavy still: at most four for each partition.
    """
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    most = max(LEAST_GROUP, total // (4 * partitions(texts.sparkSession)))
    length, heavy, left = FIRST_PREFIX, [], texts
    while True:
        begin = F.xxhash64(F.substring("text", 1, length))
        found = left.groupBy(begin.alias("begin")).agg(F.sum(F.length("text")).alias("bytes"),
                                                       F.max(F.length("text")).alias("longest"))
        found = stored(found.where((F.col("bytes") > most) & (F.col("longest") > length)).select("begin"), "heavy")
        if found.isEmpty():
            break
        heavy.append((length, found))
        left = texts.join(F.broadcast(found), begin == F.col("begin"), "left_semi")
        length *= 4
    prefix = F.substring("text", 1, length)
    out = texts
    for k, (size, found) in reversed(list(enumerate(heavy))):
        flag = found.select(F.col("begin").alias(f"__begin{k}"))
        out = out.join(F.broadcast(flag), F.xxhash64(F.substring("text", 1, size)) == F.col(f"__begin{k}"), "left")
        prefix = F.when(F.col(f"__begin{k}").isNull(), F.substring("text", 1, size)).otherwise(prefix)
    return out.select(*texts.columns, prefix.alias("prefix"))


def first_documents(texts: DataFrame) -> DataFrame:
    """doc_id and digest of the smallest id of every distinct text of ``texts`` (doc_id, digest, text; stored)."""
    schema = texts.select("doc_id", "digest").schema
    rows = with_prefixes(texts).select("doc_id", "digest", "text", "prefix")
    rows = rows.repartitionByRange(partitions(texts.sparkSession), "prefix").sortWithinPartitions("prefix")

    def run(batches):
        import pyarrow as pa

        def emptied():
            found = [(doc_id, digest) for _, digest, doc_id in trie.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), types)],
                                              names=schema.names)

        trie, now = Trie(), None
        for batch in batches:
            types = [batch.schema.field(0).type, pa.binary()]
            for part in slices(batch, 2):
                for doc_id, digest, text, prefix in zip(*(c.to_pylist() for c in part.columns)):
                    if prefix != now:
                        if now is not None:
                            yield emptied()
                        trie, now = Trie(), prefix
                    trie.put(text, (_order(doc_id), digest, doc_id))
        if now is not None:
            yield emptied()

    return rows.mapInArrow(run, schema)


def masks(docs: DataFrame) -> DataFrame:
    """Stored doc_id, part and mask (bit k: fails the k-th filter of FILTERS) of every row of ``docs`` (doc_id, part, text)."""
    with scratch(docs.sparkSession):
        rows = stored(judged(docs), "judged", large=True)
        firsts = stored(first_documents(rows.where("text IS NOT NULL").select("doc_id", "digest", "text")), "firsts",
                        large=True)
        firsts = firsts.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.lit(True).alias("__first"))
        on = (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__id"))
        copied = F.when(F.col("__first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
        return stored(rows.drop("text").join(firsts, on, "left")
                      .select("doc_id", "part", F.col("mask").bitwiseOR(copied).alias("mask")), "masks", keep=True)


def audit(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders and steps of every part of ``marked`` (of masks()), with ``labels`` (doc_id, quality, toxic)."""
    own = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = marked.where("doc_id IS NOT NULL").join(own, "doc_id", "left").select(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    nameless = marked.where("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    cells = known.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))  # at most 128
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = "CAST(shiftleft(1, ascii(substr(filter_order, {}, 1)) - ascii('A')) AS INT)"
    steps = steps.withColumn("own", F.expr(bit.format("step"))).withColumn(
        "before", F.expr(f"aggregate(sequence(0, step - 1), 0, (s, k) -> IF(k = 0, s, s | {bit.format('k')}))"))

    def total(condition, value="c.n"):
        return F.expr(f"aggregate(cells, 0L, (s, c) -> s + IF({condition}, {value}, 0L))")

    removed = "c.mask & before = 0 AND c.mask & own <> 0"
    # a document that fails k filters is removed by each of them in 1/k of all orders
    return steps.select(
        "part", "filter_order", "step",
        total("c.mask & (before | own) = 0").alias("kept"),
        total(removed).alias("removed"),
        total("c.mask & before <> 0 AND c.mask & own <> 0").alias("redundant"),
        total("c.mask = own").alias("unique_fails"),
        total(f"{removed} AND c.good").alias("good_lost"),
        total(f"{removed} AND c.toxic").alias("toxic_lost"),
        total("c.mask & own <> 0", "c.n * (120 div bit_count(c.mask))").alias("shapley"))
