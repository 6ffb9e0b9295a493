import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tablesmith.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def patterns_of(counts, capacity):
    table, n = packing.plan(dict(counts), capacity)
    places = []
    for w, c in counts.items():
        rows = table[table[:, 0] == w]
        at = np.searchsorted(rows[:, 1], np.arange(c), side="right") - 1
        k = np.arange(c) - rows[at, 1]
        places += list(zip(rows[at, 2] + k // rows[at, 3], rows[at, 4] + k % rows[at, 3] * w, [w] * c))
    return places, n


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_gapless_and_near_best(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.choice([1, 7, 60, 400])))
    places, n = patterns_of(counts, capacity)
    ends = {}
    for sequence, offset, w in sorted(places):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + w
    assert len(ends) == n and max(ends.values()) <= capacity
    total = sum(w * c for w, c in counts.items())
    assert n <= 11 / 9 * -(-total // capacity) + max(2, sum(c for w, c in counts.items() if 2 * w > capacity))


def best(items, capacity):
    """Fewest sequences, by trying everything."""
    items = sorted(items, reverse=True)
    found = [len(items)]

    def go(i, rooms):
        if len(rooms) >= found[0]:
            return
        if i == len(items):
            found[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1:])
        go(i + 1, rooms + [capacity - items[i]])

    go(0, [])
    return found[0]


@pytest.mark.parametrize("seed", range(40))
def test_dominance_keeps_the_best_count(seed):
    rng = random.Random(seed)
    low = rng.choice([1, 5, 8])
    items = [rng.randint(low, 20) for _ in range(9)]
    fixed, rest = packing.reduce_by_dominance(Counter(items), 20)
    left = [w for w, c in rest.items() for _ in range(c)]
    assert sum(len(s) * t for s, t in fixed) + len(left) == 9
    assert sum(t for _, t in fixed) + (best(left, 20) if left else 0) == best(items, 20)


def brute(texts, tokenizer_path, capacity):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path)
    for doc, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            yield doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def check(rows, texts, tokenizer_path, capacity):
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in rows)
    assert got == Counter(brute(texts, tokenizer_path, capacity))
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(e <= capacity for e in ends.values())
    return len(ends)


def test_documents(spark, tokenizer_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    packed = packing.pack(docs, tokenizer_path, 512)
    rows = packed.collect()
    n = check(rows, texts, tokenizer_path, 512)
    assert n <= 1.01 * sum(r["length"] for r in rows) / 512 + 1
    whole = packing.sequences(packed)
    by_sequence = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        by_sequence[r["sequence_id"]] = by_sequence.get(r["sequence_id"], b"") + bytes(r["ids"])
    assert {r["sequence_id"]: bytes(r["ids"]) for r in whole.collect()} == by_sequence


def test_odd_texts(spark, tokenizer_path):
    texts = [(1, None), (2, ""), (2, ""), (3, " \t\n"), (4, "ΑΣ ΑΣ. İstanbul ﬁ é́x <|endoftext|> a<|STARTOFTEXT|>b"),
             (5, "'s 'tis don't we'll 123 ４５ a.'re x̸= e,́ a…b!?c Ａ，b\u0085c　d"), (6, "word, " * 3000),
             (None, "no id"), (7, "x" * 9000)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in texts], "doc_id long, text string, length string, row_id int")
    check(packing.pack(docs, tokenizer_path, 64).collect(), texts, tokenizer_path, 64)


def test_empty(spark, tokenizer_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    packed = packing.pack(docs, tokenizer_path)
    assert packed.collect() == [] and {"sequence_id", "offset", "ids"} <= set(packed.columns)
