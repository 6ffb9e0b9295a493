import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.llm import debruijn, hashing, suffix_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def removed(sequences, size):
    """Masks of the members covered by windows that an equal one precedes."""
    seen, out = set(), []
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - size + 1):
            w = s[i:i + size] if isinstance(s, bytes) else tuple(s[i:i + size])
            if w in seen:
                gone[i:i + size] = True
            seen.add(w)
        out.append(gone)
    return out


def brute_words(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    lists = [WORD.findall((t or "").encode()) for _, t in rows]
    return [(doc, len(w), int(g.sum()), b" ".join(x for x, y in zip(w, g) if not y).decode())
            for (doc, _), w, g in zip(rows, lists, removed(lists, 20))]


def brute_bytes(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc, _), t, g in zip(rows, texts, removed(texts, 100)):
        spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if len(g) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~g])
        out.append((doc, len(t), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(docs):
    return [tuple(r) for r in debruijn.without_repeats(docs).collect()]


def bytes_(docs):
    return [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in suffix_dedup.without_repeats(docs).collect()]


def same(a, b):
    assert sorted(a, key=str) == sorted(b, key=str)


def made_up(seed, n=120):
    """Documents with shared passages, copies with edits, periodic texts and chance repeats."""
    rng = random.Random(seed)
    vocabulary = ["a", "bé", "cat", "the", "of", "xx", "yyy", "zzzz"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 120))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(vocabulary) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 50)))]
        parts += rng.choices(passages, k=rng.randint(0, 3))
        if rng.random() < 0.1:
            parts.append(rng.choice(["ab " * 200, "x" * 700, "q w e r t " * 60]))
        if rows and rng.random() < 0.2:
            copy = list(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 2)):
                if copy:
                    copy[rng.randrange(len(copy))] = "#"
            parts.append("".join(copy))
        rng.shuffle(parts)
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 256), (2, 2)])
def test_made_up_documents(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "SORTED_RUNS", hot)
    rows = made_up(seed)
    docs = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    docs = docs.sortWithinPartitions("doc_id").cache()
    same(bytes_(docs), brute_bytes(rows))
    same(words(docs), brute_words(rows))


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    same(bytes_(docs), brute_bytes(rows))
    same(words(docs), brute_words(rows))


def test_odd_documents(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (1, None), (2, ""), (3, " \n"), (4, text), (5, "é" * 60), (6, "é" * 60), (7, "z" * 99),
            (8, "z" * 100), (9, "z" * 101), (10, "long text " * 30_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, minimizer string, place int")
    same(bytes_(docs), brute_bytes(rows))
    same(words(docs), brute_words(rows))
    twice = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted(r[2] for r in words(twice)) == [0, 0, 60]
    none = docs.where("doc_id > 99")
    assert words(none) == [] and bytes_(none) == []


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 6000).astype(np.uint8)
    data[3000:5000] = data[500:2500]
    prefix, starts = hashing.Prefix(data), rng.permutation(5900)
    segments = np.sort(rng.integers(0, 9, len(starts)))
    order = suffix_dedup.sort_suffixes(prefix, data, starts, segments)
    key = lambda i: (segments[i], bytes(data[starts[i]:starts[i] + 100]))
    assert order.tolist() == sorted(range(len(starts)), key=key)
    x, y = starts[:-1], starts[1:]
    found = suffix_dedup.common_extension(prefix, x, y)
    for a, b, n in zip(x.tolist(), y.tolist(), found.tolist()):
        assert bytes(data[a:a + n]) == bytes(data[b:b + n]) and (n == 100 or data[a + n] != data[b + n])


def test_long_words_that_polynomials_confuse(spark):
    from .test_minhash import thue_morse
    a, b = thue_morse()
    words = " ".join(f"w{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{words} {a}"), (2, f"{words} {b}"), (3, f"{words} {a}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in debruijn.without_repeats(docs).collect()} == {1: 0, 2: 0, 3: 20}
    # every 100 bytes of one word also stand in the other: what decides is the bytes themselves
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.without_repeats(
        spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    seen, want = {a[i:i + 100] for i in range(len(a) - 99)}, set()
    own = set(a[i:i + 100] for i in range(0))
    for i in range(len(b) - 99):
        if b[i:i + 100] in seen | own:
            want |= set(range(i, i + 100))
        own.add(b[i:i + 100])
    assert got[2] == len(want)


def test_paths_without_branches_are_compacted(spark):
    """A path over several sources, two passages that share a middle, and cycles."""
    names = "arc long, head long, tail long, n long, doc long, place long"
    chain = [(i, i, i + 1, 2, 100 + i // 7, 2 * i) for i in range(40)]  # a path over several documents
    fork = [(50, 200, 201, 1, 1, 0), (51, 202, 201, 1, 2, 0), (52, 201, 203, 3, 1, 1), (53, 203, 204, 1, 1, 4),
            (54, 204, 205, 1, 1, 5), (55, 204, 206, 1, 2, 5)]
    cycle = [(60, 300, 301, 1, 3, 0), (61, 301, 302, 1, 4, 0), (62, 302, 300, 1, 5, 0), (70, 400, 400, 1, 6, 0)]
    got = {r["arc"]: (r["path"], r["at"]) for r in
           debruijn.compacted(spark.createDataFrame(chain + fork + cycle, names)).collect()}
    assert len(got) == 50
    assert [got[i] for i in range(40)] == [(0, 2 * i) for i in range(40)]
    assert [got[i] for i in (50, 51, 52, 53, 54, 55)] == [(50, 0), (51, 0), (52, 0), (52, 3), (54, 0), (55, 0)]
    assert [got[i][1] for i in (60, 61, 62, 70)] == [0, 0, 0, 0]


def test_spans_are_long_and_verified(spark, monkeypatch):
    """A copied passage is one span; a span whose words differ at its source stays."""
    passage = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(passage)), (2, " ".join(["x"] * 5 + passage + ["y"])), (3, " ".join(passage[50:250]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    mark = (1 << 32) - 1
    spans = [(r["doc"], r["place"] & mark, r["length"]) for r in debruijn.repeated_spans(docs.where("doc_id < 3")).collect()]
    assert spans == [(2, 5, 300)]
    monkeypatch.setattr(debruijn, "SPANS_AT_ONCE", 1)  # a row of text for nearly every span
    same(words(docs), brute_words(rows))
    wrong = debruijn._long_spans(debruijn._later_arcs(docs)).withColumn("length", F.col("length") + 1)
    kept = {tuple(r) for r in debruijn._verified(docs, wrong).select("doc", "length").collect()}
    assert (2, 301) not in kept
