import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tablesmith.llm import components, hashing, minhash, similar

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def brute(rows):
    sets = {}
    for doc, text in rows:
        sets.setdefault(doc, shingles(text))
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    roots = union_find(links, ids)
    return sorted((doc, len(shingles(text)), roots[doc], roots[doc] == doc) for doc, text in rows)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(minhash.near_duplicates(docs)) == brute(rows)


def family(n, seed, words=80):
    """Variants of one text with more and more edits: some linked, some not."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 999)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(words)] = f"x{rng.randint(0, 999)}"
        out.append(" ".join(w))
    return out


def test_families_and_copies(spark, monkeypatch):
    monkeypatch.setattr(similar, "SKETCH_BLOCK", 7)  # the large-bucket way on small buckets
    rows = list(enumerate(family(60, 1) + ["same text of copies, long enough for shingles"] * 40 + family(40, 2)))
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(docs)) == brute(rows)


def short_families(seed, families=60, variants=14):
    """Families of short texts (6 to 30 shingles) that differ in words at both ends: about one shingle a word."""
    rng, out = random.Random(seed), []
    for f in range(families):
        base = [f"f{f}w{k}" for k in range(rng.randint(10, 34))]
        for v in range(variants):
            w, most = list(base), max(1, len(base) // 8)
            for k in (*range(rng.randint(0, most)), *(-1 - k for k in range(rng.randint(0, most)))):
                w[k] = f"v{v}x{k}"
            out.append(" ".join(w))
    return out


def test_short_families(spark):
    rows = list(enumerate(short_families(4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(docs)) == brute(rows)


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(7)
    plan, n = minhash.PLAN, 200
    hasher = hashing.MinHasher(similar.SKETCH, plan.seed + 1)
    least = similar.SKETCH * (1 + plan.slack(similar.SKETCH, 1)) / 2
    for common, a, b in ((6, 1, 1), (9, 1, 2), (12, 2, 2), (18, 3, 3)):
        sets = []
        for _ in range(n):
            x = rng.integers(1, 1 << 63, common + a + b, dtype=np.uint64) * np.uint64(2)
            sets += [x[:common + a], np.delete(x, slice(common, common + a))]
        made = similar._sketch(hasher.minima(np.concatenate(sets), np.cumsum([0, *map(len, sets)])))
        assert (similar.SKETCH - np.bitwise_count(made[::2] ^ made[1::2]).sum(axis=1, dtype=int) >= least).all()


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"),
            (8, "éa É b c d e"), (9, "éa É b c d e"), (9, "éa É b c d e"), (10, "a b c d e f g h " * 5000),
            (11, "a b c d e f g h " * 4000)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, node string, set_hash int")
    assert got(minhash.near_duplicates(docs)) == brute(rows)
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 4, 6, 8, 10]


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, None), (3, "a b c d e")], "doc_id long, text string")
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert found == {(None, 1, 3), (None, 0, None), (3, 1, 3)}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).collect() == [] and minhash.drop_near_duplicates(none).collect() == []


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    plan, errors = minhash.PLAN, []
    hasher = hashing.MinHasher(plan.minima, 1)
    for _ in range(60):
        common, own = rng.integers(1, 1 << 62, 300, dtype=np.uint64), rng.integers(1, 1 << 62, 200, dtype=np.uint64)
        k = rng.integers(0, 100)
        values = np.concatenate([common, own[:k], common, own[100:100 + k]])
        minima = hasher.minima(values, np.array([0, 300 + k, 600 + 2 * k]))
        agree = (minima[:, 0] & 15 == minima[:, 1] & 15).mean()
        errors.append((agree - 1 / 16) / (15 / 16) - 300 / (300 + 2 * k))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


@pytest.mark.parametrize("seed,at_once", [(0, 1), (1, 7), (2, components.AT_ONCE)])
def test_components(spark, monkeypatch, seed, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    rng = random.Random(seed)
    n = 120
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)] + [
        (300, i) for i in range(301, 340)]
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    found = components.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {
        k: v for k, v in union_find(pairs, {x for p in pairs for x in p}).items() if k in nodes}


def test_steps_on_few_links_start_few_tasks(spark, monkeypatch):
    kept, files = components.stored, []

    def stored(df, name, **kw):
        out = kept(df, name, **kw)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "stored", stored)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    pairs = [(i, i + 1) for i in range(300) if i % 10 != 9] + [(5, 5), (3, 2)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(3))
        assert {r.node: r.component for r in found.collect()} == {i: i - i % 10 for i in range(300)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 4 and max(files) <= spark.sparkContext.defaultParallelism < 40


def test_bands_of_documents_take_one_pass(spark, monkeypatch):
    passes, one = [], similar._buckets
    monkeypatch.setattr(similar, "_buckets", lambda found: passes.append(1) or one(found))
    rows = [(1, " ".join(map(str, range(30)))), (2, " ".join(map(str, range(31)))), (3, "other words"), (4, None)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert len(passes) == 1


def test_words_and_windows():
    texts = ["a  b\tc", "", " x ", "Ab aB", "é ü"]
    data, offsets = hashing.texts(pa.array(["skip", *texts]).slice(1))
    starts, ends, bounds = hashing.words(data, offsets)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert found == [w for t in texts for w in t.split()] and list(np.diff(bounds)) == [len(t.split()) for t in texts]
    same = hashing.Prefix(data, hashing.BYTE_LOWER).spans(starts, ends)
    assert same[4] == same[5] and len(set(same.tolist())) == len(same) - 1


def thue_morse():
    """Two words of 1,024 letters that collide modulo 2**64 under every odd base."""
    bits = [0]
    for _ in range(10):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_words_that_polynomials_confuse(spark):
    a, b = thue_morse()
    data, offsets = hashing.texts(pa.array([a, b, a]))
    whole = hashing.Prefix(data).spans(offsets[:-1], offsets[1:])
    assert whole[0] == whole[2] != whole[1]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(
        spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_documents_that_share_an_id(spark):
    words = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(7, words, 1), (7, other, 2), (3, " ".join(f"u{k}" for k in range(60)), 3), (9, " ".join(f"u{k}" for k in range(60)), 4),
            (9, " ".join(f"t{k}" for k in range(60)), 5), (9, words + " more", 6), (None, other + " tail", 7), (8, "", 8), (8, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    left = minhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r["row"] for r in left.collect()) == [1, 2, 3, 5, 8]
