import random

import numpy as np
import pyarrow as pa

from tablesmith.llm import hashing, line_dedup, similar

SF = "/root/testdata/sf0.001"


def shingles(line):
    line = line.strip(" ").translate({i: i + 32 for i in range(65, 91)})
    return frozenset(line[i:i + 8] for i in range(len(line) - 7)) if len(line) >= 8 else None


def brute(rows):
    """(doc_id, n_lines, removed line numbers) of each document."""
    lines, texts = {}, sorted(set(rows), key=lambda r: (r[0] is not None, r[0]))
    for doc, text in texts:
        for k, line in enumerate([] if text is None else text.split("\n")):
            s = shingles(line)
            if s:
                lines.setdefault(s, []).append((doc, k))
    sets = list(lines)
    parent, index = list(range(len(sets))), {}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for h in s:
            for j in index.get(h, ()):
                common[j] = common.get(j, 0) + 1
            index.setdefault(h, []).append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    members = {}
    for i, s in enumerate(sets):
        members.setdefault(root(i), []).extend(lines[s])
    key = lambda x: (x[0] is not None, x)
    gone = {x for m in members.values() for x in m if x != min(m, key=key)}
    return sorted(((doc, 0 if text is None else len(text.split("\n")), sorted(k for d, k in gone if d == doc))
                   for doc, text in rows), key=str)


def got(docs):
    return sorted(((r["doc_id"], r["n_lines"], r["removed"]) for r in line_dedup.line_report(docs).collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == brute(rows)


def test_variants_and_odd_lines(spark):
    rng = random.Random(5)
    base = "the quick brown fox jumps over the lazy dog and runs away into the forest"
    rows = []
    for i in range(40):
        words = base.split()
        words[rng.randrange(len(words))] = f"w{i}"
        rows.append((i, f"own line number {i * 7919}\n{' '.join(words)}\nshort\n\n  {base.upper()} "))
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, "ééééééééé\nÉÉÉÉÉÉÉÉÉ\nééééééééé"), (44, rows[0][1]), (44, rows[0][1]),
             (None, base), (45, "long " * 30_000 + "\n" + base)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, line int, removed string")
    assert got(docs) == brute(rows)
    left = line_dedup.without_repeated_lines(docs)
    assert left.columns == docs.columns
    want = sorted(((doc, None if text is None else "\n".join(
        x for k, x in enumerate(text.split("\n")) if k not in gone)) for (doc, text), gone in
        ((r, next(b[2] for b in brute(rows) if b[0] == r[0])) for r in rows)), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == want


def test_counts_and_empty(spark):
    docs = spark.createDataFrame([(1, "a common line here\nown", 22), (2, "a common line here\nother one line", 33)],
                                 "doc_id long, text string, n_chars long")
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.without_repeated_lines(docs).collect()}
    assert left == {1: ("a common line here\nown", 22), 2: ("other one line", 14)}
    none = docs.where("doc_id > 5")
    assert line_dedup.line_report(none).collect() == [] and line_dedup.without_repeated_lines(none).collect() == []


def test_pairs_at_the_threshold_share_a_band():
    rng, plan, sets = np.random.default_rng(3), line_dedup.PLAN, []
    for _ in range(2000):
        x = rng.integers(1, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
        sets += [x[:35], np.delete(x, slice(30, 35))]  # 30 of 40 in common
    minima = hashing.MinHasher(plan.minima, plan.seed).minima(np.concatenate(sets), np.arange(4001) * 35)
    keys = hashing.band_keys(minima, plan.rows)
    assert (keys[:, ::2] == keys[:, 1::2]).any(axis=0).all()


def test_lines_are_lowered_once_and_plain_ascii_cheaply(spark):
    rows = [(1, "  ABC Éé ÀZ lines \nPLAIN ascii [@`{ LINE\nshort\nİSTANBUL Straße K", None), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    lines = line_dedup._lines(docs)
    assert sorted((r["id"]["doc_id"], r["id"]["line"], r["text"]) for r in lines.collect()) == [
        (1, 0, "abc Éé Àz lines"), (1, 1, "plain ascii [@`{ line"), (1, 3, "İstanbul straße k")]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and "lower(" in plan


def test_texts_of_the_second_look_are_hashed_for_its_pairs_only():
    hashed = []

    def shingle(data, offsets):
        hashed.append(len(offsets) - 1)
        return line_dedup.char_shingles(data, offsets)

    plan = similar.Plan(shingle, bands=32, rows=4, percent=75, short=True)
    texts = pa.array([f"{i % 3} some line of text, one of three kinds, here" for i in range(900)])
    p, q = np.array([0, 0, 5]), np.array([1, 3, 8])
    assert similar._linked_texts(texts, p, q, plan).tolist() == [True, True, True] and hashed == [5]
    assert similar._linked_texts(texts, p[:0], q[:0], plan).tolist() == [] and hashed == [5]
    far = pa.array(["a line of its own, unlike the other", "something else that shares nothing"])
    assert similar._linked_texts(far, p[:1], q[:1], plan).tolist() == [False]


def test_character_windows_of_whole_lines_and_short_ones():
    lines = ["exactly8", "ééééé and ÀÀÀ more", "plain ascii line", "ééééééééé", "日本語の長い行です。もっと", "x" * 300]
    each = [line_dedup.char_shingles(*hashing.texts(pa.array([x]))) for x in lines]
    for more in ([], ["short"]):
        values, bounds = line_dedup.char_shingles(*hashing.texts(pa.array(lines + more)))
        for k, line in enumerate(lines):
            mine = values[bounds[k]:bounds[k + 1]]
            assert (mine == each[k][0]).all() and len(mine) == len(line) - 7
            again = [line_dedup.char_shingles(*hashing.texts(pa.array([line[i:i + 8]])))[0][0] for i in range(len(mine))]
            assert mine.tolist() == again


def test_binned_minima_agree_like_independent_ones():
    rng, plan = np.random.default_rng(4), line_dedup.PLAN
    for common, mine, its in ((3, 1, 0), (6, 1, 1), (9, 1, 2), (30, 5, 5), (75, 0, 25), (300, 50, 50)):
        count = 4000 if common < 100 else 800
        x = rng.integers(1, 1 << 63, (count, common + mine + its), dtype=np.uint64) * np.uint64(2)
        a, b = x[:, :common + mine], np.delete(x, slice(common, common + mine), axis=1)
        hasher = hashing.BinnedMinHasher(plan.bands, plan.rows, plan.seed)
        m, n = (hasher.minima(y.reshape(-1), np.arange(count + 1) * y.shape[1]) for y in (a, b))
        per_row = (m == n).mean(axis=1)
        assert abs(per_row.mean() - 0.75) < 0.01 and per_row.min() > 0.68 and per_row.max() < 0.82
        ma, mb = (hashing.band_keys(y, plan.rows) for y in (m, n))
        assert (ma == mb).any(axis=0).all() and abs((ma == mb).mean() - 0.75 ** 4) < 0.02
        # no wider than independent minima, or estimates would need more slack
        assert (m == n).mean(axis=0).std() < 1.05 * (0.75 * 0.25 / plan.minima) ** 0.5
    far = rng.integers(1, 1 << 63, (2, 20_000), dtype=np.uint64)
    m, n = (hasher.minima(y, np.arange(0, 20_001, 8)) for y in far)
    assert not (hashing.band_keys(m, plan.rows) == hashing.band_keys(n, plan.rows)).any()


def test_lines_are_cut_as_by_columns(spark):
    texts = ["", " ", "\n", "  \n  an indented line  \n\nshort\n", "ééééé ÀÀÀ\n       8\n  日本語の長い行です。もっと ", "x" * 200_000 + "\nthe end of it",
             "trailing spaces      ", "tab\tis no space\t \r", "exactly8", "\n\n last line of all"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "doc_id long, text string")
    want = sorted((r["id"]["doc_id"], r["id"]["line"], r["text"]) for r in line_dedup._lines(docs).collect())
    got = []
    for text, line, start, size, lines in line_dedup._cut(pa.array(texts)):
        for k, own in enumerate(lines):
            lower = {i: i + 32 for i in range(65, 91)}
            assert own.decode() == texts[text[k]].encode()[start[k]:start[k] + size[k]].decode().translate(lower)
            got.append((int(text[k]), int(line[k]), own.decode()))
    assert sorted(got) == want


def test_keys_travel_packed_and_meet(spark, monkeypatch):
    monkeypatch.setattr(similar, "PACKED", 50)
    rows = [(i, f"{'one line that many documents have' if i % 3 else 'another line of a text'}, nearly {i % 90:03d}\nown {i * 7919:09d}")
            for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hasher = hashing.BinnedMinHasher(32, 4, line_dedup.PLAN.seed)
    node, key = [], []
    for *_, size, lines in line_dedup._cut(pa.array([t for _, t in rows])):
        node += line_dedup._named(lines, size, 1, 1)
        key.append(hashing.band_keys(hasher.minima(*line_dedup._shingles(lines, size)), 4))
    node, key = np.concatenate(node), np.concatenate(key, axis=1)
    packed = similar._packed([(node, key)], 7)
    assert packed.num_rows < 7 + 32 * 300 // 1000 + 1  # not a row per key
    members = {}
    for k in range(32):
        for n, v in zip(node.tolist(), key[k].view(np.int64).tolist()):
            members.setdefault(v, set()).add(n)
    want = {k: m for k, m in members.items() if len(m) > 1}
    met = line_dedup._met(docs.repartition(5), 600, 1).collect()
    got = {}
    for r in met:
        got.setdefault(r["key"], set()).update((r["a"], r["b"]))
    assert got == want
    for k, m in want.items():  # every member is tied to the others by meetings
        links, seen = [(r["a"], r["b"]) for r in met if r["key"] == k], {min(m)}
        for _ in m:
            seen |= {x for link in links if seen & set(link) for x in link}
        assert seen == m


def test_lines_that_share_a_name_are_told_apart(spark, monkeypatch):
    rows = [(1, "the first line\nthe second line"), (2, "a third one here\nthe first line"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seeds, table = [], line_dedup._line_table

    def clashing(docs, seed):
        seeds.append(seed)
        made = table(docs, seed)
        return made if len(seeds) > 1 else made.selectExpr("doc_id", "text_hash", "line", "start", "size", "7L AS node", "check")

    monkeypatch.setattr(line_dedup, "_line_table", clashing)
    assert got(docs) == brute(rows) and len(seeds) == 2


def test_names_of_lines():
    lines = [b"exactly8", b"exactly9!", b"exactly9!\0", b"exactly8exactly9", b"exactly9exactly8", b"12345678", b"exactly8", b"exactly8" * 2]
    size = np.array([len(x) for x in lines])
    for seed in (1, 2):
        names = line_dedup._named(lines, size, seed, 2)
        for k in range(2):
            assert len(set(names[k].tolist())) == 7 and names[k][0] == names[k][6]
            assert names[k].tolist() == [int(line_dedup._named([x], np.array([len(x)]), seed, 2)[k][0]) for x in lines]
        assert not set(names[0].tolist()) & set(names[1].tolist())
    assert line_dedup._named(lines, size, 1, 1)[0][0] != line_dedup._named(lines, size, 2, 1)[0][0]


def test_sets_in_order():
    rng = np.random.default_rng(8)
    bounds = np.array([0, 0, 5, 5, 40, 41, 300, 300])
    values = rng.integers(0, 60, 300, dtype=np.uint64)
    kept = values.copy()
    own, edges = similar.distinct_sorted(values, bounds)
    assert (values == kept).all()
    for k in range(len(bounds) - 1):
        assert own[edges[k]:edges[k + 1]].tolist() == np.unique(values[bounds[k]:bounds[k + 1]]).tolist()
    assert [len(x) for x in similar.distinct_sorted(values[:0], np.zeros(1, int))] == [0, 1]


def test_links_are_counted_in_full():
    # all members share the 16 bits that are marked first
    sets = [np.arange(a, b, dtype=np.uint64) << np.uint64(16) for a, b in ((0, 8), (0, 6), (2, 8), (8, 16), (1, 8), (0, 8))]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    p, q = np.array([0, 0, 0, 0, 0, 1, 3]), np.array([1, 2, 3, 4, 5, 2, 4])
    assert similar._link(np.concatenate(sets), bounds, p, q, 75).tolist() == [True, True, False, True, True, False, False]
