import random
import re
from itertools import permutations

from tablesmith.llm import filter_audit as audit


def brute(rows, labels):
    out, masks = [], []
    for i, part, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = [j for j, _, t in rows if (t or "") == text and j is not None and (i is None or j < i)]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": bool(smaller)}
        mine = [x for x in labels if i is not None and x[0] == i]
        masks.append((part or "", {f for f in fails if fails[f]}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    for part in sorted({m[0] for m in masks}):
        own = [m for m in masks if m[0] == part]
        count = {o: [] for o in map("".join, permutations("ABCDE"))}
        shapley = dict.fromkeys("ABCDE", 0)
        for order in count:
            left = own
            for f in order:
                gone = [m for m in left if f in m[1]]
                shapley[f] += len(gone)
                again = sum(f in m[1] for m in own) - len(gone)
                left = [m for m in left if f not in m[1]]
                count[order].append((len(left), len(gone), again, sum(m[1] == {f} for m in own),
                                     sum(m[2] for m in gone), sum(m[3] for m in gone)))
        out += [(part, o, k + 1, *c, shapley[o[k]]) for o in count for k, c in enumerate(count[o])]
    return sorted(out)


def texts(n=260, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "été", "x" * 30, "50%", " ", " y", "\x1c", "a\x0bb", "Ärger"]
    plain = [f"w{k}" for k in range(400)]
    some = []
    for _ in range(n):
        pool = rng.choice([plain, words, plain + words, plain[:20]])
        body = [rng.choice(pool) for _ in range(rng.choice([0, 3, 150, 199, 200, 201, 420]))]
        some.append(rng.choice([" ", "\n", " \t\r\n"]).join(body))
    return some


def rows(seed=1):
    rng = random.Random(seed)
    some = texts(seed=seed)
    out = [(k, rng.choice(["en", "de", "", None]), rng.choice(some)) for k in range(400)]
    shared = "license " * 700
    out += [(1000 + k, "en", shared + str(k % 9)) for k in range(60)] + [(2000 + k, "fr", "hot") for k in range(100)]
    out += [(3000, "x", None), (3001, "x", ""), (3, "en", "again"), (3, "en", "again"), (3, "en", "other"), (2, "en", "other"),
            (None, "n", "hot"), (None, "n", "nobody"), (None, "m", "nobody"), (3002, "en", shared), (3003, "en", shared)]
    return out


def check(spark, data, labels):
    docs = spark.createDataFrame([(i, p, t, b"x", 1) for i, p, t in data],
                                 "doc_id long, part string, text string, digest binary, mask int").repartition(4)
    table = spark.createDataFrame([(*x, "?") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = audit.audit(audit.masks(docs), table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(data, labels)


LABELS = [(k, k % 2, k % 3 == 0) for k in range(0, 400, 3)] + [(3, 1, 0), (3, 0, 1), (2001, None, 1), (None, 1, 1), (9999, 1, 1)]
LABELS = [(a, b, None if c is None else int(c)) for a, b, c in LABELS]


def test_every_order(spark):
    check(spark, rows(), LABELS)


def test_small_tries_and_growing_prefixes(spark, monkeypatch):
    monkeypatch.setattr(audit, "TRIE_BYTES", 4000)
    monkeypatch.setattr(audit, "LEAST_GROUP", 500)
    monkeypatch.setattr(audit, "FIRST_PREFIX", 4)
    docs = spark.createDataFrame([(k, None, t) for k, (_, _, t) in enumerate(rows(2))], "doc_id long, part string, text string")
    table = audit.stored(audit.judged(docs), "judged").where("text IS NOT NULL")
    found = [(bytes(r["text"]), bytes(r["prefix"])) for r in audit.with_prefixes(table).collect()]
    assert all(t.startswith(p) for t, p in found) and len({len(p) for _, p in found}) > 3
    assert len(dict(found)) == len(set(found))  # equal texts, equal prefixes
    check(spark, rows(2), LABELS)


def test_no_rows(spark):
    check(spark, [], LABELS)
    check(spark, [(1, None, None)], [])


def test_trie_holds_the_smallest_value_of_each_text():
    rng = random.Random(3)
    some = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() * rng.choice([1, 1, 50]) for _ in range(3000)]
    trie, want = audit.Trie(), {}
    for k, t in enumerate(rng.sample(list(enumerate(some)), len(some))):
        trie.put(t[1], (t[0], t[1]))
        want[t[1]] = min(want.get(t[1], t[0]), t[0])
    found = list(trie.values())
    assert sorted(found) == sorted((v, t) for t, v in want.items())


def test_words_of_very_long_texts_are_counted_in_chunks(monkeypatch):
    text = ("one two\x0bthree\n" * 5000 + "x" * 3000).encode()
    whole = audit.word_counts(text)
    monkeypatch.setattr(audit, "WORD_CHUNK", 1000)
    assert audit.word_counts(text) == whole == (15001, 4)
