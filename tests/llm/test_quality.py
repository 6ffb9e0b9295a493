import re

import pytest
from pyspark.sql import functions as F

from tablesmith.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = {}
    for t in triples:
        count[t] = count.get(t, 0) + 1
    covered = {i + k for i, t in enumerate(triples) if count[t] > 1 for k in range(3)}
    measures = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*measures, len(words) < 50 or 100 * len(covered) > 50 * len(words))


TEXTS = [None, "", " \t\n", "one", "a b c a b c", "a a a a a", "x\ny\nx\n\n \nx", "é ü #$ <b> %&|*", "w " * 60, "a b c d " * 30 + "tail",
         "\x0b\x0ca\x1cb c", " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i}" for i in range(70)) + " w1 w2 w3 w2 w3 w4",
         "line one here\nline two here\nline one here\r\nline one here"]


def rows(spark, texts):
    return spark.createDataFrame([(k, t, 5, "w", 1) for k, t in enumerate(texts)],
                                 "doc_id long, text string, n_words int, __w string, kept int")


def test_base_measures(spark):
    judged = quality.judged(rows(spark, TEXTS + TEXTS[3:5]))
    got = sorted(judged.collect(), key=lambda r: r["doc_id"])
    assert [tuple(r[c] for c in (*quality.MEASURES[:5], "base_failed")) for r in got] == [brute(t) for t in TEXTS + TEXTS[3:5]]
    assert "__w" in judged.columns and not any(r["kept"] and r["base_failed"] for r in got)


def test_very_long_texts(spark):
    long = " ".join(f"w{i * 7919 % 150_000}" for i in range(200_000))
    got = quality.judged(rows(spark, [long])).collect()[0]
    assert tuple(got[c] for c in quality.MEASURES[:5]) == brute(long)[:5] and got["n_repeat_words"] > 90_000


def test_triples_that_share_a_part_of_their_hash(spark, monkeypatch):
    # whatever the hash's bits, repeats are found among equal words
    monkeypatch.setattr(quality, "_TRIPLES", quality._TRIPLES.replace("xxhash64(__w[i], __w[i + 1], __w[i + 2])",
                                                                      "shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]), 20)"))
    texts = [" ".join(f"w{i % 500}" for i in range(1500)), "a b c d " * 30]
    got = sorted(quality.judged(rows(spark, texts)).collect(), key=lambda r: r["doc_id"])
    assert [r["n_repeat_words"] for r in got] == [brute(t)[4] for t in texts]


def test_clean_documents_keep_columns(spark):
    good = "The house on the hill was built in the year of the great storm and it has stood there for all of us to see, " * 1
    text = " ".join(f"{good}part {k}." for k in range(4))
    df = rows(spark, [text, None, "a b c", text])
    out = quality.clean_documents(df)
    assert out.columns == df.columns and all(r["text"] == text for r in out.collect())
    assert quality.clean_documents(df.where("false")).collect() == []


@pytest.mark.parametrize("rule,text,passes", [
    ("mean word length", "a " * 60, False), ("symbols per word", "word # " * 60, False), ("exclamations", "wow!! " * 60, False)])
def test_rules(spark, rule, text, passes):
    own = next(r for r in quality.RULES if r.name == rule)
    m = quality.measured(rows(spark, [text])).withColumn("passes", F.expr(own.sql()))
    assert m.collect()[0]["passes"] is passes
