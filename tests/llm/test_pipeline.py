import duckdb
import pytest

import corpus_pipeline as pipeline
from tablesmith.llm import mixing, queries

from . import test_line_dedup as lines
from . import test_minhash as near
from . import test_packing as packs

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_every_stage(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    con = duckdb.connect()

    stage = dict(pipeline.STAGES)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    clean = stage["quality rules"](spark, docs, SF).cache()
    want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.SQL['op4_quality_rules']}) WHERE kept").fetchall()}
    assert rows_of(clean, *names) == [r for r in rows_of(docs, *names) if r[0] in want]

    short = stage["line dedup"](spark, clean, SF).cache()
    texts = [(r["doc_id"], r["text"]) for r in clean.collect()]
    gone = {d: g for d, _, g in lines.brute(texts)}
    want = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])) for d, t in texts]
    assert rows_of(short, "doc_id", "text") == sorted([x for x in want if x[1].split()], key=str)

    alone = stage["near dedup"](spark, short, SF).cache()
    kept = {r[0] for r in near.brute([(r["doc_id"], r["text"]) for r in short.collect()]) if r[3]}
    assert alone.columns == names
    assert rows_of(alone, *names) == [r for r in rows_of(short, *names) if r[0] in kept]

    mix = stage["source mixing"](spark, alone, SF).cache()
    unmixed = alone.toPandas()  # noqa: F841 (read by DuckDB)
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM unmixed")
    copies = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, copies FROM ({queries.SQL['op9_mixing']})").fetchall()}
    assert rows_of(mix, *names) == sorted([r for r in rows_of(alone, *names) for _ in range(copies.get(r[0], 0))], key=str)

    packed = stage["packing"](spark, mix, SF)
    packs.check(packed.collect(), [(r["doc_id"], r["text"]) for r in mix.collect()],
                queries.tokenizer_path("word_bpe_49k.json"), 4096)


def test_mixing_budgets_reach_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "x", "s4", 1000)],
        "__domain string, __lang string, __source string, tokens long")
    targets = mixing.Targets(tokens=400, max_epochs=1)
    got = {r["__source"]: r["budget"] for r in mixing.budgets(leaves, targets).collect()}
    # a and b get 200 each, a's languages 100 each; s1 gives 10 and its shortage stays in its language
    assert got == {"s1": 10, "s2": 90, "s3": 100, "s4": 200}
    short = {r["__source"]: r["budget"] for r in mixing.budgets(leaves, mixing.Targets(tokens=2800, max_epochs=1)).collect()}
    # b gives all it has and a takes over: its languages 900 each by weight, s1's shortage staying inside
    assert short == {"s1": 10, "s2": 890, "s3": 900, "s4": 1000}


def test_mixing_odd_rows(spark):
    rows = [(1, None, None, "a b c"), (1, None, None, "a b c"), (2, "en", "src1", None), (3, "en", "src1", "d e"),
            (None, "en", "src1", "f g h"), (4, "zz", "x" * 50 + "9" * 40, "i j " * 5000)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows],
                                 "doc_id long, lang string, source string, text string, copies int, __leaf string")
    targets = mixing.Targets(percent=150, max_epochs=2)
    chosen = mixing.mixed(docs, targets, mixing.domain_of()).collect()
    assert sum(r["n_tokens"] * r["copies"] for r in chosen) <= 1.5 * 10011
    assert {r["doc_id"] for r in chosen} <= {1, 2, 3, 4, None} and all(1 <= r["copies"] <= 2 for r in chosen)
    none = mixing.mixed(docs.where("doc_id > 9"), targets, mixing.domain_of())
    assert none.collect() == []
