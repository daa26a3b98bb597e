"""Registered corpus queries against their oracle SQL, and the pipeline against a plain version of its stages."""

import os
import sys

import oracle
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from pairlens.llm import queries as Q  # noqa: E402

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


class Named:
    def __init__(self, name):
        self.name, self.sql = name, Q.ORACLE.get(name)

    def __call__(self, spark, folder):
        return Q.QUERIES[self.name](spark, folder)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, con, name):
    assert oracle.compare(spark, con, Named(name), FOLDER)[0] == "ok"


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_rows(spark, con, name):
    n = con.execute("SELECT count(*) FROM documents").fetchone()[0]
    rows = Q.QUERIES[name](spark, FOLDER)
    assert "doc_id" in rows.columns
    assert rows.count() == n or name.startswith("op8")


def test_benchmark_passages_are_found(spark, con):
    """The documents that hold an item word for word, and no others."""
    texts = con.execute("SELECT doc_id, text FROM documents").fetchall()
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    expected = {(d, i) for d, t in texts for i, b in items if b in (t or "")}
    found = {(r.doc_id, r.item_id) for r in Q.QUERIES["op8_benchmark_decontamination"](spark, FOLDER).collect()}
    assert expected <= found and len(found - expected) <= len(expected) // 10


def test_pipeline(spark, con):
    """Stage by stage: what goes, what changes, and the columns."""
    docs, folder = spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER
    columns = docs.columns
    items = [b for (b,) in con.execute("SELECT text FROM benchmark").fetchall()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        rows = {r.doc_id: r for r in after.collect()}
        assert set(rows) <= set(before)
        gone = set(before) - set(rows)
        if name == "soft_mixing":
            assert after.columns == [*columns, "rate"] and all(r.rate > 0 for r in rows.values())
        else:
            assert after.columns == columns
        if name == "line_dedup":
            assert not gone and all(set(r.text.split("\n")) <= set(before[i].text.split("\n")) | {""} for i, r in rows.items())
        else:
            assert all(r.text == before[i].text for i, r in rows.items())
        if name == "ngram_jaccard_join":
            kept = {r.text for r in rows.values()}
            assert len(kept) >= len({r.text for r in rows.values() if r.text.strip()})
        if name == "benchmark_decontamination":
            assert not any(b in r.text for r in rows.values() for b in items)
        docs = after.select(*columns)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(rows)


def test_stages_keep_columns_of_any_name(spark, make_docs, words, con):
    """Columns named like the helpers and results of the stages; the last stage puts its rate in place of theirs."""
    names = ["rate", "Word", "mask", "gone", "row_key", "overlapping", "line_doc", "line_digests", "domain", "label", "n_tokens", "posterior", "key", "head", "copies", "seeds"]
    rows = [(i, words(("clash", i % 15), 40) + f"\nthis line stands in very many documents\n{i}") for i in range(30)]
    docs = make_docs(rows).select("doc_id", "text", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name == "soft_mixing":
            assert out.columns == [c for c in docs.columns if c != "rate"] + ["rate"]
            assert dict(out.dtypes)["rate"] == "double"
        else:
            assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names if n != "rate" or name != "soft_mixing")
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert 0 < docs.count() <= 15


def test_stages_take_empty_and_hard_tables(spark, make_docs, hard_rows, con):
    for rows in (hard_rows, []):
        docs = make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
        assert docs.count() >= (8 if rows else 0)
