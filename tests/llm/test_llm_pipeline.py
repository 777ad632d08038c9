"""Registered queries against their SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from conftest import SF001
from llm_cases import docs, no_docs, rows
from platelens.llm import exact_dedup, packing, pieces, queries, simhash
from platelens.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t + '.parquet')}')")
    rel = con.sql(E.oracle_sql()[name])
    df = E.queries()[name](spark, SF001)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.select(*rel.columns)) == sorted(rel.fetchall(), key=repr)


def test_all_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_simhash", "op7_quality_rules", "op8_secret_scan", "op9_sentencepiece",
                                  "op11_periodic_runs", "op12_resampling", "op13_minhash"])
def test_one_row_per_document(spark, name):
    got = E.queries()[name](spark, SF001)
    assert got.select("doc_id").exceptAll(table(spark, SF001, "documents").select("doc_id")).count() == 0
    assert got.count() == table(spark, SF001, "documents").count()


def test_pipeline_stages(spark):
    d = table(spark, SF001, "documents")
    columns, seen = d.columns, [d.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = d
        d = stage(spark, d, SF001).cache()
        assert d.columns == columns and d.dtypes == before.dtypes
        seen.append(d.count())
        if name == "quality":
            assert d.exceptAll(before).count() == 0
            lab = spark.read.parquet(f"{SF001}/labels.parquet")
            kept = d.join(lab, "doc_id").groupBy("quality").count().collect()
            kept = {r["quality"]: r["count"] for r in kept}
            assert kept[1] >= 0.95 * lab.where("quality = 1").count() and kept.get(0, 0) <= 0.4 * lab.where("quality = 0").count()
        elif name == "exact_dedup":
            keep = exact_dedup.dedup(before).where("kept").select("doc_id")
            assert rows(d.select("doc_id")) == rows(keep)
        elif name == "simhash":
            near = simhash.near_duplicates(before)
            assert rows(d.select("doc_id")) == rows(near.select("component_id").distinct())
        else:
            assert rows(d.drop("text", "n_chars")) == rows(before.drop("text", "n_chars"))
            assert d.where("n_chars <> length(text)").count() == 0
    want = {r["doc_id"]: r["ids"] for r in pieces.encode(d, queries.PIECE_MODEL).collect()}
    got = {}
    for r in corpus_pipeline.run(spark, SF001).orderBy("doc_id", "part").collect():
        assert len(r["ids"]) == r["n_tokens"] <= r["bucket_length"] <= packing.MAX_LENGTH
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == want                               # every token of the masked texts, in order
    assert seen == sorted(seen, reverse=True) and seen[1] < seen[0]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("make", [lambda s: docs(s).selectExpr("*", "1L n_chars"), lambda s: no_docs(s).selectExpr("*", "1L n_chars")])
def test_stages_take_edge_tables(spark, make):
    d = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF001)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        d.collect()
    corpus_pipeline.STAGES[-1][1](spark, d, SF001).collect()
