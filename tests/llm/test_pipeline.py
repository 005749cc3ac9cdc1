"""Stages of the pipeline and registered queries over the smallest supplied tables."""

import os

import duckdb
import pytest
from brute import components as plain_components, contained, personal

import corpus_pipeline
from almanac.llm import toxicity
from almanac.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the supplied tables")


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (min(rows), rows[min(rows)].text, "en", "s", 1)], docs.schema)
    docs = docs.unionByName(extra)
    kept = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(~toxicity.held_out(3, 1))
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.predicted}
    left = [r for r in kept.collect()]
    assert kept.columns == columns and {r.doc_id for r in left} == {r.doc_id for r in docs.collect()} - bad
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SMALL)
    roots = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, root in roots.items() if i == root)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = {d for d, *_ in contained([(r.doc_id, r.text) for r in docs.collect()], items)}
    kept = corpus_pipeline.drop_contaminated(spark, docs, SMALL)
    assert kept.columns == columns and hit and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - hit
    kept = corpus_pipeline.redact_personal_data(spark, docs, SMALL)
    assert kept.columns == columns and kept.count() == docs.count()
    for r in kept.where("text is not null").collect():
        assert personal(r.text) == [] and r.n_chars == len(r.text)
        if not personal(rows[r.doc_id].text if r.doc_id in rows else ""):
            assert r.text in ("", rows[r.doc_id].text if r.doc_id in rows else "")


def test_run_packs_what_the_stages_keep(spark):
    packed = corpus_pipeline.run(spark, SMALL).toPandas()
    assert len(corpus_pipeline.STAGES) == 5 and len(packed)
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        db.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    mine, theirs = QUERIES[name](spark, SMALL).toPandas(), db.sql(ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    key = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert key(mine) == key(theirs)


def test_held_out_rows_are_told_well(spark):
    small = SMALL.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = [r for r in QUERIES["op8_language_id"](spark, small).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in found) >= 0.98 * len(found)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    found = [r for r in QUERIES["op4_toxicity"](spark, small).collect() if r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in found) >= 0.9 * len(found)
