"""The pipeline's stages, one after another, on the smallest tables."""

import duckdb

import corpus_pipeline
from tallyspark.llm.common import BATCHES, bounded_batches, table, written
from tallyspark.llm.decontamination import OP7_SQL, op7_decontamination, scan
from tallyspark.llm.line_dedup import remove_lines
from tallyspark.llm.near_dup import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == before
            counts.append(docs.count())
        if name == "near_duplicates":
            assert near_duplicates(docs).filter("not kept").count() == 0
        if name == "decontamination":
            assert scan(docs, table(spark, SF, "benchmark")).filter("size(spans) > 0").count() == 0
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert docs.select("doc_id").distinct().count() == counts[-1]


def test_decontamination_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = op7_decontamination(spark, SF)
    theirs = con.sql(OP7_SQL)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(tuple(r) for r in ours.select(names).collect()) == sorted(tuple(r[theirs.columns.index(c)] for c in names) for r in theirs.fetchall())


def test_small_batches(spark):
    docs = table(spark, SF, "documents")
    asked = lambda: [sorted(map(str, df.collect())) for df in (remove_lines(docs, least_words=1), near_duplicates(docs))]
    before = spark.conf.get(BATCHES)
    try:
        whole = asked()
        bounded_batches(spark, 3000)
        assert asked() == whole
    finally:
        spark.conf.set(BATCHES, before)
