import compare
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from spark_climbs.llm import mixing, oracle, pieces, quality_rules, queries, simhash, suffix_dedup, tokenizers_at

SF = "/root/testdata/sf0.001"


def test_everything_is_registered():
    names = set(entry.queries())
    assert set(queries.all_queries()) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in queries.all_queries()} == set(range(1, 14))
    assert set(oracle.all_sql()) <= names


@pytest.mark.parametrize("name", sorted(oracle.all_sql()))
def test_sql(spark, name):
    assert not compare.differences(entry.queries()[name](spark, SF), oracle.all_sql()[name], compare.duck(SF))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, rows = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(rows.toPandas(), rows.schema)
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "quality_rules":
            assert ids == {r["doc_id"] for r in quality_rules.verdicts(before).filter("kept").collect()}
        if name == "simhash":
            assert ids == {r["component_id"] for r in simhash.near_duplicates(before).collect()}
        if name == "suffix_dedup":
            left = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in suffix_dedup.spans(before, suffix_dedup.PASSAGE).collect()}
            assert {k for k, n in left.items() if n >= 4} <= ids
            assert all(len(r["text"].encode()) <= left[r["doc_id"]] for r in docs.collect())
        if name == "mixing":
            copies = {r["doc_id"]: r["__mix_copies"] for r in mixing.assign(before).collect()}
            counts = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert counts == {k: n for k, n in copies.items() if n}
        if name == "pieces":
            model = pieces.Pieces(tokenizers_at.path("piece_bpe_32k.model"))
            for r in docs.collect():
                assert model.decode(r["piece_ids"]) == r["text"]
        else:
            assert docs.columns == columns


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert 0 < rows.count() < 3 * spark.read.parquet(f"{SF}/documents.parquet").count()
