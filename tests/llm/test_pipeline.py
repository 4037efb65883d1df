import zlib

import corpus_pipeline
from mergescope.llm import line_dedup, packing, quality, simhash
from mergescope.llm.queries import QUERIES, SQL, vocabulary
from tests.llm.samples import documents, with_odd_columns


def test_stages_take_each_others_rows(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        left = {r.doc_id for r in docs.collect()}
        assert left <= ids and (left == ids or name in ("quality_rules", "simhash_near_dedup"))
        ids = left
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == ids
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in pieces)


def test_stages_are_their_operators(spark):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in quality.op8_quality_rules(docs).where("kept").collect()}
    assert {r.doc_id for r in stages["quality_rules"](spark, docs, "").collect()} == kept
    removed = {r.doc_id: r.n_removed for r in line_dedup.fuzzy_lines(docs).collect()}
    cut = {r.doc_id: r.text for r in stages["line_dedup"](spark, docs, "").collect()}
    assert all((cut[r.doc_id] == r.text) == (removed[r.doc_id] == 0) for r in docs.collect())
    groups = simhash.simhash_groups(docs, **corpus_pipeline.NEAR_COPIES).where("doc_id = component_id")
    assert {r.doc_id for r in stages["simhash_near_dedup"](spark, docs, "").collect()} == {r.doc_id for r in groups.collect()}
    assert stages["packing"](spark, docs, "").count() == packing.op1_packing(docs, vocabulary("word_bpe_49k.json")).count()


def test_near_copies_are_the_simhash_query_s(spark):
    docs = documents(spark)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    same = simhash.simhash_groups(docs).where("doc_id = component_id")
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == {r.doc_id for r in same.collect()}


def test_stages_take_empty_tables_and_clashing_columns(spark, tmp_path):
    docs = with_odd_columns(documents(spark))
    for name, table in (("none", docs.where("false")), ("some", docs)):
        ids = {r.doc_id for r in table.collect()}
        for stage, run in corpus_pipeline.STAGES[:-1]:
            path = str(tmp_path / f"{name}-{stage}")
            run(spark, table, "").write.parquet(path)
            table = spark.read.parquet(path)
            assert table.columns == docs.columns and {r.doc_id for r in table.collect()} <= ids
        pieces = dict(corpus_pipeline.STAGES)["packing"](spark, table, "")
        assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in table.collect()}
        assert (pieces.count() == 0) == (name == "none")


def test_all_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(SQL) <= set(QUERIES)
