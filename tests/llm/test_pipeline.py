"""The pipeline's stages on the smallest tables: each keeps whole rows of the one before."""

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        assert rows and {r.doc_id for r in rows} <= set(before)
        if k < 4:
            assert docs.columns == columns and all(before[r.doc_id] == r for r in rows)
            assert k == 3 or len(rows) == len({r.doc_id for r in rows})
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)
