"""The pipeline's stages on odd rows and on a whole small table."""

from __future__ import annotations

import corpus_pipeline
from splitlane.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_handle_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, docs, SF), name)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
            docs = out
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_equals_the_stages_and_keeps_most(spark):
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
    assert got == {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(got) > 0.4 * table(spark, SF, "documents").count()
