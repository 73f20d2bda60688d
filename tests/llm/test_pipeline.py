"""The pipeline over the smallest tables: every stage works on what the one before kept."""

import corpus_pipeline




def test_stages_follow_each_other(spark):
    from textloom.llm.common import table, written

    docs, columns = table(spark, "/root/testdata/sf0.001", "documents"), None
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == columns
        now = docs.count()
        assert 0 < now <= before and (name != "repeated_passages" or now == before)
        before = now
    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(spark, docs, "/root/testdata/sf0.001")
    assert packed.where("start = 0").count() == before
