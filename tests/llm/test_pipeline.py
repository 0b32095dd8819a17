"""The pipeline on the small tables: each stage's rows against what it may keep."""

import corpus_pipeline
from lodestone.llm.common import materialize, table
from tests.conftest import SF


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, SF), name)
        assert after.count() <= before.count()
        assert after.select("doc_id").distinct().count() == after.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.dtypes == docs.dtypes
            before = after
    assert 0 < after.count() == before.count() < docs.count()


def test_stages_take_awkward_rows(spark):
    rows = [(1, None, None, None, None), (1, "x y", "en", "s", 3), (1, "x y", "en", "s", 3), (None, "the of and", None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            materialize(stage(spark, some, SF), name).count()


def test_stages_judge_rows_not_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"}
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, text["a"], "en", "s", 1), (None, text["b"], "en", "s", 1), (None, text["b"] + " more", "en", "s", 1), (7, text["c"], "en", "s", 1), (7, text["d"], "en", "s", 1), (3, text["c"] + " z", "en", "s", 1), (None, text["d"], "en", "s", 1), (9, text["e"], "en", "t", 1), (9, text["e"], "en", "s", 1)]
    kept = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, shape).repartition(3), SF).collect()]
    b = next(t for _, t, _ in kept if t.startswith("b0"))
    assert b in (text["b"], text["b"] + " more")
    assert sorted(kept, key=str) == sorted([(None, text["a"], "s"), (None, b, "s"), (3, text["c"] + " z", "s"), (7, text["d"], "s"), (9, text["e"], "s")], key=str)

    item = table(spark, SF, "benchmark").where("size(split(text, ' ')) > 15").orderBy("item_id").first().text
    rows = [(None, item, "en", "s", 1), (None, text["a"], "en", "s", 1), (5, item, None, "s", 1), (5, text["b"], None, "s", None), (None, None, "en", None, 0)]
    left = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, shape).repartition(2), SF)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
