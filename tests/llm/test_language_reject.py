"""What is in no learned script or language is told from what is."""

import corpus_pipeline
from lodestone.llm.common import table
from lodestone.llm.language_id import fit, identify
from tests.conftest import SF

GREEK = "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια"
GIBBERISH = "xqzvk wjpfq bzxkvw qqjxz vkwpz xjqfw zzkvq pwxjv fqkzx jvwqx"


def test_unlearned_scripts_and_languages_are_rejected(spark):
    docs = table(spark, SF, "documents")
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    planted = spark.createDataFrame([(-1, GREEK, None, "s", 1), (-2, GIBBERISH, None, "s", 1), (-3, "the " + GREEK, None, "s", 1)], shape)
    kept = {r.doc_id: r for r in corpus_pipeline.language_id(spark, docs.select(*corpus_pipeline.COLUMNS).union(planted), SF).collect()}
    assert not kept.keys() & {-1, -2, -3}
    own = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept) >= 0.99 * len(own) and all(own[i] == r.text for i, r in kept.items())


def test_unlearned_scripts_have_no_vote(spark):
    model = fit(spark.createDataFrame([(1, "the house of the man and the dog", "en"), (2, "der hund und das haus mit dem mann", "de")], "doc_id long, text string, lang string"))
    rows = [(1, GREEK), (2, "the man άνθρωποι"), (3, "the man and the dog")]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert (got[1].lang_pred, got[1].score, got[1].gain, [tuple(s) for s in got[1].spans]) == ("und", 0.0, 0.0, [("und", 0, 9)])
    assert (got[2].lang_pred, got[2].score, [tuple(s) for s in got[2].spans]) == ("en", 6 / 14, [("en", 0, 2), ("und", 2, 1)])
    assert got[3].score == 1.0 and got[3].gain > 0.3
