"""Registered queries as they are: against their SQL, on the small tables and on awkward ones, and against plain versions."""

import zlib
from collections import Counter

import duckdb
import pytest

from lodestone.llm import queries as Q
from tests.conftest import SF
from tests.llm.test_classifiers import TEXT, plain_identify, plain_model
from tests.llm.test_near_edit import classes

TABLES = ["documents", "pages", "benchmark", "labels", "conversations"]
PASSAGE = " ".join(f"p{i}" for i in range(45))


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls in any column, empty and long texts, repeated rows and columns with clashing names; ids that repeat have equal texts, so ties have one order."""
    folder = str(tmp_path_factory.mktemp("awkward"))
    texts = [PASSAGE, None, "", PASSAGE + " end", "A. B\n\nC. " * 300, "x " * 5000, "Only, a few WORDS", f"é {PASSAGE} ü\n\n{PASSAGE}", "\t\n \x0b", "word." * 3000]
    docs = [(k, t, None if k % 3 else "en", "s", k) for k, t in enumerate(texts)] + [(5, texts[5], "en", "s", 1)] * 2 + [(None, "alone, without id", None, None, None)]
    extra = ", text_key string, bucket string, shard string, toxic int, word string"
    frame = lambda rows, shape, more: spark.createDataFrame([(*r, *("clash" for _ in range(more))) for r in rows], shape)
    spark.createDataFrame([(*d, "c", "c", "c", 1, "c") for d in docs], "doc_id long, text string, lang string, source string, n_chars long" + extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    frame([(1, PASSAGE.upper()), (1, PASSAGE.upper()), (2, "a FEW words"), (3, None), (4, ""), (None, "without id"), (5, "never there at all"), (2, "only")], "item_id long, text string, term string, doc_id string", 2).write.parquet(f"{folder}/benchmark.parquet")
    frame([(1, "u", "y" * 2000), (2, None, "y" * 2000), (3, "u", None), (4, "u", "small"), (5, "u", "small"), (6, "u", "é" * 500)], "page_id long, url string, html string, digest string, type string", 2).write.parquet(f"{folder}/pages.parquet")
    frame([(1, 0, "user", "a"), (1, 1, "assistant", None), (None, 0, "assistant", "x:<#\\"), (2, None, None, "z")], "conv_id long, turn long, role string, text string, formatted string", 1).write.parquet(f"{folder}/conversations.parquet")
    frame([(k, k % 2, k % 2) for k in range(9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int, text string, lang string", 2).write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, awkward, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{awkward}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


def by_sql(name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}'")
    found = con.execute(Q.ORACLES[name])
    return [d[0] for d in found.description], found.fetchall()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_equal_their_sql(spark, awkward, name):
    for folder in (SF, awkward):
        names, rows = by_sql(name, folder)
        got = Q.queries()[name](spark, folder)
        assert sorted(got.columns) == sorted(names)
        assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(rows)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries_take_awkward_and_empty_tables(spark, awkward, empty, name):
    table = "pages" if name == "op5_warc" else "conversations" if name == "op3_chat_format" else "documents"
    kept = spark.read.parquet(f"{awkward}/{table}.parquet").count()
    got = Q.queries()[name](spark, awkward)
    assert got.count() == (4 if table == "conversations" else kept)
    assert Q.queries()[name](spark, empty).count() == (1 if table == "conversations" else 0)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_query_equals_a_plain_version(spark, tmp_path):
    rows = [(k, " ".join(TEXT[lang].split() * (k % 3 + 1)), None if k % 9 == 0 else lang, "s", 1) for k, lang in enumerate(sorted(TEXT) * 12)] + [(None, TEXT["de"], "de", "s", 1), (99, None, "fr", "s", 0), (98, "12", None, "s", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    model = plain_model([(t, lang) for i, t, lang, _, _ in rows if t is not None and lang is not None and not held_out(i)])
    want = Counter((i, held_out(i), (p := plain_identify(t, model))[0], round(p[1], 9)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in Q.op6_language_id(spark, str(tmp_path)).collect()) == want


def test_near_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.class_id) for r in Q.op9_near_dedup(spark, SF).collect()) == classes(rows)


def test_toxicity_query(spark):
    got = Q.op10_toxicity(spark, SF).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
