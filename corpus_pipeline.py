"""Documents to token ids: language ID, near-dedup, substring dedup, decontamination, byte-level BPE.

Each stage gets all rows that its predecessor kept and returns the columns of ``documents``, but for
the last, which adds token ids. What each one does to a document:

1. ``language_id``: ``lang`` becomes the predicted language; documents without letters, those of which no
   language holds over ``LEAST_SHARE`` of the letters (letters of unlearned scripts are nobody's) and those whose
   likelihood over chance is under ``LEAST_GAIN`` of what their language's texts usually have go. It learns from rows whose language is known.
2. ``near_dedup``: of each class of near-duplicates the document with the smallest id stays (null ids
   last; of rows that repeat it, one). Unlike documents stay, whatever ids they share or lack.
3. ``substring_dedup``: stretches of 20 words that stand earlier are removed; a document whose words all
   stood earlier stays as an empty text. ``n_chars`` follows the text.
4. ``decontamination``: documents with a twentieth of their words inside windows of benchmark items go,
   each judged by its own row.
5. ``byte_bpe``: adds ``n_tokens`` and ``ids``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.session import open_paths, prepare, release

#: Share of letters below which a document has no language of its own.
LEAST_SHARE = 1 / 3
#: Share of the usual likelihood over chance below which a text is in no learned language; even mixes of three languages are above it.
LEAST_GAIN = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


_LEFT: list[str] = []  # what the stage before has stored beside its result


def _stage(own: Stage) -> Stage:
    """A stage's result is written before the next one begins, which deletes what only the one before still needed."""

    @wraps(own)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_LEFT, docs)
        before = set(open_paths())
        out = own(prepare(spark), docs, sf_dir)
        _LEFT[:] = [p for p in open_paths() if p not in before]
        return out

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    from lodestone.llm.language_id import UNDETERMINED, fit, identify

    docs = docs.select(*COLUMNS)
    found = identify(docs, fit(docs), keep=("text", "source", "n_chars"), with_spans=False)
    found = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SHARE) & (F.col("gain") >= LEAST_GAIN))
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    from lodestone.llm.near_dedup import first_of_classes

    return first_of_classes(docs.select(*COLUMNS))


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    from lodestone.llm.substring_dedup import factorize

    whole = docs.select(*COLUMNS).withColumn("_own", F.col("text"))
    found = factorize(whole, keep=("_own", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") == 0, F.col("_own")).otherwise(F.col("kept"))  # untouched texts keep their white space
    return found.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontamination import contamination

    whole = docs.select(*COLUMNS).withColumn("_own", F.col("text"))
    marked = contamination(whole, common.table(spark, sf_dir, "benchmark"), keep=("_own", "lang", "source", "n_chars"))
    clean = marked.where((F.col("n_hit") == 0) | (20 * F.col("n_hit") < F.col("n_words")))
    return clean.select("doc_id", F.col("_own").alias("text"), "lang", "source", "n_chars")


@_stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    import public_tokenizers

    from lodestone.llm.byte_bpe import encode

    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]
#: Language identification, near-duplicates and tokens cannot be told in SQL; tests/llm/test_pipeline_plain.py compares all stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), set(open_paths())
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        release((p for p in open_paths() if p not in before), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
