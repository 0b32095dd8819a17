"""The registered token queries against the libraries, and tokenizer files with other pipelines."""

import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm.byte_bpe import decode, encode, read_ranks
from lodestone.llm.queries import op2_token_counts, op4_byte_bpe
from lodestone.llm.token_counts import count_tokens
from tests.conftest import SF

FILE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_token_counts_equal_the_library(spark):
    whole = Tokenizer.from_file(FILE)
    counts = [(i, len(t.encode()), len(whole.encode(t, add_special_tokens=False))) for i, t in texts(spark)]
    assert Counter(map(tuple, op2_token_counts(spark, SF).collect())) == Counter((*c, c[2] > 2048) for c in counts)


def test_byte_bpe_equals_the_library(spark):
    bpe = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids := bpe.encode_ordinary(t)), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for i, t in texts(spark))
    assert Counter(map(tuple, op4_byte_bpe(spark, SF).collect())) == want


@pytest.mark.parametrize("change", [lambda f: f["normalizer"]["normalizers"].pop(), lambda f: f.update(normalizer=None), lambda f: f["pre_tokenizer"]["pretokenizers"].pop(0), lambda f: f["added_tokens"][0].update(lstrip=True)])
def test_other_pipelines_are_refused(spark, tmp_path, change):
    with open(FILE, encoding="utf-8") as lines:
        file = json.load(lines)
    change(file)
    (tmp_path / "t.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="another pipeline"):
        count_tokens(spark.createDataFrame([(1, "x")], "doc_id long, text string"), str(tmp_path / "t.json"))


def test_special_strings_come_from_the_file(spark, tmp_path):
    with open(FILE, encoding="utf-8") as lines:
        file = json.load(lines)
    file["added_tokens"][0]["content"] = "[START]"
    (tmp_path / "t.json").write_text(json.dumps(file))
    whole = Tokenizer.from_file(str(tmp_path / "t.json"))
    rows = [(1, "a [START] b"), (2, "<|startoftext|> x<|endoftext|>"), (3, None)]
    got = {r.doc_id: r.n_tokens for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t.json")).collect()}
    assert got == {i: len(whole.encode(t or "", add_special_tokens=False)) for i, t in rows}


def test_decoding(spark):
    rows = [(1, bytearray(np.array([0, 1, 50255], "<u4").tobytes())), (2, None), (3, bytearray())]
    got = {r.k: bytes(r.decoded) for r in decode(spark.createDataFrame(rows, "k long, ids binary"), RANKS).collect()}
    table = {rank: token for token, rank in read_ranks(RANKS).items()}
    assert got == {1: table[0] + table[1] + table[50255], 2: b"", 3: b""}
    with pytest.raises(Exception, match="not in the table"):
        decode(spark.createDataFrame([(1, bytearray(b"\xff\xff\x00\x00"))], "k long, ids binary"), RANKS).collect()
    long = "word é " * 300_000
    assert bytes(decode(encode(spark.createDataFrame([(1, long)], "doc_id long, text string"), RANKS, P.PATTERN), RANKS).first().decoded) == long.encode()
