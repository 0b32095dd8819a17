"""Token counts: pieces are counted once for each distinct pre-token, then summed by frequency.

A document's pre-tokens are counted (pre-token, frequency); each distinct pre-token of the whole
corpus is handed to the tokenizer's model once; the counts return to the frequencies and are
summed. No token ids are made or kept.

Split pattern and special strings are read from the tokenizer's file, whose pipeline must be NFC, white space folded, lower case,
split by a pattern, byte-level alphabet; another pipeline is refused. A special token's string in a text is one token, as the
library does by default.

Null text counts as empty (0 tokens). Repeated rows and repeated or null ids give a row each, and
columns beside the id and the text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.wordjoin import resolve_words

#: A pre-token that stands for a special token; normal ones are never empty or upper case.
MARK = "<SPECIAL>"
#: The normaliser whose work ``rules`` does.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def rules(tokenizer_file: str) -> tuple[str, tuple[str, ...]]:
    """The split pattern and the special strings of a file; a ``ValueError`` if its pipeline is another one."""
    with open(tokenizer_file, encoding="utf-8") as lines:
        file = json.load(lines)
    steps = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    fits = (file["normalizer"] or {}).get("normalizers") == NORMAL and len(steps) == 2 and steps[0]["type"] == "Split" and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True) and level.items() <= steps[1].items()
    plain = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in file["added_tokens"])
    if not (fits and plain and "Regex" in steps[0]["pattern"] and file["model"]["type"] == "BPE"):
        raise ValueError(f"{tokenizer_file} has another pipeline than lower-casing byte-level BPE")
    return steps[0]["pattern"]["Regex"], tuple(t["content"] for t in file["added_tokens"])


def splitter(pattern: str, specials: tuple[str, ...]) -> Callable[[str], tuple[list[str], int]]:
    find = regex.compile(pattern).findall
    special = regex.compile("(" + "|".join(map(regex.escape, specials or ("\x00",))) + ")")

    def plain(text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # the library lowers each character by itself: no final sigma
            text = text.replace("Σ", "σ")
        return find(text.lower())

    def split(text: str) -> tuple[list[str], int]:
        n_bytes = len(text.encode())
        if not any(s in text for s in specials):
            return plain(text), n_bytes
        words: list[str] = []
        for k, part in enumerate(special.split(text)):
            words += [MARK] if k % 2 else plain(part)
        return words, n_bytes

    return split


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for each row; the file must be readable on every executor."""
    pattern, specials = rules(tokenizer_file)

    def resolver():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        pieces = Tokenizer(Tokenizer.from_file(tokenizer_file).model)  # the model alone: words are normalised already
        pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

        def resolve(words: list[str]) -> list[bytes]:
            counts = [len(e) for e in pieces.encode_batch([w if w != MARK else "" for w in words], add_special_tokens=False)]
            return [(1 if w == MARK else n).to_bytes(4, "little") for w, n in zip(words, counts, strict=True)]

        return resolve

    def assemble(part: dict[str, np.ndarray], answers) -> pa.RecordBatch:
        data, starts, _ = answers
        pieces = np.zeros(len(starts), np.int64)
        pieces[:] = np.ascontiguousarray(data).view("<u4")[starts // 4]
        sums = np.concatenate([[0], np.cumsum(pieces[part["codes"]] * part["freqs"])])
        ends = np.cumsum(part["lens"].astype(np.int64))
        totals = sums[ends] - sums[ends - part["lens"]]
        ids = pa.array(part["ids"], mask=part["no_id"].astype(bool))
        return pa.record_batch([ids, pa.array(part["own"]), pa.array(totals)], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = resolve_words(rows, lambda: splitter(pattern, specials), resolver, assemble, "id long, n_bytes long, n_tokens long", ordered=False)
    return out.withColumnRenamed("id", id_col)
