"""Byte-level BPE by a global distinct-word shuffle.

Encoding lists each document's pre-tokens with their positions, encodes each distinct pre-token of
the whole corpus once, joins the ids back and reassembles them by position. Decoding joins ids
to the token-byte table, which has one entry for each rank of the vocabulary file: each task reads it from that file and
gathers the bytes of many ids at once, so no row is shuffled for it.

Null text counts as empty (no ids). Repeated rows and repeated or null ids give a row each;
columns beside the id and the text are ignored; an empty table gives an empty result. Decoding
null ids gives no bytes; an id outside the table is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C
from lodestone.llm.wordjoin import resolve_words


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for each row; ``ids`` are little-endian unsigned 32-bit integers."""

    def splitter():
        find = regex.compile(pattern).findall
        return lambda text: (find(text), 0)

    def resolver():
        import tiktoken

        bpe = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=read_ranks(ranks_file), special_tokens={})
        return lambda words: [np.array(bpe.encode_ordinary(w), "<u4").tobytes() for w in words]

    def assemble(part: dict[str, np.ndarray], answers) -> pa.RecordBatch:
        data, starts, lengths = answers
        flat = np.ascontiguousarray(data).view("<u4")
        codes = part["codes"].astype(np.int64)
        each = lengths[codes] // 4
        ids = flat[C.ragged(starts[codes] // 4, each)]
        words = np.concatenate([[0], np.cumsum(each)])
        edges = words[np.concatenate([[0], np.cumsum(part["lens"].astype(np.int64))])]
        blobs = pa.array([ids[i:j].tobytes() for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
        return pa.record_batch([pa.array(part["ids"], mask=part["no_id"].astype(bool)), pa.array(np.diff(edges)), blobs], names=["id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = resolve_words(rows, splitter, resolver, assemble, "id long, n_tokens long, ids binary", ordered=True)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_file: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``, the bytes of its ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_file)
        sizes = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        table = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(ids_col)), 0).to_pylist()
            for start, end in C.slices(lengths, 1_000_000):
                part = batch.slice(start, end - start)
                ids = np.frombuffer(b"".join(x or b"" for x in part.column(ids_col).to_pylist()), "<u4").astype(np.int64)
                if len(ids) and (ids.max() >= len(sizes) or sizes[ids].min() < 0):
                    raise ValueError("an id is not in the table")
                each = sizes[ids]
                text = table[C.ragged(starts[ids], each)].tobytes()
                edges = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(lengths[start:end]) // 4])].tolist()
                texts = [text[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    schema = encoded.drop("decoded").schema.add("decoded", "binary")
    return encoded.drop("decoded").mapInArrow(run, schema)

