"""Shared pieces: scratch tables, compact blobs, and splitting documents into bounded blocks.

The blocks are the unit that keeps shuffles small. A task of a scan gathers whole documents
until their characters reach a fixed budget, and from then on one row stands for the block (or
for a slice of it) rather than one row for each word. Nothing is cut: a document longer than
the budget makes a block of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import scratch_path

#: Characters of text that a block holds before it is closed.
BLOCK_CHARS = 16_000_000
#: Characters of text in one slice of a block.
SLICE_CHARS = 500_000


# --------------------------------------------------------------------------- scratch tables


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, for lost executors too."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- blobs


def pack(**arrays: np.ndarray) -> bytes:
    """Number arrays as one compressed blob; bytes of equal weight stand together."""
    head, body = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append((name, a.dtype.str, len(a)))
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else a.view(np.uint8)
        body.append(planes.tobytes())
    text = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=3).compress(len(text).to_bytes(4, "little") + text + b"".join(body))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    out, at = {}, 4 + n
    for name, kind, length in json.loads(raw[4 : 4 + n]):
        dtype = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8, length * dtype.itemsize, at).reshape(dtype.itemsize, length)
        out[name] = np.ascontiguousarray(planes.T).view(dtype).reshape(length)
        at += length * dtype.itemsize
    return out


def pack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def ids_to_arrays(ids: list[int | None]) -> dict[str, np.ndarray]:
    return {
        "ids": np.array([0 if i is None else i for i in ids], np.int64),
        "no_id": np.array([i is None for i in ids], np.uint8),
    }


def arrays_to_ids(a: dict[str, np.ndarray]) -> list[int | None]:
    return [None if gone else i for i, gone in zip(a["ids"].tolist(), a["no_id"].tolist(), strict=True)]


# --------------------------------------------------------------------------- words

_KEPT = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, as UTF-8, A-Z in lower case."""
    return (text or "").encode().translate(_KEPT).split()


# --------------------------------------------------------------------------- blocks


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def text_blocks(batches: Iterable[pa.RecordBatch], budget: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Whole documents in their order, as (ids, texts) whose characters reach ``budget`` at most once.

    The first two columns are the id and the text; a null text counts as empty.
    """
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            ids.append(one)
            texts.append(text)
            size += len(text) + 16
            if size >= budget:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def slices(sizes: Iterable[int], budget: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents whose sizes reach ``budget`` at most once."""
    start = end = total = 0
    for size in sizes:
        end += 1
        total += size + 16
        if total >= budget:
            yield start, end
            start, total = end, 0
    if end > start:
        yield start, end


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of equal values in a sorted array."""
    if len(values):
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        edges = [0, *cuts.tolist(), len(values)]
        yield from zip(edges[:-1], edges[1:], strict=True)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that read ``lengths[i]`` items from ``starts[i]``, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def to_home(df: DataFrame, column: str, n: int) -> DataFrame:
    """Deal rows to partition ``column mod n``; the caller has spread the values evenly."""
    return df.repartitionById(n, F.col(column))
