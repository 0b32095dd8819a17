"""Join each document's words to something that is worked out once for each distinct word.

``resolve_words`` runs three steps with two shuffles in between:

1. A scan task gathers documents into blocks and lists the block's distinct words in order of
   first appearance. Words leave for the bucket of their hash, at most once for each block, so
   a word that stands in every document costs a bucket one entry for each block. What the block
   knows of its documents (word numbers by position, or frequencies) leaves in slices.
2. A bucket resolves each of its distinct words once, and answers every block that asked.
3. A block's answers meet its slices again, and ``assemble`` makes rows for the documents.

The buckets are as many as ``spark.sql.shuffle.partitions``, so their share of the vocabulary
stays bounded when that setting follows the input; what a bucket remembers is bounded in any case. Blocks are dealt by number, not by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C

#: Stands between words in a blob; no UTF-8 text holds this byte.
BETWEEN = b"\xff"
#: Words whose answers a bucket remembers; a bucket of more words works some of them out again.
MOST = 2_000_000
WIRE = "route int, block long, home int, kind int, a binary, b binary"
WIRE_ARROW = pa.schema([("route", pa.int32()), ("block", pa.int64()), ("home", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
ANSWER, SLICE = 0, 1


def _wire(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(WIRE_ARROW)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, WIRE_ARROW, strict=True)], schema=WIRE_ARROW)


def resolve_words(
    docs: DataFrame,
    split: Callable[[], Callable[[str], tuple[list[str], int]]],
    resolve: Callable[[], Callable[[list[str]], list[bytes]]],
    assemble: Callable[[dict[str, np.ndarray], list[bytes]], pa.RecordBatch],
    schema: str,
    ordered: bool,
    block_chars: int = C.BLOCK_CHARS,
) -> DataFrame:
    """``docs`` has an id and a text as its first two columns; the result has ``schema``.

    ``split`` and ``resolve`` make the functions to use on a worker: the first gives a text's
    words and one number of its own, the second one answer for each of some distinct words.
    ``assemble`` gets a slice and the answers by word number. ``ordered`` slices hold ``lens`` and
    the word numbers of each document by position in ``codes``, others distinct ``codes`` with
    ``freqs``; both hold the ids and the splitter's numbers in ``own``.
    """
    n = C.shuffle_width(docs.sparkSession)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = split()
        part = C.partition_id()
        for k, (ids, texts) in enumerate(C.text_blocks(batches, block_chars)):
            block, home = (part << 32) | k, (part + k * 7919) % n
            known: dict[str, int] = {}
            for j, (start, end) in enumerate(C.slices(len(t) for t in texts)):
                found = [splitter(text) for text in texts[start:end]]
                own = np.array([number for _, number in found], np.int64)
                lens = np.array([len(words) for words, _ in found], np.int64)
                base = len(known)
                codes = _numbered(list(chain.from_iterable(words for words, _ in found)), known)
                what = _by_position(codes, base) if ordered else _by_document(codes, lens)
                what.setdefault("lens", lens.astype(np.uint32))
                yield _wire([((home + j) % n, block, home, SLICE, C.pack(own=own, **C.ids_to_arrays(ids[start:end]), **what), None)])
            words = list(known)
            if not words:
                continue
            buckets = (pd.util.hash_array(np.array(words, object), categorize=False) % np.uint64(n)).astype(np.int64)
            order = np.argsort(buckets, kind="stable")
            rows = []
            for start, end in C.runs(buckets[order]):
                own_codes = order[start:end]
                blob = BETWEEN.join([words[i].encode() for i in own_codes.tolist()])
                rows.append((int(buckets[own_codes[0]]), block, home, ANSWER, C.pack(steps=np.diff(own_codes, prepend=0).astype(np.uint32)), C.pack_bytes(blob)))
                if len(rows) == 512:
                    yield _wire(rows)
                    rows = []
            yield _wire(rows)

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolver = resolve()
        known: dict[bytes, bytes] = {}
        for batch in batches:
            rows = []
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                _, block, home, kind, a, b = row
                if kind == ANSWER:
                    words = C.unpack_bytes(b).split(BETWEEN)
                    if len(known) > MOST:
                        known.clear()
                    if new := [w for w in words if w not in known]:
                        known.update(zip(new, resolver([w.decode() for w in new]), strict=True))
                    answers = [known[w] for w in words]
                    b = C.pack(data=np.frombuffer(b"".join(answers), np.uint8), sizes=np.array([len(x) for x in answers], np.uint32))
                rows.append((home, block, home, kind, a, b))
            yield _wire(rows)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, data, sizes, answers = None, [], [], [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "a", "b")), strict=True):
                block, kind, a, b = row
                if block != now:
                    now, codes, data, sizes, answers = block, [], [], [], None
                if kind == ANSWER:
                    got = C.unpack(b)
                    codes.append(np.cumsum(C.unpack(a)["steps"], dtype=np.int64))
                    data.append(got["data"])
                    sizes.append(got["sizes"])
                    continue
                if answers is None:
                    answers = _by_code(codes, data, sizes)
                    codes, data, sizes = [], [], []
                part = C.unpack(a)
                part["codes"] = _positions(part) if ordered else _distinct(part)
                yield assemble(part, answers)

    out = C.to_home(docs.mapInArrow(scan, WIRE), "route", n).mapInArrow(answer, WIRE)
    return C.to_home(out, "route", n).sortWithinPartitions("block", "kind").mapInArrow(join, schema)


def _numbered(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Each word's number in its block; new words are numbered in order of first appearance."""
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    numbers = np.array([known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()], np.int64)
    return numbers[coded.indices.to_numpy(zero_copy_only=False)] if words else numbers


def _by_position(codes: np.ndarray, base: int) -> dict[str, np.ndarray]:
    """The numbers by position, 0 where a word appears for the first time: its number is the next one."""
    steps = codes + 1
    fresh = np.unique(codes, return_index=True)
    steps[fresh[1][fresh[0] >= base]] = 0
    return {"steps": steps.astype(np.uint32), "base": np.array([base], np.int64)}


def _positions(part: dict[str, np.ndarray]) -> np.ndarray:
    codes = part["steps"].astype(np.int64) - 1
    fresh = codes < 0
    codes[fresh] = part["base"][0] + np.arange(int(fresh.sum()))
    return codes


def _by_document(codes: np.ndarray, lens: np.ndarray) -> dict[str, np.ndarray]:
    """Each document's distinct numbers in ascending order, as steps, with their frequencies."""
    pairs, freqs = np.unique(np.repeat(np.arange(len(lens)), lens) << 32 | codes, return_counts=True)
    of, codes = pairs >> 32, pairs & 0xFFFFFFFF
    steps = np.diff(codes, prepend=0)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    steps[first] = codes[first]
    return {"steps": steps.astype(np.uint32), "freqs": freqs.astype(np.uint32), "lens": np.bincount(of, minlength=len(lens)).astype(np.uint32)}


def _distinct(part: dict[str, np.ndarray]) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(part["steps"], dtype=np.int64)])
    ends = np.cumsum(part["lens"], dtype=np.int64)
    return sums[1:] - np.repeat(sums[ends - part["lens"]], part["lens"])


def _by_code(codes: list, data: list, sizes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The answers' bytes, and each word number's start and length there."""
    if not codes:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), empty, empty
    codes, sizes = np.concatenate(codes), np.concatenate(sizes).astype(np.int64)
    starts, lengths = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    starts[codes], lengths[codes] = np.cumsum(sizes) - sizes, sizes
    return np.concatenate(data), starts, lengths
