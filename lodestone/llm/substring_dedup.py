"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

Documents are cut into blocks, each block's windows of ``LENGTH`` words are its reference index, and every
document is parsed greedily, left to right, into factors: a factor takes the earliest place of the corpus that its first
window has and goes on as long as the text there does, whatever other places its later windows have. Where it ends the
next window is checked against the index again. Factors have ``LENGTH`` words at least and are duplicate spans; a span that begins inside the
factor before it is told from that factor's end on. Steps:

1. *Blocks* are packed once, in order of document, and stored.
2. *Index.* The anchor of a window is the smallest hash of its ``ANCHOR``-word phrases. Equal windows have equal
   anchors, so a window can repeat in another block only where its anchor does. Blocks list
   their distinct anchors; buckets of hashes tell which ones several blocks have.
3. *Lookup.* Of the windows at such anchors a block sends each distinct one's hash (96 bits) and first
   place; buckets answer with the earliest place in the corpus, whichever block indexed it.
4. *Runs.* Windows in a row whose earliest places are in a row make a run. Where one run ends and another begins at once, the text at the first run's place
   may still go on: the block that holds it lends the runs of that document. Equal windows have the same
   earliest place, so the runs of both tell how many windows are equal, by hashes of rows of earliest places.
5. *Parsing.* Each factor begins with a run, goes on beyond its end as far as the reference does, and the words outside factors stay.

A phrase or window that stands in very many documents costs one entry for each block, never one
for each document, so hot passages don't pile up in one task.

Words are separated by ASCII white space and compared unchanged. Null text has no words. Of rows
that repeat an id, the one in the first block, or first in a block, is earlier. A null id sorts last. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lodestone.llm import common as C
from lodestone.session import open_paths, release

#: Words of a window; shorter factors stay.
LENGTH = 20
#: Words of an anchor phrase.
ANCHOR = 8
#: Characters of text in a block.
BLOCK_CHARS = 8_000_000
FACTORS = ArrayType(StructType().add("start", "long").add("n_words", "long").add("ref_doc", "long").add("ref_start", "long"))
#: Sorts after every id; stands for a null id.
NO_ID = np.iinfo(np.int64).max

_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed odd multipliers for mixing
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
PACKED = "block long, home int, kind int, docs binary, texts binary, extra binary"
ASKED = "bucket int, block long, home int, entries binary"
SENT = "block long, home int, kind int, source long, bucket int, data binary"
ANSWER, DOCS = 0, 1
#: Kinds of what is sent to a block's home, in the order in which they are needed there.
PLACES, STATE, RUNS, ASK, LENT = range(2, 7)


def words_of(text: bytes) -> list[bytes]:
    """The words between ASCII white space (what bytes split at by themselves)."""
    return text.split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _ODD2
    return x ^ (x >> np.uint64(32))


def _join(left: np.ndarray, right: np.ndarray, span: int, odd: np.uint64) -> np.ndarray:
    """Hashes of phrases of ``span`` words and what follows them, whose hashes are ``right``."""
    right = right[span:]
    return _mix(left[: len(right)] * odd + right)


def _phrases(hashes: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    """A hash of the ``size`` hashes from each place on: lengths double, those that make up ``size`` are joined."""
    out, power, span = None, _mix(hashes ^ odd), 1
    while True:
        if size & span:
            out = power if out is None else _join(power, out, span, odd)
        if span * 2 > size:
            return out
        power = _join(power, power, span, odd)
        span *= 2


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of the ``size`` values from each place on."""
    span, out = 1, x
    while span * 2 <= size:
        out = np.minimum(out[: max(0, len(out) - span)], out[span:])
        span *= 2
    n = max(0, len(x) - size + 1)
    return np.minimum(out[:n], out[size - span : size - span + n])


class Block:
    """A block's documents in order of id, with their windows' places, anchors and hashes."""

    def __init__(self, docs: bytes, texts: bytes):
        self.docs = C.unpack(docs)
        self.order_ids = np.where(self.docs["no_id"] == 1, NO_ID, self.docs["ids"])
        raw, ends = C.unpack_bytes(texts), np.cumsum(self.docs["sizes"], dtype=np.int64)
        self.texts = [raw[e - s : e] for s, e in zip(self.docs["sizes"].tolist(), ends.tolist(), strict=True)]
        hashes, lens = [np.zeros(0, np.uint64)], []
        for start, end in C.slices(self.docs["sizes"].tolist()):
            found = [words_of(t) for t in self.texts[start:end]]
            lens += map(len, found)
            coded = pa.array(list(chain.from_iterable(found)), pa.large_binary()).dictionary_encode()
            if len(coded):
                each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
                hashes.append(each[coded.indices.to_numpy(zero_copy_only=False)])
        self.words = np.concatenate(hashes)
        self.lens = np.array(lens, np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.at = C.ragged(self.starts, np.maximum(self.lens - LENGTH + 1, 0))
        least = _least(_phrases(self.words, ANCHOR, _ODD), LENGTH - ANCHOR + 1)
        self.anchors, self.anchor_of = np.unique(least[self.at], return_inverse=True)

    def hashed(self) -> None:
        """Number the distinct windows by hash; ``first`` has each one's first window."""
        a, b = _phrases(self.words, LENGTH, _ODD)[self.at], _phrases(self.words, LENGTH, _ODD2)[self.at].astype(np.uint32)
        order = np.argsort(a, kind="stable")
        if ((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])).any():  # rare: half of the hash is equal by chance
            order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
        self.number = np.zeros(len(order), np.int64)
        self.number[order] = np.cumsum(fresh) - 1
        self.first = order[fresh]  # the sort is stable: the first of equal windows
        self.high, self.low = a[fresh], b[fresh]

    def asked(self, repeated: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct windows (their numbers) to look up, by bucket and then by place; and the buckets."""
        number = np.flatnonzero(repeated[self.anchor_of[self.first]])
        number = number[np.argsort(self.first[number], kind="stable")]
        buckets = _bucket(self.high[number], n)
        order = np.argsort(buckets, kind="stable")
        return number[order], buckets[order]

    def state(self, asked: np.ndarray, buckets: np.ndarray) -> bytes:
        """What is needed once answers come: the windows that are asked for or stand twice here, and what was asked in which bucket."""
        some = np.bincount(self.number, minlength=len(self.first)) > 1
        some[asked] = True
        code = np.cumsum(some) - 1
        kept = np.flatnonzero(some[self.number])
        return C.pack(at=np.diff(self.at[kept], prepend=0).astype(np.uint32), codes=code[self.number[kept]].astype(np.uint32), lens=self.lens.astype(np.uint32), asked=code[asked].astype(np.uint32), buckets=buckets.astype(np.uint32))

    def place(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ordering id, number of the document in the block, number of the word in the document) of windows."""
        at = self.at[windows]
        doc = np.searchsorted(self.starts + self.lens, at, side="right")
        return self.order_ids[doc], doc, at - self.starts[doc]


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _blocks(batches: Iterable[pa.RecordBatch], last: int) -> Iterator[tuple[dict, list[dict]]]:
    """Each block's row of kind ``last`` with the rows that came before it."""
    before: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            if row["kind"] != last:
                before.append(row)
            else:
                yield row, [a for a in before if a["block"] == row["block"]]
                before = []


def _asked_rows(block: int, home: int, buckets: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for start, end in C.runs(buckets):
        yield pa.record_batch(
            [pa.array([int(buckets[start])], pa.int32()), pa.array([block], pa.int64()), pa.array([home], pa.int32()), pa.array([C.pack(**{k: v[start:end] for k, v in columns.items()})], pa.binary())],
            names=["bucket", "block", "home", "entries"],
        )


def _gathered(rows: list[dict]) -> tuple[list[dict], dict[str, np.ndarray], np.ndarray]:
    """A bucket's rows by block, their entries in one, and the row number of each entry."""
    rows.sort(key=lambda r: r["block"])
    parts = [C.unpack(r.pop("entries")) for r in rows]
    if not parts:
        return [], {}, np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(parts)), [len(next(iter(p.values()))) for p in parts])
    return rows, {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}, of


def _sent(block: int, home: int, kind: int, data: bytes, source: int = 0, bucket: int = 0) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], t) for v, t in ((block, pa.int64()), (home, pa.int32()), (kind, pa.int32()), (source, pa.int64()), (bucket, pa.int32()), (data, pa.binary()))], names=["block", "home", "kind", "source", "bucket", "data"])


def factorize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_words, n_removed, kept, factors, *keep) for each row.

    ``kept`` has the words outside factors, joined by single spaces. A factor is (start, n_words, ref_doc, ref_start):
    words of this document, counted from 0, that stand at an earlier place too. ``keep`` names
    further columns to carry along.
    """
    spark = docs.sparkSession
    n = C.shuffle_width(spark)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = C.partition_id()
        for k, (ids, texts, extra) in enumerate(_whole_rows(batches, block_chars)):
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            raw = [texts[i].encode() for i in order]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, extra.schema) as out:
                out.write_table(extra.take(pa.array(order)))
            blob = C.pack(sizes=np.array([len(t) for t in raw], np.uint32), **C.ids_to_arrays([ids[i] for i in order]))
            yield pa.record_batch(
                [pa.array([part << 32 | k], pa.int64()), pa.array([_home(part << 32 | k, n)], pa.int32()), pa.array([DOCS], pa.int32()), *(pa.array([b], pa.binary()) for b in (blob, C.pack_bytes(b"".join(raw)), C.pack_bytes(sink.getvalue().to_pybytes())))],
                names=["block", "home", "kind", "docs", "texts", "extra"],
            )

    def list_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _ in _blocks(batches, DOCS):
            anchors = Block(row["docs"], row["texts"]).anchors
            yield from _asked_rows(row["block"], row["home"], _bucket(anchors, n), anchors=anchors)

    def tell_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, entries, of = _gathered([r for batch in batches for r in batch.to_pylist()])
        if rows:
            _, number, count = np.unique(entries["anchors"], return_inverse=True, return_counts=True)
            repeated = count[number] > 1  # each block lists an anchor once
            for row, part in zip(rows, np.split(repeated, np.flatnonzero(np.diff(of)) + 1), strict=True):
                if part.any():
                    blobs = (row["bucket"].to_bytes(4, "little"), np.packbits(part).tobytes(), None)
                    yield pa.record_batch([pa.array([row["block"]], pa.int64()), pa.array([row["home"]], pa.int32()), pa.array([ANSWER], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names=["block", "home", "kind", "docs", "texts", "extra"])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, answers in _blocks(batches, DOCS):
            block = Block(row["docs"], row["texts"])
            told, repeated = {int.from_bytes(a["docs"], "little"): a["texts"] for a in answers}, np.zeros(len(block.anchors), bool)
            buckets = _bucket(block.anchors, n)
            for start, end in C.runs(buckets):
                if bits := told.get(int(buckets[start])):
                    repeated[start:end] = np.unpackbits(np.frombuffer(bits, np.uint8), count=end - start)
            block.hashed()
            number, buckets = block.asked(repeated, n)
            ids, docs, words = block.place(block.first[number])
            yield from _asked_rows(row["block"], row["home"], buckets, high=block.high[number], low=block.low[number], ids=ids, docs=docs.astype(np.uint32), words=words.astype(np.uint32))
            state = block.state(number, buckets)
            yield pa.record_batch([pa.array([row["home"]], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([-1 - row["home"]], pa.int32()), pa.array([state], pa.binary())], names=["bucket", "block", "home", "entries"])
            del block

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["home"] < 0:  # a state, which only passes by
                    yield _sent(row["block"], -1 - row["home"], STATE, row["entries"])
                else:
                    rows.append(row)
        rows, entries, of = _gathered(rows)
        if not rows:
            return
        order = np.lexsort((entries["words"], of, entries["ids"], entries["low"], entries["high"]))
        high, low = entries["high"][order], entries["low"][order]
        fresh = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
        earliest = np.zeros(len(order), np.int64)
        earliest[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        later = earliest != np.arange(len(order))
        cuts = np.flatnonzero(np.diff(of)) + 1
        blocks = np.array([r["block"] for r in rows], np.int64)
        for row, part, e in zip(rows, np.split(later, cuts), np.split(earliest, cuts), strict=True):
            if part.any():
                e = e[part]
                data = C.pack(bits=np.packbits(part), ids=entries["ids"][e], blocks=blocks[of[e]], docs=entries["docs"][e], words=entries["words"][e])
                yield _sent(row["block"], row["home"], PLACES, data, bucket=row["bucket"])

    def find_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, places in _blocks(batches, STATE):
            runs = _runs(row["block"], C.unpack(row["data"]), {a["bucket"]: a["data"] for a in places})
            yield _sent(row["block"], row["home"], RUNS, C.pack(**runs))
            yield from _asks(row["block"], runs, n)

    def lend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == RUNS:
                    own = Runs(row["block"], C.unpack(row["data"]))
                else:
                    yield _sent(row["source"], _home(row["source"], n), LENT, own.some(C.unpack(row["data"])["docs"]))

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, before in _blocks(batches, LENT + 1):
            (own,) = (Runs(row["block"], C.unpack(a["data"])) for a in before if a["kind"] == RUNS)
            for a in before:
                if a["kind"] == LENT:
                    own.borrow(C.unpack(a["data"]))
            yield _parsed(C.unpack(row["docs"]), C.unpack_bytes(row["texts"]), own, C.unpack_bytes(row["extra"]), schema)

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *keep)
    schema = rows.select("_id").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string").add("factors", FACTORS)
    for field in rows.select(*keep).schema if keep else []:
        schema = schema.add(field)
    before = set(open_paths())
    blocks = C.materialize(rows.mapInArrow(pack, PACKED), "blocks")
    listed = blocks.drop("extra").mapInArrow(list_anchors, ASKED)
    anchors = C.materialize(C.to_home(listed, "bucket", n).mapInArrow(tell_anchors, PACKED), "anchors")
    home = lambda df: C.to_home(df, "home", n).sortWithinPartitions("block", "kind")
    asked = home(blocks.withColumn("extra", F.lit(None).cast("binary")).union(anchors)).mapInArrow(ask, ASKED)
    places = C.to_home(asked, "bucket", n).mapInArrow(tell, SENT)
    runs = C.materialize(home(places).mapInArrow(find_runs, SENT), "runs")
    lent = home(runs).mapInArrow(lend, SENT)
    none = F.lit(None).cast("binary")
    told = runs.where(F.col("kind") == RUNS).union(lent).select("block", "home", "kind", "data", none.alias("docs"), none.alias("texts"), none.alias("extra"))
    whole = blocks.select("block", "home", F.lit(LENT + 1).alias("kind"), none.alias("data"), "docs", "texts", "extra")
    out = home(told.union(whole)).mapInArrow(parse, schema).withColumnRenamed("_id", id_col)
    release((p for p in open_paths() if p not in before), out)
    return out


def _home(block: int, n: int) -> int:
    """The partition where all that concerns a block meets."""
    return ((block >> 32) + (block & 0xFFFFFFFF) * 7919) % n


RUN = ("docs", "words", "sizes", "ids", "blocks", "ref_docs", "ref_words")


def _runs(block: int, state: dict[str, np.ndarray], told: dict[int, bytes]) -> dict[str, np.ndarray]:
    """The block's runs in order: the document's number and the first window's word, windows, and the earliest place of the first (id, block, document, word)."""
    at, codes, lens = np.cumsum(state["at"], dtype=np.int64), state["codes"].astype(np.int64), state["lens"].astype(np.int64)
    ends = np.cumsum(lens)
    doc = np.searchsorted(ends, at, side="right")
    word = at - (ends - lens)[doc]
    m = int(codes.max()) + 1 if len(codes) else 0
    _, first = np.unique(codes, return_index=True)
    place = {"ids": np.full(m, -1, np.int64), "blocks": np.full(m, block, np.int64), "docs": doc[first], "words": word[first]}
    known = np.zeros(m, bool)
    asked, buckets = state["asked"].astype(np.int64), state["buckets"]
    for start, end in C.runs(buckets):
        if blob := told.get(int(buckets[start])):
            got = C.unpack(blob)
            later = asked[start:end][np.unpackbits(got["bits"], count=end - start).astype(bool)]
            known[later] = True
            for k, v in place.items():
                v[later] = got[k]
    repeats = np.flatnonzero(known[codes] | (first[codes] != np.arange(len(codes))))
    doc, word, codes = doc[repeats], word[repeats], codes[repeats]
    ref = {k: v[codes] for k, v in place.items()}
    fresh = np.ones(len(doc), bool)
    if len(doc):
        fresh[1:] = (np.diff(doc) != 0) | (np.diff(word) != 1) | (np.diff(ref["blocks"]) != 0) | (np.diff(ref["docs"]) != 0) | (np.diff(ref["words"]) != 1)
    head = np.flatnonzero(fresh)
    return {"lens": lens} | dict(zip(RUN, (doc[head], word[head], np.diff(np.append(head, len(doc))), ref["ids"][head], ref["blocks"][head], ref["docs"][head], ref["words"][head]), strict=True))


def _asks(block: int, runs: dict[str, np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """The documents of other blocks at whose places a run ends that another run follows at once, for the blocks that hold them."""
    more = (runs["docs"][1:] == runs["docs"][:-1]) & (runs["words"][1:] == runs["words"][:-1] + runs["sizes"][:-1])
    asking = np.flatnonzero(more & (runs["blocks"][:-1] != block))
    order = asking[np.argsort(runs["blocks"][asking], kind="stable")]
    for start, end in C.runs(runs["blocks"][order]):
        holder = int(runs["blocks"][order[start]])
        yield _sent(holder, _home(holder, n), ASK, C.pack(docs=np.unique(runs["ref_docs"][order[start:end]])), source=block)


_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)  # a Mersenne prime, and a fixed base
_INVERSE = pow(_BASE - 1, -1, _PRIME)


def _rising(first: int, n: int) -> int:
    """The sum of (first + k) * base ** k for k below n."""
    power = pow(_BASE, n, _PRIME)
    plain = (power - 1) * _INVERSE
    return (first * plain + (n * power - _BASE * plain) * _INVERSE) % _PRIME


class Row:
    """Earliest places of windows in a row, by runs; hashes tell whether two rows agree for a while."""

    def __init__(self, starts: np.ndarray, size: int, blocks: np.ndarray, docs: np.ndarray, words: np.ndarray):
        self.starts, self.size = starts.tolist(), size
        self.firsts = [(xxhash.xxh3_64_intdigest(b"%d %d" % (block, doc)) + word) % _PRIME for block, doc, word in zip(blocks.tolist(), docs.tolist(), words.tolist(), strict=True)]
        self.before, total = [], 0
        for start, end, first in zip(self.starts, [*self.starts[1:], size], self.firsts, strict=True):
            self.before.append(total)
            total = (total + pow(_BASE, start, _PRIME) * _rising(first, end - start)) % _PRIME

    def value(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        return self.firsts[k] + at - self.starts[k]

    def upto(self, at: int) -> int:
        """The hash of the windows before one."""
        k = bisect_right(self.starts, at) - 1
        return self.before[k] + pow(_BASE, self.starts[k], _PRIME) * _rising(self.firsts[k], at - self.starts[k])

    def common(self, at: int, other: Row, there: int) -> int:
        """How many windows from ``at`` on are equal to the other row's from ``there`` on."""
        low, high = 0, min(self.size - at, other.size - there)
        if high <= 0 or (self.value(at) - other.value(there)) % _PRIME:
            return 0
        mine, its, a, b = self.upto(at), other.upto(there), pow(_BASE, there, _PRIME), pow(_BASE, at, _PRIME)
        low, step = 1, 1
        while low < high:  # steps grow while the rows agree, then halve
            n = min(high, low + step)
            if ((self.upto(at + n) - mine) * a - (other.upto(there + n) - its) * b) % _PRIME:
                high, step = n - 1, max(1, step // 2)
            else:
                low, step = n, step * 2
            step = min(step, max(1, high - low))
        return low


class Runs:
    """A block's runs by document, and those of other blocks' documents that it has borrowed."""

    PARTS = ("words", "sizes", "blocks", "ref_docs", "ref_words")

    def __init__(self, block: int, runs: dict[str, np.ndarray]):
        self.block, self.runs = block, runs
        self.first = np.searchsorted(runs["docs"], np.arange(len(runs["lens"]) + 1)).tolist()
        self.lent: dict[tuple[int, int], dict[str, np.ndarray]] = {}
        self.rows: dict[tuple[int, int], Row] = {}

    def of(self, doc: int) -> dict[str, np.ndarray]:
        return {k: self.runs[k][self.first[doc] : self.first[doc + 1]] for k in self.PARTS}

    def some(self, docs: np.ndarray) -> bytes:
        """The runs of some documents, to lend."""
        first = np.array(self.first, np.int64)
        counts = first[docs + 1] - first[docs]
        taken = C.ragged(first[docs], counts)
        return C.pack(block=np.array([self.block]), lent=docs, counts=counts, lens=self.runs["lens"][docs], **{k: self.runs[k][taken] for k in self.PARTS})

    def borrow(self, lent: dict[str, np.ndarray]) -> None:
        at = 0
        for doc, count, words in zip(lent["lent"].tolist(), lent["counts"].tolist(), lent["lens"].tolist(), strict=True):
            self.lent[int(lent["block"][0]), doc] = {"lens": words} | {k: lent[k][at : at + count] for k in self.PARTS}
            at += count

    def row(self, block: int, doc: int) -> Row:
        """All windows of a document; those that don't repeat have their own places."""
        if (block, doc) not in self.rows:
            own = self.of(doc) | {"lens": int(self.runs["lens"][doc])} if block == self.block else self.lent[block, doc]
            windows = max(0, own["lens"] - LENGTH + 1)
            gaps = np.append(0, own["words"] + own["sizes"])
            gaps = gaps[gaps < np.append(own["words"], windows)]
            order = np.argsort(np.concatenate([own["words"], gaps]), kind="stable")
            join = lambda a, b: np.concatenate([a, b])[order]
            same = lambda v: np.full(len(gaps), v, np.int64)
            if len(self.rows) > 1000:  # what is remembered stays bounded
                self.rows.clear()
            self.rows[block, doc] = Row(join(own["words"], gaps), windows, join(own["blocks"], same(block)), join(own["ref_docs"], same(doc)), join(own["ref_words"], gaps))
        return self.rows[block, doc]

    def factors(self, doc: int) -> np.ndarray:
        """(first word, words, run, words of the run before the first) of the greedy parse's factors, in order."""
        own = {k: v.tolist() for k, v in self.of(doc).items()}
        out, window, covered = [], 0, 0
        for k, (word, size) in enumerate(zip(own["words"], own["sizes"], strict=True)):
            begin, end = max(word, window), word + size
            if begin >= end:
                continue  # an earlier factor goes on through all of it
            window = end
            if k + 1 < len(own["words"]) and own["words"][k + 1] == end:
                window += self.row(self.block, doc).common(end, self.row(own["blocks"][k], own["ref_docs"][k]), own["ref_words"][k] + size)
            start = max(begin, covered)
            covered = window + LENGTH - 1
            out.append((start, covered - start, self.first[doc] + k, start - word))
        return np.array(out, np.int64).reshape(-1, 4)


def _whole_rows(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[tuple[list, list[str], pa.Table]]:
    """Ids, texts and the other columns of whole documents whose characters reach the block's size at most once."""
    ids, texts, extra, size = [], [], [], 0
    for batch in batches:
        own = [t or "" for t in batch.column(1).to_pylist()]
        rest = batch.select(batch.schema.names[2:]) if batch.num_columns > 2 else None
        for start, end in C.slices((len(t) for t in own), budget // 16):
            ids += batch.column(0).slice(start, end - start).to_pylist()
            texts += own[start:end]
            size += sum(len(t) + 16 for t in own[start:end])
            extra.append(pa.Table.from_batches([rest.slice(start, end - start)]) if rest is not None else pa.table({"_": np.zeros(end - start, np.int8)}))
            if size >= budget:
                yield ids, texts, pa.concat_tables(extra)
                ids, texts, extra, size = [], [], [], 0
    if ids:
        yield ids, texts, pa.concat_tables(extra)


def _parsed(docs: dict[str, np.ndarray], raw: bytes, own: Runs, extra: bytes, schema: StructType) -> pa.RecordBatch:
    kept, lens, removed, parts, edges, at = [], [], [], [], [0], 0
    for i, size in enumerate(docs["sizes"].tolist()):
        factors = own.factors(i)
        parts.append(factors)
        edges.append(edges[-1] + len(factors))
        words = words_of(raw[at : at + size])
        at += size
        lens.append(len(words))
        if len(factors):
            stays = np.ones(len(words), bool)
            stays[C.ragged(factors[:, 0], factors[:, 1])] = False
            words = list(compress(words, stays.tolist()))
        removed.append(lens[-1] - len(words))
        kept.append(b" ".join(words).decode())
    start, n, run, into = np.concatenate([np.zeros((0, 4), np.int64), *parts]).T
    order_ids = np.where(docs["no_id"] == 1, NO_ID, docs["ids"])
    runs = own.runs
    ref_id, local = runs["ids"][run], runs["blocks"][run] == own.block  # the block itself knows its ids
    ref_id[local] = order_ids[runs["ref_docs"][run[local]]]
    values = pa.StructArray.from_arrays([pa.array(start), pa.array(n), pa.array(ref_id, mask=ref_id == NO_ID), pa.array(runs["ref_words"][run] + into)], names=["start", "n_words", "ref_doc", "ref_start"])
    listed = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
    rest = pa.ipc.open_stream(extra).read_all().combine_chunks()
    rest = [rest.column(f.name).combine_chunks() for f in schema.fields[5:]]
    rest = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in rest]
    ids = pa.array(docs["ids"], mask=docs["no_id"].astype(bool))
    return pa.record_batch([ids, pa.array(lens, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), listed, *rest], names=[f.name for f in schema.fields])
