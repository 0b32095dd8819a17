"""Benchmark decontamination over a distributed positional inverted index.

1. *Index.* ``build_index`` reads the training documents once and stores, shard by shard, every term with the
   ordered list of its positions. A shard covers whole documents, so building needs no shuffle.
2. *Directory.* (term, shard) rows tell which shards hold which of the test items' terms.
3. *Routing.* Each window of a test item has a rarest term: that of the fewest shards. Runs of windows with one rarest term
   travel only to the shards that hold it; a window with a term that no document has travels nowhere.
4. *Matching.* A shard answers a phrase by intersecting the position lists of its terms, each moved back by
   the term's place in the phrase, starting from the term that is rarest in the shard.

Nothing but a bitmap of fixed size (``SIEVE`` bits, of the test items' term hashes) passes the driver, and no task holds more than a shard and one run.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower
case. Null text has no words. Items without words match nothing; equal item rows are one item, rows that
repeat an item's id with other texts are one item with several texts; what matches an item with a null id is hit, but no item is named.
Repeated document rows and null ids give a row each. Extra columns are
ignored. An empty document table gives an empty result; an empty test set marks nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C

#: Consecutive words of an item that make one window.
WINDOW = 13
#: Characters of text in one shard of the index.
SHARD_CHARS = 8_000_000
#: Bits of the sieve that keeps terms of no test item out of the directory.
SIEVE = 1 << 24

SHARDS = "shard long, docs binary, terms binary, postings binary"
words_of = C.plain_words


# --------------------------------------------------------------------------- index


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a shard: its documents, its terms, and each term's positions in ascending order.

    With ``keep`` the shard also holds these columns of its documents, as one compressed table.
    """
    schema = SHARDS + (", kept binary" if keep else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = C.partition_id()
        held: list[pa.RecordBatch] = []
        for k, (ids, texts) in enumerate(C.text_blocks(_seen(batches, held) if keep else batches, SHARD_CHARS)):
            known: dict[bytes, int] = {}
            codes, lens = [], []
            for start, end in C.slices(len(t) for t in texts):
                found = [words_of(t) for t in texts[start:end]]
                lens += map(len, found)
                coded = pa.array(list(chain.from_iterable(found)), pa.large_binary()).dictionary_encode()
                numbers = np.array([known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()], np.int64)
                codes.append(numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else numbers)
            lens = np.array(lens, np.int64)
            codes = np.concatenate(codes)
            places = np.arange(len(codes)) + np.repeat(np.arange(len(lens)), lens)  # no phrase crosses the gap between documents
            counts = np.bincount(codes, minlength=len(known))
            steps = np.diff(places[np.argsort(codes, kind="stable")], prepend=0)
            blobs = (C.pack(lens=lens.astype(np.uint32), **C.ids_to_arrays(ids)), C.pack_bytes(b" ".join(known)), C.pack(counts=counts.astype(np.uint32), steps=steps.astype(np.int32)))
            if keep:
                blobs += (_taken(held, len(ids)),)
            yield pa.record_batch([pa.array([(part << 32) | k]), *(pa.array([b], pa.binary()) for b in blobs)], names=["shard", "docs", "terms", "postings", *(["kept"] if keep else [])])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *keep)
    return C.materialize(rows.mapInArrow(run, schema), "postings")


def _seen(batches: Iterable[pa.RecordBatch], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, whose further columns are put into ``held`` first."""
    for batch in batches:
        held.append(batch.select(batch.schema.names[2:]))
        yield batch


def _taken(held: list[pa.RecordBatch], n: int) -> bytes:
    """The first ``n`` rows of ``held``, which lose them, as a compressed table."""
    out = []
    while n:
        out.append(held[0].slice(0, n))
        n -= out[-1].num_rows
        if out[-1].num_rows == held[0].num_rows:
            held.pop(0)
        else:
            held[0] = held[0].slice(out[-1].num_rows)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, out[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in out:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Shard:
    """A shard's position lists by term."""

    def __init__(self, docs: bytes, terms: bytes, postings: bytes):
        self.docs = C.unpack(docs)
        lists = C.unpack(postings)
        self.sizes = lists["counts"].astype(np.int64)
        self.until = np.cumsum(self.sizes)
        self.places = np.cumsum(lists["steps"], dtype=np.int64)
        self.number = {t: i for i, t in enumerate(C.unpack_bytes(terms).split(b" "))} if len(self.sizes) else {}
        lens = self.docs["lens"].astype(np.int64)
        self.ends = np.cumsum(lens + 1)
        self.starts = self.ends - lens - 1

    def terms(self, words: list[bytes]) -> np.ndarray:
        """The words' term numbers, -1 for words that the shard lacks."""
        return np.array([self.number.get(w, -1) for w in words], np.int64)

    def list_of(self, term: int) -> np.ndarray:
        return self.places[self.until[term] - self.sizes[term] : self.until[term]]

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms stand one after the other."""
        order = np.argsort(self.sizes[terms], kind="stable")
        at = self.list_of(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(at):
                break
            among = self.list_of(terms[k])
            spot = np.searchsorted(among, at + k)
            at = at[among[np.minimum(spot, len(among) - 1)] == at + k]
        return at

    def near(self, terms: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the tightest stretches of at most ``span`` words of one document that hold all terms, in any order.

        Each occurrence of the rarest term is met with the closest choice of the others: for every
        end among the terms' places the latest earlier place of each term is taken.
        """
        need = np.bincount(terms)
        need = {int(t): int(n) for t, n in enumerate(need) if n}
        rare = min(need, key=lambda t: self.sizes[t])
        if any(self.sizes[t] < n for t, n in need.items()):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        anchors = self.list_of(rare)
        ends = []
        for t in need:  # only places within reach of the rarest term can end a match
            places = self.list_of(t)
            spot = np.searchsorted(anchors, places)
            before = anchors[np.maximum(spot - 1, 0)]
            at = anchors[np.minimum(spot, len(anchors) - 1)]
            ends.append(places[((places - before >= 0) & (places - before < span)) | (places == at)])
        ends = np.unique(np.concatenate(ends))
        starts = ends.copy()
        whole = np.ones(len(ends), bool)
        for t, n in need.items():
            spot = np.searchsorted(self.list_of(t), ends, side="right") - n
            whole &= spot >= 0
            starts = np.minimum(starts, self.list_of(t)[np.maximum(spot, 0)])
        whole &= (ends - starts < span) & (self.doc_of(starts) == self.doc_of(ends))
        starts, ends = starts[whole], ends[whole]
        first = np.diff(starts, prepend=-1) != 0
        return starts[first], ends[first] + 1


# --------------------------------------------------------------------------- test items


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(one, item, place, word, term) for each word of each different item; ``one`` names the item's row, ``term`` is the word's hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                one = xxhash.xxh3_128_digest(f"{item} {text}".encode())
                for start in range(0, len(words), 100_000):
                    part = words[start : start + 100_000]
                    n = len(part)
                    yield pa.record_batch(
                        [pa.array([one] * n, pa.binary()), pa.array([item] * n, pa.int64()), pa.array(np.arange(start, start + n)), pa.array(part, pa.binary()), pa.array([_hash(w) for w in part], pa.int64())],
                        names=["one", "item", "place", "word", "term"],
                    )

    rows = items.select(F.col(id_col).cast("long").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    return C.materialize(rows.mapInArrow(run, "one binary, item long, place long, word binary, term long"), "item_terms")


def _sieve(terms: DataFrame) -> np.ndarray:
    """Bits of the hashes' residues: at most ``SIEVE`` of them, gathered as bitmaps of 4 kB."""
    bit = F.pmod("term", F.lit(SIEVE))
    maps = terms.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("map"))
    out = np.zeros(SIEVE + (1 << 15), bool)  # a bucket's number counts from 1, and bit 0 has a bucket of its own
    for row in maps.toLocalIterator():
        bits = np.unpackbits(np.frombuffer(bytes(row["map"]), np.uint8), bitorder="little")
        at = (row["k"] - 1) * len(bits) + 1
        out[max(at, 0) : at + len(bits)] |= bits[max(-at, 0) :].astype(bool)
    return out[:SIEVE]


def directory(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, shard) for the terms of test items that shards hold."""
    sent = index.sparkSession.sparkContext.broadcast(np.packbits(_sieve(terms)))  # SIEVE / 8 bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = C.unpack_bytes(blob)
                own = np.array([_hash(w) for w in text.split(b" ")] if text else [], np.int64)
                own = own[sieve[own % SIEVE]]
                yield pa.record_batch([pa.array(own), pa.array(np.full(len(own), shard))], names=["term", "shard"])

    found = index.select("shard", "terms").mapInArrow(run, "term long, shard long")
    return C.materialize(found.join(terms.select("term").distinct(), "term", "left_semi"), "directory")


def routes(terms: DataFrame, where: DataFrame, window: int) -> DataFrame:
    """(shard, item, size, words) of each run of windows and each shard that holds its rarest term: windows of ``size`` words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, words, term, count in _items(batches):
            size = min(window, len(words))
            at = np.arange(len(words) - size + 1)
            reach = at[:, None] + np.arange(size)
            rare = at + count[reach].argmin(axis=1)
            cut = np.flatnonzero(np.diff(term[rare], prepend=term[rare[0]] - 1))
            rows = [(int(term[rare[i]]), item, size, b" ".join(words[i : j + size - 1])) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True) if count[rare[i]]]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["term", "item", "size", "words"])

    counts = C.materialize(where.groupBy("term").agg(F.count("*").alias("n")), "counts")
    told = terms.join(counts, "term", "left").select("one", "item", "place", "word", "term", F.coalesce("n", F.lit(0)).alias("n"))
    dealt = told.repartition(C.shuffle_width(terms.sparkSession), "one").sortWithinPartitions("one", "place")
    found = C.materialize(dealt.mapInArrow(run, "term long, item long, size int, words binary"), "runs")
    return found.join(where, "term").select("shard", "item", "size", "words")


def _items(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[bytes], np.ndarray, np.ndarray]]:
    """Each item's id, words, terms and their counts, from rows by word."""
    now, item, words, terms, counts = None, None, [], [], []
    for batch in batches:
        for one, own, word, term, n in zip(*(batch.column(c).to_pylist() for c in ("one", "item", "word", "term", "n")), strict=True):
            if one != now:
                if words:
                    yield item, words, np.array(terms), np.array(counts)
                now, item, words, terms, counts = one, own, [], [], []
            words.append(word)
            terms.append(term)
            counts.append(n)
    if words:
        yield item, words, np.array(terms), np.array(counts)


# --------------------------------------------------------------------------- operators


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, n_hit, items, *keep) for each row: words inside windows of items, and those items.

    ``keep`` names further columns to carry along, so that nothing has to be joined back by an id.
    """
    spark = docs.sparkSession
    shards = build_index(docs, id_col, text_col, keep)
    terms = item_terms(items, item_id_col, item_text_col)
    asked = routes(terms, directory(shards, terms), window)
    more = ["kept"] if keep else []
    n = C.shuffle_width(spark)
    meet = shards.select("shard", F.lit(None).cast("long").alias("item"), F.lit(0).alias("size"), F.lit(None).cast("binary").alias("words"), "docs", "terms", "postings", *more)
    meet = meet.union(asked.select("shard", "item", "size", "words", *(F.lit(None).cast("binary") for _ in ("docs", "terms", "postings", *more))))
    home = F.pmod(F.shiftright("shard", 32) + F.pmod("shard", F.lit(1 << 32)) * 7919, F.lit(n)).cast("int")  # a shard's scan task and its number there
    dealt = C.to_home(meet.withColumn("home", home), "home", n).drop("home").sortWithinPartitions("shard", "size")
    schema = spark.createDataFrame([], "_id long, n_words long, n_hit long, items array<long>").schema
    for field in docs.select(*keep).schema if keep else []:
        schema = schema.add(field)
    return dealt.mapInArrow(_matched, schema).withColumnRenamed("_id", id_col)


def _matched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards, each before what is asked of it, to the rows of their documents."""
    shard, kept, marks = None, None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if not row["size"]:
                if shard is not None:
                    yield from _totals(shard, marks, kept)
                shard, kept, marks = Shard(row["docs"], row["terms"], row["postings"]), row.get("kept"), Marks()
                continue
            terms = shard.terms(row["words"].split(b" "))
            size = row["size"]
            lacks = np.concatenate([[0], np.cumsum(terms < 0)])
            for k in np.flatnonzero(lacks[size:] == lacks[:-size]).tolist():  # windows whose terms the shard all has
                at = shard.phrase(terms[k : k + size])
                if len(at):
                    marks.add(at, size, shard.doc_of(at), row["item"])
    if shard is not None:
        yield from _totals(shard, marks, kept)


class Marks:
    """A shard's stretches that are hit, and the items of its documents."""

    def __init__(self):
        self.starts, self.ends, self.pairs, self.n = [], [], set(), 0

    def add(self, at: np.ndarray, size: int, docs: np.ndarray, item: int | None) -> None:
        self.starts.append(at)
        self.ends.append(at + size)
        self.n += len(at)
        if item is not None:
            self.pairs.update((doc, item) for doc in np.unique(docs).tolist())
        if self.n > 1_000_000:  # what is held is bounded by the shard's words
            merged = self.merged()
            self.starts, self.ends, self.n = [merged["starts"]], [merged["ends"]], 0

    def merged(self) -> dict[str, np.ndarray]:
        none = np.zeros(0, np.int64)
        return _merged(np.concatenate([none, *self.starts]), np.concatenate([none, *self.ends]))


def _merged(starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The stretches' union, as ascending stretches that don't touch."""
    if not len(starts):
        return {"starts": starts, "ends": ends}
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.append(True, starts[1:] > ends[:-1])
    return {"starts": starts[fresh], "ends": ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)]}


def _totals(shard: Shard, marks: Marks, kept: bytes | None) -> Iterator[pa.RecordBatch]:
    docs, found = shard.docs, marks.merged()
    lens = docs["lens"].astype(np.int64)
    hit = np.bincount(shard.doc_of(found["starts"]), weights=found["ends"] - found["starts"], minlength=len(lens)).astype(np.int64)
    pairs = sorted(marks.pairs)
    edges = np.concatenate([[0], np.cumsum(np.bincount(np.array([d for d, _ in pairs], np.int64), minlength=len(lens)))])
    items = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array([x for _, x in pairs], pa.int64()))
    own = pa.record_batch([pa.array(docs["ids"], mask=docs["no_id"].astype(bool)), pa.array(lens), pa.array(hit), items], names=["_id", "n_words", "n_hit", "items"])
    at = 0
    for part in pa.ipc.open_stream(kept) if kept is not None else [own.select([])]:
        n = part.num_rows if kept is not None else own.num_rows
        some = own.slice(at, n)
        yield pa.record_batch([*some.columns, *part.columns], names=[*some.schema.names, *part.schema.names])
        at += n


def matches(index: DataFrame, phrases: list[str], span: int | None = None) -> DataFrame:
    """(doc_id, phrase, start, n_words) of exact matches, or with ``span`` of proximity matches.

    A proximity match is a stretch of at most ``span`` words of one document that holds all the
    phrase's words, in any order, as often as the phrase has them; of stretches with the same
    start the shortest is given. ``start`` counts the document's words from 0. ``phrases`` is a
    stated query set, numbered from 0; phrases without words match nothing.
    """
    asked = [(i, words) for i, words in enumerate(map(words_of, phrases)) if words]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, terms, postings in zip(*(batch.column(c).to_pylist() for c in ("docs", "terms", "postings")), strict=True):
                shard = Shard(docs, terms, postings)
                ids = C.arrays_to_ids(shard.docs)
                for number, words in asked:
                    own = shard.terms(words)
                    if (own < 0).any():
                        continue
                    starts, ends = (at := shard.phrase(own), at + len(own)) if span is None else shard.near(own, span)
                    of = shard.doc_of(starts)
                    yield pa.record_batch(
                        [pa.array([ids[d] for d in of.tolist()], pa.int64()), pa.array(np.full(len(of), number)), pa.array(starts - shard.starts[of]), pa.array(ends - starts)],
                        names=["doc_id", "phrase", "start", "n_words"],
                    )

    return index.select("docs", "terms", "postings").mapInArrow(run, "doc_id long, phrase long, start long, n_words long")
