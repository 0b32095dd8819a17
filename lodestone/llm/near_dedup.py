"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's k-mers are its shingles of ``K`` words and, apart from these, its single words, each labelled with its occurrence
(the first, the second, ...). For each of some hash functions the few k-mers with the smallest hashes are taken and kept in the
order of the text: documents whose sketch agrees share these k-mers in that order, which
edits disturb and a bag of words would not. Documents with an equal sketch are candidates. ``SKETCHES`` sketches have ``PICKED``
shingles, and ``WORD_SKETCHES`` have ``PICKED_WORDS`` words.

Two documents are linked if their words, aligned in order, share at least ``SIMILAR`` of their union: aligned words over
all words of both less the aligned ones. The alignment is a longest common subsequence among places inside the
band that the threshold leaves (``aligned``). Texts of over ``LONG`` words are first cut at phrases that stand once in both.

One substituted word changes up to ``K`` shingles, so documents of nearly ``SIMILAR`` words may share a third of their shingles only.
Of U words in the union, I of them aligned, a sketch of words agrees with probability C(I, 7) / C(U, 7), whatever the edits' places: at the
threshold 0.21 for long texts, and all ``WORD_SKETCHES`` miss such a pair with 1.4 %, one of 0.85 with 0.1 %; the shingles' sketches come on top.
Unlike texts hardly have seven words in one order. README has the recall measured against all pairs.
Documents of up to ``FEW`` words have an exact way instead:
similar documents of n words share ``SIMILAR`` n labelled words at least, so the ``CHOSEN`` smallest that they share are among the
first n - ceil(SIMILAR n) + CHOSEN of each, in the order of hashes. Each choice of ``CHOSEN`` of these is a sketch of its own, also for
documents of up to FEW / SIMILAR words, which small ones may be similar to.

Steps, none of which gathers a group in one task:

1. Equal texts are one class from the start; only the first document of each goes on.
2. Of each group of equal sketches every member is compared with the group's first and last document
   and with the one of smallest hash: three comparisons a member however large the group is.
3. Links make classes, by rounds of pointing to the smallest document known, each round stored.
4. Groups whose members are still in several classes (few: they share boilerplate, or are linked
   only through others) are compared across classes: pairs are formed where the bins that
   only one of two signatures uses still allow the threshold, which is an exact bound. A signature has bins
   in proportion to the words, so the bound is as sharp for long texts. New links are merged in. No link between members of a group is lost.

Tables that are joined on hot keys are stored first, so that Spark may split such keys among tasks.

Documents without words are alike only if their texts are equal. Null text counts as empty. Repeated rows and ids give a row each. A class is named by
its smallest id; null ids come last and a class of nulls only has a null name. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm import common as C
from lodestone.session import open_paths, release

K = 5
SIMILAR = 0.8
PICKED, SKETCHES = 4, 8
PICKED_WORDS, WORD_SKETCHES = 7, 18
#: Words up to which a document has no chance sketches but exact ones, and the words that make one of these.
FEW, CHOSEN = 24, 4
#: Words from which texts are cut at common phrases before they are aligned.
LONG = 2000
#: Bins that a signature has for each item, at least; and its least number of bins.
SPREAD, BITS = 8, 2048

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def hashes_of(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's words."""
    out = []
    for start, end in C.slices(len(t or "") for t in texts):
        found = [C.plain_words(t) for t in texts[start:end]]
        coded = pa.array(list(chain.from_iterable(found)), pa.large_binary()).dictionary_encode()
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        flat = each[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else each
        out += np.split(flat, np.cumsum([len(words) for words in found])[:-1])
    return out


def items_of(hashes: np.ndarray, size: int = K) -> np.ndarray:
    """The occurrence-labelled shingles of ``size`` words by position, as hashes; one shingle of all words if they are fewer."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    x = np.asarray(hashes, np.uint64)
    n, size = max(1, len(x) - size + 1), min(size, len(x))
    out = x[:n].copy()
    for k in range(1, size):
        out = _mix(out * _ODD2 + x[k : k + n])
    order = np.argsort(out, kind="stable")
    at = np.arange(n)
    fresh = np.append(True, np.diff(out[order]) != 0)
    label = np.empty(n, np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return _mix(out + label * _ODD)


def seeds() -> tuple[np.ndarray, np.ndarray]:
    """The hash functions of shingles' and of words' sketches."""
    every = _mix(np.arange(1, SKETCHES + WORD_SKETCHES + 1, dtype=np.uint64) * _ODD)
    return every[:SKETCHES], every[SKETCHES:]


_ODD32, _ODD32B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)  # fixed odd multipliers


def sketches_of(items: np.ndarray, seeds: np.ndarray, picked: int) -> np.ndarray:
    """One number for each hash function: the ``picked`` smallest items in the order of the text."""
    picked = min(picked, len(items))
    mixed = ((items >> np.uint64(32)).astype(np.uint32)[None, :] ^ seeds.astype(np.uint32)[:, None]) * _ODD32  # half of a hash is enough to order by
    mixed ^= mixed >> np.uint32(15)
    mixed *= _ODD32B
    mixed ^= mixed >> np.uint32(13)
    at = np.argpartition(mixed, picked - 1, axis=1)[:, :picked] if picked < len(items) else np.tile(np.arange(picked), (len(seeds), 1))
    at.sort(axis=1)
    chosen = items[at]
    out = seeds.copy()
    for k in range(picked):
        out = _mix(out * _ODD2 + chosen[:, k])
    return out


def exact_sketches_of(words: np.ndarray) -> np.ndarray:
    """One number for each choice of ``CHOSEN`` labelled words (all, if there are fewer) of those that a similar document must share some of."""
    n = len(words)
    size = min(CHOSEN, n)
    least = -(-n * round(100 * SIMILAR) // 100)
    chosen = np.sort(words)[_choices(n - least + size, size)]
    out = np.full(len(chosen), n if n < CHOSEN else CHOSEN, np.uint64)
    for k in range(size):
        out = _mix(out * _ODD2 + chosen[:, k])
    return out


@cache
def _choices(n: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(n), size)), np.int64)


def all_sketches_of(hashes: np.ndarray, items: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Similar documents of which one has up to ``FEW`` words share one of these for sure, others nearly so."""
    n, words = len(hashes), items_of(hashes, 1)
    chance = [sketches_of(items, seeds[0], PICKED), sketches_of(words, seeds[1], PICKED_WORDS)] if n > FEW else []
    return np.concatenate([items[:0], *chance, *([exact_sketches_of(words)] if 0 < n * SIMILAR <= FEW + 1e-9 else [])])


# --------------------------------------------------------------------------- alignment


def longest(a: list[int], b: list[int], offset: int, band: int) -> int:
    """Length of the longest common subsequence whose places differ by ``band`` at most; ``offset`` is added to those in ``a``.

    A column of the table is one number with a bit for each place of ``a``: 0 where the length grows. Each word of ``b`` takes
    the column on by an addition that carries from the word's places inside the band to the next growth.
    """
    if not a or not b:
        return 0
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = column = (1 << len(a)) - 1
    inside = (1 << 2 * band + 1) - 1
    for j, x in enumerate(b):
        match = places.get(x)
        if match is not None:
            at = j - band - offset
            match &= inside << at if at >= 0 else inside >> -at
            met = column & match
            if met:
                column = (column + met | column & ~match) & full
    return len(a) - column.bit_count()


def _anchors(a: list[int], b: list[int], band: int) -> list[tuple[int, int]]:
    """Places of phrases of ``K`` words that stand once in each text: as many as keep their order in both."""
    once = []
    for words in (a, b):
        phrases = list(zip(*(words[k:] for k in range(K)), strict=False))
        times = Counter(phrases)
        once.append({p: i for i, p in enumerate(phrases) if times[p] == 1})
    tails: list[int] = []  # the least place in ``a`` that ends a chain of each length, and the node that does
    ends: list[int] = []
    nodes: list[tuple[int, int, int]] = []
    for p, j in once[1].items():
        i = once[0].get(p)
        if i is not None and abs(i - j) <= band:
            k = bisect_left(tails, i)
            if k == len(tails):
                tails.append(i)
                ends.append(0)
            tails[k], ends[k] = i, len(nodes)
            nodes.append((i, j, ends[k - 1] if k else -1))
    chain, at = [], ends[-1] if ends else -1
    while at >= 0:
        i, j, at = nodes[at]
        chain.append((i, j))
    return chain[::-1]


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Words that an alignment inside the band pairs; equal beginnings and ends pair with themselves."""
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    total, i, j = head + tail, 0, 0
    for x, y in _anchors(a, b, band) if min(len(a), len(b)) > LONG else []:
        if x >= i and y >= j:
            total += longest(a[i:x], b[j:y], i - j, band) + K
            i, j = x + K, y + K
        elif x - i == y - j:  # it overlaps the phrase before
            total += x + K - i
            i, j = x + K, y + K
    return total + longest(a[i:], b[j:], i - j, band)


class Text:
    """A document's words as hashes, and its labelled words."""

    def __init__(self, text: str):
        (hashes,) = hashes_of([text])
        self.words = hashes.tolist()
        self.labelled = set(items_of(hashes, 1).tolist())


def similarity(a: Text, b: Text, least: float = SIMILAR) -> float:
    """Aligned words over the union of words; 0.0 for pairs that the words alone keep below ``least``, and pairs below it may be given less than they have."""
    both = len(a.words) + len(b.words)
    band = int(both * (1 - least) / (1 + least) + 1e-9)  # words that may stay unaligned
    if not a.words or not b.words or abs(len(a.words) - len(b.words)) > band or both - 2 * len(a.labelled & b.labelled) > band:
        return 0.0
    pairs = aligned(a.words, b.words, band)
    return pairs / (both - pairs)


# --------------------------------------------------------------------------- steps


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n_items, sketches) for each row, stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = seeds()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keys, sizes, picked = [], [], []
            for text, hashes in zip(texts, hashes_of(texts), strict=True):
                items = items_of(hashes)
                keys.append(xxhash.xxh3_128_digest((text or "").encode()))
                sizes.append(len(items))
                picked.append(all_sketches_of(hashes, items, every).view(np.int64).tolist())
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(picked, pa.list_(pa.int64()))], names=["id", "text_key", "n_items", "sketches"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return C.materialize(rows.mapInArrow(run, "id long, text_key binary, n_items int, sketches array<long>"), "sketches")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of text keys that are similar; ``texts`` has (text_key, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached: dict[bytes, Text] = {}
        held = 0

        def read(key: bytes, text: str) -> Text:
            nonlocal held
            found = cached.get(key)
            if found is None:
                if held > 500_000:  # what a worker remembers stays bounded
                    cached.clear()
                    held = 0
                found = cached[key] = Text(text)
                held += len(found.words)
            return found

        for batch in batches:
            a, b = [], []
            for one, two, text, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if similarity(read(one, text), read(two, other)) >= SIMILAR:
                    a.append(one)
                    b.append(two)
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    one = texts.select(F.col("text_key").alias("a"), F.col("text"))
    two = texts.select(F.col("text_key").alias("b"), F.col("text").alias("other"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text", "other").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each end of a link: the smallest node that links lead to.

    Each round points every node to the smallest root among its neighbours' and follows roots
    once more; the links are kept between roots only, so they shrink fast. It ends when none is left.
    """
    roots = None
    while True:
        links = C.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # every node that has a smaller neighbour points to its smallest one; chains are then halved until flat
        up = C.materialize(links.groupBy("a").agg(F.min("b").alias("b")), "up")
        while True:
            over = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
            nxt = C.materialize(up.join(over, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "up")
            up = nxt.select("a", "b")
            if nxt.where("moved").isEmpty():
                break
        found = up.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if roots is None:
            nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
            roots = nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        else:
            higher = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = roots.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = C.materialize(roots, "roots")
        one, two = (found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_top")) for c in ("a", "b"))
        links = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("a_top", "a").alias("a"), F.coalesce("b_top", "b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, text_key, n_items, class_key) for each row; ``class_key`` is never null and tells classes of nulls apart."""
    ids = classed(docs, id_col, text_col)
    named = C.materialize(ids.groupBy("root").agg(F.min("id").alias("class_id")), "named")
    return ids.join(named, "root").select(F.col("id").alias(id_col), "class_id", "text_key", "n_items", F.col("root").alias("class_key"))


def classed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n_items, root) for each row, stored; rows of one class have one root. What was stored on the way is deleted."""
    before = set(open_paths())
    rows = sketch(docs, id_col, text_col)
    # the first of equal texts goes on
    first = F.struct("n_items", "sketches")
    distinct = C.materialize(rows.groupBy("text_key").agg(F.first(first).alias("f")).select("text_key", "f.*"), "distinct")
    signed = distinct.select("text_key", F.explode("sketches").alias("bucket"))
    groups = signed.groupBy("bucket").count().where("count > 1").select("bucket")
    members = C.materialize(signed.join(groups, "bucket"), "members")
    pivots = C.materialize(members.groupBy("bucket").agg(F.array(F.min("text_key"), F.max("text_key"), F.min(F.struct(F.xxhash64("text_key"), "text_key")).getField("text_key")).alias("pivots")), "pivots")
    stars = members.join(pivots, "bucket").select("text_key", F.explode("pivots").alias("pivot")).where("text_key <> pivot")
    pairs = C.materialize(stars.select(F.greatest("text_key", "pivot").alias("a"), F.least("text_key", "pivot").alias("b")).distinct(), "pairs")

    involved = members.select("text_key").distinct()
    keyed = _keyed(docs, text_col)
    texts = C.materialize(keyed.join(involved, "text_key", "left_semi").dropDuplicates(["text_key"]), "texts")
    links = C.materialize(_verified(pairs, texts), "links")
    roots = components(links)

    # groups that still hold several classes: compare across classes, by an exact bound first
    classed = members.select("bucket", "text_key").join(roots.select(F.col("node").alias("text_key"), "root"), "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    mixed = classed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    mixed = C.materialize(mixed, "mixed")
    left = C.materialize(classed.join(mixed, "bucket"), "mixed")
    if not left.isEmpty():
        signed = _signatures(texts.join(left.select("text_key").distinct(), "text_key", "left_semi"))
        more = C.materialize(_across(left.join(signed, "text_key")).join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = _verified(more, texts)
        roots = components(links.union(found))

    ids = rows.select("id", "text_key", "n_items").join(roots.select(F.col("node").alias("text_key"), "root"), "text_key", "left")
    ids = C.materialize(ids.withColumn("root", F.coalesce("root", "text_key")), "classed")
    release((p for p in open_paths() if p not in before), ids)
    return ids


def signature_of(items: np.ndarray) -> np.ndarray:
    """The used bins of a document, 64 to a number: a power of two of bins that follows the number of labelled words."""
    size = max(BITS, 1 << (SPREAD * len(items) - 1).bit_length())
    used = np.zeros(size, bool)
    used[(items & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(used, bitorder="little").view("<i8")


def _signatures(texts: DataFrame) -> DataFrame:
    """(text_key, n_words, bits, coarse, used): signatures of labelled words, the same folded to ``BITS`` bins, and the used bins of these."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fine, coarse, used = [], [], [], []
            for hashes in hashes_of(batch.column(1).to_pylist()):
                items = items_of(hashes, 1)
                bits = signature_of(items)
                sizes.append(len(items))
                fine.append(bits)
                coarse.append(np.bitwise_or.reduce(bits.reshape(-1, BITS // 64), axis=0))
                used.append(int(np.bitwise_count(coarse[-1].view(np.uint64)).sum()))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int32()), pa.array(fine, pa.list_(pa.int64())), pa.array(coarse, pa.list_(pa.int64())), pa.array(used, pa.int32())], names=["text_key", "n_words", "bits", "coarse", "used"])

    return texts.select("text_key", "text").mapInArrow(run, "text_key binary, n_words int, bits array<long>, coarse array<long>, used int")


def _across(left: DataFrame) -> DataFrame:
    """Pairs of different classes of a group whose signatures allow the threshold.

    Each bin that only one of two documents uses has at least one labelled word that they don't share. The bound is part
    of the join's condition, so pairs that cannot be similar never leave it.
    """
    one = left.select("bucket", F.col("text_key").alias("a"), F.col("root").alias("ra"), F.col("n_words").alias("na"), F.col("bits").alias("ba"), F.col("coarse").alias("ua"), F.col("used").alias("pa"))
    two = left.select("bucket", F.col("text_key").alias("b"), F.col("root").alias("rb"), F.col("n_words").alias("nb"), F.col("bits").alias("bb"), F.col("coarse").alias("ub"), F.col("used").alias("pb"))
    close = (F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb")) & (F.col("na") >= SIMILAR * F.col("nb")) & (F.col("nb") >= SIMILAR * F.col("na"))
    enough = SIMILAR / (1 + SIMILAR) * (F.col("na") + F.col("nb")) - 1e-6
    both = sum((F.bit_count(F.col("ua")[k].bitwiseAND(F.col("ub")[k])) for k in range(BITS // 64)), F.lit(0))
    close &= both >= F.greatest(F.col("pa") - F.col("na"), F.col("pb") - F.col("nb")) + enough

    def lone(x: str, y: str):
        # the sizes of similar documents' signatures differ by a factor of two at most: the larger one is folded
        at = lambda c, k: F.get(F.col(c), k)
        folded = lambda c, k, n: F.when(F.size(c) > n, at(c, k).bitwiseOR(at(c, k + n))).otherwise(at(c, k))
        n = F.least(F.size(x), F.size(y))
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, k: total + F.bit_count(folded(x, k, n).bitwiseAND(F.bitwise_not(folded(y, k, n)))))

    close &= (F.col("na") - lone("ba", "bb") >= enough) & (F.col("nb") - lone("bb", "ba") >= enough)
    return one.join(two, "bucket").where(close).select("a", "b").distinct()


def first_of_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of each class: that of the smallest id, null ids last; of rows that share it the smallest ``text_key``, then text, then other columns."""
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("long").alias("_id"), F.col("text_key").alias("_key"))
    ids = classed(docs, id_col, text_col).withColumnRenamed("id", id_col)
    chosen = C.materialize(ids.groupBy("root").agg(F.min(order).alias("m")).select("m._id", "m._key"), "chosen")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    whole = docs.select(F.col(id_col), F.col(text_col), *others)
    schema = StructType(list(whole.schema.fields)).add("_key", "binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [xxhash.xxh3_128_digest((text or "").encode()) for text in batch.column(1).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(keys, pa.binary())], names=schema.names)

    kept = whole.mapInArrow(run, schema).join(chosen.withColumnRenamed("_key", "_of"), (F.col("_key") == F.col("_of")) & F.col(id_col).cast("long").eqNullSafe(F.col("_id")))
    # what is left to choose from are rows of one id and one text; they are combined before they are dealt
    one = kept.groupBy("_key").agg(F.min(F.struct(text_col, *others, id_col)).alias("r"))
    return one.select(*(F.col(f"r.{c}") for c in docs.columns))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a text leaves a task once, however many copies it has there
        for batch in batches:
            keys, texts = [], []
            for text in batch.column(0).to_pylist():
                key = xxhash.xxh3_128_digest((text or "").encode())
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    texts.append(text or "")
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], names=["text_key", "text"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "text_key binary, text string")
