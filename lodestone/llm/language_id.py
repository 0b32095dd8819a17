"""Language identification of mixed-language text.

The script of a word's letters (by Unicode range) first narrows the candidates to languages that were learned in
that script; only for these the word is scored by its character n-grams. Viterbi with a penalty for each switch then
labels the words, and runs of equal labels are the spans. A word begins with a letter; of scripts with equally many
letters it is in the one that is listed first. Words in a script that nobody taught are ``und``: they vote for no language. A document's language is the one with most
letters in its spans; its score is that share of all letters, those of ``und`` words too.

``gain`` tells how likely that language is: the log-likelihood of its words over that of n-grams by chance (each
hash as likely as another), for each letter of the document, as a share of what the texts it was learned from
have. Text in an unlearned language is hardly likelier than chance.

The model is fitted on at most about ``SAMPLE`` labelled documents, a bounded sample; each whole
text is used. Its size depends on the number of languages only.

Null text and text without letters give ``und``, score and gain 0.0 and no spans; text wholly in unlearned scripts gives
``und``, score and gain 0.0 and one span. Ties go to the language
that sorts first. With nothing to learn from, all is ``und``. Null or repeated ids give a row each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lodestone.llm import common as C
from lodestone.llm.ngrams import bounded_sample, grams, word_finder

#: Labelled documents to fit on, about.
SAMPLE = 6000
ORDERS = (2, 3, 4)
BITS = 18
#: Log-likelihood that a change of language must win.
SWITCH = 8.0
#: A language is a candidate in a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"
#: Words, at least, that are worked on as one column of steps; only how the work is cut depends on it.
CHUNK = 32
#: Characters of text that a worker labels at once.
AT_ONCE = 1_000_000
#: What a word scores, below its worst candidate, in a language that is none.
OUTSIDE = 100.0

#: First code points of the Unicode ranges, in order, each up to the next.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "other"), (0x0E00, "Thai"),
    (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"),
    (0x2C60, "Latin"), (0x2C80, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"),
    (0xF900, "Han"), (0xFB00, "other"),
]
SPANS = ArrayType(StructType().add("lang", "string").add("start", "long").add("n_words", "long"))
NAMES = list(dict.fromkeys(name for _, name in SCRIPTS))
_FROM = np.array([at for at, _ in SCRIPTS])
_NUMBER = np.array([NAMES.index(name) for _, name in SCRIPTS])


def scripts_of(words: list[str]) -> np.ndarray:
    """The number in ``NAMES`` of the script of most of each word's letters."""
    out = np.zeros(len(words), np.int64)  # ASCII words are Latin
    far = [i for i, word in enumerate(words) if not word.isascii()]
    if far:
        points = np.frombuffer("".join([words[i] for i in far]).encode("utf-32-le", "surrogatepass"), "<u4")
        of = np.repeat(np.arange(len(far)), [len(words[i]) for i in far])
        found = _NUMBER[np.searchsorted(_FROM, points, side="right") - 1]
        out[far] = np.bincount(of * len(NAMES) + found, minlength=len(far) * len(NAMES)).reshape(len(far), len(NAMES)).argmax(axis=1)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # language by hash: log-probabilities over chance, the mean over orders
    scripts: dict[str, list[int]]  # script: its languages
    usual: np.ndarray  # by language: log-likelihood over chance for each letter that was learned from

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood over chance by word and language; far below for languages outside the word's script, NaN if it has none."""
        out = np.full((len(words), len(self.languages)), np.nan, np.float32)
        script = scripts_of(words)
        for number in np.unique(script).tolist():
            fits = self.scripts.get(NAMES[number])
            if not fits:
                continue  # nobody writes so
            at = np.flatnonzero(script == number)
            owner, hashes = grams(words if len(at) == len(words) else [words[i] for i in at.tolist()], ORDERS, BITS)
            own = np.stack([np.bincount(owner, weights=self.table[k][hashes], minlength=len(at)) for k in fits], axis=1)
            out[at] = own.min(axis=1, keepdims=True) - OUTSIDE
            out[at[:, None], fits] = own
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from rows whose language is known; rows with a null text or language are left out."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = word_finder()
        counts: dict[str, np.ndarray] = {}
        letters: dict[tuple[str, str], int] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words = find(text)
                _, hashes = grams(words, ORDERS, BITS)
                counts[lang] = counts.get(lang, 0) + np.bincount(hashes, minlength=1 << BITS)
                sizes = np.bincount(scripts_of(words), weights=np.array([len(w) for w in words], np.int64), minlength=len(NAMES)).astype(np.int64)
                for number in np.flatnonzero(sizes).tolist():
                    key = (lang, NAMES[number])
                    letters[key] = letters.get(key, 0) + int(sizes[number])
        for lang, n in counts.items():
            own = [(s, k) for (of, s), k in letters.items() if of == lang]
            yield pa.record_batch([pa.array([lang]), pa.array([C.pack(n=n.astype(np.int64))], pa.binary()), pa.array([[s for s, _ in own]], pa.list_(pa.string())), pa.array([[k for _, k in own]], pa.list_(pa.int64()))], names=["lang", "counts", "scripts", "letters"])

    parts = bounded_sample(rows, "id", sample).select("text", "lang").repartition(4).mapInArrow(count, "lang string, counts binary, scripts array<string>, letters array<long>")
    counts: dict[str, np.ndarray] = {}
    letters: dict[str, dict[str, int]] = {}
    for row in parts.toLocalIterator():
        counts[row.lang] = counts.get(row.lang, 0) + C.unpack(row.counts)["n"]
        for script, n in zip(row.scripts, row.letters, strict=True):
            letters.setdefault(row.lang, {}).setdefault(script, 0)
            letters[row.lang][script] += n
    languages = sorted(counts)
    table = np.zeros((len(languages), 1 << BITS), np.float32)
    for k, lang in enumerate(languages):
        smooth = counts[lang] + 0.5
        table[k] = (np.log(smooth / smooth.sum()) + BITS * np.log(2)) / len(ORDERS)
    usual = np.array([counts[lang] @ table[k] / max(1, sum(letters.get(lang, {}).values())) for k, lang in enumerate(languages)])
    scripts: dict[str, list[int]] = {}
    for k, lang in enumerate(languages):
        own = letters.get(lang, {})
        for script, n in own.items():
            if n >= SCRIPT_SHARE * sum(own.values()):
                scripts.setdefault(script, []).append(k)
    return Model(languages, table, scripts, usual)


def label_words(scores: np.ndarray, lens: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best sequence of languages for each document: a row of ``scores`` for each word.

    Documents are cut into chunks of words; for each chunk the best way from each language to
    each other is found for all chunks at once, chunks are then linked, and ways traced back.
    So the number of steps doesn't follow the longest document's words.
    """
    n_langs = scores.shape[1]
    width = max(CHUNK, n_langs)  # so that a chunk's ways take no more than the scores of its words
    chunks = -(-lens // width)
    n = int(chunks.sum())
    if not n:
        return np.zeros(0, np.int64)
    last = np.cumsum(chunks)
    first = last - chunks
    before = np.cumsum(lens) - lens
    spot = np.repeat(first * width - before, lens) + np.arange(len(scores))
    padded = np.zeros((n * width, n_langs), np.float32)
    padded[spot] = scores
    padded = padded.reshape(n, width, n_langs)

    ways = np.full((n, n_langs, n_langs), -np.inf, np.float32)  # from, to
    ways[:, np.arange(n_langs), np.arange(n_langs)] = 0
    for t in range(width):
        np.maximum(ways, ways.max(axis=2, keepdims=True) - np.float32(switch), out=ways)
        ways += padded[:, t, None, :]

    order = np.argsort(-chunks, kind="stable")
    count = np.bincount(chunks, minlength=1)
    alive = len(chunks) - np.cumsum(count)  # documents with more than k chunks
    best = np.zeros((len(chunks), n_langs))
    came = np.zeros((n, n_langs), np.int64)
    for k in range(int(chunks.max())):
        docs = order[: alive[k]]
        total = best[docs][:, :, None] + ways[first[docs] + k]
        came[first[docs] + k] = total.argmax(axis=1)
        best[docs] = total.max(axis=1)
    begin, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    state = best.argmax(axis=1)
    for k in range(int(chunks.max()) - 1, -1, -1):
        docs = order[: alive[k]]
        at = first[docs] + k
        end[at] = state[docs]
        begin[at] = state[docs] = came[at, state[docs]]

    each = np.arange(n)
    score = np.full((n, n_langs), -np.inf, np.float32)
    score[each, begin] = 0
    moved = np.zeros((width, n, n_langs), bool)
    top = np.zeros((width, n), np.int16)
    for t in range(width):
        top[t] = score.argmax(axis=1)
        jump = score[each, top[t]][:, None] - np.float32(switch)
        moved[t] = jump > score
        score = np.maximum(score, jump) + padded[:, t]
    labels = np.zeros((n, width), np.int16)
    state = end
    for t in range(width - 1, -1, -1):
        labels[:, t] = state
        state = np.where(moved[t][each, state], top[t], state)
    return labels.reshape(-1)[spot].astype(np.int64)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, keep: tuple[str, ...] = (), with_spans: bool = True) -> DataFrame:
    """(id, *keep, lang_pred, score, gain, spans) for each row.

    A span is (lang, first word, number of words), words counted from 0; ``with_spans`` false leaves the column out.
    ``keep`` names further columns to carry along; the text may be one of them and travels once.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.scripts, model.usual))  # 2^BITS numbers a language
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *(c for c in keep if c != text_col))
    with_text = text_col in keep
    schema = (rows.withColumnRenamed("_text", text_col) if with_text else rows.drop("_text")).schema.add("lang_pred", "string", False).add("score", "double", False).add("gain", "double", False)
    if with_spans:
        schema = schema.add("spans", SPANS, False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        known = Known(own)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for start, end in C.slices(sizes, AT_ONCE):
                part = batch.slice(start, end - start)
                found = _identified(part.column(1), known, switch, with_spans)
                yield pa.record_batch([*(c for k, c in enumerate(part.columns) if with_text or k != 1), *found], names=[f.name for f in schema.fields])

    out = rows.mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)


class Known:
    """The scores of words that a worker has met; it forgets them when they are many."""

    MOST = 200_000

    def __init__(self, model: Model):
        self.model, self.find = model, word_finder()
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def words_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: each word's number and its letters, and the words of each text."""
        if len(self.number) > self.MOST:
            self.number, self.scores = {}, self.scores[:0]
        found = [self.find(t or "") for t in texts]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        coded = pa.array(chain.from_iterable(found), pa.large_string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy(zero_copy_only=False) if len(coded) else np.zeros(0, np.int64)
        new = [w for w in words if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, *(self.model.scores(new[i:j]) for i, j in C.slices(map(len, new)))])
        return np.array([self.number[w] for w in words], np.int64)[index], np.array([len(w) for w in words], np.int64)[index], lens


def _identified(column: pa.Array, known: Known, switch: float, with_spans: bool) -> list[pa.Array]:
    """What is told of each text: its language, score, gain and perhaps spans."""
    names = np.array([*known.model.languages, UNDETERMINED], object)
    n = len(names) - 1
    codes, letters, lens = known.words_of(column.to_pylist())
    by_word = known.scores[codes]
    strange = np.isnan(by_word).any(axis=1) if n else np.ones(len(codes), bool)
    by_word[strange] = 0  # the word decides nothing
    labels = label_words(by_word, lens, switch) if n else np.zeros(len(codes), np.int64)
    labels[strange] = n
    of = np.repeat(np.arange(len(lens)), lens)
    votes = np.bincount(of * (n + 1) + labels, weights=letters, minlength=len(lens) * (n + 1)).reshape(len(lens), n + 1)
    total = np.maximum(votes.sum(axis=1), 1)
    votes[:, n] = 0  # for no language
    most = votes.max(axis=1, initial=0)
    top = np.where(most > 0, votes.argmax(axis=1), n)
    won = (labels == top[of]) & ~strange
    likely = np.bincount(of[won], weights=by_word[won, labels[won]], minlength=len(lens))
    gain = np.where(most > 0, likely / (total * np.append(np.maximum(known.model.usual, 1e-9), 1.0)[top]), 0.0)
    told = [pa.array(names[top], pa.string()), pa.array(most / total), pa.array(gain)]
    return [*told, _spans(of, labels, lens, names if n else names[:0])] if with_spans else told


def _spans(of: np.ndarray, labels: np.ndarray, lens: np.ndarray, names: np.ndarray) -> pa.Array:
    if not len(names):
        of, labels, lens = of[:0], labels[:0], np.zeros_like(lens)
    cut = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
    sizes = np.diff(np.append(cut, len(of)))
    start = cut - (np.cumsum(lens) - lens)[of[cut]]
    values = pa.StructArray.from_arrays([pa.array(names[labels[cut]] if len(names) else [], pa.string()), pa.array(start, pa.int64()), pa.array(sizes, pa.int64())], names=["lang", "start", "n_words"])
    edges = np.concatenate([[0], np.cumsum(np.bincount(of[cut], minlength=len(lens)))])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
