"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features count, for each hashed character n-gram, the distinct words that hold it
(a word's ends count as characters). Each feature is scaled by the log of the ratio of its
smoothed shares in toxic and other documents, and logistic regression with L1 and L2 penalties is
fitted on the scaled features. Score: the logistic function of the document's sum.

The model is fitted on at most about ``SAMPLE`` labelled documents of each run, a bounded sample, each text
whole: labels are sampled by their ids before they meet any text, and only the sample's texts are moved. It
holds 2^BITS weights.

Null and empty texts score as the classifier's intercept. Rows with a null id, label or text teach
nothing; equal rows teach once, and an id with several labels or texts teaches each pair of them. With one class
only (or none), every score is the smoothed share of toxic rows. Null or
repeated ids give a row each; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C
from lodestone.llm.ngrams import bounded_sample, grams, word_finder

#: Labelled documents to fit on, about.
SAMPLE = 6000
ORDERS = (3, 4, 5)
BITS = 18
STEPS = 600
#: Features whose log-count ratio is nearer to 0 carry next to nothing and are left out.
LEAST_RATIO = 0.7
L1, L2 = 2e-4, 1e-5


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        owner, hashes = grams(words, ORDERS, BITS)
        return np.bincount(owner, weights=self.weights[hashes], minlength=len(words))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(id, text, label) of about ``sample`` labels at most, chosen by a hash of their ids."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("labels")), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return rows.join(F.broadcast(known.distinct()), "id").select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.col("label").alias(label_col))  # about ``sample`` rows of 12 bytes


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = word_finder()
        index, counts, lens, labels = [], [], [], []
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                own, n = np.unique(grams(list(dict.fromkeys(find(text))), ORDERS, BITS)[1], return_counts=True)
                index.append(own.astype(np.int32))
                counts.append(n.astype(np.float32))
                lens.append(len(own))
                labels.append(label == 1)
        model = _train(index, counts, np.array(lens, np.int64), np.array(labels, np.float32))
        yield pa.record_batch([pa.array([C.pack(w=model.weights, b=np.array([model.intercept]))], pa.binary())], names=["model"])

    # one task gets the sample and nothing else, in one order whatever the partitions were
    kept = bounded_sample(rows, "id", sample).select("text", "label").repartition(1).sortWithinPartitions("text", "label")
    got = [C.unpack(r.model) for r in kept.mapInArrow(train, "model binary").collect()]
    return Model(got[0]["w"], float(got[0]["b"][0])) if got else Model(np.zeros(1 << BITS, np.float32), 0.0)


def _train(index: list, counts: list, lens: np.ndarray, y: np.ndarray) -> Model:
    n, size = len(y), 1 << BITS
    toxic = float(y.sum())
    start = float(np.log((toxic + 0.5) / (n - toxic + 0.5)))
    if not n or toxic in (0.0, float(n)) or not lens.sum():
        return Model(np.zeros(size, np.float32), start)
    # only n-grams that several documents hold can say something about others
    cols, x = np.concatenate(index), np.concatenate(counts)
    index.clear()
    counts.clear()
    rows = np.repeat(np.arange(n, dtype=np.int32), lens)
    by_label = [np.bincount(cols, weights=x * w[rows], minlength=size) + 1.0 for w in (y, 1 - y)]
    ratio = np.log(by_label[0] / by_label[0].sum()) - np.log(by_label[1] / by_label[1].sum())
    used = ((np.bincount(cols, minlength=size) >= 3) & (np.abs(ratio) >= LEAST_RATIO))[cols]
    rows, cols = rows[used], cols[used]
    x = x[used] * ratio[cols].astype(np.float32)
    seen, cols = np.unique(cols, return_inverse=True)
    cols = cols.astype(np.int32)
    w, b = np.zeros(len(seen)), start
    m, v, mb, vb = np.zeros(len(seen)), np.zeros(len(seen)), 0.0, 0.0
    for t in range(1, STEPS + 1):  # Adam with a proximal step for L1
        z = np.bincount(rows, weights=x * w.astype(np.float32)[cols], minlength=n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(cols, weights=x * error.astype(np.float32)[rows], minlength=len(seen)) + L2 * w
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / (np.sqrt(v / (1 - 0.99**t)) + 1e-6) * 1e-2
        w -= rate * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        b -= 0.02 / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8) * mb / (1 - 0.9**t)
    weights = np.zeros(size, np.float32)
    weights[seen] = w * ratio[seen]
    return Model(weights, float(b))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score) for each row, by its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # 2^BITS numbers
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *keep)
    schema = rows.drop("_text").schema.add("score", "double", False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        find = word_finder()
        known: dict[str, float] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sums = []
            for start, end in C.slices(len(t or "") for t in texts):
                if len(known) > 200_000:  # what a worker remembers stays bounded
                    known = {}
                sets = [set(find(t or "")) for t in texts[start:end]]
                new = [w for w in set(chain.from_iterable(sets)) if w not in known]
                known.update(zip(new, own.word_scores(new).tolist(), strict=True))
                sums += [sum(map(known.__getitem__, sorted(s))) for s in sets]  # sorted: the same sum each time
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums) + own.intercept, -30, 30)))
            yield pa.record_batch([*(c for k, c in enumerate(batch.columns) if k != 1), pa.array(scores, pa.float64())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
