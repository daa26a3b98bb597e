"""FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning takes a bounded sample of labelled rows (MAX_LABELLED, the smallest hashes of doc_id) in one
task; scoring is one map over all texts with the few weights that the L1 term leaves, which travel with
the task. A feature is the presence of a word, of two neighbouring words or of two words with one between
them; its place is a 64-bit hash, so that features of a long text hardly ever collide with a weight.

Defined results: null and empty texts have no features and get the score of the bias alone; a text of any
length is read whole; equal texts have equal scores; rows that repeat are scored each; labels that repeat for a doc_id
count as toxic if one of them is; with no labelled rows, or with one class only, every score is the share
of toxic rows (0 without rows). Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm import textops as X
from pairlens.llm.common import arrow_map, map_batches, table

#: Labelled rows that the model is fitted on, at most.
MAX_LABELLED = 10_000
THRESHOLD = 0.7
UNIGRAM, BIGRAM, SKIPGRAM = (np.uint64(k) for k in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B))
SLOTS = 1 << 16
#: Counters that stand for the features while they are counted.
CELLS = 1 << 22


@dataclass(frozen=True)
class Settings:
    """Per-coordinate rate alpha / (beta + sqrt(sum of squared gradients)), L1 and L2 strengths, passes."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.01
    passes: int = 4


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def slots(self) -> np.ndarray:
        out = np.zeros(SLOTS, bool)
        out[(self.features & np.uint64(SLOTS - 1)).astype(np.int64)] = True
        return out


def _features(words: X.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind of feature: hashes, and the text of each."""
    owner = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    h = words.hashes
    out = [(h ^ UNIGRAM, owner)]
    for gap, kind in ((1, BIGRAM), (2, SKIPGRAM)):
        same = owner[gap:] == owner[:-gap]
        out.append((X.mix(h[:-gap] * X.BASE + h[gap:] + kind)[same], owner[gap:][same]))
    return out


def text_features(texts: pa.Array) -> list[np.ndarray]:
    """Distinct feature hashes of every text."""
    out = []
    for first, end, data, offsets in X.blocks(texts):
        kinds = _features(X.Words(data, offsets, X.PUNCTUATION))
        hashes = np.concatenate([k for k, _ in kinds])
        owner = np.concatenate([o for _, o in kinds])
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(end - first + 1))
        hashes = hashes[order]
        out += [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def ftrl(rows: list[np.ndarray], labels: list[int], settings: Settings) -> Model:
    """One model from rows of feature hashes, in the given order."""
    if not labels or len(set(labels)) < 2:
        share = min(max(sum(labels) / len(labels), 1e-6), 1 - 1e-6) if labels else 1e-6
        return Model(np.zeros(0, np.uint64), np.zeros(0), math.log(share / (1 - share)))
    names, counts = np.unique(np.concatenate(rows), return_counts=True)
    # a gradient is at most 1, so a feature met l1 times or fewer never leaves zero
    names = names[counts * settings.passes > settings.l1]
    kept = []
    for row in rows:
        place = np.searchsorted(names, row)
        place[place == len(names)] = 0
        kept.append(place[names[place] == row] if len(names) else place[:0])
    z, n, w = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    share = sum(labels) / len(labels)
    bias, bias_n = math.log(share / (1 - share)), 0.0
    for _ in range(settings.passes):
        for place, label in zip(kept, labels, strict=True):
            p = 1 / (1 + math.exp(-max(min(bias + float(w[place].sum()), 35), -35)))
            g = p - label
            step = np.sqrt(n[place] + g * g) - np.sqrt(n[place])
            z[place] += g - step / settings.alpha * w[place]
            n[place] += g * g
            size = np.abs(z[place])
            w[place] = np.where(size <= settings.l1, 0, -np.sign(z[place]) * (size - settings.l1) / ((settings.beta + np.sqrt(n[place])) / settings.alpha + settings.l2))
            bias_n += g * g
            bias -= settings.alpha / (settings.beta + math.sqrt(bias_n)) * g * 0.1
    used = w != 0
    return Model(names[used], w[used], bias)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on the rows of labels (doc_id, label 0/1) that docs has."""
    chosen = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def fit(batches):
        # counts by place first, so that features too rare to matter are not all held at once
        batches, cells, found = [b for b in batches if b.num_rows], np.zeros(CELLS, np.int32), []
        for batch in batches:
            for row in text_features(batch.column(2)):
                cells[(row & np.uint64(CELLS - 1)).astype(np.int64)] += 1
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [row[cells[(row & np.uint64(CELLS - 1)).astype(np.int64)] * settings.passes > settings.l1] for row in text_features(batch.column(2))]
            found += zip(ids, marks, rows, strict=True)
        found.sort(key=lambda r: (hash_order(r[0]), r[0]))
        model = ftrl([r[2] for r in found], [r[1] for r in found], settings)
        yield table(["feature", "weight"], [X.signed(model.features), model.weights], [pa.int64(), pa.float64()])
        yield table(["feature", "weight"], [[None], [model.bias]], [pa.int64(), pa.float64()])

    fitted = arrow_map(rows.repartition(1), fit, "feature long, weight double").collect()
    weights = sorted((r.feature % (1 << 64), r.weight) for r in fitted if r.feature is not None)
    bias = next((r.weight for r in fitted if r.feature is None), math.log(1e-6))
    return Model(np.array([f for f, _ in weights], np.uint64), np.array([w for _, w in weights], float), bias)


def hash_order(doc_id: int) -> int:
    return int(X.mix(np.array([doc_id % (1 << 64)], np.uint64))[0])


def scorer(model: Model):
    """Function of a text column to scores between 0 and 1."""
    slots = model.slots()

    def score(texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), model.bias)
        for first, end, data, offsets in X.blocks(texts):
            hits = []
            for hashes, owner in _features(X.Words(data, offsets, X.PUNCTUATION)) if len(model.features) else ():
                near = np.flatnonzero(slots[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)])
                place = np.minimum(np.searchsorted(model.features, hashes[near]), len(model.features) - 1)
                same = model.features[place] == hashes[near]
                hits.append(owner[near[same]] * len(model.features) + place[same])
            if hits:
                pairs = np.unique(np.concatenate(hits))
                text, place = np.divmod(pairs, len(model.features))
                out[first:end] += np.bincount(text, model.weights[place], end - first)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def build():
        score = scorer(model)

        def work(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(score(batch.column(1)))], names=["doc_id", "score"])

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), build, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose text scores below the threshold, all columns unchanged."""
    names = docs.columns
    at = names.index("text")

    def build():
        score = scorer(model)

        def work(batch):
            yield batch.filter(pa.array(score(batch.column(at)) < threshold))

        return work

    return map_batches(docs, build, docs.schema)
