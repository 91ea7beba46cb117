"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A text is a bag of sentences (cut after . ! ? and at line feeds).  A sentence's log-odds are a
base plus the weights of the features it contains: lower-case words and their first 3 to 8
bytes.  Fitting takes a document as the noisy-or of its sentences, 1 - prod(1 - p), so its label
alone trains the sentences and a high score comes with the sentences that cause it.  The base is
a leak that any sentence has; scoring divides it out, 1 - prod(min(1, (1 - p) / (1 - p0))), so
sentences without weight add nothing, however many there are.  With ``unseen`` a text in which no feature speaks keeps a small
chance of a toxic sentence that none tells, which grows with its sentences but never beyond ``UNSEEN``, far below the threshold:
it ranks these texts and decides nothing.

Fitting: candidate features are those with the clearest difference in document frequency over
a bounded labelled sample (counted by the executors); gradient ascent on the noisy-or likelihood
then learns weights, from documents reduced to the candidates in each sentence.

Defined results: null or empty texts have no sentence and score 0; whole texts count, whatever
their length; repeated rows score alike; without labels of both classes there are no features
and texts score 0; an empty table gives an empty one.  Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ODD, Block, in_blocks
from .labelled import class_weights

THRESHOLD = 0.3
#: The chance that a text of very many sentences holds one that no feature tells, and the sentences at which it is half of that: scores below it are ranked by it.
UNSEEN, HALF = 0.01, 50
CUTS = (None, 3, 4, 5, 6, 7, 8)
_TRIM = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()[]{}*#$%&|-", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))


def _trimmed(block: Block) -> None:
    """Strip up to three marks from either end of every word; words of marks alone stay."""
    at, end, b = block.word_at.copy(), block.word_end.copy(), block.bytes
    for _ in range(3):
        end -= _TRIM[b[end - 1]] & (end - at > 1)
        at += _TRIM[b[at]] & (end - at > 1)
    block.word_at, block.word_end = at, end


def _sentences(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each word its sentence, counted through the block, and for each sentence its text."""
    b = block.bytes
    stops = np.r_[0, np.cumsum(_STOP[b], dtype=np.int64)]
    mark = stops[block.word_at]  # a line feed ends every text, so no number crosses texts
    number, first = np.zeros(len(mark), np.int64), np.zeros(0, np.int64)
    if len(mark):
        new = np.r_[True, mark[1:] != mark[:-1]]
        number, first = np.cumsum(new) - 1, np.flatnonzero(new)
    return number, block.word_text[first]


@dataclass
class Model:
    """Sorted hashes of features, their weights, and the base log-odds of a sentence."""

    keys: np.ndarray
    weights: np.ndarray
    base: float

    def __post_init__(self) -> None:
        #: One bit per slot, so that words without weight cost one look-up.
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def word_weights(self, block: Block) -> np.ndarray:
        out = np.zeros(len(block.word_at))
        if not len(self.keys):
            return out
        for h in block.hashes(*CUTS):
            maybe = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            hit = self.keys[slot] == h[maybe]
            out[maybe[hit]] += self.weights[slot[hit]]
        return out

    def sentences(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sentence of the block its text, its first word and its probability."""
        _trimmed(block)
        number, owner = _sentences(block)
        odds = self.base + np.bincount(number, self.word_weights(block), len(owner))
        return owner, np.searchsorted(number, np.arange(len(owner))), (1 / (1 + np.exp(-odds)) if len(self.keys) else np.zeros(len(owner)))

    def score(self, block: Block, unseen: bool = False) -> np.ndarray:
        owner, _, p = self.sentences(block)
        leak = np.log1p(-1 / (1 + np.exp(-self.base)))
        told = 1 - np.exp(np.bincount(owner, np.minimum(np.log1p(-np.minimum(p, 1 - 1e-12)) - leak, 0), block.texts))
        if not (unseen and len(self.keys)):
            return told
        n = np.bincount(owner, minlength=block.texts)
        return np.maximum(told, UNSEEN * n / (n + HALF))


def _count_features(docs: DataFrame) -> DataFrame:
    """For features of labelled texts (text, label): documents with and without the label that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in in_blocks(batches, 0, lower=True):
            label = part.column(1).to_numpy(zero_copy_only=False)
            _trimmed(block)
            keys, toxic = [], []
            for h in block.hashes(*CUTS):
                _, first = np.unique(h ^ block.word_text.astype(np.uint64) * ODD, return_index=True)
                first = first[h[first] != 0]
                keys.append(h[first])
                toxic.append(label[block.word_text[first]])
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            ones = np.bincount(at, np.concatenate(toxic), len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ones), pa.array(np.bincount(at, minlength=len(key)) - ones)], ["key", "ones", "zeros"])

    return docs.mapInArrow(run, "key long, ones long, zeros long").groupBy("key").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def _bags(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """For labelled texts the candidate features of each sentence that has any: sentence numbers and features side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in in_blocks(batches, 0, lower=True):
            _trimmed(block)
            number, owner = _sentences(block)
            word, feature = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for h in block.hashes(*CUTS):
                slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[slot] == h)
                word.append(hit)
                feature.append(slot[hit])
            word, feature = np.concatenate(word), np.concatenate(feature)
            sentence = number[word]
            order = np.argsort(sentence, kind="stable")
            sentence, feature = sentence[order], feature[order]
            ends = np.searchsorted(owner[sentence], np.arange(block.texts + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (sentence, feature)]
            yield pa.RecordBatch.from_arrays([*lists, pa.array(np.bincount(owner, minlength=block.texts), pa.int32()), part.column(1)], ["sentences", "features", "n", "label"])

    return docs.mapInArrow(run, "sentences array<int>, features array<int>, n int, label int")


def fit(bags: list[tuple[np.ndarray, np.ndarray, int, int]], keys: np.ndarray, steps: int = 400, rate: float = 1.0, ridge: float = 1e-5, base: float = -9.0, weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Weights by gradient ascent (with per-weight step sizes) on the likelihood of the documents' labels; ``weights`` are those of a document of label 0 and of label 1."""
    y = np.array([b[3] for b in bags], float)
    if not len(keys) or len(y) == 0 or y.min() == y.max():
        return Model(keys[:0], np.zeros(0), base)
    doc, sent, feat, bare = [], [], [], np.zeros(len(bags))
    total = 0
    for d, (s, f, n, _) in enumerate(bags):
        _, local = np.unique(s, return_inverse=True)
        k = int(local.max()) + 1 if len(local) else 0
        sent.append(local + total)
        feat.append(f)
        doc.append(np.full(k, d))
        bare[d] = n - k
        total += k
    doc, sent, feat = (np.concatenate(x).astype(np.int64) for x in (doc, sent, feat))
    weight = np.where(y == 1, weights[1], weights[0])
    weight = weight / weight.mean()
    w, b = np.zeros(len(keys)), base
    seen, first, second, b1, b2 = len(y), np.zeros(len(keys) + 1), np.zeros(len(keys) + 1), 0.9, 0.99
    for t in range(1, steps + 1):
        odds = b + np.bincount(sent, w[feat], total)
        p = np.clip(1 / (1 + np.exp(-odds)), 1e-9, 1 - 1e-9)
        p0 = 1 / (1 + np.exp(-b))
        none = np.exp(np.bincount(doc, np.log1p(-p), len(y)) + bare * np.log1p(-p0))
        # of log-likelihood by each sentence's log-odds: p for label 1 weighed by none / (1 - none), -p for label 0
        pull = np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0)
        slope = (weight * pull)[doc] * p
        g = np.r_[np.bincount(feat, slope[sent], len(keys)) / seen - ridge * w, 0.0]
        first, second = b1 * first + (1 - b1) * g, b2 * second + (1 - b2) * g * g
        move = rate * (first / (1 - b1**t)) / (np.sqrt(second / (1 - b2**t)) + 1e-8) / np.sqrt(t)
        w += move[:-1]
    kept = np.abs(w) > 0.05
    return Model(keys[kept], w[kept], b)


def train(docs: DataFrame, sample: DataFrame, most_features: int = 4096, least_docs: int = 4) -> Model:
    """Fit on the texts of a bounded sample (doc_id, label), its classes weighed by ``class_weights``; counts and reduced documents reach the driver, both bounded by the parameters."""
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label")
    weights = class_weights(sample)
    gain = (F.col("ones") - 0.5) / (F.col("zeros") * (weights[0] / weights[1]) + 1.0)
    found = _count_features(labelled).where(F.col("ones") >= least_docs).withColumn("gain", gain * F.sqrt("ones")).where(gain > 1.0)
    keys = np.sort(np.array([r["key"] for r in found.orderBy(F.desc("gain"), "key").limit(most_features).collect()], np.int64).view(np.uint64))
    if not len(keys):
        return Model(keys, np.zeros(0), -9.0)
    # Arrow columns, not rows of Python lists: a few bytes per feature occurrence on the driver
    table = _bags(labelled, keys).toArrow().combine_chunks()
    sentences, features = (table[c].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("sentences", "features"))
    ends = np.array(sentences.offsets)
    flat = np.array(sentences.flatten()), np.array(features.flatten())
    ends = ends - ends[0]
    rows = [(flat[0][a:b], flat[1][a:b], n, label) for a, b, n, label in zip(ends, ends[1:], table["n"].to_pylist(), table["label"].to_pylist())]
    rows.sort(key=lambda r: (r[3], r[2], r[0].tobytes(), r[1].tobytes()))
    return fit(rows, keys, weights=weights)


def score(docs: DataFrame, model: Model, key: str = "doc_id", unseen: bool = False) -> DataFrame:
    """``key``, score (0 to 1) for every row; narrow, one pass over the texts."""
    rows = docs.select(key, "text")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in in_blocks(batches, 1, lower=True):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(block, unseen))], [key, "score"])

    return rows.mapInArrow(run, f"`{key}` {kind}, score double")


def offending(docs: DataFrame, model: Model, threshold: float = THRESHOLD, key: str = "doc_id") -> DataFrame:
    """The sentences that score ``threshold`` or more: key, sentence (its number in the text, from 0), score, words (lower-case, marks trimmed)."""
    rows = docs.select(key, "text")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in in_blocks(batches, 1, lower=True):
            owner, first, p = model.sentences(block)
            hit = np.flatnonzero(p >= threshold)
            number = hit - np.searchsorted(owner, owner[hit])
            to = np.r_[first, len(block.word_at)]
            words = [b" ".join(block.bytes[block.word_at[w] : block.word_end[w]].tobytes() for w in range(to[s], to[s + 1])).decode("utf-8", "replace") for s in hit]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[hit])), pa.array(number, pa.int32()), pa.array(p[hit]), pa.array(words, pa.string())], [key, "sentence", "score", "words"])

    return rows.mapInArrow(run, f"`{key}` {kind}, sentence int, score double, words string")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below ``threshold``."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in in_blocks(batches, where, lower=True):
            yield part.filter(pa.array(model.score(block) < threshold))

    return docs.mapInArrow(run, docs.schema)
