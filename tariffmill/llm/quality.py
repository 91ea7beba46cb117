"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gets numeric features; each feature has a lookup table over its bins, and chosen pairs
of features have tables over pairs of coarser bins.  Tables are learnt by cyclic boosting: one
shallow tree on one feature at a time, in turn, with a small step, so no feature takes what
another explains; then the same for the pairs with the largest remaining gain.  Scoring adds
table entries: log-odds = base + sum of table[bin].

Defined results: null and empty texts have all features 0 and are scored as such; texts of any
length are used whole; repeated rows score alike; without labels of both classes every score
is the smoothed share of label 1 (0.5 without any); an empty table gives an empty one.  Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, in_blocks
from .labelled import class_weights

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "points", "symbols", "bangs", "bars", "non_ascii", "lines_per_word",
    "same_as_last", "distinct", "capital_words", "symbol_words", "ends_in_point", "long_words", "words_per_sentence", "most_common",
)
_SET = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in (("digits", b"0123456789"), ("points", b".,;:!?'\"()-"), ("symbols", b"#$%&*@\\^_|~<>{}[]=+/`"), ("bangs", b"!"), ("bars", b"|"), ("stops", b".!?"))}
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)


def features(block: Block) -> np.ndarray:
    """One row of FEATURES for each text, all finite."""
    b, n = block.bytes, np.maximum(block.ends - block.begins - 1, 0)
    words = np.diff(block.text_words)
    per_byte, per_word = np.maximum(n, 1), np.maximum(words, 1)
    out = {"log_bytes": np.log1p(n), "log_words": np.log1p(words), "word_length": block.word_sums(block.word_end - block.word_at) / per_word, "upper": block.sums(_UPPER[b]) / per_byte, "non_ascii": block.sums(b >= 0xC0) / per_byte}
    for name in ("digits", "points", "symbols", "bangs", "bars"):
        out[name] = block.sums(_SET[name][b]) / per_byte
    out["lines_per_word"] = np.minimum((block.sums(b == 10) - 1) / per_word, 4)
    out["words_per_sentence"] = np.log1p(words / np.maximum(block.sums(_SET["stops"][b]), 1))
    (h,) = block.hashes(None)
    first, last = b[block.word_at], b[block.word_end - 1]
    again = np.r_[False, (h[1:] == h[:-1]) & (block.word_text[1:] == block.word_text[:-1])] if len(h) else np.zeros(0, bool)
    out |= {"same_as_last": block.word_sums(again) / per_word, "capital_words": block.word_sums(_UPPER[first]) / per_word, "symbol_words": block.word_sums(_SET["symbols"][last]) / per_word, "ends_in_point": block.word_sums(_SET["points"][last]) / per_word, "long_words": block.word_sums(block.word_end - block.word_at > 14) / per_word}
    both = h ^ block.word_text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(both)
    both = both[order]
    begin = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
    owner = block.word_text[order[begin]] if len(begin) else begin
    out["distinct"] = np.bincount(owner, minlength=block.texts) / per_word
    most = np.zeros(block.texts)
    np.maximum.at(most, owner, np.diff(np.r_[begin, len(both)]))
    out["most_common"] = most / per_word
    return np.column_stack([out[f] for f in FEATURES]).astype(np.float64)


@dataclass
class Gam:
    """Edges, tables and pair tables; fit with ``fit``, scored with ``score``."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        odds = np.full(len(x), self.base)
        for k, (edge, table) in enumerate(zip(self.edges, self.tables)):
            odds += table[np.searchsorted(edge, x[:, k], side="right")]
        coarse = {k: np.searchsorted(self.coarse[k], x[:, k], side="right") for k in {k for p in self.pairs for k in p}}
        for (i, j), table in self.pairs.items():
            odds += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-odds))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Bounds of about equally full bins, halfway between values that occur, so that rounding in a feature's last digit moves no row."""
    values = np.unique(x)
    at = np.searchsorted(values, np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")))
    at = at[at > 0]
    return (values[at - 1] + values[at]) / 2


def _leaves(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A tree on one binned feature: splits the range that gains most until there are so many leaves; Newton steps at the leaves."""
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    def split(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        at = at[(h[at] - h[a] >= least) & (h[b] - h[at] >= least)]
        if not len(at):
            return 0.0, a
        gain = value(a, at) + value(at, b) - value(a, b)
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    ranges = [(0, len(grad))]
    while len(ranges) < leaves:
        gain, at, k = max((*split(*r), k) for k, r in enumerate(ranges))
        if gain <= 1e-9:
            break
        a, b = ranges.pop(k)
        ranges += [(a, at), (at, b)]
    out = np.zeros(len(grad))
    for a, b in ranges:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.15, leaves: int = 4, weights: tuple[float, float] = (1.0, 1.0)) -> Gam:
    """Learn tables from features and 0/1 labels; ``weights`` are those of a row of label 0 and of label 1."""
    weight = np.where(y == 1, weights[1], weights[0])
    weight = weight / weight.mean() if len(y) else weight  # so that the smoothing is that of as many rows
    share = ((weight * y).sum() + 0.5) / (len(y) + 1)
    out = Gam(base=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return out
    columns = range(x.shape[1])
    out.edges, out.coarse = [_edges(x[:, k], bins) for k in columns], [_edges(x[:, k], coarse_bins) for k in columns]
    binned = [np.searchsorted(out.edges[k], x[:, k], side="right") for k in columns]
    out.tables = [np.zeros(len(e) + 1) for e in out.edges]
    odds = np.full(len(y), out.base)
    for _ in range(rounds):
        for k in columns:
            p = 1 / (1 + np.exp(-odds))
            n = len(out.tables[k])
            step = rate * _leaves(np.bincount(binned[k], weight * (y - p), n), np.bincount(binned[k], weight * p * (1 - p), n), leaves, 1e-3)
            out.tables[k] += step
            odds += step[binned[k]]
    rough = [np.searchsorted(out.coarse[k], x[:, k], side="right") for k in columns]
    size = [len(e) + 1 for e in out.coarse]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, at = 1 / (1 + np.exp(-odds)), rough[i] * size[j] + rough[j]
        return np.bincount(at, weight * (y - p), size[i] * size[j]), np.bincount(at, weight * p * (1 - p), size[i] * size[j]), at

    gains = []
    for i in columns:
        for j in range(i):
            g, h, _ = cells(i, j)
            gains.append((float((g * g / (h + 1.0)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    out.pairs = {p: np.zeros((size[p[0]], size[p[1]])) for p in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h, at = cells(i, j)
            step = rate * g / (h + 1.0)
            out.pairs[i, j] += step.reshape(size[i], size[j])
            odds += step[at]
    return out


def train(docs: DataFrame, sample: DataFrame, **options: int | float) -> Gam:
    """Fit on the texts of a bounded sample (doc_id, label), its classes weighed by ``class_weights``; only the features of the sample reach the driver."""
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in in_blocks(batches, 0):
            x = features(block).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32())), part.column(1)], ["x", "label"])

    rows = labelled.mapInArrow(run, "x array<float>, label int").toArrow()
    x = np.array(rows["x"].combine_chunks().flatten(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, np.array(rows["label"])))  # the order rows arrive in doesn't matter
    return fit(x[order], np.array(rows["label"], np.float64)[order], weights=class_weights(sample), **options)


def score(docs: DataFrame, model: Gam, key: str = "doc_id") -> DataFrame:
    """``key``, score (0 to 1) for every row; narrow, one pass over the texts."""
    rows = docs.select(key, "text")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in in_blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(features(block).astype(np.float32).astype(np.float64)))], [key, "score"])

    return rows.mapInArrow(run, f"`{key}` {kind}, score double")


def keep(docs: DataFrame, model: Gam, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in in_blocks(batches, where):
            yield part.filter(pa.array(model.score(features(block).astype(np.float32).astype(np.float64)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
