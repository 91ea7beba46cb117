"""Hard negatives by product quantisation with stored residual norms.

Vectors are rounded to integers, floor(scale * x), and scores are their inner products.  The index
holds for each row one byte for each pair of components, the entry of that pair's codebook nearest to it, and
the norm of what the entries leave.  A query adds up table entries to an estimate, and
|q . (x - entries)| <= |q| |x - entries| bounds how far off that is, so that every score lies
within estimate -/+ bound (widened for rounding).

Positives are an anchor's best rows of its own label.  Each positive opens a window of scores,
``low`` to ``high`` percent of its own, from which the best rows of other labels are wanted.
Both searches read codes first: a few rows with promising estimates are multiplied exactly and give
a floor, the score that as many rows as are wanted are known to reach; then all rows whose bounds let
them reach the floor and lie inside the window are multiplied, in integers, and the best are kept.
Floors rise from slice to slice.  No row whose bounds allow it is left out, so results are exact
whatever the codebooks, which are fitted on a bounded sample.

Defined results: rows with a null id or label, or whose vector is null or has null or non-finite
components, take no part (zero and empty vectors do; shorter ones are filled up with zeros); rows with
an anchor's own id are not among its candidates; repeated rows are candidates each, but an anchor id is
one anchor (of several rows that with the smallest label and vector); equal scores go to smaller ids;
fewer candidates than wanted are all returned; an anchor without positives, or a positive whose window is
empty, gives no rows, and so does an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .pivots import pair_scores, quantised
from .vectors import SLICE, block_count, grid, local_best, matrix, same_width, search, usable

ENTRIES = 256
#: Pairs of a slice whose estimates make them the first to be multiplied, for each row wanted.
FIRST = 4


class Codebooks:
    """Entries [part, code, 2]: for each pair of components those that the sample's pairs lie near."""

    def __init__(self, sample: np.ndarray, rounds: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        pairs = self._pairs(sample, sample.shape[1] + sample.shape[1] % 2)
        self.entries = np.zeros((pairs.shape[1], ENTRIES, 2))
        for m in range(pairs.shape[1] if len(pairs) else 0):
            p = pairs[:, m]
            entries = p[rng.choice(len(p), ENTRIES, replace=len(p) < ENTRIES)]
            for _ in range(rounds):
                code = self._nearest(p, entries)
                n = np.bincount(code, minlength=ENTRIES)
                sums = np.stack([np.bincount(code, p[:, d], ENTRIES) for d in (0, 1)], 1)
                entries = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], entries)
            self.entries[m] = entries

    @staticmethod
    def _pairs(x: np.ndarray, width: int) -> np.ndarray:
        return same_width(x, np.zeros((0, width)))[0][:, :width].reshape(len(x), width // 2, 2)

    @staticmethod
    def _nearest(p: np.ndarray, entries: np.ndarray) -> np.ndarray:
        return ((entries * entries).sum(1) - 2 * (p @ entries.T)).argmin(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes [row, part] and the norms of what they leave, components beyond the codebooks' width included."""
        pairs = self._pairs(x, 2 * len(self.entries))
        codes = np.empty(pairs.shape[:2], np.uint8)
        rest = (x * x).sum(1) - (pairs * pairs).sum((1, 2)) if x.shape[1] > 2 * len(self.entries) else np.zeros(len(x))
        for m, entries in enumerate(self.entries):
            codes[:, m] = self._nearest(pairs[:, m], entries)
            rest += ((pairs[:, m] - entries[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(np.maximum(rest, 0))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query, part and code the inner product with the entry."""
        return np.einsum("qmd,mcd->mqc", self._pairs(q, 2 * len(self.entries)), self.entries)


class Scan:
    """A block: its ids, labels, integer vectors, codes and residual norms; and the products made, for tests."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, codes: np.ndarray, rest: np.ndarray, books: Codebooks, count: list[int] | None = None):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.x, self.codes, self.rest = ids[order], labels[order], x[order], np.ascontiguousarray(codes[order].T), rest[order]
        self.books, self.count = books, count

    def ask(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of queries their tables, norms, and what rounding can make at most."""
        tables = self.books.tables(q)
        size = np.sqrt((q * q).sum(1))
        rounding = 1e-12 * (np.abs(tables).max(2, initial=0).sum(0) + size * np.sqrt((self.x * self.x).sum(1).max(initial=0))) + 1e-6
        return tables, size, rounding

    def estimate(self, tables: np.ndarray, part: slice) -> np.ndarray:
        out = np.zeros((tables.shape[1], len(self.ids[part])))
        for table, code in zip(tables, self.codes[:, part]):
            out += table[:, code]
        return out

    def products(self, q: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.count is not None:
            self.count.append(len(r))
        return pair_scores(*same_width(q, self.x), r, c)

    def slices(self, begin: int, end: int) -> Iterator[slice]:
        return (slice(at, min(at + SLICE, end)) for at in range(begin, end, SLICE))

    def best(self, wanted: int, query_ids: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, begin: int, end: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``wanted`` best rows from begin to end in each window [query, window] of scores low to high: window number, vector id, score.

        ``without``: for each query the label whose rows don't count.
        """
        tables, size, rounding = self.ask(q)
        windows = low.shape[1]
        floor = low.copy()
        top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def keep(r: np.ndarray, c: np.ndarray) -> None:
            nonlocal top
            s = self.products(q, r, c)
            for w in range(windows):
                fits = (s >= floor[r, w]) & (s <= high[r, w])
                top = tuple(np.r_[a, b] for a, b in zip(top, (r[fits] * windows + w, self.ids[c[fits]], s[fits])))
            top = local_best(*top, wanted)
            first = np.searchsorted(top[0], np.arange(low.size))
            full = np.searchsorted(top[0], np.arange(low.size), side="right") - first >= wanted
            flat = floor.reshape(-1)
            flat[full] = np.maximum(flat[full], top[2][first[full] + wanted - 1])

        for part in self.slices(begin, end):
            estimate = self.estimate(tables, part)
            off = size[:, None] * self.rest[part] * (1 + 1e-9) + rounding[:, None]
            counts = query_ids[:, None] != self.ids[None, part]
            if without is not None:
                counts &= without[:, None] != self.labels[None, part]
            done = np.zeros(estimate.shape, bool)
            few = min(FIRST * wanted, estimate.shape[1])
            for w in range(windows):  # those that seem best inside the window make the floor
                inside = np.where(counts & (estimate >= floor[:, w, None]) & (estimate <= high[:, w, None]), estimate, -np.inf)
                c = np.argpartition(-inside, few - 1, axis=1)[:, :few]
                r = np.repeat(np.arange(len(q)), few)
                c = c.ravel()
                ok = inside[r, c] > -np.inf
                done[r[ok], c[ok]] = True
            keep(*self._at(done, part))
            open_ = np.zeros(estimate.shape, bool)
            for w in range(windows):
                open_ |= (estimate + off >= floor[:, w, None]) & (estimate - off <= high[:, w, None])
            keep(*self._at(open_ & counts & ~done, part))
        return top

    @staticmethod
    def _at(which: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        r, c = np.nonzero(which)
        return r, c + part.start

    def positives(self, query_ids: np.ndarray, q: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's k best rows of its own label."""
        made = []
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            begin, end = np.searchsorted(self.labels, label), np.searchsorted(self.labels, label, side="right")
            any_ = np.full((len(own), 1), 1 << 62)
            w, vec, s = self.best(k, query_ids[own], q[own], -any_, any_, begin, end)
            made.append((query_ids[own][w], vec, s))
        return tuple(np.concatenate(z) for z in zip(*made)) if made else (np.zeros(0, np.int64),) * 3


def mine(embeddings: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, sample_rows: int = 8192, id_: str = "vec_id", label: str = "label", vector: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    ``anchors`` says of ``id`` which rows are anchors; ``low`` and ``high`` are percents of a positive's score between
    which (both included) a negative's score lies.  ``sample_rows`` bounds the rows, chosen by hash, that the codebooks are fitted on.
    """
    data = usable(embeddings, id_, vector, True, label=F.col(label).cast("long")).where("label IS NOT NULL")
    sample = data.orderBy(F.xxhash64("id", F.lit(29)), "id").limit(sample_rows).select("v").toArrow()
    books = Codebooks(quantised(matrix(sample["v"]), scale))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                codes, rest = books.encode(quantised(matrix(part.column(1)), scale))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)], ["id", "v", "label", "codes", "rest"])

    index = materialise(data.select("id", "v", "label").mapInArrow(coded, "id long, v array<double>, label long, codes binary, rest double"), "negatives_index")
    asked = index.where(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")
    width = 2 * len(books.entries)
    _, blocks = block_count(index, 8 * width + width // 2 + 32, block_rows)

    def scan(held: pa.Table) -> Scan:
        codes = np.frombuffer(b"".join(held["codes"].to_pylist()), np.uint8).reshape(held.num_rows, -1)
        return Scan(held["id"].to_numpy(), held["label"].to_numpy(), quantised(matrix(held["v"]), scale), codes, held["rest"].to_numpy(), books)

    def nearest(held: pa.Table):
        block = scan(held)
        return lambda asked: block.positives(asked["id"].to_numpy(), quantised(matrix(asked["v"]), scale), asked["label"].to_numpy(), positives)

    found = materialise(search(asked, index, nearest, blocks, positives, True, "long"), "positives")
    ordered = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    windows = asked.join(ordered, F.col("id") == F.col("query_id")).select("id", "label", "v", "p.vec_id", "p.score")

    def inside(held: pa.Table):
        block = scan(held)

        def answer(asked: pa.Table) -> tuple[np.ndarray, ...]:
            ids, (lows, highs) = asked["id"].to_numpy(), edges(asked["score"].to_pylist(), positives, low, high)
            w, vec, s = block.best(negatives, ids, quantised(matrix(asked["v"]), scale), lows, highs, 0, len(block.ids), asked["label"].to_numpy())
            return ids[w // positives], w % positives + 1, vec, s

        return answer

    schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_rank", "negative_id", "negative_score")])
    made = grid(windows, index, inside, blocks, schema)
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("negative_score"), "negative_id"))
    named = found.select(F.col("query_id").alias("anchor_id"), F.col("rank").cast("long").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return made.withColumn("rank", place).where(F.col("rank") <= negatives).join(named, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def edges(scores: list[list[int]], width: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows [row, positive] of whole scores s with low * p <= 100 * s <= high * p; none inside where there is no positive."""
    lows, highs = np.ones((len(scores), width), np.int64), np.zeros((len(scores), width), np.int64)
    for i, row in enumerate(scores):
        lows[i, : len(row)] = [-(-low * p // 100) for p in row]
        highs[i, : len(row)] = [high * p // 100 for p in row]
    return lows, highs
