"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit scans, exact reranking.

Vectors are coded by products of 16-entry codebooks, one four-bit code per pair of dimensions.
Codes and codebooks minimise a weighted error: the part of the residual parallel to the vector
counts more than the rest, since that part changes the largest inner products.  Codebooks are fitted
on a bounded sample by turns of coordinate descent over codes and weighted least squares over
entries; every row is then coded.

A search adds table entries: two codes form a byte, so a query has one 256-entry table per
pair of codes.  Euclidean nearness is the largest q.x - x.x / 2, with x.x kept exactly.  Scans read codes
only; each query's best ``rerank`` rows of the whole table by that estimate are then measured
exactly, in double precision, on the original vectors, and the k nearest of them are the result.

Blocks hold a random share of the rows (see ``vectors.search``), so of a query's best ``rerank`` a block
of share p has a binomial number: each block hands on six standard deviations and 16 rows more
than it expects, and the chance that one of the best is lost there is below 1e-8.

Defined results: see ``vectors.usable`` (zero vectors take no part); rows with the same id as a
query are not among its candidates; repeated rows are candidates each; equal distances go to smaller ids;
fewer candidates than k are all returned; an empty table gives no rows.  Shorter vectors are filled up with zeros.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import SLICE, best_rows, block_count, local_best, matrix, same_width, search, usable

ENTRIES = 16


@dataclass
class Codebooks:
    """Entries [part, code, dimension of part]; ``parallel``: how much more a parallel error counts."""

    entries: np.ndarray
    parallel: float

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def parts(self, x: np.ndarray) -> np.ndarray:
        x = same_width(x, np.zeros((0, self.width)))[0][:, : self.width]
        return x.reshape(len(x), self.entries.shape[0], self.entries.shape[2])

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes [row, part] by coordinate descent on the anisotropic error, from the nearest entries."""
        p = self.parts(x)
        unit = p / np.maximum(np.sqrt((p * p).sum((1, 2)))[:, None, None], 1e-30)
        away = ((p[:, :, None, :] - self.entries[None]) ** 2).sum(3)
        along = ((p[:, :, None, :] - self.entries[None]) * unit[:, :, None, :]).sum(3)
        codes = away.argmin(2)
        rows = np.arange(len(p))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for m in range(p.shape[1]):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (away[:, m] + (self.parallel - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                total = rest + along[rows, m, codes[:, m]]
        return codes

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte of two codes the inner product with the entries they name."""
        one = np.einsum("qmd,mcd->qmc", self.parts(q), self.entries)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros((len(q), 1, ENTRIES))], 1)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, ENTRIES * ENTRIES).astype(np.float32)


def packed_codes(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], 1)
    return (codes[:, 0::2] * ENTRIES + codes[:, 1::2]).astype(np.uint8)


def fit(x: np.ndarray, part: int = 2, parallel: float = 4.0, rounds: int = 3, seed: int = 7) -> Codebooks:
    """Codebooks for these vectors."""
    rng = np.random.default_rng(seed)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % part)))
    p = x.reshape(len(x), -1, part)
    entries = np.stack([p[rng.choice(len(p), ENTRIES, replace=len(p) < ENTRIES), m] for m in range(p.shape[1])])
    for _ in range(6):  # plain means to begin with
        codes = ((p[:, :, None, :] - entries[None]) ** 2).sum(3).argmin(2)
        for m in range(p.shape[1]):
            sums = np.stack([np.bincount(codes[:, m], p[:, m, d], ENTRIES) for d in range(part)], 1)
            n = np.bincount(codes[:, m], minlength=ENTRIES)
            entries[m] = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], entries[m])
    books = Codebooks(entries, parallel)
    unit = x / np.maximum(np.sqrt((x * x).sum(1))[:, None], 1e-30)
    size = entries.size
    for _ in range(rounds):
        codes = books.encode(x)
        # normal equations: each row selects one entry per part, its error weighed by I + (parallel - 1) u u'
        at = ((np.arange(p.shape[1]) * ENTRIES + codes)[:, :, None] * part + np.arange(part)).reshape(len(x), -1)
        normal, right = np.zeros((size, size)), np.zeros(size)
        for a in range(0, len(x), 1024):
            spread = np.zeros((len(x[a : a + 1024]), size))
            np.put_along_axis(spread, at[a : a + 1024], unit[a : a + 1024], 1)
            normal += (parallel - 1) * spread.T @ spread
            right += (parallel - 1) * spread.T @ (unit[a : a + 1024] * x[a : a + 1024]).sum(1)
        normal[np.diag_indices(size)] += np.bincount(at.ravel(), minlength=size) + 1e-6
        right += np.bincount(at.ravel(), x.ravel(), size) + 1e-6 * entries.ravel()
        entries = np.linalg.solve(normal, right).reshape(entries.shape)
        books = Codebooks(entries, parallel)
    return books


def build(data: DataFrame, books: Codebooks) -> DataFrame:
    """The index: id, ``half`` of the squared length and ``codes`` (two to a byte) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = matrix(part.column(1))
                codes = packed_codes(books.encode(x))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((x * x).sum(1) / 2), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "half", "codes"])

    return materialise(data.mapInArrow(run, "id long, half double, codes binary"), "ann_index")


def best_in_block(query_ids: np.ndarray, q: np.ndarray, vec_ids: np.ndarray, half: np.ndarray, codes: np.ndarray, books: Codebooks, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``most`` best estimates of a block (query id, vec id, estimate), equal ones with smaller ids first."""
    tables = books.tables(q)
    reached = np.full(len(q), -np.inf)
    top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for low in range(0, len(vec_ids), SLICE):
        part = slice(low, low + SLICE)
        estimate = np.zeros((len(q), len(vec_ids[part])), np.float32)
        for b in range(codes.shape[1]):
            estimate += tables[:, b][:, codes[part, b]]
        estimate = estimate - half[part]
        estimate[query_ids[:, None] == vec_ids[None, part]] = -np.inf
        if estimate.shape[1] > most:  # what the slice alone rules out
            np.maximum(reached, -np.partition(-estimate, most - 1, axis=1)[:, most - 1], out=reached)
        r, c = np.nonzero((estimate >= reached[:, None]) & (estimate > -np.inf))
        top = local_best(np.r_[top[0], r], np.r_[top[1], vec_ids[part][c]], np.r_[top[2], estimate[r, c]], most)
        first = np.searchsorted(top[0], np.arange(len(q)))
        full = np.searchsorted(top[0], np.arange(len(q)), side="right") - first >= most
        reached[full] = np.maximum(reached[full], top[2][first[full] + most - 1])
    return query_ids[top[0]], top[1], top[2]


def measure(pairs: DataFrame, data: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, vec_id and the exact distance of each pair, for all rows that have its vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, x = same_width(matrix(batch.column(2)), matrix(batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(((x - q) ** 2).sum(1)))], ["query_id", "vec_id", "score"])

    with_x = pairs.select("query_id", "vec_id").distinct().join(data.select(F.col("id").alias("vec_id"), F.col("v").alias("x")), "vec_id")
    both = with_x.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return both.select("query_id", "vec_id", "q", "x").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(embeddings: DataFrame, queries: Column, k: int = 10, sample_rows: int = 8192, rerank: int = 512, id_: str = "vec_id", vector: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (the Euclidean distance) of the k nearest found per query; ``queries`` says of ``id`` which rows ask.

    ``sample_rows`` bounds the rows, chosen by hash, that the codebooks are fitted on; ``rerank`` is a query's budget of exact distances.
    """
    data = usable(embeddings, id_, vector, zero_counts=False)
    sample = data.orderBy(F.xxhash64("id", F.lit(23)), "id").limit(sample_rows).select("id", "v").toArrow()
    x = matrix(sample["v"]) if sample.num_rows else np.zeros((0, 0))
    books = fit(x) if x.size else Codebooks(np.zeros((1, ENTRIES, 2)), 4.0)
    index = build(data, books)
    asked = data.where(queries)
    n, blocks = block_count(index, 16 + books.entries.shape[0] // 2, block_rows)
    budget = max(rerank, k)
    mean = budget / blocks
    most = min(budget, int(np.ceil(mean + 6 * np.sqrt(mean))) + 16) if blocks > 1 else budget

    def ready(held: pa.Table):
        codes = np.frombuffer(b"".join(held["codes"].to_pylist()), np.uint8).reshape(held.num_rows, -1)
        ids, half = held["id"].to_numpy(), held["half"].to_numpy()
        return lambda asked: best_in_block(asked["id"].to_numpy(), matrix(asked["v"]), ids, half, codes, books, most)

    found = search(asked, index, ready, blocks, budget, True, "double")
    return best_rows(measure(found, data, asked), k, False)
