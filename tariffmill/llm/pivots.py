"""Exact top-k inner products of integer vectors by pivot-table elimination.

Distances to the pivots are computed once for every vector and query, and a lower bound on the
distance d(q, x) follows from them.  By the triangle inequality each pivot p gives
|d(q, p) - d(x, p)|.  All together give more: with a first pivot in the middle of a sample and the
others a step t from it along its principal directions, the distances fix a vector's
coordinates, y_j = (d_0**2 + t**2 - d_j**2) / 2t, and what is left of d_0, so that the
distance of these places is a bound too, never below any single pivot's.  As
2 q.x = q.q + x.x - d(q, x)**2, it is an upper bound on the score.

A query starts with the k-th best score among a bounded sample of rows as its floor, since that many rows reach it;
the floor rises from slice to slice of a block.  Candidates whose bound is below it are never
multiplied; the others are in the order of their bounds, in growing steps, until the next
bound is below the k-th best so far (an equal one goes on, for ties).  Each pair is multiplied once at most.

Scores are exact: integer products are summed in doubles only where these hold them exactly,
else in 64-bit integers.  Defined results: see ``vectors.usable``; components are
floor(scale * x); shorter vectors are filled up with zeros; equal scores go to smaller ids;
rows with the same id as a query are not among its candidates; repeated rows are candidates each;
fewer candidates than k are all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import SLICE, block_count, local_best, matrix, same_width, search, usable

#: Pairs whose vectors are gathered for their products at once.
PAIRS = 1 << 14


def quantised(v: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * v)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q with all of x, as 64-bit integers."""
    top = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def pair_scores(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows r of q with the rows c of x, pair by pair, as 64-bit integers."""
    top = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if top >= 2**53:
        q, x = q.astype(np.int64), x.astype(np.int64)
    out = np.empty(len(r), np.int64)
    for at in range(0, len(r), PAIRS):
        out[at : at + PAIRS] = np.einsum("ij,ij->i", q[r[at : at + PAIRS]], x[c[at : at + PAIRS]])
    return out


class Pivots:
    """A first pivot and others a step from it along the principal directions of a sample."""

    def __init__(self, sample: np.ndarray, most: int):
        self.first = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
        middle = sample - self.first
        self.step = max(float(np.sqrt((middle * middle).sum(1).mean())) if len(sample) else 0.0, float(np.sqrt(self.first @ self.first)), 1.0)
        _, size, directions = np.linalg.svd(middle, full_matrices=False) if middle.size else (0, np.zeros(0), np.zeros((0, sample.shape[1])))
        self.others = self.step * directions[: max(most - 1, 0)][size[: max(most - 1, 0)] > 1e-9 * self.step]

    def table(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the first pivot and the others."""
        x, first = same_width(x, self.first[None])
        middle, others = same_width(x - first, self.others)
        near = (middle * middle).sum(1)[:, None]
        return np.concatenate([near, np.maximum(near + self.step**2 - 2 * (middle @ others.T), 0)], 1)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the table: coordinates with what is left; half of x.x less the first squared distance; whether rounding lets them bound anything."""
        far = self.table(x)
        y = (far[:, :1] + self.step**2 - far[:, 1:]) / (2 * self.step)
        left = np.sqrt(np.maximum(far[:, 0] - (y * y).sum(1), 0))
        own = (x * x).sum(1)
        return np.concatenate([y, left[:, None]], 1), (own - far[:, 0]) / 2, np.maximum(own, far[:, 0]) < 1e6 * self.step**2


def best_in_block(query_ids: np.ndarray, q: np.ndarray, vec_ids: np.ndarray, x: np.ndarray, pivots: Pivots, k: int, floor: np.ndarray | None = None, count: list[int] | None = None, placed: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of a block by elimination; ``count`` gets the numbers of products made.

    ``floor``: scores that k candidates of each query are known to reach.  ``placed``: the block's places, where they are known.
    """
    q, x = same_width(q, x)
    (yq, hq, okq), (yx, hx, okx) = pivots.places(q), placed or pivots.places(x)
    kth = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
    top_r, top_s = np.zeros(0, np.int64), np.zeros(0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size_q = (q * q).sum(1) + pivots.step**2
    for low in range(0, len(x), SLICE):
        part = slice(low, low + SLICE)
        bound = yq @ yx[part].T + hq[:, None] + hx[part]
        # a margin for rounding, far above its error and below any harm
        bound += 1e-6 * (size_q[:, None] + (x[part] * x[part]).sum(1)) + 1
        bound[~okq] = np.inf
        bound[:, ~okx[part]] = np.inf
        bound[query_ids[:, None] == vec_ids[None, part]] = -np.inf
        r, c = np.nonzero((bound >= kth[:, None]) & (bound > -np.inf))
        b = bound[r, c]
        order = np.lexsort((-b, r))
        r, c, b = r[order], c[order] + low, b[order]
        place, at, step = np.arange(len(r)) - np.searchsorted(r, r), 0, max(4 * k, 32)
        while True:
            now = (place >= at) & (place < at + step) & (b >= kth[r])
            if not now.any():
                break
            rows, columns = r[now], c[now]
            if count is not None:
                count.append(len(rows))
            made = pair_scores(q, x, rows, columns)
            worth = made >= kth[rows]
            out.append((query_ids[rows[worth]], vec_ids[columns[worth]], made[worth]))
            top_r, top_s = np.r_[top_r, rows[worth]], np.r_[top_s, made[worth]]
            order = np.lexsort((-top_s, top_r))
            top_r, top_s = top_r[order], top_s[order]
            nth = np.arange(len(top_r)) - np.searchsorted(top_r, top_r)
            kth[top_r[nth == k - 1]] = np.maximum(kth[top_r[nth == k - 1]], top_s[nth == k - 1])
            top_r, top_s = top_r[nth < k], top_s[nth < k]
            at, step = at + step, step * 4
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return local_best(*(np.concatenate(z) for z in zip(*out)), k)


def floors(query_ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among the seeds other than itself; -inf with fewer."""
    q, seeds = same_width(q, seeds)
    if len(seeds) < k:
        return np.full(len(q), -np.inf)
    scores = exact_scores(q, seeds).astype(float)
    scores[query_ids[:, None] == seed_ids] = -np.inf
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def top_k(embeddings: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, n_pivots: int = 48, seed_rows: int = 2048, id_: str = "vec_id", vector: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: exactly the k largest integer inner products per query; ``queries`` says of ``id`` which rows ask.

    ``seed_rows`` bounds the rows, chosen by hash, that place the pivots and give the floors; any choice gives the same result.
    """
    data = usable(embeddings, id_, vector, zero_counts=True)
    chosen = data.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(seed_rows).toArrow()
    seed_ids, seeds = chosen["id"].to_numpy(), quantised(matrix(chosen["v"]), scale)
    pivots = Pivots(seeds, n_pivots)
    _, blocks = block_count(data, 8 * seeds.shape[1], block_rows)

    def prepare(asked: pa.Table) -> pa.Table:
        at_least = floors(asked["id"].to_numpy(), quantised(matrix(asked["v"]), scale), seed_ids, seeds, k)
        return asked.append_column("floor", pa.array(at_least, pa.float64()))

    def ready(held: pa.Table):
        ids, x = held["id"].to_numpy(), quantised(matrix(held["v"]), scale)
        placed = pivots.places(x)

        def best(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return best_in_block(asked["id"].to_numpy(), quantised(matrix(asked["v"]), scale), ids, x, pivots, k, asked["floor"].to_numpy(), None, placed)

        return best

    return search(data.where(queries), data, ready, blocks, k, True, "long", prepare)
