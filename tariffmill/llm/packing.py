"""Best-fit packing of token sequences by exact-complement hashing.

Whatever the number of pieces, a plan depends only on how many there are of each length, so it
is made on the driver from a table of at most ``capacity`` counts.  For the longest length left,
its gap is looked up among the sums of one, two and three available lengths (kept as bit sets:
bit s of a shifted and intersected set tells that two lengths add up to s), and the combination
is consumed as often as counts allow.  Lengths without an exact complement take the longest
length that fits, and the rest of their gap is looked up again; what still leaves a gap is the
residual.  A step is repeated as often as the counts allow, so the plan's size is bounded by the
capacity, not by the data.

Pieces get their places without meeting: each carries its rank among the equally long pieces of
its partition; adding the counts of earlier partitions makes that a rank among all, and the plan
says which sequence and offset a rank has.

Defined results: null texts count as empty and hold just the closing id; a text is cut only
if it is longer than the capacity, its first piece taking the remainder; repeated rows are packed
each; an empty table gives no rows; extra columns of ``pack``'s input pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import release
from .bpe import model
from .common import free_names, materialise

Pattern = tuple[tuple[int, ...], int]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, closing_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Each text's ids and the closing id, cut into pieces: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(bpe.encode_batch(part.column(1).to_pylist())):
                    ids = np.append(ids, closing_id).astype("<u4")
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int32))
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names)
        release()

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class _Stock:
    """Available lengths with their counts, and bit sets of which there are."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.count = capacity, dict(counts)
        self.there = self.mirrored = 0
        for n in counts:
            self._show(n)

    def _show(self, n: int) -> None:
        self.there |= 1 << n
        self.mirrored |= 1 << (self.capacity - n)

    def take(self, n: int, times: int) -> None:
        self.count[n] -= times
        if not self.count[n]:
            del self.count[n]
            self.there &= ~(1 << n)
            self.mirrored &= ~(1 << (self.capacity - n))

    def put(self, n: int, times: int) -> None:
        if n not in self.count:
            self.count[n] = 0
            self._show(n)
        self.count[n] += times

    def longest(self, limit: int) -> int:
        """The longest available length up to the limit, or 0."""
        return max((self.there & ((1 << (limit + 1)) - 1)).bit_length() - 1, 0) if self.there and limit > 0 else 0

    def two(self, total: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, the first as long as can be."""
        if total < 2:
            return None
        fits = self.there & (self.mirrored >> (self.capacity - total)) & ((1 << total) - 1)
        while fits:
            a = fits.bit_length() - 1
            if 2 * a < total:
                return None
            if 2 * a != total or self.count[a] > 1:
                return a, total - a
            fits &= ~(1 << a)
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap exactly."""
        if self.count.get(gap):
            return (gap,)
        if pair := self.two(gap):
            return pair
        a = self.longest(gap - 2)
        while a and 3 * a >= gap:
            self.take(a, 1)
            pair = self.two(gap - a)
            self.put(a, 1)
            if pair:
                return (a, *pair)
            a = self.longest(a - 1)
        return None


def plan_packing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns of lengths and how often each is used, together using up the counts."""
    stock, plan = _Stock({n: c for n, c in counts.items() if c > 0}, capacity), []
    while stock.count:
        pattern = [stock.longest(capacity)]
        stock.take(pattern[0], 1)
        gap = capacity - pattern[0]
        while gap and stock.count:
            more = stock.complement(gap) or ((n,) if (n := stock.longest(gap)) else ())
            if not more:
                break
            for n in more:
                stock.take(n, 1)
            pattern += more
            gap -= sum(more)
        uses = {n: pattern.count(n) for n in set(pattern)}
        again = min(stock.count.get(n, 0) // k for n, k in uses.items())
        if again:
            for n, k in uses.items():
                stock.take(n, k * again)
        plan.append((tuple(pattern), 1 + again))
    return plan


def _runs(plan: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The plan by length and rank: sorted keys (length << 40 | first rank), first sequences, pieces per sequence, where their offsets begin, offsets."""
    used: dict[int, int] = {}
    rows, offsets, sequence = [], [], 0
    for pattern, times in plan:
        places = np.cumsum([0, *pattern[:-1]]).tolist()
        for n in sorted(set(pattern)):
            own = [p for p, m in zip(places, pattern) if m == n]
            rows.append((n << 40 | used.get(n, 0), sequence, len(own), len(offsets)))
            offsets += own
            used[n] = used.get(n, 0) + len(own) * times
        sequence += times
    rows.sort()
    return (*(np.array([r[k] for r in rows], np.int64) for k in range(4)), np.array(offsets, np.int64))


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length") -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset, which replace columns of these names.

    Rows whose length is null, or not 1 to ``capacity``, fit nowhere: they come back with both null.
    """
    pieces = pieces.drop("sequence_id", "offset")
    schema = pieces.schema
    part_, rank_, size_, before_ = free_names(pieces, "part", "rank", "size", "before")
    tagged_schema = T.StructType([*schema.fields, T.StructField(part_, T.IntegerType()), T.StructField(rank_, T.LongType()), T.StructField(size_, T.LongType())])
    where = schema.names.index(length)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            n = batch.column(where).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).copy()
            n[(n < 1) | (n > capacity)] = 0
            order = np.argsort(n, kind="stable")
            first = np.searchsorted(n[order], n[order])
            rank = np.empty(len(n), np.int64)
            rank[order] = seen[n[order]] + np.arange(len(n)) - first
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(rank), pa.array(n)], tagged_schema.names)

    # two Python steps in one task would keep twice the workers, each with a vocabulary
    tagged = materialise(materialise(pieces, "pieces").mapInArrow(tag, tagged_schema), "tagged_pieces", 50_000)
    by_part = materialise(tagged.groupBy(size_, part_).agg(F.count("*").alias("n")), "piece_counts")
    counts = {r[size_]: r["n"] for r in by_part.where(F.col(size_) > 0).groupBy(size_).agg(F.sum("n").alias("n")).collect()}
    keys, sequences, widths, begins, offsets = _runs(plan_packing(counts, capacity))
    earlier = Window.partitionBy(size_).orderBy(part_).rowsBetween(Window.unboundedPreceding, -1)
    based = by_part.select(size_, part_, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before_))
    ranked = tagged.join(based, [size_, part_]).select(*[F.col(f"`{c}`") for c in schema.names], size_, (F.col(rank_) + F.col(before_)).alias(rank_))
    out_schema = T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            fits = np.flatnonzero(n > 0)
            run = np.searchsorted(keys, n[fits] << 40 | rank[fits], side="right") - 1
            within = rank[fits] - (keys[run] & ((1 << 40) - 1))
            made = []
            for x in (sequences[run] + within // widths[run], offsets[begins[run] + within % widths[run]]) if len(fits) else (fits, fits):
                full = np.zeros(len(n), np.int64)
                full[fits] = x
                made.append(pa.array(full, mask=n == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], out_schema.names)

    return ranked.mapInArrow(place, out_schema)
