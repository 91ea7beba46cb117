"""Packing as a cutting-stock problem, solved by column generation over the histogram of lengths.

Sequences are the stock, documents the pieces that it is cut into.  The driver sees a table of at most ``capacity``
counts, whatever the number of documents:

1.  Lengths fall into ``classes``, and a linear program over patterns of classes asks for the fewest sequences that
    hold every class as often as it occurs.  Its columns are generated: a knapsack by dynamic programming prices them
    (the most valuable pattern that fits, never with more of a class than there are), and the simplex method takes the one
    it finds, until no pattern is worth more than one sequence by ``gap``.
2.  Patterns are rounded up to whole numbers, the most used first, and made of real lengths of their
    classes whose sum is exactly the capacity: a widest-path search over sums takes the combination that
    can be repeated most often, again and again.  What counts don't allow is left, and steps 1 and 2 are repeated on the rest.
3.  What is left in the end is laid end to end, longest first, and cut at the capacity; the last, shorter
    stretch is cut into powers of two.  So no sequence has padding, and only documents that are longer than the
    capacity, or left over, are cut.

Documents meet nowhere: each piece has a rank among the equally long ones, and patterns own ranges of ranks.

Defined results: null texts count as empty and hold just the closing id; repeated rows are packed
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import release
from .common import materialise
from .packing import Pattern, _runs
from .words import encoder

#: Relative excess of the linear program's value over its bound at which it counts as solved, and how often the rest is solved again.
GAP, PASSES = 1e-3, 5
#: Texts with stretches to be read again, up to which they are broadcast.
FEW = 100_000


def knapsack(value: np.ndarray, size: np.ndarray, most: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable choice of at most ``most`` of each item within the room: its value and how many of each."""
    best, steps = np.zeros(room + 1), []
    for i in np.flatnonzero(value > 0):
        left, times = min(int(most[i]), room // int(size[i])), 1
        while left > 0:  # 1, 2, 4, ... of the item make any number of it
            k = min(times, left)
            w = k * int(size[i])
            with_ = best[: room + 1 - w] + k * value[i]
            better = with_ > best[w:] + 1e-12
            best[w:][better] = with_[better]
            steps.append((i, k, w, better))
            left, times = left - k, times * 2
    at, chosen = room, np.zeros(len(value), np.int64)
    for i, k, w, better in reversed(steps):
        if at >= w and better[at - w]:
            chosen[i] += k
            at -= w
    return float(best[room]), chosen


def fractional(size: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[float, np.ndarray]]:
    """The linear program by column generation: patterns with how often each is used, at least as often as demanded in all."""
    n = len(size)
    most = np.minimum(demand, room // size)
    columns = np.diag(most).astype(float)
    inverse = np.diag(1.0 / most)
    x = inverse @ demand
    for turn in range(1, 50 * n + 100):
        dual = np.maximum(inverse.sum(0), 0.0)  # every pattern costs one sequence
        worth, pattern = knapsack(dual, size, most, room)
        if worth <= 1 + gap:  # sum(x) / worth bounds the optimum from below
            break
        direction = inverse @ pattern
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leaves = int(ratio.argmin())
        columns[:, leaves] = pattern
        if turn % 100:
            row = inverse[leaves] / direction[leaves]
            inverse -= np.outer(direction, row)
            inverse[leaves] = row
        else:
            inverse = np.linalg.inv(columns)
        x = np.maximum(inverse @ demand, 0)
    return [(float(x[i]), columns[:, i].astype(np.int64)) for i in np.argsort(-x, kind="stable") if x[i] > 1e-9]


def exact_lengths(parts: list[tuple[int, int]], lengths: list[np.ndarray], count: np.ndarray, total: int) -> tuple[tuple[int, ...], int]:
    """Of parts (class, number of it) real lengths with this sum and how often counts allow them: the combination that can be repeated most often."""
    items = []
    for c, k in parts:
        own = lengths[c]
        for j in range(k):  # items of one class share its counts, no two the same unit
            items.append((own, (count[own] + (np.arange(len(own)) + j) % k) // k))
    low = sum(int(own[0]) for own, _ in items)
    high = sum(int(own[-1]) for own, _ in items)
    if not low <= total <= high:
        return (), 0
    width = np.zeros(total - low + 1, np.int64)
    width[0] = np.iinfo(np.int64).max
    trail = []
    for own, share in items:
        new, by = np.zeros_like(width), np.full(len(width), -1, np.int64)
        for n, s in zip((own - own[0]).tolist(), share.tolist()):
            if not s or n >= len(width):
                continue
            way = np.minimum(width[: len(width) - n], s)
            better = way > new[n:]
            new[n:][better] = way[better]
            by[n:][better] = n
        trail.append(by)
        width = new
    if not width[-1]:
        return (), 0
    at, chosen = len(width) - 1, []
    for (own, _), by in zip(reversed(items), reversed(trail)):
        step = int(by[at])
        chosen.append(int(own[0]) + step)
        at -= step
    return tuple(sorted(chosen, reverse=True)), int(width[-1])


def plan_cutting(counts: dict[int, int], capacity: int, classes: int = 128) -> list[Pattern]:
    """Patterns of lengths that fill the capacity exactly, and how often each is used; what they don't use is to be cut."""
    step = max(1, capacity // classes)
    count = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        count[n] = c
    of = np.maximum((np.arange(capacity + 1) + step // 2) // step, 1)
    room, plan = int(of[capacity]), []
    for _ in range(PASSES):
        there = np.flatnonzero(count)
        if not len(there):
            break
        kinds, at = np.unique(of[there], return_inverse=True)
        demand = np.bincount(at, count[there]).astype(np.int64)
        lengths = [there[at == i] for i in range(len(kinds))]
        made = 0
        for x, pattern in fractional(kinds, demand, room):
            parts, left = [(int(c), int(pattern[c])) for c in np.flatnonzero(pattern)], int(np.ceil(x - 1e-6))
            while left:
                chosen, times = exact_lengths(parts, lengths, count, capacity)
                times = min(times, left)
                if not times:
                    break
                for n in chosen:
                    count[n] -= times
                plan.append((chosen, times))
                left, made = left - times, made + times
        if not made:
            break
    return plan


def word_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, closing_id: int) -> DataFrame:
    """Each text's ids with the closing id in pieces of the capacity, the first one shorter: doc_id, key (a hash of the text), doc_tokens, start, length, ids_crc32."""
    rows = docs.select("doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    names = ["doc_id", "key", "doc_tokens", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = encoder(tokenizer_path), np.array([closing_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, size, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(ids_of.encode_batch(part.column(2))):
                    ids += last
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for a, b in zip(edges, edges[1:]):
                        row.append(i)
                        size.append(n)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(memoryview(ids)[4 * a : 4 * b]))
                keep = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), *(pa.array(x, pa.int64()) for x in (size, start, length, crc))], names)
        release()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, doc_tokens long, start long, length long, ids_crc32 long")


def cut_ids(docs: DataFrame, wanted: DataFrame, tokenizer_path: str, closing_id: int) -> DataFrame:
    """doc_id, key, start, length, ids and their ids_crc32 of the stretches ``wanted`` (doc_id, key, start, length) of the texts."""
    asked = wanted.distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "length")).alias("cuts"))
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), "text")
    rows = texts.join(_small(asked), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key"))).select("doc_id", "key", "text", F.col("cuts.start").alias("starts"), F.col("cuts.length").alias("lengths"))
    names = ["doc_id", "key", "start", "length", "ids", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = encoder(tokenizer_path), np.array([closing_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, start, length, kept, crc = [], [], [], [], []
                for i, (ids, a, n) in enumerate(zip(ids_of.encode_batch(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist())):
                    ids += last
                    for s, size in zip(a, n):
                        own = bytes(memoryview(ids)[4 * s : 4 * (s + size)])
                        row.append(i)
                        start.append(s)
                        length.append(size)
                        kept.append(np.frombuffer(own, "<i4"))
                        crc.append(zlib.crc32(own))
                keep = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(kept, pa.list_(pa.int32())), pa.array(crc, pa.int64())], names)
        release()

    made = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, start long, length long, ids array<int>, ids_crc32 long")
    return made.dropDuplicates(["doc_id", "key", "start", "length"])  # copies of a row give one each


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where a count shows it small; else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= FEW else df


class Places:
    """Where the piece of a length and rank goes, as whole arrays."""

    def __init__(self, counts: dict[int, int], plan: list[Pattern], capacity: int):
        self.capacity = capacity
        self.keys, self.sequences, self.widths, self.begins, self.offsets = _runs(plan)
        self.planned = sum(times for _, times in plan)
        self.used = np.zeros(capacity + 1, np.int64)
        for pattern, times in plan:
            for n in pattern:
                self.used[n] += times
        left = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            left[n] = c - self.used[n]
        tokens = (left * np.arange(capacity + 1))[::-1]
        self.base = (np.cumsum(tokens) - tokens)[::-1].copy()  # longest first
        total = int(tokens.sum())
        self.full = total // capacity
        rest = total % capacity
        powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.tails = self.full * capacity + np.cumsum([0, *powers])

    def sequence_of(self, at: np.ndarray) -> np.ndarray:
        """Which of the sequences of leftovers holds these places of their stream."""
        return np.where(at < self.tails[0], at // self.capacity, self.full + np.searchsorted(self.tails, at, side="right") - 1)

    def begin_of(self, sequence: np.ndarray) -> np.ndarray:
        return np.where(sequence < self.full, sequence * self.capacity, self.tails[np.clip(sequence - self.full, 0, len(self.tails) - 1)])

    def __call__(self, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each part of the pieces: which piece, its start there, its length, sequence and offset."""
        planned = rank < self.used[n]
        whole, cut = np.flatnonzero(planned), np.flatnonzero(~planned)
        run = np.searchsorted(self.keys, n[whole] << 40 | rank[whole], side="right") - 1
        within = rank[whole] - (self.keys[run] & ((1 << 40) - 1)) if len(whole) else whole
        sequence = self.sequences[run] + within // self.widths[run] if len(whole) else whole
        offset = self.offsets[self.begins[run] + within % self.widths[run]] if len(whole) else whole
        at = self.base[n[cut]] + (rank[cut] - self.used[n[cut]]) * n[cut]
        first, last = self.sequence_of(at), self.sequence_of(at + n[cut] - 1)
        parts = last - first + 1
        piece = np.repeat(np.arange(len(cut)), parts)
        own = first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.maximum(at[piece], self.begin_of(own))
        end = np.minimum((at + n[cut])[piece], self.begin_of(own + 1))
        return np.r_[whole, cut[piece]], np.r_[np.zeros(len(whole), np.int64), begin - at[piece]], np.r_[n[whole], end - begin], np.r_[sequence, self.planned + own], np.r_[offset, begin - self.begin_of(own)]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, closing_id: int = 2, classes: int = 128, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every text, and its ``ids`` if asked.

    Sequences hold ``capacity`` tokens or a smaller power of two, without padding.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = materialise(word_pieces(docs, tokenizer_path, capacity, closing_id), "cutting_pieces", 50_000)
    columns = "doc_id {}, key long, doc_tokens long, start long, length long, ids_crc32 long".format(kind)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            n = batch.column(4).to_numpy()
            order = np.argsort(n, kind="stable")
            rank = np.empty(len(n), np.int64)
            rank[order] = seen[n[order]] + np.arange(len(n)) - np.searchsorted(n[order], n[order])
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(rank)], [*batch.schema.names, "part", "rank"])

    tagged = materialise(pieces.mapInArrow(tag, columns + ", part int, rank long"), "cutting_ranked", 50_000)
    by_part = materialise(tagged.groupBy("length", "part").agg(F.count("*").alias("n")), "cutting_counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(counts, plan_cutting(counts, capacity, classes), capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = tagged.join(based, ["length", "part"]).select("doc_id", "key", "doc_tokens", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, start = batch.column(4).to_numpy(), batch.column(3).to_numpy()
            row, begin, length, sequence, offset = places(n, batch.column(6).to_numpy())
            keep = pa.array(row)
            crc = pa.array(batch.column(5).to_numpy()[row], mask=length != n[row])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in (0, 1, 2)), pa.array(start[row] + begin), pa.array(length), crc, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:6], "sequence_id", "offset"])

    placed = materialise(ranked.mapInArrow(place, columns + ", sequence_id long, offset long"), "cutting_placed", 50_000)
    whole, cut = placed.where("ids_crc32 IS NOT NULL"), placed.where("ids_crc32 IS NULL")
    ask = placed if with_ids else cut
    known = cut_ids(docs, ask.select("doc_id", "key", "start", "length"), tokenizer_path, closing_id).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("start").alias("s"), F.col("length").alias("l"), F.col("ids_crc32").alias("crc"), *(["ids"] if with_ids else []))
    same: Column = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("start") == F.col("s")) & (F.col("length") == F.col("l"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    found = ask.join(known, same).withColumn("ids_crc32", F.col("crc")).select(*out)
    return found if with_ids else whole.select(*out).unionByName(found)
