"""Near-duplicate components by MinHash with tensored banding, verified on full shingle sets.

A table key combines one value of each of two small collections.  Each collection holds m
values, each made of r minhashes, and the m * m pairs of values serve as m * m tables of 2r
rows: 2mr minhashes do the work of 2rm**2.  A pair of documents of similarity s meets in some
table unless one collection has no common value: the chance to meet is (1 - (1 - s**r)**m)**2,
with r = 3 and m = 12 above 0.9996 at s = 0.8 and 0.99998 at 0.85.

Steps.  (1) Each text gives its set's size, a 128-bit digest and the values; documents of equal
sets form classes, and only each class's smallest doc_id goes on.  (2) Within buckets of equal
keys, small ones give all pairs, larger ones a star: pairs of their first member with each other
one.  Pairs of several tables are one candidate; those whose sizes alone rule a link out are
dropped, the others confirmed on their full sets.  (3) A star whose ends are all in its first
member's component has nothing left to find.  The members of the others are compared across
components by an exact prefix and position filter, so no candidate is capped away.  (4) Components
of all links, by star contraction in the shared folder.

Defined results: null texts and texts without words have an empty set, are linked with nothing
and are their own component.  Rows that share a doc_id count as one node, also where their texts differ:
classes are then told apart by their digests, and those of one doc_id are linked.  A null doc_id is
its own component (null) and kept.  An empty table gives an empty one.  A very long text is hashed
as a block of its own, and its set is held by one task at a time.  Ties (similarity of exactly
``percent``) are links.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Block, in_blocks, mix
from .common import drop_tables, materialise, measured_broadcasts
from .graph import components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Buckets up to this size give all their pairs at once.
SMALL = 8
#: Rows of buckets that are held before they go out, and rows of one bucket before it goes out in stretches.
HELD, STRETCH = 200_000, 2_000_000
#: How much larger the sizes of one band are than those of the band before.
BAND = 1.02
#: Rows of ids, at most, that are broadcast to find candidates' texts; more are joined by shuffle.  The driver builds the table.
BROADCAST_ROWS = 250_000
#: Rows with whole sets in one batch between the JVM and Python.
PAIR_ROWS = 200


def shingle_sets(block: Block, words: int) -> list[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes; with fewer words than asked, the whole sequence as one."""
    block.bytes = _LOWER[block.bytes]
    (h,) = block.hashes(None)
    shingle = h.copy()
    for k in range(1, words):
        if len(h) > k:
            shingle[: len(h) - k] = mix(shingle[: len(h) - k] * np.uint64(3) + h[k:])
    out = []
    for a, b in zip(block.text_words[:-1], block.text_words[1:]):
        if b - a >= words:
            out.append(np.unique(shingle[a : b - words + 1]))
        elif b > a:
            out.append(np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(h[:0])
    return out


def _constants(values: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(911)
    n = 2 * values * rows
    return rng.integers(1, 1 << 63, n, dtype=np.uint64), rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def signatures(docs: DataFrame, words: int, values: int, rows: int) -> DataFrame:
    """Per row doc_id, n_shingles, the set's digest (null if empty) and the 2 * values of its two collections."""
    seeds, factors = _constants(values, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in in_blocks(batches, 1):
            sizes, digests, made = [], [], []
            for s in shingle_sets(block, words):
                sizes.append(len(s))
                if not len(s):
                    digests.append(None)
                    made.append(None)
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                low = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(s), 4096):
                    low = np.minimum(low, ((s[at : at + 4096, None] ^ seeds) * factors).min(0))
                low = low.reshape(-1, rows)
                h = low[:, 0]
                for k in range(1, rows):
                    h = mix(h * np.uint64(3) + low[:, k])
                made.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "collections"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, collections array<long>")


def _buckets(classes: DataFrame, values: int) -> DataFrame:
    """One row (key, doc, n) per class and table."""
    left = classes.select("doc", "n", "collections", F.posexplode(F.slice("collections", 1, values)).alias("i", "u"))
    both = left.select("doc", "n", "i", "u", F.posexplode(F.slice("collections", values + 1, values)).alias("j", "v"))
    return both.select(F.xxhash64("i", "u", "j", "v").alias("key"), "doc", "n")


def _scan(buckets: DataFrame) -> DataFrame:
    """Candidates of sorted buckets: rows (a, b, a_n, b_n, star), where ``star`` marks pairs with the first member of a large bucket."""

    def pairs(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, n: np.ndarray, star: bool) -> Iterator[pa.RecordBatch]:
        if len(lo):
            at = np.unique(np.stack([doc[lo], doc[hi]]), axis=1, return_index=True)[1]
            lo, hi = lo[at], hi[at]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (doc[lo], doc[hi], n[lo], n[hi], np.full(len(lo), star)))], ["a", "b", "a_n", "b_n", "star"])

    def emit(key: np.ndarray, doc: np.ndarray, n: np.ndarray, continued: bool) -> Iterator[pa.RecordBatch]:
        """``continued``: the first bucket is what remains of a large one, and counts as large whatever its size."""
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        lo, hi = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        big = size > SMALL
        big[0] |= continued
        for z in range(2, SMALL + 1):
            at = start[(size == z) & ~big]
            x, y = np.triu_indices(z, 1)
            lo.append((at[:, None] + x).ravel())
            hi.append((at[:, None] + y).ravel())
        yield from pairs(np.concatenate(lo), np.concatenate(hi), doc, n, False)
        first = np.repeat(start, size)
        rest = np.flatnonzero(np.repeat(big, size) & (np.arange(len(key)) > first))
        yield from pairs(first[rest], rest, doc, n, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        continued = False
        for batch in batches:
            new = [batch.column(k).to_numpy() for k in range(3)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) < HELD:
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:  # the last bucket may go on
                yield from emit(*(x[:last] for x in held), continued)
                held, continued = [x[last:] for x in held], False
            elif len(held[0]) > STRETCH:  # a huge bucket goes out in stretches, all led by its first member
                yield from emit(*held, continued)
                held, continued = [x[:1] for x in held], True
        if held is not None and len(held[0]):
            yield from emit(*held, continued)

    sorted_ = buckets.repartition("key").sortWithinPartitions("key", "doc")
    return sorted_.mapInArrow(run, "a long, b long, a_n long, b_n long, star boolean")


def _can_link(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b, star) with ``linked``, by intersecting full sets."""
    left, right = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.select("a", "b", "star").join(left, "a").join(right, "b").select("a", "b", "star", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(3), batch.column(4)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(linked, pa.bool_())], ["a", "b", "star", "linked"])

    return joined.mapInArrow(run, "a long, b long, star boolean, linked boolean")


def _node(by_digest: bool, doc: str) -> Column:
    """What names a class: its smallest doc_id, or a hash of its digest where a doc_id has different sets."""
    return F.xxhash64("digest") if by_digest else F.col(doc)


def _sets(docs: DataFrame, ids: DataFrame, words: int, by_digest: bool = False) -> DataFrame:
    """(doc, shingles) of the documents named in ``ids`` (doc), one row for each; doc is the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in in_blocks(batches, 1):
            sets = [s.tobytes() for s in shingle_sets(block, words)]
            digests = [hashlib.blake2b(s, digest_size=16).digest() if by_digest else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["doc", "digest", "shingles"])

    few = ids.count() <= BROADCAST_ROWS
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(F.broadcast(ids) if few else ids.hint("merge"), "doc", "left_semi")
    return chosen.mapInArrow(run, "doc long, digest binary, shingles binary").select(_node(by_digest, "doc").alias("doc"), "shingles")


def _heads(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of documents (doc, n, label) the shingles among which a pair of different labels must meet, with ``rest``: how many of the set don't come before.

    In one order of all shingles two sets that are similar enough must share one of the first
    n - ceil(n * percent / 100) + 1 of each.  Shingles of one label alone are shared by no pair
    that is sought: they come first and only take places.  The others follow, rarest first.  So
    what a family of near copies has to itself fills its members' places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                each = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(3)]
                rows = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in range(3)), pa.array(np.concatenate(each))], ["doc", "n", "label", "shingle"])

    spread = docs.join(sets, "doc").select("doc", "n", "label", "shingles").mapInArrow(run, "doc long, n long, label long, shingle long")
    spread = materialise(spread, "spread", PAIR_ROWS)
    shared = spread.groupBy("shingle").agg(F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle", "df")
    of_doc = Window.partitionBy("doc")
    place = F.row_number().over(of_doc.orderBy("df", "shingle")) + F.col("n") - F.count("*").over(of_doc)
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    placed = spread.join(shared, "shingle").withColumn("place", place).where(F.col("place") <= prefix)
    heads = materialise(placed.select("doc", "n", "label", "shingle", (F.col("n") - F.col("place") + 1).alias("rest")), "heads")
    drop_tables(docs.sparkSession, spread)
    return heads


def _meetings(heads: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, their n and rest) of different labels that meet in a shingle of their heads, ``a`` in a band of sizes not above that of ``b``.

    A pair must share percent / (100 + percent) of both sizes together, and no more than what follows its
    first shared shingle in either.  So how far a shingle may be from the front depends on the other's
    size, and each row is dealt to just those bands of partners' sizes for which it is near enough.
    Labels are paired first, and only then expanded to their members: members of one label never meet.
    """
    band = lambda n: F.floor(F.log(n) / math.log(BAND)).cast("int")
    n, least = F.col("n"), F.ceil(F.col("n") * percent / 100)
    most = F.floor(F.col("n") * 100 / percent)

    def side(other: str, low: Column, high: Column, floor: Column) -> DataFrame:
        """Rows by the partner's band ``other``; ``floor``: the partner's least size whatever its band."""
        dealt = heads.withColumn("own", band(n)).withColumn(other, F.explode(F.sequence(band(low), band(high))))
        smallest = F.greatest(F.pow(F.lit(BAND), F.col(other)) - 1e-6, floor)
        return dealt.where(F.col("rest") >= percent / (100 + percent) * (n + smallest) - 1e-6)

    key = ["shingle", "band_a", "band_b"]
    left = side("band_b", n, most, n).withColumnRenamed("own", "band_a").select(*key, "label", F.col("doc").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"))
    right = side("band_a", least, n, least).withColumnRenamed("own", "band_b").select(*key, F.col("label").alias("b_label"), F.col("doc").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("b_rest"))
    labels = left.select(*key, "label").distinct().join(right.select(*key, "b_label").distinct(), key).where("label <> b_label")
    return left.join(labels, [*key, "label"]).join(right, [*key, "b_label"]).select("a", "b", "a_n", "b_n", "a_rest", "b_rest")


def _prefix_pairs(heads: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b), a < b, of documents with different labels that can be similar enough, from their heads.

    What follows the first shared shingle in both bounds what they can share at all; a later one
    has less behind it, so a pair that its first one rules out is ruled out by all.
    """
    enough = (100 + percent) * F.least("a_rest", "b_rest") >= percent * (F.col("a_n") + F.col("b_n"))
    met = _meetings(heads, percent).where("a_n < b_n or a_n = b_n and a < b").where(_can_link("a_n", "b_n", percent)).where(enough)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, values: int = 12, rows: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether it is its component's smallest doc_id), one row per input row.

    What its joins put on the driver does not grow with the documents.
    """
    with measured_broadcasts(docs.sparkSession):
        return _near_duplicates(docs, words, percent, values, rows)


def _near_duplicates(docs: DataFrame, words: int, percent: int, values: int, rows: int) -> DataFrame:
    spark = docs.sparkSession
    signed = materialise(signatures(docs, words, values, rows), "signatures")
    whole = signed.where("digest is not null and doc_id is not null")
    least = whole.groupBy("digest").agg(F.min("doc_id").alias("class"), F.count("*").alias("copies"))
    hashed = signed.where("doc_id is not null").select("doc_id", F.xxhash64("digest").alias("d"))
    several = materialise(hashed.groupBy("doc_id").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high").select("doc_id"), "several")
    by_digest = not several.isEmpty()
    classes = materialise(whole.join(least, "digest").where("doc_id = class").select(_node(by_digest, "doc_id").alias("doc"), F.col("n_shingles").alias("n"), "collections", "digest", "class").dropDuplicates(["digest"]), "classes")
    found = materialise(_scan(_buckets(classes, values)), "candidates", 50_000)
    once = found.groupBy("a", "b").agg(F.max("star").alias("star"), F.min(_can_link("a_n", "b_n", percent)).alias("fits"))
    pairs = materialise(once, "pairs")
    ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    named_ids = ids.join(classes.select("doc", "class"), "doc").select(F.col("class").alias("doc")).distinct() if by_digest else ids
    sets = materialise(_sets(docs, named_ids, words, by_digest).dropDuplicates(["doc"]), "sets")
    checked = materialise(_confirm(pairs.where("fits"), sets, percent), "checked", PAIR_ROWS)
    links = checked.where("linked").select("a", "b")
    if by_digest:
        nodes = whole.join(several, "doc_id", "left_semi").select("doc_id", _node(True, "doc_id").alias("b")).distinct()
        tied = nodes.join(nodes.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").where("a < b").select("a", "b")
        links = links.unionByName(tied)
    named = components(links)
    done = [signed, classes, several, found, pairs, sets, checked, named]
    label = lambda x: named.select(F.col("node").alias(x), F.col("component").alias(f"{x}_label"))
    apart = checked.where("star and not linked").select("a", "b").unionByName(pairs.where("star and not fits").select("a", "b"))
    apart = apart.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b"))
    mixed = materialise(apart.select(F.col("a").alias("f")).distinct(), "mixed")
    stars = pairs.where("star").select(F.col("a").alias("f"), "b").join(mixed, "f").select("f", F.explode(F.array("f", "b")).alias("doc")).distinct()
    open_docs = stars.select("doc").distinct().join(classes.select("doc", "n"), "doc").join(label("doc"), "doc", "left").select("doc", "n", F.coalesce("doc_label", "doc").alias("label"))
    open_docs = materialise(open_docs, "open")
    done += [mixed, open_docs]
    merged = None  # components of components
    if not open_docs.isEmpty():
        heads = _heads(open_docs, sets, percent)
        asked = materialise(_prefix_pairs(heads, percent).join(pairs.where("fits"), ["a", "b"], "left_anti").withColumn("star", F.lit(False)), "pairs")
        of = lambda x: open_docs.select(F.col("doc").alias(x), F.col("label").alias(f"{x}_label"))
        linked = _confirm(asked, sets, percent).where("linked").join(of("a"), "a").join(of("b"), "b")
        late = materialise(linked.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct(), "links", PAIR_ROWS)
        done += [heads, asked, late]
        if not late.isEmpty():
            merged = components(late)
            done.append(merged)
    known = classes.select("digest", "doc", "class").join(named, F.col("doc") == F.col("node"), "left").select("digest", "class", F.coalesce("component", "doc").alias("component"))
    if merged is not None:
        known = known.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("digest", "class", F.coalesce("to", "component").alias("component"))
    if by_digest:
        known = known.join(known.groupBy("component").agg(F.min("class").alias("least")), "component").select("digest", F.col("least").alias("component"))
    placed = signed.select("doc_id", "n_shingles", "digest").join(known.select("digest", "component"), "digest", "left")
    if by_digest:  # a row without words belongs to its doc_id's others
        others = placed.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("other"))
        placed = placed.join(others, "doc_id", "left").withColumn("component", F.coalesce("component", "other"))
    out = placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    out = materialise(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near_duplicates")
    drop_tables(spark, *done)
    return out


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """The rows, with all their columns, of each component's smallest doc_id."""
    gone = near_duplicates(docs, **options).where("not kept").select("doc_id").distinct()
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone.hint("merge"), docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
