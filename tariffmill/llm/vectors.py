"""Blocks of vectors for searches: which rows count, how they are dealt, and how results are merged.

A stated query set is searched against all rows in a grid: vectors are dealt to blocks by a
hash of their id, so equal or crowded vectors spread evenly; queries are packed, one row for
some hundreds, and packs form groups.  A task holds one block and one group.  Every vector is
copied once for each group and every query once for each block, and both are large (up to ``BLOCK_ROWS``
vectors, ``GROUP`` packs), so copies grow as slowly as a task's memory allows.  Each block answers with its own
best per query, and the best k of those are the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Packs of queries that a task takes at most, and queries of a pack.
GROUP, QUERY_ROWS = 64, 512
#: Vectors of a block: at most so many rows and bytes; with fewer rows than these a table isn't cut for the cores' sake.
BLOCK_ROWS, BLOCK_BYTES, LEAST_ROWS = 65_536, 32 << 20, 1_024
#: Vectors that are compared with a pack at once inside a block.
SLICE = 4_096


def usable(embeddings: DataFrame, id_: str, vector: str, zero_counts: bool, **carried: Column) -> DataFrame:
    """(id, v, and what is carried) of rows whose id and vector are there, with all components there and finite; zero and empty vectors only if they count."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    keep = F.col(id_).isNotNull() & v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True))
    if not zero_counts:
        keep &= F.exists(v, lambda x: x != 0)
    return embeddings.where(keep).select(F.col(id_).cast("long").alias("id"), v.alias("v"), *[c.alias(n) for n, c in carried.items()])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.array(column.offsets))
    flat = np.array(column.flatten(), np.float64)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    wide = lambda x: x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
    return wide(a), wide(b)


def block_count(held: DataFrame, row_bytes: int, block_rows: int | None = None) -> tuple[int, int]:
    """Rows of ``held``, and into how many blocks they go: as few as memory allows, but one a core where they are enough."""
    n = held.count()
    most = block_rows or max(LEAST_ROWS, min(BLOCK_ROWS, BLOCK_BYTES // max(row_bytes, 1)))
    return n, max(1, -(-n // most), min(-(-n // LEAST_ROWS), held.sparkSession.sparkContext.defaultParallelism))


def grid(asked: DataFrame, held: DataFrame, ready: Callable, blocks: int, schema: pa.Schema, prepare: Callable | None = None) -> DataFrame:
    """What every block of ``held`` (id, ...) answers to every pack of ``asked`` (id, ...), as rows of ``schema`` (64-bit integers and doubles).

    ``ready(held_table)`` is called once for a block and gives ``best(asked_table)``, which gives one array
    for each column of the schema.  ``prepare`` may add columns to a pack of queries.
    """
    packs = max(1, -(-asked.count() // QUERY_ROWS))
    groups = -(-packs // GROUP)
    names = asked.columns

    def packed(table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        rows = table.select(names)
        rows = prepare(rows) if prepare else rows
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return pa.table({"pack": table["_pack"].slice(0, 1), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    sent = asked.withColumn("_pack", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(packs)).cast("int")).groupBy("_pack").applyInArrow(packed, "pack int, rows binary")
    sent = sent.select((F.col("pack") / GROUP).cast("int").alias("g"), "rows", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    dealt = held.withColumn("b", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        if left.num_rows and right.num_rows:
            best = ready(left)
            made = [best(pa.ipc.open_stream(rows).read_all()) for rows in right["rows"].to_pylist()]
        columns = [np.concatenate([m[c] for m in made]) if made else [] for c in range(len(schema))]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    kinds = ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'long'}" for f in schema)
    return dealt.groupBy("b", "g").cogroup(sent.groupBy("b", "g")).applyInArrow(both, kinds)


def search(asked: DataFrame, held: DataFrame, ready: Callable, blocks: int, k: int, descending: bool, score: str, prepare: Callable | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best per query of ``asked`` (id, ...) among the rows of ``held`` (id, ...).

    See ``grid``: the arrays are query id, vec id and score of a block's best for each query; ``score`` is the scores' SQL type.
    """
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64() if score == "double" else pa.int64())])
    return best_rows(grid(asked, held, ready, blocks, schema, prepare), k, descending)


def best_rows(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, ties to smaller ids."""
    order = [F.desc("score") if descending else F.asc("score"), F.asc("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def local_best(query_ids: np.ndarray, vec_ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of flat (query, vector, score) with higher better, each query's k best, ties to smaller ids."""
    order = np.lexsort((vec_ids, -scores, query_ids))
    q = query_ids[order]
    keep = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
    return query_ids[keep], vec_ids[keep], scores[keep]

