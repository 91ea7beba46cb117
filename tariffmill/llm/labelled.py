"""Bounded, reproducible samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_labels(labels: DataFrame, label: str, train: Column, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` rows (key, label, of) of each class among training rows, by hash order of the key.

    ``of`` is the number of training rows of the class, from which ``class_weights`` restores the
    shares that the bound changes.  Several labels of one key: the largest counts.  Rows with a null key or label take no part.
    The bound is a parameter of the models' fit only; scoring covers every row.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & train).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect() if r["label"] in (0, 1)}
    parts = []
    for value, n in sorted(counts.items()):
        # those of the smallest hashes, whatever the order of rows; a threshold somewhat above leaves few to sort
        place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
        near = place < int(min(1.0, 1.2 * most / n + 100 / n) * (1 << 30))
        parts.append(rows.where((F.col("label") == value) & near).orderBy(place, key).limit(most).withColumn("of", F.lit(n).cast("long")))
    out = labels.select(key).limit(0).withColumn("label", F.lit(0)).withColumn("of", F.lit(0).cast("long"))
    for part in parts:
        out = out.unionByName(part)
    return out


def class_weights(sample: DataFrame) -> tuple[float, float]:
    """For labels 0 and 1 how many training rows a sampled row stands for; 1 each where ``sample`` has no column ``of``."""
    out = [1.0, 1.0]
    if "of" in sample.columns:
        for r in sample.groupBy("label").agg(F.max("of").alias("of"), F.count("*").alias("n")).collect():
            out[r["label"]] = r["of"] / r["n"]
    return out[0], out[1]


def in_fold(modulus: int, *remainders: int, key: str = "doc_id") -> Column:
    """True for rows whose crc32 of the key as text has one of these remainders."""
    return (F.crc32(F.col(key).cast("string")) % modulus).isin(*remainders)
