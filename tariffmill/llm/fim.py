"""Fill-in-middle: texts cut in three and reordered, by DuckDB SQL inside ``mapInArrow``.

Each batch goes through in slices of bounded size.  A slice is registered as a table and one SQL statement makes
all outputs, so that no Python runs per row: ``regexp_extract_all`` cuts a text into runs of ``RUN``
code points, and only the runs in which a cut falls into single ones, so that lists stay a small
part of the text; ``list_slice`` and ``array_to_string`` put prefix, middle and suffix together.
The first four 8-digit groups of sha256("<seed>:<doc_id>") give both cuts, whether a text stays
plain and the order of its parts: nothing depends on partitions or on other rows.

A text that contains a marker stays plain, so each marker occurs once in an output, and
``restore`` finds the parts again.

Defined results: null texts count as empty, and empty texts stay plain; a null id counts as an
empty one; repeated rows are treated one by one and alike; empty tables give empty results; extra
columns are ignored; a text is held whole by its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import release

#: Code points of a run.
RUN = 64
#: Bytes of text that a slice has at most, unless it is a single row.
SLICE_BYTES = 1 << 20
MARKERS = ("<P>", "<S>", "<M>")
#: Outputs with their Spark types.
OUTPUTS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string", "output_sha256": "string", "restored_sha256": "string"}
UNITS = "regexp_extract_all({}, '(?s).')"
MACROS = f"""
CREATE MACRO units(run) AS {UNITS.format("coalesce(run, '')")};
CREATE MACRO joined(list) AS coalesce(array_to_string(list, ''), '');
CREATE MACRO head(runs, k) AS joined(list_slice(runs, 1, k // {RUN})) || joined(list_slice(units(runs[k // {RUN} + 1]), 1, k % {RUN}));
CREATE MACRO tail(runs, k) AS joined(list_slice(units(runs[k // {RUN} + 1]), k % {RUN} + 1, {RUN})) || joined(list_slice(runs, k // {RUN} + 2, len(runs)));
CREATE MACRO middle(runs, a, b) AS CASE WHEN a // {RUN} = b // {RUN} THEN joined(list_slice(units(runs[a // {RUN} + 1]), a % {RUN} + 1, b % {RUN}))
  ELSE joined(list_slice(units(runs[a // {RUN} + 1]), a % {RUN} + 1, {RUN})) || joined(list_slice(runs, a // {RUN} + 2, b // {RUN})) || joined(list_slice(units(runs[b // {RUN} + 1]), 1, b % {RUN})) END;
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def check_markers(markers: tuple[str, str, str]) -> None:
    """Markers must be findable whatever text surrounds them: none overlaps itself or another, or lies in another."""
    for a in markers:
        for b in markers:
            if not a or (a is not b and a in b) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)) + (a is not b))):
                raise ValueError(f"markers {a!r} and {b!r} can overlap")


def restored(output: str, form: str, markers: tuple[str, str, str]) -> str:
    """SQL of the text that an output of this form was made from."""
    p, s, m = map(_quoted, markers)
    after = lambda mark: f"split_part({output}, {mark}, 2)"
    until = lambda text, mark: f"split_part({text}, {mark}, 1)"
    psm = f"{until(after(p), s)} || {after(m)} || {until(after(s), m)}"
    spm = f"{until(after(p), m)} || {after(m)} || {until(after(s), p)}"
    return f"CASE {form} WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE {output} END"


def statement(columns: tuple[str, ...], seed: int, plain: int, spm: int, markers: tuple[str, str, str]) -> str:
    """The SQL for a registered slice ``batch`` (id, text)."""
    p, s, m = map(_quoted, markers)
    hash_ = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    marked = " OR ".join(f"contains(text, {x})" for x in (p, s, m))
    return f"""
WITH cut AS (SELECT id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s).{{1,{RUN}}}') AS runs, sha256('{int(seed)}:' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM batch),
sized AS (SELECT *, {RUN} * greatest(len(runs) - 1, 0) + len(units(runs[len(runs)])) AS n FROM cut),
placed AS (SELECT *, least({hash_(0)} % (n + 1), {hash_(1)} % (n + 1)) AS a, greatest({hash_(0)} % (n + 1), {hash_(1)} % (n + 1)) AS b,
  CASE WHEN n = 0 OR {marked} OR {hash_(2)} % 100 >= {100 - int(plain)} THEN 'plain' WHEN {hash_(3)} % 100 < {int(spm)} THEN 'spm' ELSE 'psm' END AS form FROM sized),
made AS (SELECT id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  CASE form WHEN 'psm' THEN {p} || head(runs, a) || {s} || tail(runs, b) || {m} || middle(runs, a, b)
    WHEN 'spm' THEN {s} || tail(runs, b) || {p} || head(runs, a) || {m} || middle(runs, a, b) ELSE text END AS output FROM placed)
SELECT id, {", ".join({"output_sha256": "sha256(output) AS output_sha256", "restored_sha256": f"sha256({restored('output', 'form', markers)}) AS restored_sha256"}.get(c, c) for c in columns)} FROM made"""


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with ``SLICE_BYTES`` of text at most each, or one row."""
    column = batch.column(text)
    ends = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64))) if len(column) else np.zeros(0, np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _through_sql(rows: DataFrame, sql: str, schema: str, text: int, names: list[str]) -> DataFrame:
    """What the SQL makes of each slice of ``rows``, registered as ``batch`` with these column names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
            db.execute(MACROS)
            for batch in batches:
                for part in slices(batch, text):
                    db.register("batch", pa.Table.from_batches([part]).rename_columns(names))
                    yield from db.execute(sql).to_arrow_table().to_batches()
                    db.unregister("batch")
        release()

    return rows.mapInArrow(run, schema)


def transform(docs: DataFrame, columns: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output"), seed: int = 1, plain: int = 10, spm: int = 20, markers: tuple[str, str, str] = MARKERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key and the asked ``OUTPUTS``; ``plain`` and ``spm`` are percents, ``markers`` stand before prefix, suffix and middle."""
    check_markers(markers)
    rows = docs.select(key, text)
    kind = rows.schema[0].dataType.simpleString()
    return _through_sql(rows, statement(columns, seed, plain, spm, markers), ", ".join([f"`{key}` {kind}", *(f"{c} {OUTPUTS[c]}" for c in columns)]), 1, ["id", "text"]).toDF(key, *columns)


def restore(made: DataFrame, markers: tuple[str, str, str] = MARKERS, key: str = "doc_id") -> DataFrame:
    """Each row's key and the ``text`` that its ``output`` and ``form`` were made from."""
    check_markers(markers)
    rows = made.select(key, "form", "output")
    kind = rows.schema[0].dataType.simpleString()
    return _through_sql(rows, f"SELECT id, {restored('output', 'form', markers)} AS text FROM batch", f"`{key}` {kind}, text string", 2, ["id", "form", "output"])
