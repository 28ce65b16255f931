"""Raw annotation lines into typed columns, with every line that fails kept apart and explained.

A record block (one Arrow batch) is parsed once, by columnar kernels that also say which checks its
records fail.  A block without failures is accepted as a whole.  Else it is bisected, halves being
judged by the checks already made, until the failing records stand alone; a strict parser names
their reasons.  Only lines that fail, and nothing else, reach per-record Python.

Defined cases: blank lines and comment lines are no records and yield no row; a null line is a
failing record (``null_line``); empty tables give empty results; repeated lines are separate
records; a null id is kept as null; further input columns are ignored unless named in ``keep``
(their names may not clash with the typed columns, which raises ``ValueError``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_POSITION = 2147483647
GTF_FIELDS = ("chr", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")
BED_FIELDS = ("chr", "start", "end", "name")
ATTRIBUTES = r'[^ ";]+ (?:[0-9]+|"[^"]*")(?:; [^ ";]+ (?:[0-9]+|"[^"]*"))*;?'
BED_NAME = r'(?:[^"\t]*|"(?:[^"]|"")*")'


class _Format:
    def __init__(self, fields: tuple[str, ...], skip: str, first: int, last_field: str, pattern: str, loose: bool):
        self.fields, self.skip, self.first, self.pattern, self.loose = fields, skip, first, pattern, loose
        self.last_field = last_field
        self.at_start, self.at_end, self.at_last = fields.index("start"), fields.index("end"), len(fields) - 1


FORMATS = {
    # 1-based, end included: start may equal end
    "gtf": _Format(GTF_FIELDS, "^#", 1, "attributes", ATTRIBUTES, False),
    # 0-based, half-open: start is below end; a quoted last field may hold tabs
    "bed": _Format(BED_FIELDS, "^(#|track|browser)", 0, "name", BED_NAME, True),
}


def _positions(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values as int64, and which are digits (of any length; 0 and False where they are none)."""
    short = pc.ascii_ltrim(text, characters="0")
    fine = pc.and_(pc.match_substring_regex(text, "^[0-9]+$"), pc.less_equal(pc.binary_length(short), 18))
    digits = pc.if_else(pc.and_(fine, pc.greater(pc.binary_length(short), 0)), short, "0")
    return pc.cast(digits, pa.int64()).to_numpy(), fine.to_numpy(zero_copy_only=False)


def parse_block(lines: pa.Array, fmt: _Format) -> tuple[list[pa.Array], np.ndarray]:
    """The typed columns of the records that pass all checks, and which records of the block do."""
    n, width = len(lines), len(fmt.fields)
    parts = pc.split_pattern(lines, "\t", max_splits=width - 1 if fmt.loose else None)
    passed = pc.fill_null(pc.equal(pc.list_value_length(parts), width), False)
    if not pc.all(passed).as_py():
        parts = parts.filter(passed)
    flat, at = parts.flatten(), np.arange(len(parts), dtype=np.int64) * width
    columns = [flat.take(pa.array(at + k)) for k in range(width)]
    (low, low_fine), (high, high_fine) = _positions(columns[fmt.at_start]), _positions(columns[fmt.at_end])
    fine = low_fine & high_fine & (low >= fmt.first) & (high <= MAX_POSITION) & (low + (1 - fmt.first) <= high)
    fine &= pc.match_substring_regex(columns[fmt.at_last], f"^{fmt.pattern}$").to_numpy(zero_copy_only=False)
    if not fine.all():
        columns, low, high = [c.filter(pa.array(fine)) for c in columns], low[fine], high[fine]
    columns[fmt.at_start], columns[fmt.at_end] = pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))
    ok = np.zeros(n, bool)
    ok[np.flatnonzero(passed.to_numpy(zero_copy_only=False))[fine]] = True
    return columns, ok


def isolate(ok: np.ndarray) -> list[int]:
    """Records that fail, by bisection of the blocks that hold some."""
    failures = np.concatenate([[0], np.cumsum(~ok)])
    alone: list[int] = []
    stack = [(0, len(ok))]
    while stack:
        a, b = stack.pop()
        if failures[a] == failures[b]:
            continue
        if failures[b] - failures[a] == b - a:  # nothing in it to keep
            alone += range(a, b)
        else:
            middle = (a + b) // 2
            stack += [(middle, b), (a, middle)]
    return alone


def diagnose(line: str | None, fmt: _Format) -> str | None:
    """Why a single record fails; None if it doesn't."""
    if line is None:
        return "null_line"
    parts = line.split("\t", len(fmt.fields) - 1) if fmt.loose else line.split("\t")
    if len(parts) != len(fmt.fields):
        return "field_count"
    values = []
    for name, k in (("start", fmt.at_start), ("end", fmt.at_end)):
        if not re.fullmatch("[0-9]+", parts[k]):
            return f"{name}_not_digits"
        values.append(int(parts[k]))
    if values[0] < fmt.first:
        return "start_too_small"
    if max(values) > MAX_POSITION:
        return "position_too_large"
    if values[0] + (1 - fmt.first) > values[1]:
        return "start_after_end"
    last = parts[fmt.at_last]
    if not re.fullmatch(fmt.pattern, last):
        if fmt.loose and "\t" in last and not last.startswith('"'):
            return "field_count"
        return f"{fmt.last_field}_quoting" if '"' in last else f"{fmt.last_field}_form"
    return None


def parse_batch(lines: pa.Array, fmt: _Format) -> tuple[list[pa.Array], np.ndarray, np.ndarray, list[str]]:
    """Columns of the valid records, their rows, the rows of the others, and the reasons of those."""
    columns, ok = parse_block(lines, fmt)
    bad = np.asarray(isolate(ok), dtype=np.int64)
    reasons = [diagnose(line, fmt) for line in lines.take(pa.array(bad)).to_pylist()]
    if None in reasons:
        raise AssertionError("the two parsers disagree")
    return columns, np.flatnonzero(ok), bad, reasons


def load_records(lines: DataFrame, fmt: str, line_col: str = "line", keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """``keep`` columns, the typed columns of ``fmt``, ``raw_line`` and ``reason``.

    A valid record has a null ``reason`` and null ``raw_line``; a failing one has its line and
    reason, and nulls in the typed columns.  A narrow operation: no shuffle.
    """
    form = FORMATS[fmt]
    if set(keep) & {*form.fields, "reason", "raw_line"}:
        raise ValueError("columns to keep clash with the typed columns")
    source = lines.select(*keep, F.col(line_col).alias("raw_line")).where(
        F.col("raw_line").isNull() | ~(F.col("raw_line").rlike(r"^\s*$") | F.col("raw_line").rlike(form.skip))
    )
    schema = T.StructType(
        [source.schema[k] for k in keep]
        + [T.StructField(f, T.IntegerType() if f in ("start", "end") else T.StringType()) for f in form.fields]
        + [T.StructField("raw_line", T.StringType()), T.StructField("reason", T.StringType())]
    )
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = pc.cast(batch.column(n_keep), pa.string())
            stripped = pc.replace_substring_regex(raw, "\r$", "")
            columns, rows, bad, reasons = parse_batch(stripped, form)
            for at, typed, tail in (
                (rows, columns, [pa.nulls(len(rows), pa.string())] * 2),
                (bad, [pa.nulls(len(bad), c.type) for c in columns], [raw.take(pa.array(bad)), pa.array(reasons, pa.string())]),
            ):
                if len(at):
                    kept = [batch.column(k).take(pa.array(at)) for k in range(n_keep)]
                    yield pa.RecordBatch.from_arrays([*kept, *typed, *tail], names=names)

    return source.mapInArrow(run, schema)


def valid_records(loaded: DataFrame) -> DataFrame:
    """The records that could be read, without the two diagnostic columns."""
    return loaded.where(F.col("reason").isNull()).drop("raw_line", "reason")


def rejected_records(loaded: DataFrame, keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """``keep``, the raw line and the reason of every record that could not be read."""
    return loaded.where(F.col("reason").isNotNull()).select(*keep, "raw_line", "reason")
