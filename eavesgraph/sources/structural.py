"""Line records with the reason why they fail, found by structural indexing.

A batch of lines is one byte buffer. Byte masks mark white space, delimiters
and quotes; running sums over the masks give the field borders, the number of
fields of a record and, by the parity of the quotes before a byte, whether a
byte stands inside quotes. Nothing loops over rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTING, COLUMNS, VALUE = "quoting", "columns", "value"
NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


@dataclass
class FieldIndex:
    """Fields of a batch: record of each, its bytes, and what quotes it holds."""

    record: np.ndarray
    start: np.ndarray
    end: np.ndarray
    quotes: np.ndarray
    sound_pair: np.ndarray
    is_record: np.ndarray
    first: np.ndarray


def index_fields(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, quoted_delimiters: bool = False) -> FieldIndex:
    """Locate the fields of the records ``buf[starts[i]:ends[i]]``.

    Surrounding blanks, tabs, CR and LF do not belong to a record. Fields are
    parted by runs of blanks and tabs; with ``quoted_delimiters`` those inside
    quotes (an odd number of quotes before them in the record) do not part.
    Empty records and those that begin with ``#`` have no fields.
    """
    n = len(buf)
    blank = (buf == 32) | (buf == 9)
    solid = np.flatnonzero(~(blank | (buf == 13) | (buf == 10)))
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = hi > lo
    s = np.where(full, solid[np.minimum(lo, max(len(solid) - 1, 0))] if len(solid) else 0, 0)
    e = np.where(full, solid[np.maximum(hi - 1, 0)] + 1 if len(solid) else 0, 0)
    is_record = full.copy()
    if n:
        is_record &= buf[np.minimum(s, n - 1)] != 35
    prefix = np.zeros(n + 1, np.int64)
    np.cumsum(buf == 34, out=prefix[1:])
    step = np.zeros(n + 1, np.int8)
    np.add.at(step, s[is_record], 1)
    np.add.at(step, e[is_record], -1)
    inside = np.cumsum(step[:-1]).astype(bool) if n else np.zeros(0, bool)
    order = np.flatnonzero(is_record)
    if quoted_delimiters and len(order):
        at = np.flatnonzero(blank & inside)
        rec = order[np.searchsorted(s[order], at, "right") - 1]
        odd = (prefix[at] - prefix[s[rec]]) % 2 == 1
        blank = blank.copy()
        blank[at[odd]] = False
    part = inside & ~blank
    begins, stops = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[s[order]], stops[e[order]] = True, True
    before = np.concatenate(([False], part[:-1])) if n else part
    after = np.concatenate((part[1:], [False])) if n else part
    f_start = np.flatnonzero(part & (~before | begins[:n]))
    f_end = np.flatnonzero(part & (~after | stops[1:])) + 1
    record = order[np.searchsorted(s[order], f_start, "right") - 1] if len(order) else np.zeros(0, np.int64)
    quotes = prefix[f_end] - prefix[f_start]
    sound = (quotes == 2) & (f_end - f_start >= 2)
    if n:
        sound &= (buf[np.minimum(f_start, n - 1)] == 34) & (buf[f_end - 1] == 34)
    new = np.ones(len(record), bool)
    new[1:] = record[1:] != record[:-1]
    return FieldIndex(record, f_start, f_end, quotes, sound, is_record, new)


def slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string array, gathered at once."""
    length = end - start
    offset = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offset[1:])
    at = np.repeat(start - offset[:-1], length) + np.arange(offset[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offset), pa.py_buffer(np.ascontiguousarray(buf[at])))


def to_numbers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(value, sound) of strings that must be finite ASCII decimal numbers."""
    ok = pc.match_substring_regex(text, NUMBER).to_numpy(zero_copy_only=False).astype(bool)
    value = np.full(len(ok), np.nan)
    sound = np.flatnonzero(ok)
    if len(sound):
        picked = text.take(pa.array(sound))
        size = pc.utf8_length(picked).to_numpy(zero_copy_only=False)
        hard = pc.match_substring_regex(picked, r"[eE+]|\A-?\.|\.\z").to_numpy(zero_copy_only=False).astype(bool) | (size > 300)
        easy = np.flatnonzero(~hard)
        if len(easy):
            value[sound[easy]] = pc.cast(picked.take(pa.array(easy)), pa.float64()).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(hard)
        if len(rest):
            value[sound[rest]] = [float(x) for x in picked.take(pa.array(rest)).to_pylist()]
    return value, np.isfinite(value)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of an Arrow string array; nulls are empty."""
    column = pc.cast(column, pa.large_string())
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    base, top = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    return buf[base:top], offsets[:-1] - base, offsets[1:] - base


def parse_batch(raw: pa.Array, kind: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """(is_record, reason, values) for the lines of a batch.

    kind: 'obj' lines count only if their first field is ``v``, and the fields
    after it are checked; of other kinds all fields are. want: the number of
    fields that a sound record has (negative: none is sound).
    """
    buf, starts, ends = text_buffer(raw)
    ix = index_fields(buf, starts, ends)
    n = len(starts)
    obj = kind == "obj"
    is_record = ix.is_record.copy()
    vertex = np.zeros(n, bool)
    lead = ix.first & (ix.end - ix.start == 1)
    if len(buf):
        lead &= buf[np.minimum(ix.start, len(buf) - 1)] == 118
    vertex[ix.record[lead]] = True
    is_record &= ~obj | vertex
    keep = is_record[ix.record] & ~(ix.first & obj[ix.record]) if len(ix.record) else np.zeros(0, bool)
    rec, fs, fe = ix.record[keep], ix.start[keep], ix.end[keep]
    sound = ix.sound_pair[keep]
    count = np.bincount(rec, minlength=n)
    bad_quote = np.bincount(rec, weights=(ix.quotes[keep] > 0) & ~sound, minlength=n) > 0
    bad_count = count != want
    fs, fe = fs + sound, fe - sound
    check = ~(bad_quote | bad_count)[rec] if len(rec) else np.zeros(0, bool)
    value, ok = to_numbers(slices(buf, fs[check], fe[check]))
    at = rec[check]
    first = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(at, minlength=n), out=first[1:])
    pos = np.arange(len(at)) - first[at]
    with np.errstate(invalid="ignore"):
        ok &= ~((pos >= 3) & (pos <= 5) & ((value < 0) | (value > 255)))
        ok &= ~((pos >= 6) & (value < 0))
    bad_value = np.bincount(at, weights=~ok, minlength=n) > 0
    reason = np.full(n, None, object)
    reason[bad_value], reason[bad_count], reason[bad_quote] = VALUE, COLUMNS, QUOTING
    reason[~is_record] = None
    valid = is_record & (reason == None)  # noqa: E711
    offset = np.zeros(n + 1, np.int32)
    np.cumsum(np.where(valid, count, 0), out=offset[1:])
    values = pa.ListArray.from_arrays(pa.array(offset), pa.array(value[valid[at]] if len(at) else value))
    return is_record, reason, (values, valid)


def parse_lines(lines: DataFrame, columns_of_obj: int = 3) -> DataFrame:
    """Split the lines of text files into sound records and reasoned rejects.

    lines: line_id, file_kind, n_cols, raw, and any of file_path, frame_id,
    line_no, loaded_at; other columns are ignored, so none can clash. Returns
    the rows that are records, with ``values`` (null for a reject) and
    ``reason`` (null for a sound record): ``quoting``, ``columns`` or
    ``value``, the first that applies.

    A null, empty or blank ``raw`` and a comment are no records. A null n_cols
    in a file that is not 'obj' declares no count that could be met, so its
    records fail by ``columns``; a null file_kind is treated as 'xyz'. Repeated
    lines give repeated rows. An empty table gives an empty table.
    """
    carried = [c for c in ("line_id", "file_path", "frame_id", "file_kind", "line_no", "loaded_at") if c in lines.columns]
    src = lines.select(*carried, F.coalesce("file_kind", F.lit("xyz")).alias("_kind"), F.when(F.col("file_kind") == "obj", columns_of_obj).otherwise(F.coalesce("n_cols", F.lit(-1))).cast("int").alias("_want"), "raw")
    fields = [f for f in src.schema.fields if not f.name.startswith("_") and f.name != "raw"]
    schema = T.StructType([*fields, T.StructField("raw", T.StringType()), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("reason", T.StringType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column("raw")
            kind = np.asarray(b.column("_kind").to_pylist(), object)
            is_record, reason, (values, valid) = parse_batch(raw, kind, b.column("_want").to_numpy(zero_copy_only=False))
            values = pc.if_else(pa.array(valid), values, pa.scalar(None, values.type))
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in names), raw, values, pa.array(list(reason), pa.string())], [*names, "raw", "values", "reason"])
            yield out.filter(pa.array(is_record))

    return src.mapInArrow(run, schema)


def rejects(lines: DataFrame) -> DataFrame:
    """The failing lines with their reason."""
    return parse_lines(lines).where("reason is not null").drop("values")


def loaded_points(lines: DataFrame) -> DataFrame:
    """The sound records of 'xyz' files as rows of points; absent channels are null."""
    v = lambda i: F.try_element_at("values", F.lit(i))
    return parse_lines(lines).where("reason is null and (file_kind is null or file_kind <> 'obj')").select("line_id", *[v(i + 1).alias(c) for i, c in enumerate(("x", "y", "z", "r", "g", "b", "nir", "intensity"))])


def loaded_vertices(lines: DataFrame) -> DataFrame:
    """The sound ``v`` records of 'obj' files."""
    return parse_lines(lines).where("reason is null and file_kind = 'obj'").select("line_id", *[F.col("values")[i].alias(c) for i, c in enumerate("xyz")])
