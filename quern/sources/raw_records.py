"""Problem 5: CSV records that fail to parse, told apart from those that load.

A structural index in the manner of simdjson's and csv indexers' bitmaps: over the bytes of a
whole Arrow batch, numpy finds the quotes, the parity of the quotes before every byte tells what
stands inside quotes, and commas and line ends outside are the delimiters. Counting and type
checks then work on the index, never record by record.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.labels import LABELS

FIELDS = ("id", "post_id", "text", "label", "collected_at")
QUOTING, COLUMN_COUNT, INVALID_VALUE = "quoting", "column_count", "invalid_value"
_QUOTE, _COMMA, _LF, _CR = 0x22, 0x2C, 0x0A, 0x0D
# White space as in the Unicode property, as an RE2 class.
_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# ISO 8601 calendar, ordinal and week dates with a time; extended or basic form throughout.
_TIME = r"T(?P<h>\d\d)(?::(?P<m>\d\d)(?::(?P<s>\d\d)(?:[.,]\d+)?)?|(?P<bm>\d\d)(?:(?P<bs>\d\d)(?:[.,]\d+)?)?)?(?:Z|[+-](?P<oh>\d\d)(?::?(?P<om>\d\d))?)?"
_DATE = r"(?P<y>\d{4})(?:-(?P<mo>\d\d)-(?P<d>\d\d)|(?P<bmo>\d\d)(?P<bd>\d\d)|-?(?P<doy>\d{3})|-?W(?P<w>\d\d)-?(?P<wd>[1-7]))"


def iso_8601(values: pa.Array) -> np.ndarray:
    """Whether each string is a valid ISO 8601 date and time; calendar and clock are checked."""
    parts = pc.extract_regex(values, f"^{_DATE}{_TIME}$")
    ok = pc.is_valid(parts).to_numpy(zero_copy_only=False)
    if not ok.any():
        return ok
    parts = parts.fill_null(pa.scalar({f.name: "" for f in parts.type}, parts.type)) if parts.null_count else parts

    def number(*names: str, default: int = 0) -> np.ndarray:
        found = parts.field(names[0])
        for name in names[1:]:  # at most one of them is there
            found = pc.binary_join_element_wise(found, parts.field(name), pa.scalar("", found.type))
        return pc.if_else(pc.equal(found, ""), pa.scalar(str(default), found.type), found).cast(pa.int64()).to_numpy(zero_copy_only=False)

    y = number("y")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    mo, d = number("mo", "bmo", default=1), number("d", "bd", default=1)
    days = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(mo, 1, 12) - 1] + ((mo == 2) & leap)
    ok &= (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= days)
    doy, week = number("doy", default=1), number("w", default=1)
    before = np.maximum(y, 1) - 1
    first_day = (1 + 5 * (before % 4) + 4 * (before % 100) + 6 * (before % 400)) % 7  # of the year; Sunday is 0
    weeks = np.where((first_day == 4) | (leap & (first_day == 3)), 53, 52)
    ok &= (doy >= 1) & (doy <= 365 + leap) & (week >= 1) & (week <= weeks)
    h, m, s = number("h"), number("m", "bm"), number("s", "bs")
    midnight = (h == 24) & (m == 0) & (s == 0)
    return ok & ((h <= 23) | midnight) & (m <= 59) & (s <= 60) & (number("oh") <= 23) & (number("om") <= 59)


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[start:end] as one Arrow array."""
    lengths = np.maximum(ends - starts, 0)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[index])))


def index_records(raw: pa.Array, columns: int = len(FIELDS)) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Per record: whether its quoting is broken, its number of fields, and (for records with ``columns`` fields) the fields.

    A line end after the last field is not part of the record; other line ends outside quotes are
    broken quoting, as fields with line breaks must be quoted.
    """
    raw = pc.fill_null(raw.cast(pa.large_string()), "")
    n = len(raw)
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] else np.zeros(0, np.uint8)
    begin, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    # line ends that only end the record
    end = end.copy()
    for char in (_LF, _CR):
        has = end > begin
        last = np.zeros(n, dtype=bool)
        last[has] = data[end[has] - 1] == char
        end -= last
    size = len(data)
    record = np.repeat(np.arange(n), offsets[1:] - offsets[:-1])
    inside_record = np.zeros(size, dtype=bool)
    position = np.arange(size)
    if size:
        inside_record = position < end[record]
    quote = (data == _QUOTE) & inside_record
    before = np.cumsum(quote) - quote  # quotes before each byte
    at_start = np.zeros(n, dtype=np.int64)
    full = begin < size
    at_start[full] = before[begin[full]]
    at_start[~full] = quote.sum()
    inside = ((before - at_start[record]) & 1).astype(bool) if size else inside_record
    total = np.bincount(record[quote], minlength=n)
    broken = (total & 1).astype(bool)
    comma = (data == _COMMA) & ~inside & inside_record
    broken |= np.bincount(record[((data == _LF) | (data == _CR)) & ~inside & inside_record], minlength=n).astype(bool)
    if size:
        first = position == begin[record]
        last = position == end[record] - 1
        previous, following = np.empty_like(data), np.empty_like(data)
        previous[0], previous[1:] = 0, data[:-1]
        following[-1], following[:-1] = 0, data[1:]
        after_comma = np.zeros(size, dtype=bool)
        after_comma[1:] = comma[:-1]
        # an opening quote stands at the start of a field or right after a closing one (a doubled quote)
        opening = quote & ~inside
        bad = opening & ~first & ~after_comma & (previous != _QUOTE)
        # a closing quote is followed by a comma, the end or another quote
        closing = quote & inside
        bad |= closing & ~last & (following != _COMMA) & (following != _QUOTE)
        broken |= np.bincount(record[bad], minlength=n).astype(bool)
    count = np.bincount(record[comma], minlength=n) + 1
    good = np.flatnonzero(~broken & (count == columns))
    commas = np.flatnonzero(comma & np.isin(record, good)) if len(good) else np.zeros(0, np.int64)
    cuts = commas.reshape(len(good), columns - 1)
    fields = []
    for k in range(columns):
        s = begin[good] if k == 0 else cuts[:, k - 1] + 1
        e = end[good] if k == columns - 1 else cuts[:, k]
        quoted = np.zeros(len(good), dtype=bool)
        some = e > s
        quoted[some] = data[s[some]] == _QUOTE
        values = _gather(data, s + quoted, e - quoted)
        fields.append(pc.replace_substring(values, '""', '"') if quoted.any() else values)
    return broken, count, fields


def record_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the records in the bytes of a CSV file: a record ends at a line end before which the quotes are even.

    The line end (LF, CR LF or CR) belongs to no record; blank lines are records without content.
    An unclosed quote makes the rest of the file one record.
    """
    even = (np.cumsum(data == _QUOTE) & 1) == 0
    lf, cr = (data == _LF) & even, (data == _CR) & even
    paired = np.zeros(len(data), dtype=bool)
    paired[:-1] = cr[:-1] & lf[1:]
    last = np.flatnonzero(lf | (cr & ~paired))
    ends = last - ((last > 0) & lf[last] & cr[last - 1])
    starts = np.concatenate(([0], last + 1))
    ends = np.concatenate((ends, [len(data)]))
    return (starts[:-1], ends[:-1]) if starts[-1] == len(data) else (starts, ends)


def read_raw_files(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(file_key, row_number, raw) of CSV files: their records as they stand, to be parsed by :func:`parse_records`.

    A file is read by one task, as whether a line end ends a record depends on all quotes before
    it; many files are read in parallel. Bytes that are no UTF-8 come as U+FFFD, a byte order mark
    is dropped, and with ``header`` the first record; row_number counts the others from 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = np.frombuffer(content.as_buffer(), dtype=np.uint8)
                data = data[3:] if data[:3].tobytes() == b"\xef\xbb\xbf" else data
                starts, ends = (x[1:] if header else x for x in record_bounds(data))
                raw = pa.array([data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts, ends)], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(raw), pa.string()), pa.array(np.arange(1, len(raw) + 1), pa.int32()), raw], ["file_key", "row_number", "raw"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_key"), "content")
    return files.mapInArrow(run, "file_key string, row_number int, raw string")


def _as_bool(x: pa.Array) -> np.ndarray:
    return np.asarray(x.to_numpy(zero_copy_only=False), dtype=bool)


def check_values(fields: Sequence[pa.Array], labels: Sequence[str] = LABELS) -> np.ndarray:
    """Whether each record of the five fields holds an invalid value."""
    ident, post, text, label, when = fields
    edge = f"^{_SPACE}|{_SPACE}$"
    bad = np.zeros(len(ident), dtype=bool)
    for key in (ident, post):
        bad |= _as_bool(pc.equal(key, "")) | _as_bool(pc.match_substring_regex(key, edge))
    bad |= _as_bool(pc.match_substring_regex(text, f"^{_SPACE}*$")) | _as_bool(pc.match_substring(text, "�"))
    bad |= ~_as_bool(pc.is_in(label, value_set=pa.array(["", *labels], label.type)))
    return bad | ~iso_8601(when)


def parse_records(raw_rows: DataFrame, raw: str = "raw", keep: Sequence[str] = ("file_key", "row_number")) -> DataFrame:
    """The columns ``keep``, the five fields and ``reason``, one row per input row.

    Valid records have their fields and a NULL reason; others have NULL fields and the first of
    quoting, column_count and invalid_value that holds. A NULL or empty record has one empty
    field, so its reason is column_count. The fields are compared and kept as they are. Nothing
    is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            broken, count, fields = index_records(b.column(b.num_columns - 1))
            n = b.num_rows
            reason = np.full(n, None, dtype=object)
            wrong = count != len(FIELDS)
            good = np.flatnonzero(~broken & ~wrong)
            invalid = check_values(fields)
            reason[good[invalid]] = INVALID_VALUE
            reason[wrong] = COLUMN_COUNT
            reason[broken] = QUOTING
            # place the fields of valid records
            take = np.full(n, -1)
            take[good[~invalid]] = np.flatnonzero(~invalid)
            at = pa.array(take, mask=take < 0)
            out = [f.take(at).cast(pa.string()) for f in fields]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out, pa.array(reason, pa.string())], [*b.schema.names[:-1], *FIELDS, "reason"])

    src = raw_rows.select(*keep, F.col(raw).alias("_raw"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, ddl + "".join(f", {f} string" for f in FIELDS) + ", reason string")


def rejected_rows(raw_rows: DataFrame) -> DataFrame:
    """(file_key, row_number, reason) of the records that don't load; a repeated row is given once."""
    return parse_records(raw_rows).where("reason IS NOT NULL").select("file_key", "row_number", "reason").distinct()


def loaded_rows(raw_rows: DataFrame) -> DataFrame:
    """The records that load, as comments: id, post_id, text, label, collected_at, file_key, row_number."""
    return parse_records(raw_rows).where("reason IS NULL").select(*FIELDS, "file_key", "row_number")
