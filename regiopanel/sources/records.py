"""CSV records from text that is read in parallel splits (SRC-1..4, SRC-5, WN-8).

A line break inside quotes belongs to its record, and where a split begins nobody
knows whether a quote is open.  So the text is read as plain lines, in splits, once:

1. *Scan.*  Every split is walked once for both cases, "a quote is open at its first
   line" and "none is".  A line without quotes leaves the state as it is; the others
   run through the reader's four states (field start, plain field, quoted field, quote
   in a quoted field), written as a regular expression for each case, which is exact also
   for quotes inside plain fields, where the parity of quotes is not.  The lines are staged with their state before and after
   and their running record number, in both cases.
2. *Prefix scan.*  A split maps the state at its start to the one at its end: it keeps
   it, flips it, or sets it.  Windows over one row per split give each split's true
   start state and the number of records before it.
3. *Cut.*  The lines of a record that lie next to each other in a batch are joined there.
   Only the pieces of records that go over the end of a batch or a split are shuffled, to
   be joined in order.  The records are staged once.

Every record gets its number in its file, the header being 1, and ``_row``, one long
that orders all records of an import: file number, then record number.  Files are in
the order of their names.  Each file's own header names its columns.

Lines end with a line feed; a carriage return before it goes, and one inside quotes
stays.  Empty lines between records count as no record.  A quote that never closes
takes the rest of its file; a record of more than ``max_record_bytes`` is an error, as
it would end up in one task.
"""

from __future__ import annotations

import csv
import io
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regiopanel.session import stage_table

RECORD_BITS = 42               # of _row; the bits above hold the file number
MAX_FILES = 1 << 21
MAX_HEADERS = 1000
MAX_RECORD_BYTES = 16 << 20
_LINES = ("file string, block long, line long, value string, open0 boolean, open1 boolean, after0 boolean, "
          "after1 boolean, rec0 long, rec1 long")


class ImportRejected(ValueError):
    """Whole-file rejection (unknown dataset type, missing columns, a runaway quote)."""


# From a field's start to a quoted field, and from a quoted field to one, as expressions:
# _IN stays in it, _NEXT goes on to the next field's start.
_IN = r'(?:[^"]|"")*'
_NEXT = r'(?:[^",][^,]*)?,'
_FIELDS = rf'(?:(?:"{_IN}")?{_NEXT})*'
_OPENS = rf'^{_FIELDS}"{_IN}$'
_STAYS = rf'^{_IN}(?:"{_NEXT}{_FIELDS}"{_IN})?$'


def ends_open(line: bytes, is_open: bool) -> bool:
    """Is a quoted field open behind this line?  ``is_open``: was one before it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.match_substring_regex(pa.array([line], pa.binary()), _STAYS if is_open else _OPENS)[0].as_py()


def _after(opens, stays, start: bool):
    """Is a quoted field open behind each line?  ``opens``, ``stays``: whether one is
    behind the line if none or one was before it; ``start``: was one before the first."""
    import numpy as np

    flips = np.cumsum(opens & ~stays)
    at = np.maximum.accumulate(np.where(opens == stays, np.arange(len(opens)), -1))  # the last line that sets it
    fixed = at >= 0
    turns = flips - np.where(fixed, flips[at], 0) + np.where(fixed, opens[at], start)
    return turns % 2 == 1


def _walk(batches):
    """Lines of one task, in order, with their states in both cases."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    at, state, seen, n = None, [False, True], [0, 0], 0
    for b in batches:
        files, blocks = b.column("file"), b.column("block").to_numpy(zero_copy_only=False)
        values = b.column("value").cast(pa.binary())
        codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(blocks)]):
            if hi == lo:
                continue
            key = (files[int(lo)].as_py(), int(blocks[lo]))
            if key != at:
                at, state, seen, n = key, [False, True], [0, 0], 0
            part = values.slice(lo, hi - lo)
            size = len(part)
            opens, stays = (pc.match_substring_regex(part, x).to_numpy(zero_copy_only=False) for x in (_OPENS, _STAYS))
            empty = pc.or_(pc.equal(pc.binary_length(part), 0), pc.equal(part, b"\r")).to_numpy(zero_copy_only=False)
            before, after, records = [], [], []
            for h in (0, 1):
                after.append(_after(opens, stays, state[h]))
                before.append(np.concatenate([[state[h]], after[h][:-1]]))
                records.append(np.cumsum(~before[h] & ~empty) + seen[h])
                state[h], seen[h] = bool(after[h][-1]), int(records[h][-1])
            yield pa.RecordBatch.from_arrays(
                [files.slice(lo, size), pa.array(blocks[lo:hi]), pa.array(np.arange(n, n + size)), b.column("value").slice(lo, size),
                 *map(pa.array, (*before, *after, *records))],
                ["file", "block", "line", "value", "open0", "open1", "after0", "after1", "rec0", "rec1"])
            n += size


def _cut(max_record_bytes: int):
    """Joins neighbouring lines of a record; ``whole`` is false for a piece that goes on
    before or behind its batch, and for a record over the limit."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            value = b.column("value")
            part = pc.or_(b.column("open"), b.column("after"))
            b = b.filter(pc.or_(part, pc.invert(pc.is_in(value, value_set=pa.array(["", "\r"], value.type)))))
            if not len(b):
                continue
            block, line, record, open_, after = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "line", "record", "open", "after"))
            file = b.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.ones(len(b), bool)
            first[1:] = (record[1:] != record[:-1]) | (line[1:] != line[:-1] + 1) | (block[1:] != block[:-1]) | (file[1:] != file[:-1])
            at = np.flatnonzero(first)
            ends = np.append(at[1:], len(b))
            lines = pa.ListArray.from_arrays(pa.array(np.append(at, len(b)), pa.int32()), b.column("value").cast(pa.string()))
            text = pc.binary_join(lines, "\n")
            size = pc.binary_length(text).to_numpy(zero_copy_only=False) + 1
            whole = ~open_[at] & ~after[ends - 1] & (size <= max_record_bytes)
            heads = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*(heads.column(c) for c in ("file", "record", "block", "line")), text, pa.array(whole)],
                                             ["file", "record", "block", "line", "text", "whole"])

    return run


@contextmanager
def _split_size(spark: SparkSession, split_bytes: int | None):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys if split_bytes else ():
            spark.conf.set(k, str(split_bytes))
        yield
    finally:
        for k in keys if split_bytes else ():
            spark.conf.set(k, old[k]) if old[k] is not None else spark.conf.unset(k)


def scan_lines(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Step 1, staged: the input is read here and nowhere else."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    with _split_size(spark, split_bytes):
        return stage_table(lines.mapInArrow(_walk, _LINES), "csv-lines")


def resolve_splits(lines: DataFrame) -> DataFrame:
    """Step 2: (file, block, is_open, before, file_records): each split's start state,
    the records that start before it in its file, and those of the whole file."""
    splits = lines.groupBy("file", "block").agg(
        F.max_by("after0", "line").alias("f0"), F.max_by("after1", "line").alias("f1"),
        F.max("rec0").alias("n0"), F.max("rec1").alias("n1"))
    order = Window.partitionBy("file").orderBy("block")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    flips = splits.withColumn("flips", F.sum(F.when(F.col("f0") & ~F.col("f1"), 1).otherwise(0)).over(order))
    sets = F.when(F.col("f0") == F.col("f1"), F.struct(F.col("f0").cast("int").alias("to"), "flips"))
    known = flips.select("*", F.last(sets, ignorenulls=True).over(above).alias("set"),
                         F.coalesce(F.last("flips").over(above), F.lit(0)).alias("done"))
    turns = F.col("done") - F.coalesce("set.flips", F.lit(0)) + F.coalesce("set.to", F.lit(0))
    known = known.withColumn("is_open", turns % 2 == 1)
    n = F.when(F.col("is_open"), F.col("n1")).otherwise(F.col("n0"))
    return known.select("file", "block", "is_open", F.coalesce(F.sum(n).over(above), F.lit(0)).alias("before"),
                        F.sum(n).over(Window.partitionBy("file")).alias("file_records"))


def number_files(splits: DataFrame) -> DataFrame:
    """(file, file_no, file_records, records_before): one row per file, in name order."""
    files = splits.groupBy("file").agg(F.max("file_records").alias("file_records"))
    names = Window.orderBy("file")                   # one row per file, not per record
    above = names.rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", (F.row_number().over(names) - 1).alias("file_no"), "file_records",
                        F.coalesce(F.sum(F.greatest(F.col("file_records") - 1, F.lit(0))).over(above), F.lit(0)).alias("records_before"))


def _small(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A staged table of one row per file or split: broadcast up to a size."""
    return F.broadcast(df) if df.count() <= most_rows else df


class CsvRecords:
    """The records of a CSV file, a folder of files or a glob."""

    def __init__(self, spark: SparkSession, path: str, split_bytes: int | None = None,
                 max_record_bytes: int = MAX_RECORD_BYTES):
        self.spark, self.max_record_bytes = spark, max_record_bytes
        self.lines = scan_lines(spark, path, split_bytes)
        splits = stage_table(resolve_splits(self.lines), "csv-splits")
        self.files = stage_table(number_files(splits), "csv-files")
        if self.files.count() > MAX_FILES:
            raise ImportRejected(f"More than {MAX_FILES} files in one import")
        self._splits = _small(splits.select("file", "block", "is_open", "before"))
        self._files = _small(self.files)
        cut = self._resolved().mapInArrow(_cut(max_record_bytes), "file string, record long, block long, line long, text string, whole boolean")
        self.cut = stage_table(cut, "csv-records", "whole")
        self.headers = self._headers()

    def _resolved(self) -> DataFrame:
        pick = lambda c: F.when(F.col("is_open"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
        return self.lines.join(self._splits, ["file", "block"]).select(
            "file", "block", "line", "value", pick("open").alias("open"), pick("after").alias("after"),
            (F.col("before") + pick("rec")).alias("record"))

    def texts(self) -> DataFrame:
        """(file, record, text) of all records, headers included (step 3)."""
        own = F.regexp_replace("text", "\r$", "").alias("text")
        whole = self.cut.where("whole").select("file", "record", own)
        parts = self.cut.where("not whole")
        if parts.isEmpty():
            return whole
        worst = parts.groupBy("file", "record").agg(F.sum(F.octet_length("text") + 1).alias("n")) \
            .agg(F.max(F.struct("n", "file", "record")).alias("w")).first().w
        if worst.n > self.max_record_bytes:
            raise ImportRejected(f"Record {worst.record} of {worst.file} has {worst.n} bytes: a quote in it is never closed")
        joined = parts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "line", "text"))).alias("p"))
        return whole.unionByName(joined.select("file", "record", F.array_join("p.text", "\n").alias("text")).select("file", "record", own))

    def _headers(self) -> list[tuple[int, list[str], DataFrame]]:
        """(number, columns, files with it) of each distinct header."""
        # the lines of record 1 are at most max_record_bytes of each file
        first = self.texts().where("record = 1").select("file", F.regexp_replace("text", "^﻿", "").alias("header"))
        first = stage_table(first, "csv-headers")
        distinct = sorted(r.header for r in first.select("header").distinct().limit(MAX_HEADERS + 1).collect())
        if len(distinct) > MAX_HEADERS:
            raise ImportRejected(f"More than {MAX_HEADERS} different headers in one import")
        return [(i, next(csv.reader(io.StringIO(h, newline="\n")), []), first.where(F.col("header") == h).select("file"))
                for i, h in enumerate(distinct)]

    def rows(self, columns: list[str], files: DataFrame | None = None) -> DataFrame:
        """Records parsed with these columns: ``_row``, ``_malformed`` (too few or too
        many fields) and the columns as text, by their last place where a name repeats."""
        texts = self.texts().where("record > 1")
        if files is not None:
            texts = texts.join(_small(files), "file", "left_semi")
        texts = texts.join(self._files, "file") \
            .select((F.col("file_no").cast("long") * (1 << RECORD_BITS) + F.col("record")).alias("_row"), "text")
        schema = ", ".join([f"c{i} string" for i in range(len(columns))] + ["_corrupt_record string"])
        parsed = texts.select("_row", F.from_csv("text", F.lit(schema), {
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "escape": '"', "maxCharsPerColumn": "-1",
            "maxColumns": "100000"}).alias("r"))
        last = {c: i for i, c in enumerate(columns)}
        return parsed.select("_row", F.col("r._corrupt_record").isNotNull().alias("_malformed"),
                             *[F.col(f"r.c{last[c]}").alias(c) for c in last])

    def ordinals(self, df: DataFrame) -> DataFrame:
        """``df``, which has ``_row``, with ``ordinal``: the record's place among all
        records of the import, from 1."""
        return df.join(_small(self.files.select(F.col("file_no").alias("_no"), "records_before")),
                       F.shiftright("_row", RECORD_BITS) == F.col("_no")) \
            .withColumn("ordinal", F.col("records_before") + F.col("_row").bitwiseAND((1 << RECORD_BITS) - 1) - 1).drop("_no", "records_before")
