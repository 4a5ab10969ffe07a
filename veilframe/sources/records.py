"""Records of delimited text, cut in parallel: a quoted cell may hold line breaks, and records are numbered without a sort.

A file is read as lines, in the ranges of bytes that Spark deals to its tasks. Whether a line begins a record depends on
whether a quoted cell is open there, which a range alone cannot tell. So a first pass takes each range under both
assumptions and reports one row: where the cell stands at its end, and how many records begin in it. A prefix over these
rows, one per range, says how each range really begins and how many records precede it. The second pass cuts the lines into
records; a record that runs over the end of a range is put together from its parts, at most two rows per range.
No line is shuffled for this, no file is one task, and no RDD is needed.

A cell is quoted if its first character is a quote; inside, a quote is doubled. A quote elsewhere in a cell is an ordinary character.
Lines end with a line feed; a carriage return before it is dropped at the end of a record. Blank lines between records are skipped. The first
record of each file is its header. A quoted cell that is never closed reaches to the end of its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ends_open(line: str, sep: str, is_open: bool) -> bool:
    """Whether a quoted cell is open at the end of a line, given whether one is at its begin."""
    at = 0
    while True:
        if is_open:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            at = line.find(sep, at + 1)
            if at < 0:
                return False
            at += len(sep)
            is_open = False
        if not line.startswith('"', at):
            at = line.find(f'{sep}"', at)
            if at < 0:
                return False
            at += len(sep)
        at, is_open = at + 1, True


def open_before(lines: pa.Array, sep: str, is_open: bool) -> tuple[np.ndarray, bool]:
    """Whether a cell is open before each line, and after the last one; only lines with quotes are looked at."""
    out, at = np.empty(len(lines), bool), 0
    for k in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist():
        out[at : k + 1] = is_open
        is_open, at = ends_open(lines[k].as_py(), sep, is_open), k + 1
    out[at:] = is_open
    return out, is_open


def _blank(lines: pa.Array) -> np.ndarray:
    return pc.equal(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of one range each, and whether the range is new; a task reads its ranges one after another."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = (file[a], start[a])
            yield now != last, batch.slice(a, b - a)
            last = now


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file (a hash of its path) and start (first byte of the range) of every line."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def ranges(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, start, is_open (whether a cell is open where the range begins), ends_open, before (records of the file in earlier ranges) and n (records that begin here).

    One row per range of a file, as many as Spark itself lists when it plans the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for fresh, part in _by_range(batches):
            if fresh:
                if now:
                    yield reported(now)
                now = [part.column("file")[0].as_py(), part.column("start")[0].as_py(), [False, True], [0, 0]]
            lines = part.column("value")
            full = ~_blank(lines)
            for k in (0, 1):
                before, now[2][k] = open_before(lines, sep, now[2][k])
                now[3][k] += int((full & ~before).sum())
        if now:
            yield reported(now)

    def reported(now: list) -> pa.RecordBatch:
        file, start, ends, n = now
        cells = [(file, pa.int64()), (start, pa.int64()), (ends[0], pa.bool_()), (ends[1], pa.bool_()), (n[0], pa.int64()), (n[1], pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in cells], ["file", "start", "end0", "end1", "n0", "n1"])

    made = _lines(spark, path).mapInArrow(run, "file long, start long, end0 boolean, end1 boolean, n0 long, n1 long")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start")
    # a range sets the state, keeps it, or flips it: the last one that sets it counts, and the flips since
    sets, flips = F.col("end0") == F.col("end1"), (F.col("end0") & ~F.col("end1")).cast("int")
    made = made.withColumn("flips", F.sum(flips).over(upto)).withColumn("was", F.last(F.when(sets, F.struct("end0", "flips")), ignorenulls=True).over(earlier))
    all_flips = F.coalesce(F.lag("flips").over(upto), F.lit(0))
    since = all_flips - F.coalesce(F.col("was.flips"), F.lit(0))
    is_open = F.coalesce(F.col("was.end0"), F.lit(False)) != (since % 2 == 1)
    made = made.withColumn("is_open", is_open)
    n = F.when(F.col("is_open"), F.col("n1")).otherwise(F.col("n0"))
    made = made.withColumns({"n": n, "ends_open": F.when(F.col("is_open"), F.col("end1")).otherwise(F.col("end0"))})
    return made.select("file", "start", "is_open", "ends_open", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), "n")


def _cut(lines: DataFrame, sep: str) -> DataFrame:
    """file, start, nr (in its range; -1: what belongs to an earlier record), ends (whether the record ends here) and record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_open, nr, rest, at = False, -1, None, None  # rest: lines of the record that is not yet whole

        def whole(records: pa.Array, ends: bool) -> pa.RecordBatch:
            n = len(records)
            cells = [pa.array([at[0]] * n, pa.int64()), pa.array([at[1]] * n, pa.int64()), pa.array(np.arange(nr, nr + n)), pa.array([ends] * n, pa.bool_()), records]
            return pa.RecordBatch.from_arrays(cells, names)

        def last() -> Iterator[pa.RecordBatch]:
            if rest is not None:
                yield whole(pc.binary_join(pa.array([rest.to_pylist()], pa.list_(pa.string())), "\n"), not is_open)

        for fresh, part in _by_range(batches):
            if fresh:
                yield from last()
                at = (part.column("file")[0].as_py(), part.column("start")[0].as_py())
                is_open, rest = part.column("is_open")[0].as_py(), None
                nr = -1 if is_open else 0
            lines = part.column("value")
            before, is_open = open_before(lines, sep, is_open)
            kept = before | ~_blank(lines)
            lines, before = lines.filter(pa.array(kept)), before[kept]
            begins = np.flatnonzero(~before)
            if not len(lines):
                continue
            if not len(begins):
                rest = lines if rest is None else pa.concat_arrays([rest, lines])
                continue
            head = lines.slice(0, begins[0])
            rest = head if rest is None else pa.concat_arrays([rest, head])
            if len(rest):
                yield whole(pc.binary_join(pa.array([rest.to_pylist()], pa.list_(pa.string())), "\n"), True)
                nr += 1
            elif nr < 0:
                nr = 0
            body = lines.slice(begins[0], begins[-1] - begins[0])
            if len(body) == len(begins) - 1:  # every line is a record
                made = body
            else:
                made = pc.binary_join(pa.ListArray.from_arrays(pa.array(begins - begins[0], pa.int32()), body), "\n")
            if len(made):
                yield whole(made, True)
                nr += len(made)
            rest = lines.slice(begins[-1])
        yield from last()

    names = ["file", "start", "nr", "ends", "record"]
    return lines.mapInArrow(run, "file long, start long, nr long, ends boolean, record string")


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, nr (in the file, its header is 0) and record, the text of each record, in no order."""
    # one row per range, as in the list of files that the driver plans from
    known = ranges(spark, path, sep)
    lines = _lines(spark, path).join(F.broadcast(known), ["file", "start"])
    columns = ["value", "file", "start", "is_open"]
    cut = _cut(lines.select(*columns), sep)
    own = known.select("file", "start", "before")
    whole = cut.where("ends AND nr >= 0")
    # parts of records that run over the end of a range; nothing to read where no range ends inside a cell
    split = _cut(lines.where("is_open OR ends_open").select(*columns), sep).where("NOT ends OR nr < 0")
    along = Window.partitionBy("file").orderBy("start", "nr")
    split = split.withColumn("owner", F.sum((F.col("nr") >= 0).cast("int")).over(along))
    parts = F.array_sort(F.collect_list(F.struct("start", "nr", "record")))
    joined = split.groupBy("file", "owner").agg(parts.alias("parts")).select(
        "file", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["nr"].alias("nr"),
        F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"),
    )
    every = whole.select("file", "start", "nr", "record").unionAll(joined)
    bare = F.when(F.endswith("record", F.lit("\r")), F.substring("record", F.lit(1), F.char_length("record") - 1)).otherwise(F.col("record"))
    return every.join(F.broadcast(own), ["file", "start"]).select("file", (F.col("before") + F.col("nr")).alias("nr"), bare.alias("record"))


def file_offsets(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file and first, the number of records (without headers) of the files before it in the order of their paths."""
    counts = ranges(spark, path, sep).groupBy("file").agg(F.sum("n").alias("n"))
    # a listing only: no content is read
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    names = listed.select("path", F.xxhash64("path").alias("file"))
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    rows = F.greatest(F.coalesce(F.col("n"), F.lit(0)) - 1, F.lit(0))
    return names.join(counts, "file", "left").select("file", F.coalesce(F.sum(rows).over(order), F.lit(0)).alias("first"))


def parsed(record: Column, width: int, sep: str) -> Column:
    """c0, c1, … and reject: the record itself if it has not as many fields as the header."""
    schema = ", ".join([*[f"c{i} string" for i in range(width)], "reject string"])
    return F.from_csv(record, schema, {"sep": sep, "escape": '"', "columnNameOfCorruptRecord": "reject", "mode": "PERMISSIVE"})
