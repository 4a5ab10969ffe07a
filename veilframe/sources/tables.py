"""Reading and writing tables; delimiter detection and structure checks of delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources import records

DELIMITERS = [",", ";", "\t", "|"]


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, max_rows: int | None = None, encoding: str = "UTF-8",
    line_breaks: bool = True, sample_lines: int | None = None, reject: str | None = None, position: str | None = None,
) -> DataFrame:
    """Text with a header in each file, every cell a string; a quote within quotes is doubled.

    The delimiter is detected if not given, from all lines or the first `sample_lines`. Cells may hold line breaks, and files are
    still read in parallel (`sources/records.py`). `reject` names a column with the whole record where it has fewer or more fields than the header.
    `position` names a column with the number of the record, from 0, through all files in the order of their paths: a key for tables
    without one, which holds as long as the files are not rewritten. `line_breaks=False` takes every line as a record, by Spark's own
    reader; so does another encoding than UTF-8, which has one task per file if cells may hold line breaks.
    """
    sep = sep or detect_delimiter(spark, path, sample_lines=sample_lines)
    own = encoding.upper() in ("UTF-8", "UTF8") and line_breaks
    if not own and (reject or position):
        raise ValueError("rejects and positions need UTF-8 and records with line breaks")
    # the header of one file; nothing behind it is read
    read = {"header": True, "sep": sep, "encoding": encoding, "inferSchema": False, "escape": '"'}
    df = spark.read.csv(path, multiLine=line_breaks, **read)
    if not df.columns:
        raise ValueError(f"{path} has no header")
    if own:
        names = df.columns
        rows = records.records(spark, path, sep).where("nr > 0")
        if position:
            rows = rows.join(F.broadcast(records.file_offsets(spark, path, sep)), "file").withColumn("nr", F.col("first") + F.col("nr") - 1)
        rows = rows.select("nr", records.parsed(F.col("record"), len(names), sep).alias("r"))
        out = [F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)]
        df = rows.select(*out, *([F.col("r.reject").alias(reject)] if reject else []), *([F.col("nr").alias(position)] if position else []))
    return df if max_rows is None else df.limit(max_rows)


def read_table(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """A parquet table, typed by its schema."""
    df = spark.read.parquet(path)
    return df if max_rows is None else df.limit(max_rows)


def with_file_key(df: DataFrame, name: str = "file_key") -> DataFrame:
    """Add the position of each row in its parquet file, a key for tables that have none.

    It needs no shuffle and no sort. It holds as long as the files are not rewritten.
    """
    return df.withColumn(name, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"))


def write_delimited(df: DataFrame, path: str, sep: str = ",", columns: Sequence[str] | None = None) -> None:
    """Delimited text with a header in each file, columns in the given order."""
    out = df if columns is None else df.select(*columns)
    out.write.csv(path, header=True, sep=sep, escape='"', mode="errorifexists")


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    out = df if columns is None else df.select(*columns)
    out.write.parquet(path, mode="errorifexists")


def _fields(line: Column, sep: str) -> Column:
    """Number of fields of a line; quoted parts do not count."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.char_length(bare) - F.char_length(F.replace(bare, F.lit(sep), F.lit(""))) + F.lit(1)


def delimiter_statistics(
    spark: SparkSession,
    path: str,
    candidates: Sequence[str] = DELIMITERS,
    sample_lines: int | None = None,
) -> DataFrame:
    """(delimiter, lines, min_fields, max_fields) of each candidate, in one pass.

    `sample_lines` looks at the first lines only, which opens no more files than it must.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if sample_lines is not None:
        lines = spark.createDataFrame(lines.take(sample_lines), "value string")
    counts = lines.select([_fields(F.col("value"), d).alias(f"d{i}") for i, d in enumerate(candidates)])
    wide = counts.agg(
        F.count(F.lit(1)).alias("lines"),
        *[F.min(f"d{i}").alias(f"min{i}") for i in range(len(candidates))],
        *[F.max(f"d{i}").alias(f"max{i}") for i in range(len(candidates))],
    )
    rows = [
        F.struct(
            F.lit(d).alias("delimiter"), F.col("lines"),
            F.col(f"min{i}").alias("min_fields"), F.col(f"max{i}").alias("max_fields"),
        )
        for i, d in enumerate(candidates)
    ]
    return wide.select(F.inline(F.array(*rows)))


def detect_delimiter(
    spark: SparkSession,
    path: str,
    candidates: Sequence[str] = DELIMITERS,
    sample_lines: int | None = None,
) -> str:
    """The candidate that splits every line (or the first `sample_lines`) into the same number of fields, the more the better.

    Where no candidate does, the one with the most fields in every line; else a comma.
    """
    rows = delimiter_statistics(spark, path, candidates, sample_lines).where("min_fields > 1").collect()
    some = [r for r in rows if r["min_fields"] == r["max_fields"]] or rows
    if not some:
        return ","
    return max(some, key=lambda r: r["min_fields"])["delimiter"]


def structure_issues(spark: SparkSession, path: str, columns: Sequence[str], sep: str) -> DataFrame:
    """One row per broken rule of a ragged record: (severity, check, row_key, found).

    `row_key` is the raw record, with the line breaks of its quoted cells. Blank lines and the header of each file are no records.
    """
    rows = records.records(spark, path, sep).where("nr > 0").withColumnRenamed("record", "value")
    found, expected = _fields(F.col("value"), sep), len(columns)
    rules = [
        (found != expected, "error", "column_count"),
        (found < expected, "error", "missing_columns"),
        (found > expected, "warning", "extra_columns"),
    ]
    broken = F.array_compact(F.array(*[
        F.when(rule, F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check")))
        for rule, severity, check in rules
    ]))
    return rows.select(F.col("value").alias("row_key"), found.alias("found"), F.inline(broken)).select(
        "severity", "check", "row_key", "found"
    )
