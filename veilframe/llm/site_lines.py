"""Line dedup by site-relative frequency, in DataFrame operations only.

Pages are grouped by host. A line is boilerplate of a host if the share of the host's pages that contain it exceeds `ratio`; its occurrences
are dropped on all pages of that host. A line of one page is no repetition, so two pages are the least (`least`). Lines are compared without
white space at their ends; lines without any text are kept.

Lines travel as two 64-bit hashes. Counts are combined before each shuffle, so that a line on a third of all pages
is one row per task. The boilerplate meets the line hashes in a join by host and line; the lines of one page that are dropped come
together as an array, and meet the text once, by a hash of the page.

Defined cases: a NULL host is a host of its own; NULL text has no lines and stays NULL; an empty text stays. Repeated rows are
one page of their host (NULL texts too), in the count of a line and of the host alike, so that many exact copies do not make boilerplate of
their own lines; near copies still count each. With `once=False` every row is a page. The decision depends on host and line only, so rows with equal keys are treated alike. A page may lose all
lines; its text is then empty. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.05
#: A line of one page is no repetition.
REPEATED = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash_of(value: Column) -> Column:
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(value, F.lit(1)).alias("b"))


def _hash(line: Column) -> Column:
    return _hash_of(F.trim(line, F.lit(" \t\r\x0b\x0c")))


def _counted(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c")) != ""


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = REPEATED, once: bool = True) -> DataFrame:
    """host, the hashes of a line, pages with it and pages of the host, for lines beyond the ratio."""
    slim = pages.select(F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").cast("string").alias("text"))
    own = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _counted), _hash))
    if once:
        # copies meet by the hash of their text, and only the hashes of the lines travel
        slim = slim.select("host", _hash_of(F.col("text")).alias("page"), own.alias("own")).dropDuplicates(["host", "page"])
        own = F.col("own")
    totals = slim.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("n_pages"))
    lines = slim.select("host", F.explode(own).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("n_pages")).select("host", "line", "n", "n_pages")


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = REPEATED, counts: tuple[str, str] | None = None,
    once: bool = True,
) -> DataFrame:
    """The rows of pages, all columns, with the boilerplate lines left out of the text.

    counts: names of two more columns, the lines of a page and how many were dropped. once: equal texts of a host count as one page.
    """
    plates = boilerplate(pages, host, text, ratio, least, once).select(F.col("host").alias("p_host"), F.col("line").alias("p_line"))
    own, words = F.col(f"`{host}`").cast("string"), F.col(f"`{text}`").cast("string")
    page = F.xxhash64(own, words)
    lines = pages.select(own.alias("l_host"), page.alias("l_page"), F.explode(F.array_distinct(F.transform(F.filter(_lines(words), _counted), _hash))).alias("l_line"))
    met = lines.join(plates, F.col("l_host").eqNullSafe(F.col("p_host")) & (F.col("l_line") == F.col("p_line")))
    gone = met.groupBy("l_host", "l_page").agg(F.collect_set("l_line").alias("l_gone"))
    names = pages.columns
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), own.alias("r_host"), page.alias("r_page"))
    joined = packed.join(gone, F.col("r_host").eqNullSafe(F.col("l_host")) & (F.col("r_page") == F.col("l_page")), "left")
    old = F.col("r")[text].cast("string")
    left = F.filter(_lines(old), lambda x: ~F.array_contains(F.col("l_gone"), _hash(x)) | ~_counted(x))
    new = F.when(F.col("l_gone").isNull(), old).otherwise(F.array_join(left, "\n"))
    out = [new.alias(c) if c == text else F.col("r")[c].alias(c) for c in names]
    if counts:
        all_lines = F.coalesce(F.size(_lines(old)), F.lit(0)).cast("bigint")
        out += [all_lines.alias(counts[0]), F.when(F.col("l_gone").isNull(), 0).otherwise(all_lines - F.size(left)).cast("bigint").alias(counts[1])]
    return joined.select(*out)
