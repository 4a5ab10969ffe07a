"""The corpus pipeline: documents of good quality, without boilerplate lines, near copies and benchmark text, as token ids.

STAGES are applied in order; each gets what its predecessor returned, written and read again.

documents needs the columns doc_id, text and source; n_chars follows the text where it is there, all others stay as they are up to the last stage. Rows are
judged as in the operators: NULL texts are empty, a NULL source is a source, of rows with equal doc_id and text that are near copies one
stays, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, positional_index, quality_gam, simhash, site_lines
from veilframe.llm.common import written
from veilframe.llm.queries import table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.keep_good(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that its source repeats on different texts; n_chars follows the text."""
    made = site_lines.drop_boilerplate(docs, host="source")
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near copies."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return positional_index.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digest of the ids, and digest of the text that they decode to."""
    return bpe.round_trip(docs, *vocabulary())


STAGES = [
    ("quality_classifier", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("byte_bpe", tokens),
]

#: Boosted models, fingerprints and merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
