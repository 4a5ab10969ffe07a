"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with that speaker as assistant and the
others as named users. The rendering is a table of segments, one row per turn and perspective, so that a
conversation of any length never has to fit into one row or one task:

    conv_id, perspective, seq, speaker, seat, segment, trained, start, mask_start, mask_end

`segment` is a header with the seat (and the name of a user) and the text. Segments of one perspective in the
order of `seq`, joined without separator, are the rendered dialogue; `start` is the character offset of a segment in it, and
[mask_start, mask_end) the characters that are trained on (the words of the assistant and the end mark; NULL
for the others). A speaker named in `scene` (the system prompt) sets the scene: it is rendered as system in
every perspective and gets no perspective of its own, unless nobody else speaks.

Defined cases: rows without a conversation form one conversation with a NULL id. A NULL speaker is the
participant `unknown`, a NULL text is empty. Turns are ordered by number, NULL last, then by
speaker and text; repeated rows stay, each with its own seq. An empty table gives an empty result.

Offsets are prefix sums in two steps: sums of blocks of 64 turn numbers, prefix sums over the blocks, and then within
blocks. Turns with their texts are dealt by block, once; perspectives reach them as rows of one block and perspective each, with the prefix
sums. So a conversation with a third of all turns is spread over as many groups as it has blocks, and only its blocks, without texts,
meet by conversation. Turns without a number are cut into blocks by speaker and the first letters of their text, in the order that they
have; turns beyond that which share one number share a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
#: Letters of the text by which turns without a number are cut into blocks.
HEAD = 3
SCENE = ("system",)
START, END = "<|start|>", "<|end|>\n"


def rotate(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
    scene: tuple[str, ...] = SCENE, block: int = BLOCK,
) -> DataFrame:
    """Segments of every perspective of every conversation."""
    col = lambda name: F.col(f"`{name}`")
    rows = turns.select(
        col(conversation).alias("conv_id"), col(turn).cast("bigint").alias("turn"),
        F.coalesce(col(speaker).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(col(text).cast("string"), F.lit("")).alias("text"),
    )
    none = F.col("turn").isNull()
    block = F.struct(
        F.coalesce(F.floor(F.col("turn") / block), F.lit(2**62)).alias("nr"), F.when(none, F.col("speaker")).otherwise("").alias("speaker"),
        F.when(none, F.substring("text", 1, HEAD)).otherwise("").alias("head"),
    )
    rows = rows.withColumn("block", block)
    # keys without NULL keep one partitioning usable for a window and the join after it
    rows = rows.withColumns({"none": F.col("conv_id").isNull(), "conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))})
    # participants: distinct speakers, combined before the shuffle
    people = rows.groupBy("none", "conv", "speaker").agg(F.lit(1).alias("one"))
    sets_scene = F.col("speaker").isin(*scene)
    others = F.max(~sets_scene).over(Window.partitionBy("none", "conv"))
    seats = people.withColumn("others", others).where(~sets_scene | ~F.col("others")).select("none", "conv", F.col("speaker").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    seat = F.when(own, "assistant").when(sets_scene, "system").otherwise("user")
    header = F.when(own | sets_scene, F.concat(F.lit(START), seat, F.lit("\n"))).otherwise(
        F.concat(F.lit(f"{START}user name="), F.col("speaker"), F.lit("\n"))
    )
    sizes = rows.select("none", "conv", "block", "speaker", F.length("text").alias("n")).groupBy("none", "conv", "block", "speaker").agg(
        F.sum("n").alias("n"), F.count("*").alias("turns")
    )
    # the same headers for sums of texts: one row per block, speaker and perspective
    blocks = sizes.join(seats, ["none", "conv"]).groupBy("none", "conv", "perspective", "block").agg(
        F.sum(F.col("n") + F.col("turns") * (F.length(header) + len(END))).alias("b_size"), F.sum("turns").alias("b_rows")
    )
    before = Window.partitionBy("none", "conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("none", "conv", "perspective", "block", _sum("b_size", before).alias("b_start"), _sum("b_rows", before).alias("b_first"))
    made = rows.join(blocks, ["none", "conv", "block"]).withColumns({"seat": seat, "trained": own, "header": header})
    made = made.withColumn("size", (F.length("header") + F.length("text") + len(END)).cast("bigint"))
    # the join has dealt the rows by conversation and block, which serves these windows as well
    within = Window.partitionBy("none", "conv", "block", "perspective").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("w_start", _sum("size", upto)).withColumn("w_seq", F.row_number().over(within) - 1)
    start = F.col("b_start") + F.col("w_start")
    return placed.select(
        "conv_id", "perspective", (F.col("b_first") + F.col("w_seq")).alias("seq"), "speaker", "seat",
        F.concat("header", "text", F.lit(END)).alias("segment"), "trained", start.alias("start"),
        F.when(F.col("trained"), start + F.length("header")).alias("mask_start"), F.when(F.col("trained"), start + F.col("size")).alias("mask_end"),
    )


def _sum(name: str, window) -> Column:
    return F.coalesce(F.sum(name).over(window), F.lit(0)).cast("bigint")
