"""SimHash near-duplicates with pivot distance tables.

Fingerprint: A-Z in lower case, words [^\\x20\\x09-\\x0D]+, shingles of four words joined by spaces (a shorter text is one
shingle), XXH64 of each with seed 42; a bit is set if more than half of the hashes have it. Texts without words have
fingerprint 0. Two documents are linked if their fingerprints differ in at most `reach` bits; classes are the connected components.

How links are found without comparing all pairs:

1. Equal fingerprints become one node. The 64 bits are cut into BLOCKS pieces; of two fingerprints within reach 4 at least
   BLOCKS - 4 pieces are equal, so both stand in the group of some choice of that many pieces.
2. The Hamming distances of each fingerprint to PIVOTS reference fingerprints form a table. Two fingerprints within reach differ by at most
   reach in every column: pairs of a group with a larger difference in any column are discarded, survivors are verified by their bits.
3. Of the links in a group only a spanning forest leaves the task, so a dense group gives fewer rows than it has members.
4. A group of more than GROUP members is cut into parts by a hash, and every pair of parts is compared as a group of its own: no
   task holds more than two parts, and no pair is lost.

Defined cases: NULL and empty texts share fingerprint 0 and are linked. Repeated rows stay rows. A class without any key that is not
NULL has a NULL id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import ASCII_LOWER, per_text, written
from veilframe.llm.components import components

SHINGLE, REACH, BLOCKS, PIVOTS, GROUP = 4, 4, 6, 24, 4096
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = text.translate(ASCII_LOWER).split()
    n = len(words)
    if not n:
        return 0
    k = min(shingle, n)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    stops = ends[k - 1 :].tolist()
    for at in range(0, len(stops), 100_000):  # a long text is counted part by part
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + 100_000], stops[at : at + 100_000])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(stops), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp of every row. No shuffle."""
    return per_text(docs, key, text, [T.StructField("fp", T.LongType())], lambda texts: [[fingerprint(t) for t in texts]])


def pivots(number: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(k).encode(), SEED) for k in range(number)], np.uint64)


def _pieces(blocks: int) -> list[tuple[int, int]]:
    """First bit and width of each piece."""
    width = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    return [(sum(width[:k]), w) for k, w in enumerate(width)]


def _keys(fp: Column, blocks: int, equal: int) -> Column:
    """One key per choice of pieces that may be equal: the number of the choice and the bits of its pieces."""
    parts = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in _pieces(blocks)]
    return F.array(*[F.struct(F.lit(n).alias("choice"), *[parts[k].alias(f"p{i}") for i, k in enumerate(c)]) for n, c in enumerate(combinations(range(blocks), equal))])


class Forest:
    """Spanning forest of the links among some rows: the label of a row is the smallest row tied to it."""

    def __init__(self, rows: int):
        self.label = np.arange(rows)

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label[:] = jumped


def tied(fp: np.ndarray, group: np.ndarray, side: np.ndarray, reach: int, reference: np.ndarray) -> np.ndarray:
    """For rows sorted by group: the row each row is tied to. Rows of equal side in a two-sided group are not compared (-1: one side)."""
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ reference[None, :]).astype(np.int8)
    forest = Forest(n)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    rest = np.repeat(edges[1:], np.diff(edges)) - np.arange(n)  # rows from here to the end of the group
    i = np.flatnonzero(rest > 1)
    step = 1
    while len(i):
        # several steps at once while few rows are left
        many = max(1, min(int(rest[i].max()) - step, 200_000 // len(i)))
        steps = np.arange(step, step + many)
        a = np.repeat(i, many)
        b = a + np.tile(steps, len(i))
        ok = np.tile(steps, len(i)) < np.repeat(rest[i], many)
        a, b = a[ok], b[ok]
        apart = (side[a] < 0) | (side[a] != side[b])
        a, b = a[apart], b[apart]
        for column in table.T:
            near = np.abs(column[a] - column[b]) <= reach
            a, b = a[near], b[near]
            if not len(a):
                break
        if len(a):
            linked = np.bitwise_count(fp[a] ^ fp[b]) <= reach
            forest.tie(a[linked], b[linked])
        step += many
        i = i[rest[i] > step]
    return forest.label


def links(nodes: DataFrame, fp: str = "fp", reach: int = REACH, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """Pairs a, b of distinct fingerprints that tie all fingerprints together that links within reach connect."""
    equal = blocks - reach
    if equal < 1:
        raise ValueError("more pieces than bits that may differ are needed")
    rows = nodes.select(F.col(fp).alias("fp")).select("fp", F.explode(_keys(F.col("fp"), blocks, equal)).alias("k")).select("fp", "k.*")
    names = [c for c in rows.columns if c != "fp"]
    large = rows.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > group)
    large = large.select(*[F.col(c).alias(f"l_{c}") for c in names], F.ceil(F.col("n") / group).cast("int").alias("parts"))
    same = [F.col(c) == F.col(f"l_{c}") for c in names]
    marked = rows.join(large, same, "left").select("fp", *names, F.coalesce("parts", F.lit(1)).alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # row of part p goes to the group of every pair of parts that has p in it
    dealt = marked.withColumn("part", part).select("fp", *names, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select(
        "fp", *names, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        F.when(F.col("part") == F.col("other"), -1).otherwise((F.col("part") > F.col("other")).cast("int")).alias("side"),
    )
    keys = [*names, "low", "high"]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = dealt.repartition(parts, *keys).sortWithinPartitions(*keys)
    reference = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            k = np.stack([t[c].to_numpy() for c in keys], 1)
            new = np.concatenate(([True], (k[1:] != k[:-1]).any(1)))
            last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            rest = t.slice(last)
            if last:
                yield from found(t.slice(0, last), np.cumsum(new[:last]))
        if rest is not None and rest.num_rows:
            yield from found(rest, np.zeros(rest.num_rows, int))

    def found(t: pa.Table, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = t["fp"].to_numpy()
        label = tied(fp.view(np.uint64), number, t["side"].to_numpy(), reach, reference)
        other = np.flatnonzero(label != np.arange(len(label)))
        if len(other):
            yield pa.RecordBatch.from_arrays([pa.array(fp[other]), pa.array(fp[label[other]])], ["a", "b"])

    return sorted_rows.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """key, fp and component_id (smallest key of the class) of every row of docs."""
    prints = written(fingerprints(docs, key, text), "fingerprints").select(F.col(f"`{key}`").alias("k"), "fp")
    nodes = prints.groupBy("fp").agg(F.min("k").alias("least"))
    nodes = written(nodes, "nodes")
    tied_nodes = components(links(nodes, "fp", reach))
    placed = nodes.join(tied_nodes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "component").join(ids, "component").select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select(F.col("k").alias(key), "fp", "component_id")


def hex_of(fp: str) -> Column:
    """A signed 64-bit number as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """The rows of docs, all columns, of the smallest key of each class; of rows with equal key one stays."""
    row = F.struct(F.xxhash64(f"`{key}`", f"`{text}`"), F.xxhash64(f"`{text}`", f"`{key}`", F.lit(1)))
    marked = docs.select(F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), row.alias("row")).alias("k"), F.col(f"`{text}`").alias("text"))
    found = classes(marked, "k", "text", reach)
    kept = found.select("component_id").distinct().select(F.col("component_id.row.col1").alias("a"), F.col("component_id.row.col2").alias("b"))
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), row.alias("row")).select("r", F.col("row.col1").alias("a"), F.col("row.col2").alias("b"))
    once = Window.partitionBy("a", "b").orderBy("a")
    first = packed.join(kept, ["a", "b"], "left_semi").withColumn("nr", F.row_number().over(once)).where("nr = 1")
    return first.select(*[F.col("r")[c].alias(c) for c in names])
