"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are gathered into blocks. Block k (from 0) of a source with weight w, its share of the whole, may not
run before slot floor(k / w) and has to run before slot ceil((k + 1) / w); in each slot, of the blocks that may run the
one with the earliest deadline does. For weights that add up to one this keeps every source within less than one
block of weight times slots, at each slot, for as long as all of them still have blocks.

Weights are not rounded: they are given as integers, fractions or floats and taken as the exact fractions that these
are, however many sources there are. Weights by count and power are floats. The driver knows the number of rows of each
source; it schedules with two heaps up to the first slot that finds its source without a full block. From there on the
other blocks follow in the order of their deadlines. The schedule is written in pieces of ``PIECE`` slots: the driver
holds one piece and the next block of each source, however many rows there are, and blocks have the same number of
rows in every table. Rows join the places of their blocks. (The driver takes some 4 seconds for a million blocks, so a
table of many billions of rows asks for larger ``block_rows``, and gets the deviation that goes with it.)

Defined cases: a null source is a source of its own; an empty table gives an empty result; once a source has run out
the others go on in the order of their deadlines, so every row is given a place (``on_target`` tells which lie before
that); sources that are not among the weights given share the smallest of these, by their counts to the power; a given
weight of zero or less is none, so such a source comes last; texts are not looked at; rows that agree in id and text
are interchangeable.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, materialize, materialize_all, numbered, read, with_row_id, without_row_id

BLOCK_ROWS = 32
#: Slots of the schedule that are written at a time.
PIECE = 1 << 18
_MOST = 2**63 - 1  # a window that far off tells nothing but that


def integers(weights: list[int | float | Fraction]) -> list[int]:
    """The weights as whole numbers in exactly the same proportions."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    common = math.gcd(*whole) or 1
    return [w // common for w in whole]


def schedule(parts: list[int], full: list[int]) -> Iterator[int]:
    """The class that runs in each slot: earliest deadline first among the released blocks, until one has no full block left."""
    total = sum(parts)
    ran = [0] * len(parts)
    ready = [(-(-total // p), i) for i, p in enumerate(parts) if p > 0]  # (deadline, class)
    heapq.heapify(ready)
    later: list[tuple[int, int]] = []  # (release, class)
    slot = 0
    while ready or later:
        while later and later[0][0] <= slot:
            i = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(ran[i] + 1) * total // parts[i]), i))
        i = heapq.heappop(ready)[1]
        if ran[i] >= full[i]:
            return
        ran[i] += 1
        yield i
        heapq.heappush(later, (ran[i] * total // parts[i], i))
        slot += 1


def places(parts: list[int], sizes: list[int], block_rows: int) -> Iterator[tuple[int, int, int | None, int | None, int, bool]]:
    """(class, block, release, deadline, slot, on target) of all blocks, slot by slot."""
    total, ran, slot = sum(parts), [0] * len(parts), 0

    def block(i: int, k: int) -> tuple[int, int, int | None, int | None]:
        return (i, k, min(_MOST, k * total // parts[i]), min(_MOST, -(-(k + 1) * total // parts[i]))) if parts[i] > 0 else (i, k, None, None)

    def late(i: int) -> Iterator[tuple[bool, int, int, int]]:
        for k in range(ran[i], -(-sizes[i] // block_rows)):
            yield parts[i] <= 0, -(-(k + 1) * total // parts[i]) if parts[i] > 0 else 0, i, k

    for slot, i in enumerate(schedule(parts, [n // block_rows for n in sizes]), 1):  # noqa: B007
        yield *block(i, ran[i]), slot - 1, True
        ran[i] += 1
    for j, (_, _, i, k) in enumerate(heapq.merge(*(late(i) for i in range(len(parts))))):
        yield *block(i, k), slot + j, False


def written(spark: SparkSession, blocks: Iterator[tuple], piece: int = PIECE) -> DataFrame:
    """The places as a table, written piece by piece."""
    kinds = [pa.int64()] * 5 + [pa.bool_()]
    names = ["_c", "_at", "release", "deadline", "slot", "on_target"]

    def pieces() -> Iterator[DataFrame]:
        columns = list(zip(*itertools.islice(blocks, piece), strict=True)) or [()] * 6
        while columns:
            yield spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names))
            columns = list(zip(*itertools.islice(blocks, piece), strict=True))

    return materialize_all(spark, pieces(), "mix-places")


def mix(docs: DataFrame, weights: dict[str | None, int | float | Fraction] | None = None, power: float = 0.5, block_rows: int = BLOCK_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs(doc_id, text, source) with its place in the mixture.

    weights: by source; None derives them from the counts, to the given power. Returns doc_id, source, keep (columns
    that tell rows apart), weight (the source's share), block, release, deadline, slot, position and on_target.
    """
    spark = docs.sparkSession
    rows = materialize(docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("_digest"), *keep), "mix-rows")
    counts = rows.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("source")).toArrow()
    sizes = counts["n"].to_pylist()
    share: list[int | float | Fraction] = [n**power for n in sizes]
    if weights is not None:
        given = [weights.get(x) for x in counts["source"].to_pylist()]
        left = sum(Fraction(s) for s, w in zip(share, given, strict=True) if w is None)
        least = Fraction(min((w for w in weights.values() if w > 0), default=1))
        share = [max(Fraction(w), 0) if w is not None else least * Fraction(s) / left for s, w in zip(share, given, strict=True)]
    parts = integers(share)
    total = sum(parts)
    classes = pa.table([counts["source"], pa.array(range(len(parts)), pa.int64()), pa.array([float(Fraction(p, total or 1)) for p in parts], pa.float64())], names=["_name", "class", "weight"])
    named = few(materialize(spark.createDataFrame(classes, "_name string, class long, weight double"), "mix-sources"))
    classed = rows.join(named, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    ranked = numbered(classed, "class", ["_digest", "doc_id", "source"], "_rank", then=keep)
    placed = few(written(spark, places(parts, sizes, block_rows)))
    return (
        ranked.withColumn("block", F.floor(F.col("_rank") / block_rows).cast("long"))
        .join(placed, (F.col("class") == F.col("_c")) & (F.col("block") == F.col("_at")))
        .select("doc_id", "source", *keep, "weight", "block", "release", "deadline", "slot", (F.col("slot") * block_rows + F.col("_rank") % block_rows).alias("position"), "on_target")
    )


def interleaved(docs: DataFrame) -> DataFrame:
    """docs in the order of the mixture: partitions follow each other by position, and rows within them."""
    rows = with_row_id(docs)
    placed = materialize(mix(rows, keep=("_row",)).select(F.col("_row").alias("_of"), F.col("position").alias("_position")), "positions")
    joined = rows.join(few(placed), F.col("_row") == F.col("_of"))
    return joined.repartitionByRange("_position").sortWithinPartitions("_position").drop("_of", "_position").transform(without_row_id)


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
