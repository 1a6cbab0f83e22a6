"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``VNODES`` points of a 64-bit ring; a key belongs to the shard of the next point clockwise. A shard
holds ceil or floor of rows / shards, so that counts differ by one at most; keys beyond that continue clockwise to
the next shard with room. Only the number of keys on each arc reaches the driver (shards times VNODES rows); from it
the overflow is planned as ranges of ranks, and rows find their range by a join on the arc.

Defined cases: rows with a null id are placed by their text; repeated rows count one by one; a null text has one byte
and the checksum of nothing; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, numbered, read

SHARDS = 8
VNODES = 64


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Points in ascending order and the shard of each; a shard's points do not depend on the number of shards."""
    points = sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}".encode()), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.uint64), np.array([s for _, s in points], np.int32)


def plan(counts: dict[int, int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges (arc, first rank, rows, shard, first slot) that fill each shard to its bound.

    Keys at home come first, arc by arc; what exceeds a shard's bound goes on clockwise from its arc.
    """
    rows = sum(counts.values())
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    used, pieces, over = [0] * shards, [], []

    def put(arc: int, first: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            pieces.append((arc, first, n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n
        return n

    for arc, shard in enumerate(owner):
        n = counts.get(arc, 0)
        stays = put(arc, 0, n, shard)
        if stays < n:
            over.append((arc, stays, n - stays))
    for arc, first, n in over:
        at = arc
        while n:
            at = (at + 1) % len(owner)
            moved = put(arc, first, n, owner[at])
            first, n = first + moved, n - moved
    return pieces


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard, arc."""
    points, owner = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc(keys: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, keys.to_numpy(np.int64).view(np.uint64), side="left") % len(points)).astype(np.int32))

    text = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = materialize(keys.withColumn("arc", arc(F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id")))), "ring-keys")
    counts = {r["arc"]: r["n"] for r in keys.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # shards * vnodes rows at most
    pieces = docs.sparkSession.createDataFrame(plan(counts, owner.tolist(), shards), "_arc int, first long, n long, shard int, used long")
    ranked = numbered(keys, "arc", ["doc_id", "text_crc32", "size"], "rank")
    placed = ranked.join(F.broadcast(pieces), (F.col("arc") == F.col("_arc")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("used") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "arc")


def op5_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
