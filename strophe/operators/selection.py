"""Exact selection by rank in groups of any size, by histograms instead of sorting."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a value that a round decides; 64 in all.
DIGIT = 16
#: Different values of a group that one task may hold at most; larger groups go digit by digit.
SMALL = 1 << DIGIT
#: Rows of a task, about, that sums up the counts of small groups.
TASK = 1 << 18


def _ordered(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of doubles; 0.0 and -0.0 are one, NaN comes last."""
    bits = np.where(np.isnan(values), np.float64("nan"), values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def patterns(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and d0 to d3, the digits of the value's ordered bit pattern from the highest on; nulls are left out."""
    told = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _ordered(b["_v"].to_numpy()).view(np.uint64) ^ np.uint64(1 << 63)
            digits = [pa.array(((u >> np.uint64(64 - DIGIT * (i + 1))) & np.uint64(0xFFFF)).astype(np.int32)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), *digits], names=[*keys, "d0", "d1", "d2", "d3"])

    kinds = "".join(f"`{k}` {told.schema[k].dataType.simpleString()}, " for k in keys)
    return told.mapInArrow(work, f"{kinds}d0 int, d1 int, d2 int, d3 int")


def values_of(picked: DataFrame, keep: list[str]) -> DataFrame:
    """keep and value for digits d0 to d3."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = reduce(lambda u, i: (u << np.uint64(DIGIT)) | b[f"d{i}"].to_numpy().astype(np.uint64), range(4), np.zeros(b.num_rows, np.uint64))
            bits = (u ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))], names=[*keep, "value"])

    kinds = "".join(f"`{k}` {picked.schema[k].dataType.simpleString()}, " for k in keep)
    return picked.select(*keep, "d0", "d1", "d2", "d3").mapInArrow(work, f"{kinds}value double")


def held(df: DataFrame) -> DataFrame:
    """df for several uses: a reliable checkpoint where ``spark.checkpoint.dir`` is set, else on disks, from where a lost part is made again."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return df.checkpoint() if shared else df.persist(StorageLevel.DISK_ONLY)


def median(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys and the exact median of each group's values (the mean of the middle two of an even number), as ``F.median`` has it.

    Values are counted in one aggregation, which needs no shuffle where rows already lie by some of the keys. Groups of at
    most ``SMALL`` different values take the middle ranks of their running counts; others go through ``_by_digits``. A
    group whose values are all null has no row.
    """
    told = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    seen = held(told.groupBy(*keys, "_v").agg(F.count("*").alias("n")))
    sizes = seen.groupBy(*keys).agg(F.count("*").alias("_kinds"))
    total, many = sizes.agg(F.coalesce(F.sum("_kinds"), F.lit(0)), F.count_if(F.col("_kinds") > SMALL)).first()
    dealt = lambda small: small.repartition(-(-total // TASK), *keys) if keys and total > TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else small
    if not many:
        return _middles(dealt(seen), keys, out)
    large = held(sizes.where(F.col("_kinds") > SMALL).select(*(F.col(k).alias(f"_{k}") for k in keys), F.lit(True).alias("_large")))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.lit(True))
    large = F.broadcast(large) if many <= SMALL else large
    return _middles(dealt(seen.join(large, same, "left_anti")), keys, out).unionAll(_by_digits(seen.join(large, same, "left_semi"), keys, out))


def _middles(seen: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Medians of groups of seen(keys, _v, n) by the running counts of their values in order."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    running = seen.withColumn("_to", F.sum("n").over(by.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(by))
    holds = lambda rank: (rank >= F.col("_to") - F.col("n")) & (rank < F.col("_to"))
    middle = running.where(holds(F.floor((F.col("_all") - 1) / 2)) | holds(F.floor(F.col("_all") / 2)))
    low, high = F.min("_v"), F.max("_v")
    return middle.groupBy(*keys).agg(F.when(low == high, low).otherwise(low * 0.5 + high * 0.5).alias(out), F.count("*").alias("_n")).where("_n > 0").drop("_n")


def _by_digits(seen: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The same for groups of any size: digit by digit, the counts are summed up to the digit that holds the middle rank and
    only what starts with the digits found so far goes on.

    What is shuffled for a round has a row for each digit of a group, 65,536 at most, so a group with most of the rows is
    no task's burden.
    """
    seen = held(patterns(seen, [*keys, "n"], "_v"))
    targets: DataFrame | None = None
    digits: list[str] = []
    for i in range(4):
        here, group = f"d{i}", [*keys, *(["rank_no"] if i else []), *digits]
        if targets is None:
            inside = seen
        else:
            left = targets.select(*(F.col(c).alias(f"_{c}") for c in [*keys, *digits]), "rank_no", "rank")
            same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, *digits]))
            inside = seen.join(left, same).drop(*(f"_{c}" for c in [*keys, *digits]))
        hist = inside.groupBy(*group, *(["rank"] if i else []), here).agg(F.sum("n").alias("n"))
        by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
        running = hist.withColumn("_to", F.sum("n").over(by.orderBy(here).rowsBetween(Window.unboundedPreceding, 0)))
        if i == 0:  # the two middle ranks, which are one for an odd number
            running = running.withColumn("_all", F.sum("n").over(by))
            middle = F.array(*(F.struct(F.lit(no).alias("rank_no"), r.cast("long").alias("rank")) for no, r in enumerate((F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)))))
            running = running.withColumn("_m", F.explode(middle)).select("*", "_m.rank_no", "_m.rank").drop("_m", "_all")
        before = F.col("_to") - F.col("n")
        found = running.where((F.col("rank") >= before) & (F.col("rank") < F.col("_to")))
        targets = found.select(*keys, "rank_no", (F.col("rank") - before).alias("rank"), *digits, here)
        digits.append(here)
    low, high = F.min("value"), F.max("value")
    return values_of(targets, keys).groupBy(*keys).agg(F.when(low == high, low).otherwise(low * 0.5 + high * 0.5).alias(out), F.count("*").alias("_n")).where("_n > 0").drop("_n")
