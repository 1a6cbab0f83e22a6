"""Folds over chunks give what the fold over the whole series gives."""

import pytest
from pyspark.sql import functions as F

from strophe.operators import chunks, sections


def series(spark, n):
    """Five series of up to n rows that jump often and seldom; one has a single row, one has jumps at every row."""
    i = F.col("id")
    level = F.when(F.col("k") == 0, F.pmod(F.xxhash64(i), F.lit(9))).when(F.col("k") == 1, i % 2 * 9).when(F.col("k") == 2, F.lit(5)).otherwise(F.pmod(F.xxhash64(i, F.lit(3)), F.lit(4)) * 2)
    rows = spark.range(n).crossJoin(spark.range(5).select(F.col("id").alias("k"))).where((F.col("k") != 4) | (i == 0))
    return rows.select("k", i.alias("frame"), level.cast("double").alias("rms_db"), (F.pmod(F.xxhash64(i, F.lit(7)), F.lit(50)) / 10).alias("bright")).orderBy(F.rand(1))


@pytest.mark.parametrize(("least", "size"), [(1, 2), (3, 4), (10, 11), (10, 64), (7, 1000)])
def test_boundaries_equal_the_fold(spark, least, size):
    df = series(spark, 500).withColumn("bright", F.lit(0.0) + F.when(F.col("frame") % 97 == 0, 9.0).otherwise(0.0))
    want = {(r.k, c) for r in sections.boundaries(df, "k", 4.5, 4.0, least).select("k", "cuts").collect() for c in r.cuts}
    got = chunks.boundaries(df, "k", "frame", 4.5, 4.0, least, size).collect()
    assert {(r.k, r.cut) for r in got} == want and len(got) == len(want)


def test_one_long_series_is_many_tasks(spark):
    n = 300_000
    df = spark.range(n, numPartitions=4).select(F.lit("a").alias("k"), F.col("id").alias("frame"), (F.pmod(F.xxhash64("id"), F.lit(13)) * 1.0).alias("rms_db"), F.lit(0.0).alias("bright"))
    pieces = chunks.chunked(df.withColumnsRenamed({"rms_db": "e", "bright": "b"}), "k", "frame", ["e", "b"], 4096)
    assert pieces.agg(F.count("*"), F.max(F.size("rows"))).first() == (74, 4096)
    levels = [r.rms_db for r in df.orderBy("frame").collect()]
    want, last = [0], 0
    for i in range(1, n):
        if abs(levels[i] - levels[i - 1]) > 9.5 and i - last >= 10:
            want.append(i)
            last = i
    assert sorted(r.cut for r in chunks.boundaries(df, "k", "frame", 9.5, 1.0, 10, 4096).collect()) == sorted({*want, n - 1})
