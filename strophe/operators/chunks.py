"""Order-dependent folds over a series of any length, chunk by chunk.

A fold whose state has few values can be run for a chunk from each of them. That gives a table from the state a chunk may
start in to the state it ends in; tables are composed in order, which costs a step a chunk; and with the state that it does
start in each chunk is folded once more, for its results. So no task holds a series, only a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import held

SIZE = 8192
#: Rows of a task, about, once they are spread by a key.
SPREAD = 1 << 18


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows with all of a key's together, in as many tasks as their number asks for; steps by that key shuffle them no more.

    So what a task holds does not grow with the input. Reads a table's row count, nothing of its columns.
    """
    tasks = -(-rows.count() // SPREAD)
    few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, key) if tasks > few else rows.repartition(key)


def chunked(rows: DataFrame, key: str, idx: str, columns: list[str], size: int = SIZE) -> DataFrame:
    """key, chunk, rows (an array in order of ``idx``, which counts a key's rows from 0 without gaps) and before, the row
    that precedes the chunk (null for the first)."""
    item = F.struct(F.col(idx).cast("long").alias("i"), *columns)
    chunk, last = F.floor(F.col(idx) / size).cast("long"), F.pmod(F.col(idx).cast("long"), F.lit(size)) == size - 1
    places = F.array(F.struct(chunk.alias("c"), F.lit(True).alias("own")), F.when(last, F.struct((chunk + 1).alias("c"), F.lit(False).alias("own"))))
    spread = rows.select(F.col(key), item.alias("x"), F.explode(F.array_compact(places)).alias("p"))
    groups = spread.groupBy(key, F.col("p.c").alias("chunk")).agg(F.sort_array(F.collect_list(F.when(F.col("p.own"), F.col("x")))).alias("rows"), F.max(F.when(~F.col("p.own"), F.col("x"))).alias("before"))  # size rows
    return groups.where(F.size("rows") > 0)


def entered(tables: DataFrame, key: str, start: int) -> DataFrame:
    """key, chunk and state: the state in which each chunk of tables(key, chunk, table) starts, table[state] being that in which it ends.

    One key's tables are folded in order: a few numbers for each chunk, not for each row.
    """
    first = F.struct(F.lit(start).alias("state"), F.array().cast("array<struct<chunk:bigint,state:int>>").alias("out"))
    step = lambda a, x: F.struct(F.get(x["table"], a["state"]).alias("state"), F.concat(a["out"], F.array(F.struct(x["chunk"].alias("chunk"), a["state"].alias("state")))).alias("out"))
    folded = tables.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list(F.struct("chunk", "table"))), first, step).alias("s"))  # one table a chunk
    return folded.select(key, F.explode("s.out").alias("o")).select(F.col(key).alias("_k"), F.col("o.chunk").alias("_chunk"), F.col("o.state").alias("state"))


def boundaries(frames: DataFrame, key: str, idx: str, level_jump: float, shape_jump: float, least: int, size: int = SIZE) -> DataFrame:
    """key and cut: the positions that ``sections.boundaries`` finds, for series of any length.

    The state is how many rows have to pass before another cut may come: 0 to ``least``.
    """
    size = max(size, least + 1)
    pieces = chunked(frames.withColumnsRenamed({"rms_db": "e", "bright": "b"}), key, idx, ["e", "b"], size)
    pairs = F.zip_with(F.col("rows"), F.concat(F.array("before"), F.slice("rows", F.lit(1), F.size("rows") - 1)), lambda x, was: F.struct(x.alias("x"), was.alias("was")))
    jump = lambda p: p["was"].isNotNull() & ((F.abs(p["x"]["e"] - p["was"]["e"]) > level_jump) | (F.abs(p["x"]["b"] - p["was"]["b"]) > shape_jump))
    jumps = held(pieces.select(key, "chunk", F.transform(F.filter(pairs, lambda p: F.coalesce(jump(p), F.lit(False))), lambda p: p["x"]["i"]).alias("jumps"), F.element_at("rows", -1)["i"].alias("last")))
    base, after = F.col("chunk") * size, (F.col("chunk") + 1) * size

    def passed(r: Column) -> Column:
        free = F.aggregate("jumps", base + r, lambda at, j: F.when(j >= at, j + least).otherwise(at))
        return F.least(F.lit(least).cast("long"), F.greatest(F.lit(0).cast("long"), free - after)).cast("int")

    tables = jumps.select(key, "chunk", F.transform(F.sequence(F.lit(0), F.lit(least)), passed).alias("table"))
    start = entered(tables, key, least)
    found = jumps.join(start, F.col(key).eqNullSafe(F.col("_k")) & (F.col("chunk") == F.col("_chunk")))
    none = F.struct((base + F.col("state")).alias("at"), F.array().cast("array<bigint>").alias("out"))
    taken = F.aggregate("jumps", none, lambda a, j: F.when(j >= a["at"], F.struct((j + least).alias("at"), F.concat(a["out"], F.array(j)).alias("out"))).otherwise(a))["out"]
    inner = found.select(key, F.explode(taken).alias("cut"))
    ends = jumps.groupBy(key).agg(F.max("last").alias("last")).select(key, F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.col("last")))).alias("cut"))
    return inner.unionAll(ends).distinct()
