"""A cache of measurements as a table of buckets, of which a change rewrites those that it touches.

Entries lie in buckets by a hash of their key. A change reads the buckets of its keys alone, writes them anew beside the old
ones and then publishes a list of all buckets' folders; it is renamed into place whole, so a reader sees the cache before
the change or after it and never half of either. Of two changes at one time the second to publish fails and says so. Folders
that no list names any more are deleted by ``vacuum``, when no reader can still be using them.

A key has one entry: of several in one change the one that is greatest by all its columns stays. A null key is a key. A
column keeps the type that it came with first; entries from before a column came have null there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
KEY = "content_key"


class Conflict(RuntimeError):
    """Another change was published meanwhile."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _lists(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, f"{path}/_lists")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number and the contents of the list that counts: the schema and each bucket's folder; 0 of an empty cache."""
    known = _lists(spark, path)
    if not known:
        return 0, {"schema": None, "buckets": {}}
    rows = spark.read.text(f"{path}/_lists/{known[-1]}.json").collect()  # one line
    return known[-1], json.loads(rows[0].value)


def _publish(spark: SparkSession, path: str, number: int, contents: dict) -> None:
    text = json.dumps(contents, sort_keys=True)
    fs, at = _fs(spark, f"{path}/_lists/.{number}-{uuid.uuid4().hex}")
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    goal = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_lists/{number}.json")
    if fs.exists(goal) or not fs.rename(at, goal):
        fs.delete(at, False)
        raise Conflict(f"list {number} of {path} was published meanwhile")


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def entries(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame | None:
    """The entries as they are now, of some buckets if told so; None of a cache that never had any."""
    _, told = current(spark, path)
    if told["schema"] is None:
        return None
    from pyspark.sql.types import StructType

    shape = StructType.fromJson(told["schema"])
    folders = [f for b, f in told["buckets"].items() if only is None or int(b) in only]
    return spark.read.schema(shape).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], shape)


def _changed(spark: SparkSession, path: str, keys: DataFrame, new: DataFrame | None) -> None:
    number, told = current(spark, path)
    touched = sorted(r.b for r in keys.select(bucket_of(F.col(KEY)).alias("b")).distinct().collect())  # BUCKETS at most
    old = entries(spark, path, touched)
    if old is not None:
        kinds = {f.name: f.dataType for f in old.schema}
        new = new.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else c for c in new.columns)) if new is not None else None
        gone = keys.select(F.col(KEY).alias("_gone")).distinct()
        old = old.join(gone, F.col(KEY).eqNullSafe(F.col("_gone")), "left_anti")
    parts = [df for df in (old, new) if df is not None]
    if not touched or not parts:
        return
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    folder = f"data/{uuid.uuid4().hex}"
    whole.withColumn("_bucket", bucket_of(F.col(KEY))).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    fs, at = _fs(spark, f"{path}/{folder}")
    made = {s.getPath().getName().removeprefix("_bucket=") for s in fs.listStatus(at) if s.getPath().getName().startswith("_bucket=")}
    buckets = {b: f for b, f in told["buckets"].items() if int(b) not in touched} | {b: f"{folder}/_bucket={b}" for b in made}
    _publish(spark, path, number + 1, {"schema": json.loads(whole.schema.json()), "buckets": buckets})


def put(new: DataFrame, path: str, version: int = 2) -> None:
    """Adds entries(content_key, ...) to a cache or replaces those of their keys."""
    rest = [c for c in new.columns if c != KEY]
    one = new.groupBy(KEY).agg(F.max(F.struct(*rest)).alias("_e")).select(KEY, "_e.*") if rest else new.distinct()
    _changed(new.sparkSession, path, new, one.withColumn("schema_version", F.lit(version)))


def invalidate(keys: DataFrame, path: str) -> None:
    """Takes the entries of keys(content_key) out of a cache."""
    _changed(keys.sparkSession, path, keys, None)


def size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Entries, and bytes of the files that hold them."""
    held = entries(spark, path)
    if held is None:
        return 0, 0
    total = 0
    for folder in current(spark, path)[1]["buckets"].values():
        fs, at = _fs(spark, f"{path}/{folder}")
        total += fs.getContentSummary(at).getLength()
    return held.count(), total


def clear(spark: SparkSession, path: str) -> int:
    """Empties a cache; returns how many entries it had."""
    number, told = current(spark, path)
    held = entries(spark, path)
    n = held.count() if held is not None else 0
    _publish(spark, path, number + 1, {"schema": told["schema"], "buckets": {}})
    return n


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes folders that none of the last ``keep`` lists names, and older lists; returns how many folders went."""
    known = _lists(spark, path)
    named = set()
    for n in known[-keep:]:
        named |= set(json.loads(spark.read.text(f"{path}/_lists/{n}.json").collect()[0].value)["buckets"].values())
    gone = 0
    fs, at = _fs(spark, f"{path}/data")
    for change in fs.listStatus(at) if fs.exists(at) else []:
        parts = [s.getPath() for s in fs.listStatus(change.getPath()) if s.isDirectory()]
        dead = [p for p in parts if f"data/{change.getPath().getName()}/{p.getName()}" not in named]
        for p in dead if len(dead) < len(parts) else [change.getPath()]:
            fs.delete(p, True)
        gone += len(dead)
    for n in known[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_lists/{n}.json"), False)
    return gone
