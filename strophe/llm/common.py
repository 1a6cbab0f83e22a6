"""Helpers shared by the training-data operators: tables, shared storage, and numbering without hot tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Rows that one numbering task should hold at most.
ROWS_PER_BUCKET = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own where it is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strophe-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


class Steps:
    """The steps that one call has written to the shared folder, in a folder of its own; deleted as one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/strophe/{uuid.uuid4().hex}"
        self.written: list[tuple[DataFrame, str]] = []
        self.kept: list[str] = []

    def write(self, parts: Iterable[DataFrame], name: str) -> DataFrame:
        """Parts of one table, one or more, as one step."""
        path, schema = f"{self.path}/{name}-{uuid.uuid4().hex}", None
        for df in parts:
            df.write.option("compression", "zstd").mode("append").parquet(path)
            schema = df.schema
        found = self.spark.read.schema(schema).parquet(path)
        self.written.append((found, path))
        return found

    def close(self, outer: Steps | None) -> None:
        """Deletes all but what was kept, which is the outer call's from now on."""
        gone = [p for _, p in self.written if p not in self.kept]
        delete(self.spark, gone if self.kept else [*gone, self.path])
        if self.kept:
            (outer or _rest(self.spark)).written += [(df, p) for df, p in self.written if p in self.kept]


#: The innermost call that writes steps, in each thread; steps written outside all calls stay until ``clear``.
_INNER: ContextVar[Steps | None] = ContextVar("steps", default=None)
_OUTSIDE: list[Steps] = []


def _rest(spark: SparkSession) -> Steps:
    if not _OUTSIDE or _OUTSIDE[0].spark is not spark:
        _OUTSIDE.insert(0, Steps(spark))
    return _OUTSIDE[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and a lost executor costs nothing before it."""
    return materialize_all(df.sparkSession, [df], name)


def materialize_all(spark: SparkSession, parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The same for parts of one table, one or more, that are made one after another."""
    return (_INNER.get() or _rest(spark)).write(parts, name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the steps written within, but for the frames (as ``materialize`` gave them) handed to what it yields.

    Those belong to the call around it. Around a whole job, written results included, it leaves no step behind:
    ``with scratch(spark): pipeline(...).write.parquet(...)``.
    """
    outer, own = _INNER.get(), Steps(spark)
    token = _INNER.set(own)

    def keep(df: DataFrame) -> DataFrame:
        own.kept += [p for found, p in own.written if found is df]
        return df

    try:
        yield keep
    finally:
        _INNER.reset(token)
        own.close(outer)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs, above = at.getFileSystem(spark._jsc.hadoopConfiguration()), at.getParent()
        fs.delete(at, True)
        if fs.exists(above) and not len(fs.listStatus(above)):
            fs.delete(above, False)


def clear(spark: SparkSession) -> None:
    """Deletes the steps that calls outside ``scratch`` have left, when no frame made from them is used any more."""
    for steps in _OUTSIDE:
        delete(spark, [*(p for _, p in steps.written), steps.path])
    _OUTSIDE.clear()


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; Catalyst would inline it into every element of a lambda otherwise."""
    return F.transform(F.array(value), body)[0]


def numbered(df: DataFrame, key: str, tie: list[str], out: str, per_bucket: int = ROWS_PER_BUCKET, then: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``out``: a gapless number from 0 within each ``key`` (no nulls), in order of a hash of ``tie``.

    A key with more than ``per_bucket`` rows is cut by hash ranges into as many buckets as its own rows ask for, so no
    window partition grows with the key; the bucket sizes, summed before them, give the offsets. ``df`` is read three
    times and should be materialized. Rows that agree in all of ``tie`` are ordered by ``then``.
    """
    sizes = few(materialize(df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")), "key-sizes"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / per_bucket)).cast("int"))
    hashed = df.withColumn("_h", F.xxhash64(*tie)).join(sizes, F.col(key) == F.col("_k")).withColumn("_bits", bits)
    hashed = hashed.withColumn("_b", F.when(F.col("_bits") > 0, F.expr("shiftrightunsigned(_h, 64 - _bits)")).otherwise(F.lit(0).cast("long"))).drop("_k", "_n", "_bits")
    before = Window.partitionBy("_k").orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.count("*").alias("_n"))
    offsets = few(materialize(offsets.select("_k", "_kb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets"))
    inside = Window.partitionBy(key, "_b").orderBy("_h", *tie, *then)
    ranked = hashed.withColumn("_r", F.row_number().over(inside) - 1)
    joined = ranked.join(offsets, (ranked[key] == offsets["_k"]) & (ranked["_b"] == offsets["_kb"]))
    return joined.withColumn(out, (F.col("_before") + F.col("_r")).cast("long")).drop("_h", "_b", "_r", "_k", "_kb", "_before")


def without_row_id(rows: DataFrame) -> DataFrame:
    return rows.drop("_row").withColumnRenamed("_row_given", "_row")


#: What is sent to every executor at most, in bytes, and what a row and an element of its arrays take in a hash table.
BROADCAST_BYTES, ROW_BYTES, ELEMENT_BYTES = 64 << 20, 150, 32


def with_row_id(docs: DataFrame) -> DataFrame:
    """Adds ``_row``: the file and place a row was read from, which no retry or other split changes.

    A frame that isn't read straight from files is written to the shared folder first. A column of that name is kept
    as ``_row_given`` until ``without_row_id``.
    """
    if "_row" in docs.columns:
        docs = materialize(docs.withColumnRenamed("_row", "_row_given"), "rows")
    from_files = "_metadata" in docs.columns or bool(docs.inputFiles())
    try:
        if from_files:
            docs.select("_metadata.row_index")
    except AnalysisException:  # files lie below a step that has no such column
        from_files = False
    if not from_files:
        docs = materialize(docs, "rows")
    return docs.withColumn("_row", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))


def few(df: DataFrame, elements: str | None = None) -> DataFrame:
    """df, a written table, to be sent to every executor if its bytes are few; it is shuffled beyond that.

    elements: an array column whose elements are counted as well.
    """
    sizes = [F.octet_length(f.name) for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    if elements:
        sizes.append(F.size(elements) * ELEMENT_BYTES)
    size = sum((F.coalesce(s, F.lit(0)).cast("long") for s in sizes), F.lit(ROW_BYTES).cast("long"))
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES else df


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs, which has ``_row``, without the rows listed in dropped(_row)."""
    gone = materialize(dropped.select(F.col("_row").alias("_gone")), "dropped")
    return docs.join(few(gone), F.col("_row") == F.col("_gone"), "left_anti").transform(without_row_id)


def released(work):
    """work, a function for mapInArrow, that hands memory back to the system at the end of a task: workers outlive it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """What is run within hands Python workers about so many bytes at a time; Spark's own bound is 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)
