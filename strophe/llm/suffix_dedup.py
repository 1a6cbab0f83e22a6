"""Removal of long repeated byte strings with a logarithmic family of (sparse) suffix arrays.

A string of ``WINDOW`` bytes that starts at two places has to go in both. Of all suffixes only those are kept that
content selects: every window has a key, the smallest hash among its ``GRAM``-byte grams, and windows that follow each
other with the same key form a run. Equal windows have equal keys, wherever they stand, and a run is about a hundred
windows long, so an array of runs holds one suffix in a hundred and misses no match.

The arrays are sorted by key and kept in levels. A new batch gets its own array, which is merge-joined with every
level for the keys they share; two levels of one size are merged into one of twice the size, so there are as many as
the logarithm of the batches.

Runs with a shared key are then compared. Runs are told apart by a cryptographic digest (BLAKE2b, 128 bits) of all
their bytes; those whose whole strings recur are repeated in full. The others, at the edges of a match, are brought
together by key with one of each kind of their partners, and a suffix array of their strings (prefix doubling;
neighbours in it share 400 bytes or not) tells which windows recur. Where a key has more than ``KINDS`` kinds, their
strings are cut into runs anew by longer grams: equal windows have equal keys again, and fewer strings share one. Runs
that recur whole and those without partners drop out, what is left of crowded keys goes on with still longer grams, up
to the window itself, where each window is a run. So what is handed on shrinks from round to round.

Defined cases: a null text is empty; a text below 400 bytes has nothing to remove; overlapping repeats within a text
count; null ids and repeated rows are worked on row by row (a repeated row of 400 bytes or more is removed in full in
each copy); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, few, materialize, read, released, scratch, shared_dir, small_batches, with_row_id
from .langid import spans
from .shingles import mixed

WINDOW, GRAM = 400, 200
BATCHES = 4
#: Kinds of runs of one key in an array: some 2 MB of strings.
KINDS = 4096
#: Bytes of text, or of gathered strings, that a task works on at a time.
SLICE = 1 << 20
# Grams are hashed by sums of powers, which choose the keys alone: strings that collide are compared in vain.
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15 | 1


class _Powers:
    """Powers of the base, and of its inverse, as far as they were needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            cls.up, cls.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up, cls.down


def digested(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Digests of the strings of data from lo to hi, as two 64-bit integers each."""
    view = memoryview(np.ascontiguousarray(data))
    whole = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
    return np.frombuffer(whole, "<i8").reshape(-1, 2)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _Powers.to(len(data) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)], dtype=np.uint64))), down


def runs(data: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of texts that lie one after another in data: key, first window, windows, and whether the key's gram
    stands in them twice, without which no window can recur in its own run."""
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.bool_))
    if len(data) < window:
        return empty
    total, down = prefix_sums(data)
    h = mixed((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
    w, places = window - gram + 1, len(data) - window + 1
    rows = np.concatenate((h, np.full(-len(h) % w, np.uint64(2**64 - 1)))).reshape(-1, w)
    before = np.minimum.accumulate(rows, 1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    least = np.minimum(after[:places], before[w - 1 : w - 1 + places])
    edge = np.zeros(places + 1, np.int32)  # windows that lie in one text
    long = ends[1:] - ends[:-1] >= window
    np.add.at(edge, ends[:-1][long], 1)
    np.add.at(edge, ends[1:][long] - window + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    if not inside.any():
        return empty
    fresh = inside.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= fresh[1:] | ~inside[1:]
    lo, hi = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    key, ahead = least[lo], np.arange(w)
    left = lo + np.argmax(h[lo[:, None] + ahead] == key[:, None], 1)
    right = hi + w - 2 - np.argmax(h[(hi + w - 2)[:, None] - ahead] == key[:, None], 1)
    return key, lo, hi - lo, left != right


def repeated_windows(strings: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each string whether each of its windows occurs anywhere else among the strings, by their suffix array.

    Ranks of suffixes by their first 8 bytes are doubled to 256; the ranks at a window's start and where its last
    256 bytes begin tell its place in the order, and neighbours of one place share the whole window.
    """
    sizes = np.array([len(s) for s in strings])
    buffer = np.concatenate((np.frombuffer(b"".join(strings), np.uint8), np.zeros(2 * window, np.uint8))).astype(np.uint64)
    n = len(buffer) - 8
    rank = np.zeros(n, np.uint64)
    for i in range(8):
        rank = (rank << np.uint64(8)) | buffer[i : i + n]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    span = 8
    while 2 * span <= window:
        further = np.concatenate((rank[span:], np.zeros(min(span, len(rank)), np.uint64)))
        rank = np.unique((rank << np.uint64(32)) | further, return_inverse=True)[1].astype(np.uint64)
        span *= 2
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    counts = np.maximum(0, sizes - window + 1)
    place = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    _, kind, many = np.unique((rank[place] << np.uint64(32)) | rank[place + window - span], return_inverse=True, return_counts=True)
    return np.split(many[kind] > 1, np.cumsum(counts)[:-1])


def spans_of(flags: np.ndarray, first: int, window: int) -> list[tuple[int, int]]:
    """Bytes that the flagged windows cover, the first window starting at ``first``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [(first + int(a), first + int(b) - 1 + window) for a, b in zip(edges[::2], edges[1::2], strict=True)]


_ROW = "_row struct<file:bigint,at:bigint>"
_RUN = f"{_ROW}, key long, s1 long, s2 long, first long, windows long, twice boolean"


def entries(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The runs of docs(_row, text): _row, key, the digest of all their bytes (s1, s2), first (byte), windows and twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = spans(b["text"])
            i, n = 0, b.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1)
                a, z = int(ends[i]), int(ends[j])
                step = SLICE if j == i + 1 else max(1, z - a)
                for at in range(a, max(z, a + 1), step):  # a long text in pieces that share all but one byte of a window
                    stop = min(z, at + step + window - 1)
                    own = np.array([0, stop - at]) if j == i + 1 else ends[i : j + 1] - a
                    key, lo, size, twice = runs(data[at:stop], own, window, gram)
                    if not len(key):
                        continue
                    doc = i + (np.searchsorted(own, lo, "right") - 1 if j > i + 1 else np.zeros(len(lo), np.int64))
                    digest = digested(data[at:stop], lo, lo + size + window - 1)
                    columns = [pa.array(key.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(lo + at - ends[doc]), pa.array(size), pa.array(twice)]
                    yield pa.RecordBatch.from_arrays([b["_row"].take(pa.array(doc)), *columns], names=["_row", "key", "s1", "s2", "first", "windows", "twice"])
                i = j

    return docs.select("_row", F.col("text").cast("string").alias("text")).mapInArrow(released(work), _RUN)


class SuffixIndex:
    """Sorted arrays of runs in levels of 1, 2, 4 ... batches, and the keys found more than once so far.

    A level is kept with its distinct keys: scans for shared keys join these, so no key has many rows in them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/strophe/suffixes-{uuid.uuid4().hex}"
        self.levels: list[tuple[int, str, str]] = []
        self.shared: list[str] = []

    def _new(self, name: str) -> str:
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, name: str) -> str:
        path = self._new(name)
        df.write.option("compression", "zstd").parquet(path)
        return path

    def add(self, docs: DataFrame, batches: int = 1) -> None:
        """Takes in docs(_row, text) as so many batches, from one scan."""
        path = self._new("batches")
        dealt = entries(docs).withColumn("batch", F.pmod(F.xxhash64("_row"), F.lit(batches)).cast("int"))
        with small_batches(self.spark):
            dealt.repartition("key").sortWithinPartitions("batch", "key", "s1", "s2").write.partitionBy("batch").option("compression", "zstd").parquet(path)
        held = self.spark.read.schema(f"{_RUN}, batch int").parquet(path)
        for k in sorted(r["batch"] for r in held.select("batch").distinct().collect()):  # as many as there are batches
            self._level(f"{path}/batch={k}")

    def _level(self, path: str) -> None:
        keys = self._write(self.spark.read.parquet(path).groupBy("key").agg(F.count("*").alias("n")), "keys")
        new = self.spark.read.parquet(keys)
        found = new.where("n > 1").select("key")
        for _, _, other in self.levels:
            found = found.unionAll(new.select("key").join(self.spark.read.parquet(other).select("key"), "key"))
        self.shared.append(self._write(found, "shared"))
        self.levels.append((1, path, keys))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, *a), (_, *b) = self.levels.pop(), self.levels.pop()
            whole = self.spark.read.parquet(a[0], b[0]).repartition("key").sortWithinPartitions("key", "s1", "s2")
            both = self.spark.read.parquet(a[1], b[1]).groupBy("key").agg(F.sum("n").alias("n"))
            self.levels.append((2 * n, self._write(whole, "level"), self._write(both, "keys")))
            delete(self.spark, [*a, *b])

    def candidates(self) -> DataFrame:
        """The runs whose key occurs again, in another run or in their own."""
        if not self.levels:
            return self.spark.createDataFrame([], _RUN)
        runs_of = self.spark.read.parquet(*(p for _, p, _ in self.levels))
        shared = materialize(self.spark.read.parquet(*self.shared).distinct().select(F.col("key").alias("_key")), "shared-keys")
        again = runs_of.join(few(shared), F.col("key") == F.col("_key"), "left_semi")
        return again.unionAll(runs_of.where("twice").join(few(shared), F.col("key") == F.col("_key"), "left_anti"))

    def clear(self) -> None:
        delete(self.spark, [self.path])


def longer_grams(window: int, gram: int) -> list[int]:
    """Lengths of grams from gram to window, each halfway to the window until little is left."""
    out = []
    while gram < window:
        gram = window if window - gram <= window // 16 else (gram + window + 1) // 2
        out.append(gram)
    return out


_PIECE = f"{_RUN}, string binary"


def rekeyed(strings: DataFrame, window: int, gram: int) -> DataFrame:
    """The strings(_row, first, string) as runs by another length of grams, with their own strings; one run a window if that is a window's length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["string"].to_pylist()
            ends = np.cumsum([0, *map(len, texts)])
            data = np.frombuffer(b"".join(texts), np.uint8)
            key, lo, size, twice = runs(data, ends, window, gram)
            if gram == window and len(key):
                lo = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
                key, twice, size = np.repeat(key, size), np.zeros(len(lo), np.bool_), np.ones(len(lo), np.int64)
            of = np.searchsorted(ends, lo, "right") - 1
            hi = lo + size + window - 1
            digest = digested(data, lo, hi)
            whole = data.tobytes()
            columns = [pa.array(key.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(b["first"].to_numpy()[of] + lo - ends[of]), pa.array(size), pa.array(twice), pa.array([whole[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([b["_row"].take(pa.array(of)), *columns], names=["_row", "key", "s1", "s2", "first", "windows", "twice", "string"])

    return strings.select("_row", "first", "string").mapInArrow(released(work), _PIECE)


def sorted_out(found: DataFrame, window: int, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Of runs found: the stretches (_row, a, b) of those that recur whole, and one of each kind, with the crowd of its key,
    of keys that may hold more that recurs.

    What is counted for each kind of run or key is written before it is joined with the runs: both sides of the joins
    are then dealt out by shuffles of their own, which skew handling can split.
    """
    found = materialize(found.withColumn("_id", F.monotonically_increasing_id()), "candidates")
    kinds = found.groupBy(F.col("s1").alias("_s1"), F.col("s2").alias("_s2")).agg(F.count("*").alias("many"), F.min("_id").alias("_one"))
    kinds = materialize(kinds, "kinds")
    told = found.join(kinds, (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")))
    told = materialize(told.select("_row", "key", "first", "windows", "twice", *also, "many", (F.col("_id") == F.col("_one")).alias("one")), "told")
    whole = told.where("many > 1").select("_row", F.col("first").alias("a"), (F.col("first") + F.col("windows") + (window - 1)).alias("b"))
    open_keys = told.where("one").groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("crowd"), F.min("many").alias("least"), F.bool_or("twice").alias("_twice"))
    open_keys = materialize(open_keys.where("least = 1 AND (crowd > 1 OR _twice)").select("_key", "crowd"), "open-keys")
    return whole, told.where("one").join(few(open_keys), F.col("key") == F.col("_key")).select("_row", "key", "first", "windows", *also, "crowd")


def repeats(docs: DataFrame, candidates: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_row, a, b): stretches of bytes that repeat, from docs(_row, text) and their candidate runs."""
    whole, open_runs = sorted_out(candidates, window)
    send = open_runs.groupBy("_row").agg(F.collect_list(F.struct("key", "first", "windows", "crowd")).alias("runs"))  # no more than a text has
    send = materialize(send.select(F.col("_row").alias("_of"), "runs"), "open-runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, rows = [], []
            for i, (text, its) in enumerate(zip(b["text"].to_pylist(), b["runs"].to_pylist(), strict=True)):
                data = text.encode()
                for r in its:
                    which.append(i)
                    rows.append((r["key"], r["first"], r["crowd"], data[r["first"] : r["first"] + r["windows"] + window - 1]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b["_row"].take(pa.array(which, pa.int64())), *arrays], names=["_row", "key", "first", "crowd", "string"])

    joined = docs.join(few(send, "runs"), F.col("_row") == F.col("_of")).select("_row", F.col("text").cast("string").alias("text"), "runs")
    with small_batches(docs.sparkSession):
        strings = materialize(joined.mapInArrow(released(cut), f"{_ROW}, key long, first long, crowd long, string binary"), "strings")

    def array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            flagged = repeated_windows([r[4] for r in held], window)
            found = np.array([(i, *s) for i, (r, flags) in enumerate(zip(held, flagged, strict=True)) for s in spans_of(flags, r[3], window)], np.int64).reshape(-1, 3)
            row = [pa.array(np.array([r[i] for r in held], np.int64)[found[:, 0]]) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(row, names=["file", "at"]), pa.array(found[:, 1]), pa.array(found[:, 2])], names=["_row", "a", "b"])

        for b in batches:
            where = b["_row"].flatten()
            for r in zip(*(x.to_pylist() for x in (*where, *(b[n] for n in ("key", "first", "string")))), strict=True):
                if size >= SLICE and held[-1][2] != r[2]:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield flush()

    stretches = [whole]
    grams = iter(longer_grams(window, gram))
    with small_batches(docs.sparkSession):
        while True:
            longer = next(grams, None)
            crowded = F.lit(False) if longer is None else F.col("crowd") > KINDS
            few_kinds = strings.where(~crowded).select("_row", "key", "first", "string").repartition("key").sortWithinPartitions("key")
            stretches.append(materialize(few_kinds.mapInArrow(released(array), f"{_ROW}, a long, b long"), "edges"))
            if longer is None or strings.where(crowded).isEmpty():
                return reduce(DataFrame.unionAll, stretches)
            whole, rest = sorted_out(rekeyed(strings.where(crowded).repartition("_row", "first"), window, longer), window, ("string",))
            stretches.append(whole)
            strings = materialize(rest.select("_row", "key", "first", "crowd", "string"), "strings")


def joined_up(stretches: DataFrame) -> DataFrame:
    """The stretches (_row, a, b) that overlap or touch as one: runs that follow each other overlap by a window."""
    by_start = Window.partitionBy("_row").orderBy("a", "b")
    before = F.max("b").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = stretches.withColumn("_fresh", (before.isNull() | (F.col("a") > before)).cast("int"))
    return fresh.withColumn("_at", F.sum("_fresh").over(by_start.rowsBetween(Window.unboundedPreceding, 0))).groupBy("_row", "_at").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_at")


def removed(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that are left."""
    docs = with_row_id(docs).select("_row", "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    index = SuffixIndex(docs.sparkSession)
    index.add(docs, batches)
    with scratch(docs.sparkSession) as keep:
        stretches = repeats(docs, index.candidates(), window)
        per_text = keep(materialize(joined_up(stretches).groupBy(F.col("_row").alias("_of")).agg(F.collect_list(F.struct("a", "b")).alias("cuts")), "cuts"))  # no more than a text has
    index.clear()

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 500) for whole in parts for i in range(0, whole.num_rows, 500)):
            rows = []
            for doc, text, cuts in zip(*(b[n].to_pylist() for n in ("doc_id", "text", "cuts")), strict=True):
                data, at, gone, left = text.encode(), 0, 0, []
                for a, z in sorted((c["a"], c["b"]) for c in cuts or ()):  # they neither overlap nor touch
                    left.append(data[at:a])
                    gone, at = gone + z - a, z
                left.append(data[at:])
                kept = b"".join(left)
                rows.append((doc, len(data), gone, len(left) - 1, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = docs.join(few(per_text, "cuts"), F.col("_row") == F.col("_of"), "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(released(work), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, and the text that is left: U+FFFD stands for a character of which a removed run took a part."""
    found = removed(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))
