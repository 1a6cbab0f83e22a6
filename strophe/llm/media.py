"""Chroma fingerprints of recordings, and their alignment.

A recording's frames are turned into twelve pitch classes. Box filters over the image of pitch classes and time, in
constant time from its integral image, compare regions of it; each of ``FILTERS`` gives two bits, packed to one
32-bit integer for each place in time. Two recordings are aligned where most equal integers agree in their distance
(a histogram of offsets), and match if the bits differ little over the whole overlap.

A search takes some recordings as queries against all. Recordings with equal fingerprints are one class. A match needs
``VOTES`` of the shorter one's places to have integers of the longer one, so any choice of places that leaves out fewer
than that many shares some with each match. Each class chooses the places of its rarest integers; a join on integers
counts them, and pairs with too few are no matches. What is aligned so are all pairs that can match, at any ratio of lengths.

Defined cases: short recordings (below ``FRAME + 15 * HOP`` samples) have no integers; they are classes by their samples
and match their equal copies, with 0 votes over an overlap of 0. Null and empty recordings match nothing; repeated rows
share a class; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, released, small_batches

#: Samples a second of 8-bit PCM, of a frame and from one frame to the next.
RATE, FRAME, HOP = 8000, 256, 64
LENGTH = 16
#: (kind, first pitch class, pitch classes, frames): a rule in place of a trained list; two bits each.
FILTERS = [(k, y, h, w) for (k, (h, w)), y in itertools.product(zip(range(4), ((4, 8), (6, 4), (3, 12), (4, 16)), strict=True), (0, 2, 4, 6))]
LEVELS = (-0.12, 0.0, 0.12)
#: A match: so many of the shorter one's integers agree at one offset, and at most so many bits differ in the overlap.
VOTES, ERRORS = 0.5, 0.15
#: Classes of hashed integers whose counts tell rare from common. They decide what the join costs, never what it finds.
RANKS = 1 << 16
#: Of the votes that a match needs at least, the share that its chosen places have to show.
SHOWN = 0.25
#: A usual integer is in a class of integers counted so often, and so many times the mean. A recording's so many most usual
#: ones tell where it is met once instead of at each. They decide how often a pair is met, never whether it is.
OFTEN, TIMES, USUAL = 256, 8, 8
_HZ = np.fft.rfftfreq(FRAME, 1 / RATE)
_CLASS = np.zeros((len(_HZ), 12), np.float32)
_CLASS[np.arange(2, len(_HZ)), np.round(12 * np.log2(_HZ[2:] / 440.0)).astype(int) % 12] = 1
_WINDOW = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Twelve pitch classes for each full frame of samples, each frame's to a sum of 1."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    out = []
    views = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for i in range(0, len(views), 4096):
        power = np.abs(np.fft.rfft(views[i : i + 4096] * _WINDOW, axis=1)).astype(np.float32) @ _CLASS
        out.append(power / (power.sum(1, keepdims=True) + 1e-9))
    return np.concatenate(out)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """An integer for each place where LENGTH frames begin."""
    image = chroma(samples)
    n = len(image) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def box(x: int, w: int, y: int, h: int) -> np.ndarray:
        return whole[at + x + w, y + h] - whole[at + x, y + h] - whole[at + x + w, y] + whole[at + x, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:  # before against after
            a, b = box(0, w // 2, y, h), box(w // 2, w - w // 2, y, h)
        elif kind == 1:  # low against high
            a, b = box(0, w, y, h // 2), box(0, w, y + h // 2, h - h // 2)
        elif kind == 2:  # the middle in time against both ends
            a, b = box(w // 3, w // 3, y, h) * 2, box(0, w // 3, y, h) + box(2 * (w // 3), w // 3, y, h)
        else:  # diagonals
            a = box(0, w // 2, y, h // 2) + box(w // 2, w // 2, y + h // 2, h // 2)
            b = box(0, w // 2, y + h // 2, h // 2) + box(w // 2, w // 2, y, h // 2)
        level = np.searchsorted(LEVELS, np.log((a + 1e-3) / (b + 1e-3))).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbours differ in one bit
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, float]:
    """The offset of b's start in a with most votes (the smallest on a tie), votes, overlap and the share of bits that differ.

    Where too many bits differ there, the next offset that has the votes of a match and few enough of such bits, if any.
    """
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    hits = hi - lo
    if not hits.any():
        return 0, 0, 0, 1.0
    i = np.repeat(np.arange(len(a)), hits)
    j = order[np.repeat(lo - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())]
    offsets, votes = np.unique(i - j, return_counts=True)
    need = min(VOTES * min(len(a), len(b)), votes.max())
    first: tuple[int, int, int, float] | None = None
    for at in np.argsort(-votes, kind="stable"):
        if votes[at] < need:
            break
        off = int(offsets[at])
        x, y = a[max(0, off) :], b[max(0, -off) :]
        n = min(len(x), len(y))
        found = (off, int(votes[at]), n, float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n))
        first = first or found
        if found[3] <= ERRORS:
            return found
    return first


def fingerprints(recordings: DataFrame, keep: list[str]) -> DataFrame:
    """keep, the integers, their number n and their digest (s1, s2) for recordings(pcm: 8-bit samples).

    Without integers the digest is of the samples; null and empty recordings have none.
    """
    told = recordings.select(*keep, "pcm")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint((np.frombuffer(x.as_py() or b"", np.uint8).astype(np.float32) - 128) / 128) for x in b["pcm"]]
            digests = [xxhash.xxh3_128_intdigest(p.tobytes()) if len(p) else xxhash.xxh3_128_intdigest(x.as_py() or b"", seed=1) for p, x in zip(prints, b["pcm"], strict=True)]
            nothing = np.array([not x.as_py() for x in b["pcm"]], bool)
            signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64), mask=nothing)
            columns = [pa.array([p.tobytes() for p in prints], pa.binary()), pa.array([len(p) for p in prints], pa.int64()), signed([d >> 64 for d in digests]), signed([d & (2**64 - 1) for d in digests])]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), *columns], names=[*keep, "prints", "n", "s1", "s2"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema if f.name != "pcm")
    return told.mapInArrow(released(work), f"{schema}, prints binary, n long, s1 long, s2 long")


def rank_of(values: np.ndarray) -> np.ndarray:
    return ((values * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def commonness(classes: DataFrame) -> np.ndarray:
    """How often integers of each rank occur, counted in all classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(RANKS, np.int64)
        for b in batches:
            found += np.bincount(rank_of(np.frombuffer(b"".join(b["prints"].to_pylist()), np.uint32)), minlength=RANKS)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some], pa.int64())], names=["rank", "n"])

    counts = classes.select("prints").mapInArrow(released(count), "rank int, n long").groupBy("rank").agg(F.sum("n").alias("n")).toArrow()  # RANKS rows at most
    out = np.zeros(RANKS, np.int64)
    out[counts["rank"].to_numpy()] = counts["n"].to_numpy()
    return out


def enough(n: int) -> tuple[int, bool]:
    """Of a shorter recording's n places, how many a match has at least that agree and have another such place one or two
    further on or back; where there may be none, how many agree."""
    need = math.ceil(VOTES * n)
    gaps = math.ceil((3 * need - 2 - n) / 2)  # need - 1 gaps, n - 1 long together at most: so many are no longer than 2
    return (gaps + 1, True) if gaps > 0 else (need, False)


def neighbours(prints: np.ndarray) -> np.ndarray:
    """For each place four bytes, hashes (from 1 on) of the integers two and one before and one and two after; 0 beyond an end."""
    hashed = (((prints * np.uint32(2246822519)) >> np.uint32(8)) % np.uint32(255) + np.uint32(1)).astype(np.uint32)
    wide = np.concatenate((np.zeros(2, np.uint32), hashed, np.zeros(2, np.uint32)))
    n = len(prints)
    return wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[3 : n + 3] << np.uint32(16) | wide[4 : n + 4] << np.uint32(24)


def chosen(prints: np.ndarray, common: np.ndarray, often: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct integers with their neighbours, at how many chosen places each is, how many of those a match has at
    least, whether a neighbour has to agree there, which of the integers are usual, which are the recording's own usual
    ones (the USUAL most common at chosen places, each with its most frequent neighbours), and these with each neighbour."""
    need, near = enough(len(prints))
    least = math.ceil(SHOWN * need)
    rare = np.argsort(common[rank_of(prints)], kind="stable")[: len(prints) - need + least]
    both, at = np.unique(prints.astype(np.uint64) << np.uint64(32) | neighbours(prints).astype(np.uint64), return_inverse=True)
    values, around, places = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32), np.bincount(at[rare], minlength=len(both))
    count = common[rank_of(values)]
    usual = count >= often
    named = np.flatnonzero(usual & (places > 0) & (around > 0))
    named = named[np.lexsort((both[named], -places[named], values[named], -count[named]))]
    named = named[np.concatenate(([True], values[named[1:]] != values[named[:-1]]))[: len(named)]][:USUAL]
    own = np.zeros(len(both), np.bool_)
    own[named] = True
    beside = around[named, None] >> np.arange(0, 32, 8, dtype=np.uint32) & np.uint32(255)
    names = values[named, None].astype(np.uint64) << np.uint64(32) | np.arange(4, dtype=np.uint64) << np.uint64(8) | beside.astype(np.uint64)
    return values, around, places, least, near, usual, own, names[beside > 0].view(np.int64)


def postings(classes: DataFrame, common: np.ndarray) -> DataFrame:
    """(value, around, node, asks, n, places, least, near, own, usual) for each distinct integer of each class with its
    neighbours; own: it is one of the class's own usual integers, and at all usual integers usual names these."""
    often = max(OFTEN, TIMES * common.mean())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [chosen(np.frombuffer(x, np.uint32), common, often) for x in b["prints"].to_pylist()]
            if not got:
                continue
            of = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
            rows = pa.array(of)
            values, around, places = (np.concatenate([g[i] for g in got]).astype(np.int64).astype(np.int32) for i in range(3))
            each = [pa.array([g[3] for g in got], pa.int32()).take(rows), pa.array([g[4] for g in got], pa.bool_()).take(rows), pa.array(np.concatenate([g[6] for g in got]))]
            usual = pa.array([g[7] for g in got], pa.list_(pa.int64())).take(pa.array(of, mask=~np.concatenate([g[5] for g in got])))
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(around), b["node"].take(rows), b["asks"].take(rows), b["n"].cast(pa.int32()).take(rows), pa.array(places), *each, usual], names=["value", "around", "node", "asks", "n", "places", "least", "near", "own", "usual"])

    schema = "value int, around int, node long, asks boolean, n int, places int, least int, near boolean, own boolean, usual array<long>"
    return classes.where("n > 0").select("node", "asks", "n", "prints").mapInArrow(released(work), schema)


def meetings(held: DataFrame) -> DataFrame:
    """(a, b, shared, least, sure): where an integer of a query's class is one of another class, from the ``postings``.

    A place counts where the integer agrees and, for all but the shortest, one of its neighbours does as well, which a
    match has often enough (``enough``) and what shares single common integers has not. Two classes that both name a
    usual integer with an equal neighbour are met at the first of these alone, and sure: recordings that repeat a few
    sounds would else be met at each of them.
    """
    side = lambda of, x: of.select("value", *(F.col(c).alias(f"{c}_{x}") for c in ("around", "node", "n", "places", "least", "near", "own", "usual")))
    byte = lambda x, k: F.shiftright(F.col(f"around_{x}"), 8 * k).bitwiseAND(F.lit(255))
    agree = reduce(lambda p, q: p | q, ((byte("a", k) == byte("b", k)) & (byte("a", k) != 0) for k in range(4)))
    places = F.expr("IF(n_a <= n_b, places_a, places_b)")
    beside = ~F.expr("IF(n_a <= n_b, near_a, near_b)") | agree
    first = F.expr("array_min(array_intersect(usual_a, usual_b))")
    here = F.col("own_a") & F.col("own_b") & (F.shiftright(first, 32) == F.col("value"))
    met = side(held.where("asks"), "a").join(side(held, "b"), "value").where((F.col("node_a") != F.col("node_b")) & (places > 0) & beside & (first.isNull() | here))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), places.alias("shared"), F.expr("IF(n_a <= n_b, least_a, least_b)").alias("least"), first.isNotNull().alias("sure"))


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b): a query's class and another one that shares as many of the shorter one's chosen places as a match does, or a
    usual integer that both name."""
    met = meetings(materialize(postings(classes, commonness(classes)), "recording-integers"))
    met = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least"), F.bool_or("sure").alias("sure"))
    return met.where("sure OR shared >= least").select("a", "b")


def aligned(recordings: DataFrame, key: str, asks: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The recordings (key, _asks, n, s1, s2), their classes of equal fingerprints, and the pairs (a, b) of a query's class and another that matches."""
    with small_batches(recordings.sparkSession):
        found = materialize(fingerprints(recordings.withColumn("_asks", asks), [key, "_asks"]), "fingerprints")
    classes = found.where("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min(key).alias("id"), F.count("*").alias("copies"), F.coalesce(F.bool_or("_asks"), F.lit(False)).alias("asks"), F.first("prints").alias("prints"), F.first("n").alias("n"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "recording-classes")
    held = lambda x: classes.select(F.col("node").alias(x), F.col("prints").alias(f"prints_{x}"))
    rows = materialize(candidates(classes), "recording-pairs").join(held("a"), "a").join(held("b"), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch[c].to_pylist() for c in ("a", "b", "prints_a", "prints_b")), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                off, votes, n, errors = align(x, y)
                if votes >= VOTES * min(len(x), len(y)) and errors <= ERRORS:
                    out.append((a, b, off, votes, n, errors))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "b", "offset", "votes", "overlap", "bit_error"])

    with small_batches(recordings.sparkSession):
        pairs = materialize(rows.select("a", "b", "prints_a", "prints_b").mapInArrow(released(work), "a long, b long, offset long, votes long, overlap long, bit_error double"), "alignments")
    return found, classes, pairs


def search(recordings: DataFrame, key: str, asks: Column, report: bool = False) -> DataFrame:
    """Matches of the recordings(key, pcm) for which ``asks`` holds among all: query_id and match_id (the smallest key of
    a class of equal recordings), query_copies and match_copies, offset, votes, overlap and bit_error.

    report: adds a row without match for each query that has no integers and so is compared with its equals only.
    """
    found, classes, pairs = aligned(recordings, key, asks)
    side = lambda x, n: classes.select(F.col("node").alias(x), F.col("id").alias(f"{n}_id"), F.col("copies").alias(f"{n}_copies"))
    own = classes.where("asks AND copies > 1").select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).cast("long").alias("offset"), (F.octet_length("prints") / 4).cast("long").alias("votes"), (F.octet_length("prints") / 4).cast("long").alias("overlap"), F.lit(0.0).alias("bit_error"))
    every_pair = pairs.unionAll(own).join(side("a", "query"), "a").join(side("b", "match"), "b")
    matches = every_pair.select("query_id", "match_id", "query_copies", "match_copies", "offset", "votes", "overlap", F.round("bit_error", 6).alias("bit_error"))
    if not report:
        return matches
    without = classes.where("asks AND n = 0").select("id", "copies").unionAll(found.where("_asks AND s1 IS NULL").select(key, F.lit(1).cast("long")))
    return matches.unionByName(without.select(F.col("id").alias("query_id"), F.col("copies").alias("query_copies")), allowMissingColumns=True)


def linked(recordings: DataFrame, key: str, asks: Column) -> DataFrame:
    """One row for each recording: key, class_id (the smallest key of its class of equal recordings; null for null and empty
    ones), copies (the class's recordings), asks (one of the class is a query), links and linked_rows (other classes that
    match it, and their recordings, of which either side is a query), and of the closest one (fewest bits that differ, then
    most votes, then smallest class) closest_id, offset (of its start in this one), votes, overlap and bit_error.
    """
    found, classes, pairs = aligned(recordings, key, asks)
    told = classes.select("node", "id", "copies", "asks")
    both = pairs.withColumn("_flip", F.explode(F.array(F.lit(False), F.lit(True))))
    turn = lambda x, y: F.when(F.col("_flip"), F.col(y)).otherwise(F.col(x))
    both = both.select(turn("a", "b").alias("node"), turn("b", "a").alias("other"), F.when(F.col("_flip"), -F.col("offset")).otherwise(F.col("offset")).alias("offset"), "votes", "overlap", F.round("bit_error", 6).alias("bit_error"), "_flip")
    both = both.join(told.select("node", F.col("asks").alias("_own")), "node").where("NOT (_flip AND _own)")  # a query has its own pair
    others = told.select(F.col("node").alias("other"), F.col("id").alias("_id"), F.col("copies").alias("_copies"))
    best = F.min(F.struct("bit_error", (-F.col("votes")).alias("few"), F.col("_id").alias("closest_id"), "offset", "overlap"))
    links = both.join(others, "other").groupBy("node").agg(F.count("*").alias("links"), F.sum("_copies").alias("linked_rows"), best.alias("x"))
    links = links.select("node", "links", "linked_rows", "x.closest_id", "x.offset", (-F.col("x.few")).alias("votes"), "x.overlap", "x.bit_error")
    of_class = classes.select("s1", "s2", "node", F.col("id").alias("class_id"), "copies", "asks").join(links, "node", "left").drop("node")
    rows = found.select(key, "_asks", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select(key, "class_id", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.coalesce("asks", "_asks", F.lit(False)).alias("asks"), zero("links"), zero("linked_rows"), "closest_id", "offset", "votes", "overlap", "bit_error")


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no table of audio: a document's bytes stand in for 8-bit samples. Queries: doc_id divisible by 50. One row a
    document with its class and the number of its links."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("pcm"))
    return linked(docs, "doc_id", F.col("doc_id") % 50 == 0)
