"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words, in lower case, and how words begin (``HEADS`` bytes), hashed to ``2 ** BITS`` buckets; a
text is the set of its buckets. The machine's score is

    w0 + sum of w[i] x[i] + sum over pairs i < j of v[i] . v[j] x[i] x[j],

so two terms can say together what neither says alone (an insult beside a group's name), which additive weights miss.
x[i] is the same in every text that has the term: the more the term alone tells, the larger, so that what is shared by
many texts of a label is learnt before what singles one out.

It is fitted on a bounded sample of labelled rows: up to ``SAMPLE`` rows of either label, those with the smallest
hashes of doc_id, chosen from the labels alone. Of their buckets the ``TERMS`` that tell the labels apart best (by the
likelihood ratio of their counts, a grouped aggregation) take part; sets of these reach the driver, which descends by
gradients with the two labels weighing alike. Machines fitted on parts of the sample score the rest of it; from these
scores a slope and an offset are fitted that make the score a chance. Every row is scored on its whole text, in a scan
without shuffle.

Defined cases: a null text is an empty one and both have the score of w0 alone; a null doc_id has no label and is not
held out; of several labels of one doc_id the highest counts, a null label is none; with no labels, or of one kind
only, the score is the share of label 1 drawn towards a half; repeated rows are scored row by row; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, materialize, read, released, scratch, small_batches
from .langid import spans
from .shingles import eights, hashes, mixed

#: Labelled rows of either label that the machine is fitted on at most, and buckets that take part at most.
SAMPLE, TERMS = 4096, 4096
BITS = 18
#: Bytes of a word's beginning that are a term of their own, from words that are longer.
HEADS = (4, 5, 6)
FACTORS, EPOCHS, BATCH, FOLDS = 8, 30, 64, 3
#: Steps of weights and of factors, the decay of both, the factors' spread at first, and the least x.
STEP, FACTOR_STEP, DECAY, SPREAD, LEAST = 2.0, 0.5, 1e-4, 0.02, 0.1
#: A document is called toxic from this score on.
TOXIC = 0.7
#: Bytes worked on at a time.
SLICE = 1 << 21

_LETTER = np.zeros(256, np.bool_)
_LETTER[128:] = True
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[ord("0") : ord("9") + 1] = True


def buckets(column: pa.Array, bits: int = BITS, only: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each text the distinct buckets of its terms, sorted; ``only`` marks the buckets that count."""
    data, ends = spans(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1)
        own = [np.zeros(0, np.int64)] * (j - i)
        for a, b in _parts(data, int(ends[i]), int(ends[j])):  # more than one only for a text longer than SLICE
            found = _terms(data[a:b], np.clip(ends[i : j + 1], a, b) - a, bits, only)
            own = [np.union1d(x, y) if len(x) else y for x, y in zip(own, found, strict=True)]
        yield from own
        i = j


def _parts(data: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE bytes that end where no word goes on."""
    while last - first > SLICE:
        at = first + SLICE
        while at < last and _LETTER[data[at]]:
            at += 1
        yield first, at
        first = at
    yield first, last


def _terms(data: np.ndarray, ends: np.ndarray, bits: int, only: np.ndarray | None) -> list[np.ndarray]:
    """The distinct buckets of each of the texts that lie one after another in data."""
    full, edge = _LETTER[data], np.zeros(len(data) + 1, np.bool_)
    edge[ends] = True
    if not full.any():
        return [np.zeros(0, np.int64)] * (len(ends) - 1)
    lo = np.flatnonzero(full & ~(np.concatenate(([False], full[:-1])) & ~edge[:-1]))
    hi = np.flatnonzero(full & ~(np.concatenate((full[1:], [False])) & ~edge[1:])) + 1
    padded, size = np.concatenate((data, np.zeros(8, np.uint8))), hi - lo
    owner = np.searchsorted(ends, lo, "right") - 1
    keys, owners = [hashes(padded, lo, size)], [owner]
    for h in HEADS:
        some = size > h
        keys.append(mixed(eights(padded, lo[some], np.full(int(some.sum()), h)) ^ mixed(np.full(1, h, np.uint64))))
        owners.append(owner[some])
    code, owner = (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners).astype(np.int64)
    if only is not None:
        some = only[code]
        code, owner = code[some], owner[some]
    code = np.unique((owner << bits) | code)
    cut = np.searchsorted(code >> bits, np.arange(len(ends)))
    code &= (1 << bits) - 1
    return [code[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@dataclass(frozen=True)
class Machine:
    """A factorization machine over the buckets in ``terms`` (sorted), and how its score becomes a chance."""

    terms: np.ndarray
    x: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, sets: list[np.ndarray]) -> np.ndarray:
        """The scores of sets of places in terms."""
        return _sums(self.w0, self.w, self.v, *_flat(sets, self.x))[0]

    def scores(self, column: pa.Array, bits: int = BITS) -> np.ndarray:
        only = np.zeros(1 << bits, np.bool_)
        only[self.terms] = True
        return logistic(self.slope * self.raw([np.searchsorted(self.terms, s) for s in buckets(column, bits, only)]) + self.offset)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _flat(sets: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)
    return at, x[at], np.cumsum([0, *map(len, sets)])


def _by_row(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; rows may be empty."""
    sums = np.add.reduceat(np.concatenate((values, np.zeros((1, *values.shape[1:])))), cut[:-1], axis=0)
    return sums * (cut[1:] > cut[:-1]).reshape(-1, *[1] * (values.ndim - 1))


def _sums(w0: float, w: np.ndarray, v: np.ndarray, at: np.ndarray, x: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, each row's sums of factors, and the factors times x."""
    own = v[at] * x[:, None]
    s = _by_row(own, cut)
    return w0 + _by_row(w[at] * x, cut) + 0.5 * ((s * s).sum(1) - _by_row((own * own).sum(1), cut)), s, own


def descend(terms: np.ndarray, x: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """Fits a machine to sets of places in terms by gradients of the weighted logistic loss."""
    rng = np.random.default_rng(1)
    w0, w, v = 0.0, np.zeros(len(terms)), rng.normal(0, SPREAD, (len(terms), factors))
    for _ in range(epochs):
        order = rng.permutation(len(sets))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            at, xs, cut = _flat([sets[i] for i in rows], x)
            z, s, own = _sums(w0, w, v, at, xs, cut)
            off = (logistic(z) - labels[rows]) * weights[rows] / len(rows)
            each = np.repeat(off, np.diff(cut)) * xs
            some, inverse = np.unique(at, return_inverse=True)
            slope = each[:, None] * (np.repeat(s, np.diff(cut), axis=0) - own)
            dv = np.stack([np.bincount(inverse, slope[:, f], len(some)) for f in range(factors)], 1) if factors else v[some]
            w0 -= STEP * off.sum()
            w[some] -= STEP * (np.bincount(inverse, each, len(some)) + DECAY * w[some])
            v[some] -= FACTOR_STEP * np.clip(dv + DECAY * v[some], -1, 1)
    return Machine(terms, x, w0, w, v)


def calibrated(machine: Machine, sets: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, chance: np.ndarray, factors: int) -> Machine:
    """machine with the slope and offset that suit scores of rows by machines fitted without them."""
    fold, z = np.arange(len(sets)) % FOLDS, np.zeros(len(sets))
    for f in range(FOLDS):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        z[own] = descend(machine.terms, machine.x, [sets[i] for i in rest], labels[rest], weights[rest], factors).raw([sets[i] for i in own])
    z = np.clip(z, -50, 50)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps; the slope is drawn to 1
        p = logistic(a * z + b)
        off, curve = (p - labels) * chance, np.maximum(p * (1 - p), 1e-6) * chance
        step = np.linalg.solve([[curve @ (z * z) + 1, curve @ z], [curve @ z, curve.sum() + 1e-3]], [off @ z + a - 1, off.sum()])
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return replace(machine, slope=max(a, 0.01), offset=b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, factors: int = FACTORS, bits: int = BITS) -> Machine:
    """Fits a machine on docs(doc_id, text) and labels(doc_id, toxic), on rows that are not held out."""
    spark = docs.sparkSession
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    given = given.withColumn("_h", F.xxhash64("doc_id"))
    with scratch(spark):
        given = materialize(given, "toxic-labels")
        kinds = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
        total = sum(kinds.values())
        if len(kinds) < 2:
            share = (kinds.get(1, 0) + 1) / (total + 2)
            return Machine(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, factors)))
        some = given.where(F.col("y") == 0).orderBy("_h").limit(sample).unionAll(given.where(F.col("y") == 1).orderBy("_h").limit(sample))
        some = materialize(some.select(F.col("doc_id").alias("_id"), "y"), "toxic-sample")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = list(buckets(b["text"], bits))
                yield pa.RecordBatch.from_arrays([b["y"], pa.array([s.astype(np.int32) for s in sets], pa.list_(pa.int32()))], names=["y", "terms"])

        rows = docs.select("doc_id", "text").join(few(some), F.col("doc_id") == F.col("_id")).select("y", "text")
        with small_batches(spark):
            rows = materialize(rows.mapInArrow(released(work), "y int, terms array<int>").distinct(), "toxic-terms")
        many = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n0, n1 = many.get(0, 0), many.get(1, 0)
        counted = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.count("*").alias("n"))

        def part(seen: Column, expected: Column) -> Column:
            return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

        a, b, n, all_n = F.col("a"), F.col("n") - F.col("a"), F.col("n"), float(max(1, n0 + n1))
        ratio = part(a, n * n1 / all_n) + part(b, n * n0 / all_n) + part(n1 - a, (all_n - n) * n1 / all_n) + part(n0 - b, (all_n - n) * n0 / all_n)
        chosen = counted.where("n > 1").withColumn("g", F.round(ratio, 9)).orderBy(F.desc("g"), "term").limit(terms).select("term", "g").toPandas().sort_values("term")  # terms rows at most
        kept, gain = chosen["term"].to_numpy(np.int64), chosen["g"].to_numpy(np.float64)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [np.flatnonzero(np.isin(kept, np.array(t, np.int64))).astype(np.int32) for t in b["terms"].to_pylist()]
                yield pa.RecordBatch.from_arrays([b["y"], pa.array(own, pa.list_(pa.int32()))], names=["y", "at"])

        got = rows.mapInArrow(places, "y int, at array<int>").orderBy("y", "at").toArrow()  # 2 * sample rows of terms places at most
    y = got["y"].to_numpy().astype(np.float64)
    sets = [np.array(t, np.int64) for t in got["at"].to_pylist()]
    x = np.maximum(LEAST, np.sqrt(np.sqrt(np.maximum(gain, 0) / max(gain.max(initial=0), 1e-9))))
    alike = np.where(y == 1, 0.5 / max(1, n1), 0.5 / max(1, n0)) * len(y)
    found = np.where(y == 1, kinds[1] / total / max(1, n1), kinds[0] / total / max(1, n0)) * len(y)
    return calibrated(descend(kept, x, sets, y, alike, factors), sets, y, alike, np.sqrt(alike * found), factors)


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """keep and score for each row of docs(text, keep)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = machine.scores(b["text"], bits)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(got, pa.float64())], names=[*keep, "score"])

    chosen = docs.select(*keep, "text")
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    return chosen.mapInArrow(released(work), schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text)."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op11_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
