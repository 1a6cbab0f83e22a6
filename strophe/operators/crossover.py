"""Signals split into bands by recursive filters, block by block, and put together again with a gain for each band.

Each edge between bands is a low-pass of two poles; a band is the difference of two of them, so bands add up to the signal.
A recursive filter's state after a block is an affine function of that before it, state' = M state + b, with the same M
for all blocks of a length. So each block is run from a state of zeros, which gives its b; these maps are composed in order,
a few numbers a block; and then each block is run once more from the state in which it really starts. Tasks hold blocks,
never a signal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even_units, unit_sum
from .chunks import chunked
from .selection import held

#: The bands and the edges between them, in Hz.
BANDS = ["sub_bass", "bass", "low_mid", "mid", "high_mid", "air"]
EDGES = [60.0, 250.0, 500.0, 2000.0, 6000.0]
SIZE = 8192


def poles(rate: float, edges: list[float]) -> np.ndarray:
    """Of each edge's low-pass how much of the last output stays."""
    return np.exp(-2 * np.pi * np.minimum(edges, 0.49 * rate) / rate)


def run(x: np.ndarray, a: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low-passes of blocks x (a row each, of one length) and their states afterwards: states (blocks, edges, 2).

    Sample by sample, all blocks and edges at once.
    """
    out, (one, two) = np.empty((x.shape[1], len(x), len(a))), (state[..., 0].copy(), state[..., 1].copy())
    b = 1 - a
    for n in range(x.shape[1]):
        one = a * one + b * x[:, n, None]
        two = a * two + b * one
        out[n] = two
    return out.transpose(1, 0, 2), np.stack((one, two), -1)


def transition(a: float, n: int) -> np.ndarray:
    """What n samples make of the state of a two-pole low-pass, apart from what they bring in: a 2 by 2 matrix."""
    return np.linalg.matrix_power(np.array([[a, 0.0], [a * (1 - a), a]]), n)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of a length together: their places and samples."""
    ends, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, flat[ends[at][:, None] + np.arange(n)]


def _entered(samples: DataFrame, key: str, a: np.ndarray, size: int) -> DataFrame:
    """key, chunk, xs and state: the blocks of samples, each with the state in which the low-passes a start it."""
    many = 2 * len(a)
    blocks = chunked(samples, key, "i", ["x"], size)
    blocks = held(blocks.select(key, "chunk", F.transform("rows", lambda r: F.coalesce(r["x"].cast("double"), F.lit(0.0))).alias("xs")))
    kind = f"`{key}` {samples.schema[key].dataType.simpleString()}, chunk long"

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_length(b["xs"]):
                _, state = run(x, a, np.zeros((len(x), len(a), 2)))
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([b[key].take(rows), b["chunk"].take(rows), pa.array(list(state.reshape(len(x), -1)), pa.list_(pa.float64()))], names=[key, "chunk", "brings"])

    m = [transition(v, size) for v in a]
    brings = blocks.mapInArrow(alone, f"{kind}, brings array<double>")

    def step(acc, x):
        s = lambda i: F.get(acc["state"], F.lit(i))
        after = F.array(*(F.lit(float(m[i // 2][i % 2, 0])) * s(i - i % 2) + F.lit(float(m[i // 2][i % 2, 1])) * s(i - i % 2 + 1) + F.get(x["brings"], F.lit(i)) for i in range(many)))
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(F.struct(x["chunk"].alias("chunk"), acc["state"].alias("state")))).alias("out"))

    zero = F.struct(F.array_repeat(F.lit(0.0), many).alias("state"), F.array().cast("array<struct<chunk:bigint,state:array<double>>>").alias("out"))
    entered = brings.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list(F.struct("chunk", "brings"))), zero, step).alias("s"))  # a few numbers a block
    entered = entered.select(F.col(key).alias("_k"), F.explode("s.out").alias("o")).select("_k", F.col("o.chunk").alias("_c"), F.col("o.state").alias("state"))
    return blocks.join(entered, F.col(key).eqNullSafe(F.col("_k")) & (F.col("chunk") == F.col("_c"))).select(key, "chunk", "xs", "state")


def _bands(batches: Iterator[pa.RecordBatch], a: np.ndarray, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of ``most`` blocks, the places there of blocks of one length, their samples and their bands (blocks, samples, bands)."""
    for whole in batches:
        for b in (whole.slice(i, most) for i in range(0, whole.num_rows, most)):
            states = np.array(b["state"].flatten().to_numpy()).reshape(b.num_rows, len(a), 2)
            for at, x in _by_length(b["xs"]):
                low, _ = run(x, a, states[at])
                yield b, at, x, np.diff(np.concatenate((np.zeros((*x.shape, 1)), low, x[..., None]), -1), axis=-1)


def equalised(samples: DataFrame, key: str, rate: float, gains: dict[str, float], edges: list[float] = EDGES, bands: list[str] = BANDS, size: int = SIZE) -> DataFrame:
    """key, i, x and each band of samples(key, i, x), i from 0 without gaps; x is the bands' sum with gains in dB (0 if not told)."""
    a, factor = poles(rate, edges), np.array([10 ** (gains.get(n, 0.0) / 20) for n in bands])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, x, parts in _bands(batches, a, 32):
            rows, place = pa.array(np.repeat(at, x.shape[1])), (b["chunk"].take(pa.array(at)).to_numpy()[:, None] * size + np.arange(x.shape[1])).reshape(-1)
            yield pa.RecordBatch.from_arrays([b[key].take(rows), pa.array(place), pa.array((parts @ factor).reshape(-1)), *(pa.array(parts[..., i].reshape(-1)) for i in range(len(bands)))], names=[key, "i", "x", *bands])

    return _entered(samples, key, a, size).mapInArrow(split, f"`{key}` {samples.schema[key].dataType.simpleString()}, i long, x double, " + ", ".join(f"{n} double" for n in bands))


def magnitudes(samples: DataFrame, key: str, rate: float, gains: dict[str, float], digits: int, edges: list[float] = EDGES, bands: list[str] = BANDS, size: int = SIZE) -> DataFrame:
    """key, n and, of what ``equalised`` gives, the sum of the magnitudes of x and of each band, each rounded to so many digits.

    A block's samples are rounded and added where they are made, as integers, so a row for each block is shuffled.
    """
    a, factor = poles(rate, edges), np.array([10 ** (gains.get(n, 0.0) / 20) for n in bands])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, x, parts in _bands(batches, a, max(1, (1 << 17) // size)):
            sums = [half_even_units(np.abs(v), digits).sum(1) for v in (parts @ factor, *np.moveaxis(parts, -1, 0))]
            yield pa.RecordBatch.from_arrays([b[key].take(pa.array(at)), pa.array(np.full(len(at), x.shape[1])), *map(pa.array, sums)], names=[key, "n", "x", *bands])

    told = _entered(samples, key, a, size).mapInArrow(measure, f"`{key}` {samples.schema[key].dataType.simpleString()}, n long, x long, " + ", ".join(f"{n} long" for n in bands))
    return told.groupBy(key).agg(F.sum("n").alias("n"), *(unit_sum(F.col(c), digits).alias(c) for c in ("x", *bands)))
