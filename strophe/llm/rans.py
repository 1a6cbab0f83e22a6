"""Token ids in a binary format: static range asymmetric numeral system (rANS).

A file is a table of segments. A segment holds whole documents: their ids and counts, one frequency table shared by
all its blocks, and the blocks. A block is a fixed number of tokens dealt over ``LANES`` interleaved states that
share one stream of 32-bit words; every ``EVERY`` steps it keeps a checkpoint (the states and the place in the
stream), so each stretch between two checkpoints can be decoded on its own, and a checksum of its tokens. All
stretches of a segment are decoded at once by vector operations, and segments by as many tasks as there are.

Files are written by Spark's own writer in ascending order of documents, so a lost executor costs the part it held.

Defined cases: a null text is empty and has the end id alone; rows with a null id come first; rows that share an id
are ordered by their text's checksum; an empty table gives an empty result; a damaged block raises ``ValueError``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, released, shared_dir, small_batches
from .tokens import tokenizer_path, worker_encoder

LANES = 64
BLOCK = 1 << 16
EVERY = 256
#: Tokens gathered for one segment, if its last document is no longer than that.
SEGMENT = 1 << 21
LOW = np.uint64(1 << 31)
END = (0).to_bytes(4, "little")


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to a sum of 2**bits, 1 at least for each."""
    total = 1 << bits
    f = np.maximum(1, counts.astype(np.float64) * total / counts.sum()).astype(np.int64)
    off = total - int(f.sum())
    if off > 0:
        f[np.argmax(f)] += off
    while off < 0:  # take from the largest, which lose least by it
        order = np.argsort(-f, kind="stable")[: min(len(f), -off)]
        order = order[f[order] > 1]
        f[order] -= 1
        off += len(order)
    return f.astype(np.uint64)


class Table:
    """Frequencies of a segment's distinct ids, with what the decoder looks up."""

    def __init__(self, ids: np.ndarray, f: np.ndarray):
        self.ids, self.f = ids, f.astype(np.uint64)
        self.bits = np.uint64(int(self.f.sum()).bit_length() - 1)
        self.cum = np.concatenate(([0], np.cumsum(self.f)[:-1])).astype(np.uint64)

    @classmethod
    def of(cls, tokens: np.ndarray) -> tuple[Table, np.ndarray]:
        counts = np.bincount(tokens) if tokens.size and tokens.max() < 1 << 24 else None
        if counts is None:
            ids, symbols, n = np.unique(tokens, return_inverse=True, return_counts=True)
        else:
            ids = np.flatnonzero(counts)
            n, place = counts[ids], np.zeros(len(counts), np.int32)
            place[ids] = np.arange(len(ids), dtype=np.int32)
            symbols = place[tokens]
        bits = min(24, max(12, int(len(ids)).bit_length() + 3))
        return cls(ids.astype(np.uint32), frequencies(n, bits)), symbols

    def pack(self) -> tuple[bytes, bytes]:
        return zlib.compress(np.diff(self.ids, prepend=np.uint32(0)).astype("<u4").tobytes(), 1), zlib.compress(self.f.astype("<u4").tobytes(), 1)

    @classmethod
    def unpack(cls, ids: bytes, f: bytes) -> Table:
        return cls(np.cumsum(np.frombuffer(zlib.decompress(ids), "<u4"), dtype=np.uint32), np.frombuffer(zlib.decompress(f), "<u4").astype(np.uint64))


def encode_blocks(symbols: np.ndarray, table: Table) -> list[tuple[bytes, bytes, list[int]]]:
    """Words, checkpoint states and checkpoint places of equally long blocks (a row of ``symbols`` each)."""
    blocks, n = symbols.shape
    lanes, steps = min(LANES, n), -(-n // LANES)
    shift, up = np.uint64(63) - table.bits, np.uint64(32)
    x = np.full((blocks, lanes), LOW)
    words, emitted = np.zeros((steps, blocks, lanes), np.uint32), np.zeros((steps, blocks, lanes), np.bool_)
    states: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        s = symbols[:, t * LANES : (t + 1) * LANES]
        k = s.shape[1]
        f, c, v = table.f[s], table.cum[s], x[:, :k]
        out = v >= (f << shift)
        words[t, :, :k], emitted[t, :, :k] = v.astype(np.uint32), out
        v = np.where(out, v >> up, v)
        q = v // f
        x[:, :k] = (q << table.bits) + (v - q * f) + c
        if t % EVERY == 0:
            states.append(x.copy())
    sizes = np.concatenate((np.zeros((1, blocks), np.int64), np.cumsum(emitted.sum(2), 0)))[:-1:EVERY]
    kept = np.stack(states[::-1])
    return [(words[:, b][emitted[:, b]].astype("<u4").tobytes(), kept[:, b].astype("<u8").tobytes(), sizes[:, b].tolist()) for b in range(blocks)]


def decode_blocks(blocks: list[tuple[int, bytes, bytes, list[int]]], table: Table) -> list[np.ndarray]:
    """Tokens of each block (tokens, words, states, places); every stretch of every block runs in the same vectors."""
    where, base = [], 0
    for b, (n, words, _, places) in enumerate(blocks):
        where += [(b, j, n, base + p) for j, p in enumerate(places)]
        base += len(words) // 4
    stream = np.frombuffer(b"".join(w for _, w, _, _ in blocks) + bytes(4), "<u4")
    out = [np.empty(n, np.uint32) for n, *_ in blocks]
    symbol = np.repeat(np.arange(len(table.f), dtype=np.uint32), table.f.astype(np.int64))
    low, up = (np.uint64(1) << table.bits) - np.uint64(1), np.uint64(32)
    groups: dict[tuple[int, int], list] = {}
    for b, j, n, at in where:  # stretches of one shape go together
        groups.setdefault((min(LANES, n), min(n - j * EVERY * LANES, EVERY * LANES)), []).append((b, j, at))
    for (lanes, length), members in groups.items():
        steps = -(-length // LANES)
        x = np.stack([np.frombuffer(blocks[b][2], "<u8").reshape(-1, lanes)[j] for b, j, _ in members]).astype(np.uint64)
        at = np.array([p for *_, p in members], np.int64)[:, None]
        got = np.zeros((steps, len(members), lanes), np.uint32)
        for t in range(steps):
            k = min(lanes, length - t * LANES)
            v = x[:, :k]
            slot = v & low
            s = symbol[slot]
            got[t, :, :k] = s
            v = table.f[s] * (v >> table.bits) + slot - table.cum[s]
            need = v < LOW
            rank = np.cumsum(need, 1)
            x[:, :k] = np.where(need, (v << up) | stream[np.minimum(at + rank - 1, len(stream) - 1)], v)
            at = at + rank[:, -1:]
        for i, (b, j, _) in enumerate(members):
            out[b][j * EVERY * LANES : j * EVERY * LANES + length] = table.ids[got[:, i].reshape(-1) if lanes == LANES else got[0, i]][:length]
    return out


SEGMENTS = "part int, seq int, doc_ids array<long>, counts array<long>, table_ids binary, table_f binary, blocks array<struct<n:int,words:binary,states:binary,places:array<long>,crc:long>>, n_tokens long"
_BLOCK = pa.struct([("n", pa.int32()), ("words", pa.binary()), ("states", pa.binary()), ("places", pa.list_(pa.int64())), ("crc", pa.int64())])
_SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("table_ids", pa.binary()), ("table_f", pa.binary()), ("blocks", pa.list_(_BLOCK)), ("n_tokens", pa.int64())])


def encode_segment(tokens: np.ndarray) -> dict:
    """The table and the blocks of a segment's tokens."""
    table, symbols = Table.of(tokens)
    whole, blocks = len(tokens) // BLOCK, []
    for first in range(0, whole, 32):  # so many blocks at a time
        some = symbols[first * BLOCK : min(whole, first + 32) * BLOCK].reshape(-1, BLOCK)
        blocks += [(BLOCK, *x) for x in encode_blocks(some, table)]
    if len(tokens) % BLOCK:
        blocks += [(len(tokens) % BLOCK, *x) for x in encode_blocks(symbols[None, whole * BLOCK :], table)]
    data = tokens.astype("<u4")
    rows = [{"n": n, "words": w, "states": s, "places": p, "crc": zlib.crc32(data[i * BLOCK : i * BLOCK + n])} for i, (n, w, s, p) in enumerate(blocks)]
    ids, f = table.pack()
    return {"table_ids": ids, "table_f": f, "blocks": rows, "n_tokens": len(tokens)}


def decode_segment(table_ids: bytes, table_f: bytes, blocks: list[dict]) -> Iterator[np.ndarray]:
    """Tokens of a segment, some blocks at a time; each block's checksum is compared."""
    table = Table.unpack(table_ids, table_f)
    for first in range(0, len(blocks), 32):
        some = blocks[first : first + 32]
        for b, tokens in zip(some, decode_blocks([(b["n"], b["words"], b["states"], b["places"]) for b in some], table), strict=True):
            if zlib.crc32(tokens.astype("<u4")) != b["crc"]:
                raise ValueError("a block's tokens do not have the checksum that was stored with it")
            yield tokens


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the ids of docs(doc_id, text) in ascending order of doc_id, id 0 after each document."""
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_encoder(tokenizer), TaskContext.get().partitionId()
        held: list[tuple[int | None, bytes]] = []
        size = seq = 0

        def segment() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "doc_ids": [d for d, _ in held], "counts": [len(x) // 4 for _, x in held]}
            row |= encode_segment(np.frombuffer(b"".join(x for _, x in held), "<u4"))
            return pa.RecordBatch.from_pylist([row], schema=_SEGMENT)

        for b in batches:
            for doc, ids in zip(b["doc_id"].to_pylist(), encoder.documents(b["text"], END), strict=True):
                if held and size + len(ids) // 4 > SEGMENT:
                    yield segment()
                    held, size, seq = [], 0, seq + 1
                held.append((doc, ids))
                size += len(ids) // 4
        if held:
            yield segment()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.crc32(F.col("text").cast("binary"))]  # rows that share an id, or have none, can be dealt out as well
    with small_batches(docs.sparkSession):
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(released(write), SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files at path: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b[n][i].as_py() for n in b.schema.names}
                counts, k, left, crc, found = row["counts"], 0, row["counts"][0], 0, []
                for tokens in decode_segment(row["table_ids"], row["table_f"], row["blocks"]):
                    data, at = tokens.astype("<u4"), 0
                    while at < len(data):
                        take = min(left, len(data) - at)
                        crc, at, left = zlib.crc32(data[at : at + take], crc), at + take, left - take
                        if not left:
                            found.append(crc)
                            k, crc = k + 1, 0
                            left = counts[k] if k < len(counts) else 0
                starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
                same = lambda n, v=row: pa.array([v[n]] * len(v["counts"]), pa.int32())
                yield pa.RecordBatch.from_arrays([same("part"), same("seq"), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.int64())], names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(path)
    sizes = files.select(F.col("part").alias("_p"), F.col("seq").alias("_s"), F.col("n_tokens").alias("_n"))
    parts = sizes.groupBy("_p").agg(F.sum("_n").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("_p").alias("_q"), before(Window.orderBy("_p")).alias("_parts_before"))  # a row for each part file
    offsets = sizes.withColumn("_inside", before(Window.partitionBy("_p").orderBy("_s"))).join(parts, F.col("_p") == F.col("_q")).select("_p", "_s", (F.col("_parts_before") + F.col("_inside")).alias("_before"))
    decoded = files.select("part", "seq", "doc_ids", "counts", "table_ids", "table_f", "blocks").mapInArrow(released(decode), "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    joined = decoded.join(offsets, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s")))
    return joined.select("doc_id", (F.col("_before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", F.col("part").alias("file_part"), "seq")


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/strophe/rans-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
