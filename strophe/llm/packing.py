"""Best-fit packing, planned on the histogram of lengths.

Documents are turned into token ids and cut only where they exceed a sequence. How many pieces there are of each
length (as many numbers as a sequence has tokens) is all that the plan needs: best fit, longest first, over counts
gives ranges of places for each length. Pieces then take their place by a join on their rank within their length.

The plan holds groups of sequences with the same room instead of single ones, so its size depends on the sequence
length alone. Pieces of one length are numbered bucket by bucket: a length that a third of all rows share is no task.

Defined cases: a null text is empty and has the end id alone; null ids and repeated rows are packed row by row;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, materialize, numbered, read, released, small_batches, with_row_id
from .tokens import tokenizer_path, worker_encoder

SEQUENCE = 2048
END = (0).to_bytes(4, "little")


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges (length, first rank, pieces, pieces in a sequence, first sequence, offset of the first piece).

    Pieces of one length come one after another, so they fill a sequence before the next: a group of sequences
    with the same room takes ``room // length`` pieces each.
    """
    ranges, rooms, groups, fresh = [], [], {}, 0  # rooms: ascending keys of groups {room: [(first sequence, sequences)]}

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                bisect.insort(rooms, room)
            groups.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, n = size, fresh, -(-left // (size // length))
                fresh += n
            each = room // length
            took = min(left, each * n)
            ranges.append((length, rank, took, each, first, size - room))
            full, rest = divmod(took, each)
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            used = full + (rest > 0)
            put(room, first + used, n - used)
            rank, left = rank + took, left - took
    return ranges


def pieces(docs: DataFrame, tokenizer: str, size: int, order: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the order of its document."""
    columns = ["doc_id", "text"] + ([order] if order else [])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (f", {order} long" if order else "")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ([order] if order else [])
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + ([pa.int64()] if order else [])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for b in batches:
            rows = []
            places = b[order].to_pylist() if order else [None] * b.num_rows
            for doc, place, ids in zip(b["doc_id"].to_pylist(), places, encoder.documents(b["text"], END), strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), place))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *columns[2:]).mapInArrow(released(cut), schema)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, order: str | None = None) -> DataFrame:
    """One row for each piece of docs(doc_id, text): where it came from, sequence_id and offset.

    order: a column with the place of each document in the stream; each sequence then has ``sequence_order``, the
    first place among its documents, and the result is sorted by it.
    """
    with small_batches(docs.sparkSession):
        cut = materialize(pieces(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), size, order), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    table = few(materialize(docs.sparkSession.createDataFrame(plan(counts, size), "_length long, first long, n long, each long, sequence long, at long"), "plan"))
    ranked = numbered(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], "_rank")
    step = F.col("_rank") - F.col("first")
    placed = ranked.join(table, (F.col("length") == F.col("_length")) & (step >= 0) & (step < F.col("n"))).select(
        *cut.columns, (F.col("sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + step % F.col("each") * F.col("length")).cast("long").alias("offset")
    )
    if order is None:
        return placed
    placed = materialize(placed, "placed")
    first = placed.groupBy(F.col("sequence_id").alias("_s")).agg(F.min(order).alias("sequence_order"))
    return placed.join(first, F.col("sequence_id") == F.col("_s")).drop("_s", order).orderBy("sequence_order", "sequence_id", "offset")


def in_stream_order(docs: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Packs docs as they were written (file by file, row by row): sequences come in the order of the stream."""
    rows = with_row_id(docs)
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    return pack(rows.select("doc_id", "text", (F.shiftleft(part, 40) + F.col("_row.at")).alias("_order")), size=size, order="_order")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
