"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size blocks of bytes. Equal blocks get one integer name: the smallest id among the blocks
with that content. Names of adjacent blocks are then paired and each distinct pair is named, again and again, until
a document has a single name. Two documents share that name exactly when their texts are equal: no digest decides.

Names come from aggregations with partial results, so a block that fills a third of the corpus reaches its reducer as
one row for each map task. The first one groups blocks by their content; it moves the corpus once, and what it leaves
is a name for each content with a 128-bit key. Names are handed back by a join on these keys, from tables that were
written first: both sides are shuffles, which skew handling can split, and only integers move. Should two contents
share a key, their blocks are named by a join on the content itself.

Defined cases: null, empty and blank-only texts are equal to each other; null ids are allowed and lose ties against
any id; a row that is repeated with its id is a copy like any other (one of the rows stays); an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, let, materialize, read, scratch, with_row_id, without_rows

BLOCK_BYTES = 2048
#: The characters that do not count when texts are compared: [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\v", "\f", "\r")


def without_blanks(text: Column) -> Column:
    """Plain replacements work on bytes and cost less than a pattern."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def name_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Replaces the columns keys of rows, a written table, none of them null, by ``_name``: the smallest _id of a row with the same keys."""
    names = rows.groupBy(*(F.col(c).alias(f"{c}_of") for c in keys)).agg(F.min("_id").alias("_name"))
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"{c}_of") for c in keys))
    return rows.join(materialize(names, "names"), same).drop("_id", *keys, *(f"{c}_of" for c in keys))


def keys_of(block: Column) -> tuple[Column, Column]:
    return F.xxhash64(block), F.xxhash64(F.lit(1), block)


def named_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The blocks of docs(_row, doc_id, text) with ``_name`` in place of their content."""
    blocks = blocks_of(docs, block_bytes)
    keys = [k.alias(name) for k, name in zip(keys_of(F.col("_block")), ("_k1", "_k2"), strict=True)]
    rows = materialize(blocks.select("_row", "_i", "_parts", "_about", *keys).withColumn("_id", F.monotonically_increasing_id()), "block-keys")
    contents = materialize(blocks.select(*keys, "_block").distinct().select("_k1", "_k2"), "contents")
    shared = contents.groupBy("_k1", "_k2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_k1").alias("_c1"), F.col("_k2").alias("_c2"))
    shared = few(materialize(shared, "shared-keys"))
    if shared.isEmpty():
        return name_by(rows, "_k1", "_k2")
    told = (F.col("_k1") == F.col("_c1")) & (F.col("_k2") == F.col("_c2"))
    alone = name_by(materialize(rows.join(shared, told, "left_anti"), "block-keys"), "_k1", "_k2")
    clashing = materialize(blocks.withColumns({"_k1": keys[0], "_k2": keys[1]}).join(shared, told, "left_semi").drop("_k1", "_k2").withColumn("_id", F.monotonically_increasing_id()), "clashing")
    return alone.unionByName(name_by(clashing, "_block").withColumn("_name", -2 - F.col("_name")))  # below -1, which stands for no block


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row for each block: _row, _i, _parts, _about (on the first block only) and _block."""
    bare = without_blanks(F.col("text")).cast("binary")

    def cut(b: Column) -> Column:
        last = F.floor(F.greatest(F.octet_length(b) - 1, F.lit(0)) / F.lit(block_bytes)).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(b, i * block_bytes + 1, F.lit(block_bytes)))
        return F.struct(pieces.alias("pieces"), F.sha2(b, 256).alias("sha"))

    about = F.struct(F.col("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), F.col("_cut.sha").alias("text_sha256"))
    return (
        docs.select("_row", "doc_id", "text", let(bare, cut).alias("_cut"))
        .select("_row", F.size("_cut.pieces").alias("_parts"), about.alias("_about"), F.posexplode("_cut.pieces").alias("_i", "_block"))
        .select("_row", "_i", "_parts", F.when(F.col("_i") == 0, F.col("_about")).alias("_about"), "_block")
    )


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs (_row, doc_id, text): _row, _about and its identity (_level, _name)."""
    level = materialize(named_blocks(docs, block_bytes), "names-0")
    most, done, k = level.agg(F.max("_parts")).first()[0] or 0, [], 0
    while True:
        done.append(level.where("_parts = 1").select("_row", "_about", F.lit(k).alias("_level"), "_name"))
        if most <= 1:
            return reduce(DataFrame.unionAll, done)
        half = lambda odd: F.coalesce(F.max(F.when(F.col("_i") % 2 == odd, F.col("_name"))), F.lit(-1))
        pairs = (
            level.where("_parts > 1")
            .groupBy("_row", F.floor(F.col("_i") / 2).cast("int").alias("_j"))
            .agg(F.max("_parts").alias("_parts"), F.max("_about").alias("_about"), half(0).alias("_left"), half(1).alias("_right"))
            .select("_row", F.col("_j").alias("_i"), F.ceil(F.col("_parts") / 2).cast("int").alias("_parts"), "_about", "_left", "_right")
            .withColumn("_id", F.monotonically_increasing_id())
        )
        most, k = (most + 1) // 2, k + 1
        level = materialize(name_by(materialize(pairs, f"pairs-{k}"), "_left", "_right"), f"names-{k}")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs(doc_id, text): _row, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points in its original form stays, then the smallest doc_id.
    """
    return groups_of(with_row_id(docs), block_bytes)


def groups_of(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same for rows that have ``_row``."""
    with scratch(rows.sparkSession) as keep:
        named = keep(materialize(identities(rows.select("_row", "doc_id", "text"), block_bytes), "identities"))
    order = F.struct(-F.col("_about.n_points"), F.col("_about.doc_id").isNull(), F.col("_about.doc_id"), F.col("_row"))
    groups = named.groupBy(F.col("_level").alias("_l"), F.col("_name").alias("_n")).agg(
        F.count("*").alias("group_size"), F.min_by(F.struct(F.col("_about.doc_id").alias("doc_id"), F.col("_row").alias("row")), order).alias("_keep")
    )
    groups = materialize(groups, "groups")  # for a join that can split a group with most rows
    return named.join(groups, (F.col("_level") == F.col("_l")) & (F.col("_name") == F.col("_n"))).select(
        "_row", F.col("_about.doc_id").alias("doc_id"), F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep.row")).alias("kept"), F.col("_about.text_sha256").alias("text_sha256")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts."""
    rows = with_row_id(docs)
    return without_rows(rows, groups_of(rows).where(~F.col("kept")).select("_row"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).drop("_row")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS bare FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER (PARTITION BY bare ORDER BY n DESC, doc_id) = 1 AS kept, sha256(bare) AS text_sha256
FROM d
"""
