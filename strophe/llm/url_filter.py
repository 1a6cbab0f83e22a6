"""URL filters: a sorted digest array.

Rules (host and path) are kept as 64-bit xxhash digests in ascending order, memory-mapped from a file that Spark
sends to every executor, beside their full strings. A url's candidates (each domain that holds its host, joined
with the starts of its path at the lengths that rules have) are probed in one vectorised binary search for each
batch; a hit counts only when the stored string is the candidate itself, so digests that collide do no harm.

Rules are a list or a table. Those of up to ``MAX_BYTES`` are gathered and sent; a larger rule table is joined instead
(``judge_by_join``), with the same result.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; rules win
by the length of host and path together, then the later string; repeated urls are judged one by one; an empty table
gives an empty result.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, released, with_row_id

MAX_BYTES = 64 << 20
#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: The verdict on urls that no rule fits.
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end; A-Z are lower-cased, other letters stay."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*(/[^?#]*)", 1)


class DigestArray:
    """Sorted digests and their strings, opened from files without reading them whole."""

    def __init__(self, folder: str, prefix: str):
        at = lambda name: os.path.join(folder, f"{prefix}-{name}.npy")
        self.keys, self.ends, self.blob, self.verdicts = (np.load(at(n), mmap_mode="r") for n in ("keys", "ends", "blob", "verdicts"))

    @staticmethod
    def write(rules: list[tuple[str, str, str]], folder: str, prefix: str) -> list[str]:
        strings = sorted(((h + p).encode(), v) for v, h, p in rules)
        order = sorted(range(len(strings)), key=lambda i: (xxhash.xxh64_intdigest(strings[i][0]), strings[i][0]))
        blob = b"".join(strings[i][0] for i in order)
        parts = {
            "keys": np.array([xxhash.xxh64_intdigest(strings[i][0]) for i in order], np.uint64),
            "ends": np.cumsum([0] + [len(strings[i][0]) for i in order]),
            "blob": np.frombuffer(blob, np.uint8),
            "verdicts": np.array([strings[i][1] == "allow" for i in order], np.bool_),
        }
        for name, values in parts.items():
            np.save(os.path.join(folder, f"{prefix}-{name}.npy"), values)
        return [os.path.join(folder, f"{prefix}-{name}.npy") for name in parts]

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """The place of each candidate, or -1: binary search on digests, then the strings themselves."""
        digests = np.fromiter((xxhash.xxh64_intdigest(c) for c in candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, digests)
        found = np.full(len(candidates), -1)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == digests) if len(self.keys) else []):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:  # strings that share a digest stand side by side
                if self.blob[self.ends[k] : self.ends[k + 1]].tobytes() == candidates[i]:
                    found[i] = k
                    break
                k += 1
        return found


def domains(host: str) -> list[str]:
    """host and every domain above it."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = DEFAULT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages(page_id, url).

    rules: (verdict, host, path), as a list or as a table with columns of these names.
    """
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "verdict string, host string, path string")
    size = table.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 17), F.lit(0))).first()[0]
    if size > max_bytes:
        return judge_by_join(with_row_id(pages), table, default)
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = [(r["verdict"], r["host"], r["path"]) for r in table.select("verdict", "host", "path").collect()]  # max_bytes at most
    prefix, folder = f"rules-{uuid.uuid4().hex}", tempfile.mkdtemp()
    for f in DigestArray.write(rules, folder, prefix):
        spark.sparkContext.addFile(f)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the files from here
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.getRootDirectory(), prefix)
        for b in batches:
            owner, strings = [], []
            for i, (h, p) in enumerate(zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)):
                if h:
                    for d in domains(h):
                        for n in lengths:
                            if n <= len(p):
                                owner.append(i)
                                strings.append((d + p[:n]).encode())
            best: list[tuple[int, bytes, bool] | None] = [None] * b.num_rows
            for j, k in enumerate(array.find(strings)):
                if k >= 0:
                    hit = (len(strings[j].decode()), strings[j], bool(array.verdicts[k]))
                    best[owner[j]] = max(best[owner[j]] or hit, hit)
            rule = pa.array([x and x[1].decode() for x in best], pa.string())
            verdict = pa.array([default if x is None else "allow" if x[2] else "block" for x in best], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], names=[*b.schema.names, "rule", "verdict"])

    return parsed.mapInArrow(released(probe), "page_id long, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The same for rule tables of any size and pages that have ``_row``: candidates are joined with the rules on their strings."""
    parsed = pages.select(F.col("_row").alias("_id"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = rules.select(F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict"), F.length("path").alias("_n"))
    lengths = F.array_sort(F.collect_set("_n"))
    rows = parsed.crossJoin(F.broadcast(keys.agg(lengths.alias("_lengths"))))  # one row: the distinct path lengths
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.flatten(F.transform(names, lambda d: F.transform(F.filter("_lengths", lambda n: n <= F.length("path")), lambda n: F.concat(d, F.substring(F.col("path"), F.lit(1), n)))))
    hits = rows.where(F.col("host") != "").select("_id", F.explode(fits).alias("_rule")).join(keys, "_rule")
    best = hits.groupBy("_id").agg(F.max_by(F.struct(F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict")), F.struct(F.length("_rule"), F.col("_rule"))).alias("_best"))
    return rows.join(best, "_id", "left").select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def op4_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM p
), r(verdict, rh, rp) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT q.page_id, host, path, rule, coalesce(m.verdict, 'allow') AS verdict FROM q LEFT JOIN m USING (page_id)
"""
