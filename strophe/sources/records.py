"""Line records and JSON artifacts: corpora, histories, reports; and what is still to be done for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "text", "section_title", "source", "topic", "intent")] + [T.StructField("word_count", T.LongType()), T.StructField("difficulty", T.StringType())])


def corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records with a text, and the lines that are no records (for a report of the first ones)."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", T.StructType([*CORPUS.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.where(F.col("r._bad").isNull() & (F.trim(F.coalesce("r.text", F.lit(""))) != "")).select(*(F.col(f"r.{f.name}") for f in CORPUS.fields))
    return good, parsed.where(F.col("r._bad").isNotNull()).select(F.col("value").alias("line"))


def history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An append-only log; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def artifacts(spark: SparkSession, folder: str, kind: str, schema: T.StructType) -> DataFrame:
    """The artifacts of one kind (``<stem>.<kind>.json``) with their stem; none is an empty frame, not an error."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", f"*.{kind}.json").option("recursiveFileLookup", "true").json(folder)
    return rows.withColumn("stem", F.regexp_extract(F.input_file_name(), rf"([^/]+)\.{kind}\.json$", 1))


def recent_files(spark: SparkSession, folder: str, since: str, most: int) -> DataFrame:
    """The newest files by name that were modified after a time; older ones are never opened."""
    files = spark.read.format("binaryFile").option("modifiedAfter", since).load(folder)
    return files.orderBy(F.desc("path")).limit(most)


def renamed_keys(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """A map's old keys under their new names, where the new one isn't there yet."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    entries = F.transform(F.map_entries(column), lambda e: F.struct(F.when(~F.map_contains_key(column, F.coalesce(table[e["key"]], e["key"])), table[e["key"]]).otherwise(e["key"]).alias("key"), e["value"].alias("value")))
    return df.withColumn(column, F.map_from_entries(entries))


def cached(wanted: DataFrame, cache: DataFrame, key: str = "content_key", version: int = 2) -> tuple[DataFrame, DataFrame]:
    """Hits and misses of a cache table; an entry of another version, or with all its bands near silence, is a miss."""
    values = F.map_values("band_stats")
    valid = cache.where((F.col("schema_version") == version) & (F.size(values) >= 6) & F.exists(values, lambda v: v > -69))
    return wanted.join(valid, key), wanted.join(valid.select(key), key, "left_anti")


#: Bytes of a chunk that a content key reads.
CHUNK = 1 << 20


def content_key(content: Column, chunk: int = CHUNK) -> Column:
    """The cache key of a file's bytes: MD5 of its size and first chunk, with the middle and the last one of a file of more than three."""
    n = F.octet_length(content)
    part = lambda at: F.substring(content, at + 1, F.lit(chunk))
    more = F.when(n > 3 * chunk, F.concat(part(F.floor(n / 2).cast("int")), part(n - chunk))).otherwise(F.lit("").cast("binary"))
    return F.md5(F.concat(n.cast("string").cast("binary"), part(F.lit(0)), more))


#: What the lines of a loudness log are called, and the figure that each gives.
LOUDNESS_LINES = {
    "input_i": r"Output Integrated:\s*(-?(?:\d+(?:\.\d+)?|inf|nan))\s*LUFS",
    "input_tp": r"Output True Peak:\s*(-?(?:\d+(?:\.\d+)?|inf|nan))\s*dBTP",
    "input_lra": r"Output LRA:\s*(-?(?:\d+(?:\.\d+)?|inf|nan))\s*LU",
    "input_thresh": r"Output Threshold:\s*(-?(?:\d+(?:\.\d+)?|inf|nan))\s*LUFS",
    "target_offset": r"Target Offset:\s*(-?(?:\d+(?:\.\d+)?|inf|nan))\s*LU",
}
#: Lines of levels and of volumes.
RMS_LINE = r"RMS[_ ]level(?:\s*dB)?\s*[:=]\s*(-?(?:\d+(?:\.\d+)?|inf|nan))"
OUT_TIME = r"out_time_us=(\d+)"
VOLUME_LINE = r"{name}_volume:\s*(-?\d+\.?\d*)\s*dB"


def as_number(text: Column) -> Column:
    """inf and nan are numbers here, what is no number is null."""
    return text.try_cast("double")


def last_finite(log: Column, pattern: str) -> Column:
    """The last finite figure that a pattern finds in a log."""
    found = F.transform(F.regexp_extract_all(log, F.lit(f"(?i){pattern}"), F.lit(1)), as_number)
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(-1))


def rms_level(log: Column) -> Column:
    """The last finite overall level, or else the last finite level of any channel."""
    return F.coalesce(last_finite(log, r"Overall\." + RMS_LINE), last_finite(log, RMS_LINE))


def volume(log: Column, name: str) -> Column:
    """The mean or the max of a volume report."""
    return as_number(F.nullif(F.regexp_extract(log, VOLUME_LINE.format(name=name), 1), F.lit("")))


def loudness_lines(log: Column) -> dict[str, Column]:
    """The figures of the closing lines of a loudness log; null where a line is missing."""
    return {n: as_number(F.nullif(F.regexp_extract(log, f"(?i){p}", 1), F.lit(""))) for n, p in LOUDNESS_LINES.items()}


def loudness_block(log: Column) -> Column:
    """The last block of measured figures in a log, as a map of texts; null without one."""
    blocks = F.regexp_extract_all(log, F.lit(r'(?s)(\{\s*"input_i".*?\})'), F.lit(1))
    return F.from_json(F.try_element_at(blocks, F.lit(-1)), "map<string,string>")


def out_time(text: Column) -> Column:
    """How far a running job has come, in seconds: the last figure that its log has; null without one."""
    found = F.regexp_extract_all(text, F.lit(OUT_TIME), 1)
    return F.try_element_at(found, F.lit(-1)).cast("double") / 1e6
