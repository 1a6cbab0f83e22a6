"""Reports as files: JSON and Markdown by track, TOML, and append-only histories, published whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports


def json_reports(rows: DataFrame, folder: str, key: str) -> None:
    """A folder of JSON lines for each track."""
    rows.write.mode("overwrite").partitionBy(key).json(folder)


def markdown(title: Column, fields: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"- **{n}**: "), F.coalesce(c.cast("string"), F.lit("n/a"))) for n, c in fields.items()]
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), *lines)


def toml_escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def toml(sections: dict[str, dict[str, Column]], texts: set[str] = frozenset()) -> Column:
    """Sections of keys and values; numbers with two digits, the names in ``texts`` quoted."""
    parts = []
    for section, fields in sections.items():
        parts.append(F.lit(f"[{section}]"))
        for n, c in fields.items():
            shown = F.concat(F.lit('"'), toml_escape(F.coalesce(c, F.lit(""))), F.lit('"')) if n in texts else F.format_string("%.2f", c.cast("double"))
            parts.append(F.concat(F.lit(f"{n} = "), shown))
    return F.concat_ws("\n", *parts)


def write_text(rows: DataFrame, folder: str, text: Column) -> None:
    rows.select(text.alias("value")).write.mode("overwrite").text(folder)


def append_history(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def report_pairs(rows: DataFrame, folder: str, key: str, kind: str, fields: dict[str, Column]) -> None:
    """Each track's report twice, as ``<track>.<kind>.json`` and ``.md``; all of them are published at once."""
    reports.write(rows, folder, F.concat(F.col(key).cast("string"), F.lit(f".{kind}")), markdown(F.col(key).cast("string"), fields))


def rollout_report(report: DataFrame, folder: str, stamp: str) -> str:
    """The report of a rollout in a folder that is named by its time; returns the folder."""
    path = f"{folder}/rollout-{stamp}"
    report.coalesce(1).write.mode("errorifexists").json(path)
    return path


def mark_completed(done: DataFrame, path: str) -> None:
    """Adds finished files to a job's checkpoint: appended after each batch, so a restarted job goes on behind the last one."""
    done.select("path", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def completed(spark: SparkSession, path: str) -> DataFrame:
    """The files that a job has finished, each once."""
    return spark.read.schema("path string, at timestamp").parquet(path).select("path").distinct()
