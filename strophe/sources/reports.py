"""Reports as pairs of files, ``<stem>.json`` and ``<stem>.md``, written by a data source that publishes all or none.

Tasks write into a pending folder and hand their files' names to the driver; when all tasks are done it renames the files
into place. A job that fails leaves no file; what failed attempts of a task have left goes with the pending folder. A stem
that two rows have stops the job before anything is published.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (name while pending, final name)."""

    files: list[tuple[str, str]]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class ReportsWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.pending = folder, f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, top = _open(self.folder)
        system.create_dir(f"{top}/{self.pending}")
        files = []
        for row in iterator:
            for kind, text in (("json", row.json), ("md", row.markdown)):
                name = f"{uuid.uuid4().hex}.{kind}"  # each attempt has names of its own
                with system.open_output_stream(f"{top}/{self.pending}/{name}") as out:
                    out.write(text.encode())
                files.append((name, f"{row.stem}.{kind}"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = _open(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        if len({final for _, final in files}) < len(files):
            self.abort(messages)
            raise ValueError("two reports have one stem")
        for name, final in files:
            system.move(f"{top}/{self.pending}/{name}", f"{top}/{final}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, top = _open(self.folder)
        if system.get_file_info(f"{top}/{self.pending}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.pending}")


class ReportsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return "stem string, json string, markdown string"

    def writer(self, schema, overwrite: bool) -> ReportsWriter:
        return ReportsWriter(self.options["path"])


def write(rows: DataFrame, folder: str, stem: Column, markdown: Column) -> None:
    """Each row as JSON and as Markdown, under its stem."""
    rows.sparkSession.dataSource.register(ReportsSource)
    told = rows.select(stem.cast("string").alias("stem"), F.to_json(F.struct("*")).alias("json"), markdown.alias("markdown"))
    told.write.format("reports").mode("append").option("path", folder).save()
