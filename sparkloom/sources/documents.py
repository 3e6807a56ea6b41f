"""A sink that writes ordered parts of documents, all or none."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (partition, document, place in the task, temporary path)."""

    files: list[tuple[int, str, int, str]]


class PartsWriter(DataSourceWriter):
    """Tasks write below a folder of their own run; the driver moves the files in place once all tasks are done."""

    def __init__(self, path: str, overwrite: bool, separator: str):
        self.path, self.overwrite, self.separator, self.run = path.rstrip("/"), overwrite, separator, uuid.uuid4().hex

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        fs, base = self._fs()
        task = TaskContext.get()
        out: list[tuple[int, str, int, str]] = []
        stream, now = None, None
        try:
            for row in rows:
                if row["document"] != now:
                    if stream is not None:
                        stream.close()
                    now = row["document"]
                    temporary = f"{base}/_run-{self.run}/{task.partitionId()}-{task.taskAttemptId()}-{len(out)}"
                    fs.create_dir(f"{base}/_run-{self.run}", recursive=True)
                    stream = fs.open_output_stream(temporary)
                    out.append((task.partitionId(), now, len(out), temporary))
                stream.write((row["text"] + self.separator).encode())
        finally:
            if stream is not None:
                stream.close()
        return Written(out)

    def commit(self, messages) -> None:
        fs, base = self._fs()
        fs.create_dir(base, recursive=True)
        if self.overwrite:
            for found in fs.get_file_info(pafs.FileSelector(base)):
                if found.type == pafs.FileType.Directory and not found.base_name.startswith("_run-"):
                    fs.delete_dir(found.path)
        files = sorted(f for m in messages if m is not None for f in m.files)
        number: dict[str, int] = {}
        for _, document, _, temporary in files:
            n = number[document] = number.get(document, -1) + 1
            folder = f"{base}/{quote(document, safe='')}"
            fs.create_dir(folder, recursive=True)
            fs.move(temporary, f"{folder}/{n:05d}.md")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, base = self._fs()
        if fs.get_file_info(f"{base}/_run-{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/_run-{self.run}")


class PartsSink(DataSource):
    """``df.write.format("document_parts")`` for rows (document, text) in order; options path and separator."""

    @classmethod
    def name(cls) -> str:
        return "document_parts"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"], overwrite, self.options.get("separator", "\n\n"))


def write_documents(parts: DataFrame, path: str, document: str = "workspace", order: tuple[str | Column, ...] = ("part", "ord"), separator: str = "\n\n") -> None:
    """Write (document, ..., text) as folders of numbered Markdown files under ``path``, one folder for each document.

    Rows are dealt by ranges of (document, order), so a document of any size is written by as many tasks as
    hold a range of it, and its files in order are its text.  A failed task leaves no file; a null text is left out.
    """
    parts.sparkSession.dataSource.register(PartsSink)
    keys = [F.col(c) if isinstance(c, str) else c for c in (document, *order)]
    rows = parts.where("text IS NOT NULL").repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.select(F.coalesce(F.col(document).cast("string"), F.lit("")).alias("document"), "text").write.format("document_parts").option("path", path).option("separator", separator).mode("overwrite").save()
