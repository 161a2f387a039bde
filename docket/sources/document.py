"""One JSON document from all predictions, written by many tasks: each writes its stretch, and the commit joins the stretches in order.

No task and no driver holds the rows: the driver copies bytes of the stretches, which lie beside the document until then.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

HEAD, BETWEEN, TAIL, CHUNK = b'{"predictions": [', b", ", b"]}", 1 << 22


@dataclass
class Stretch(WriterCommitMessage):
    """A task's file and the key that it begins with; an empty task has no file."""

    path: str | None = None
    first: bytes | None = None


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Stretch:
        out, stretch = None, Stretch()
        for key, text in iterator:
            if out is None:
                files, folder = pafs.FileSystem.from_uri(self.parts)
                files.create_dir(folder)
                own = f"{folder}/{uuid.uuid4().hex}"  # of this attempt alone, so a task that runs twice spoils nothing
                out, stretch = files.open_output_stream(own), Stretch(own, None if key is None else key.encode())
            else:
                out.write(BETWEEN)
            out.write(text.encode())
        if out is not None:
            out.close()
        return stretch

    def commit(self, messages: list) -> None:
        files, target = pafs.FileSystem.from_uri(self.path)
        filled = sorted((m for m in messages if m is not None and m.path), key=lambda m: (m.first is not None, m.first))
        making = f"{target}.making-{uuid.uuid4().hex}"
        with files.open_output_stream(making) as out:
            out.write(HEAD)
            for n, m in enumerate(filled):
                out.write(BETWEEN if n else b"")
                with files.open_input_stream(m.path) as part:
                    while piece := part.read(CHUNK):
                        out.write(piece)
            out.write(TAIL)
        files.move(making, target)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        files, folder = pafs.FileSystem.from_uri(self.parts)
        if files.get_file_info(folder).type == pafs.FileType.Directory:
            files.delete_dir(folder)


class PredictionsDocument(DataSource):
    """Sink of (key, text) rows that are range-partitioned and sorted by key; option `path`: a file that driver and executors reach."""

    @classmethod
    def name(cls) -> str:
        return "predictions_document"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_document(rows: DataFrame, path: str, key: str, text: str) -> None:
    """{"predictions": [...]} of the texts in order of key, then text; a file that is there is replaced once the new one is whole, a folder is refused."""
    path = path if "://" in path or path.startswith("/") else f"{_here()}/{path}"
    files, target = pafs.FileSystem.from_uri(path)
    if files.get_file_info(target).type == pafs.FileType.Directory:
        raise FileExistsError(f"{path} is a folder")
    rows.sparkSession.dataSource.register(PredictionsDocument)
    ordered = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    ordered.write.format("predictions_document").option("path", path).mode("append").save()


def _here() -> str:
    from pathlib import Path

    return str(Path.cwd())
