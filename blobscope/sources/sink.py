"""Files out of rows: each row's bytes become one file, by tasks, with a commit.

A task writes its files under names of its own in a staging folder and reports what it wrote; once all tasks
have ended well the driver moves the files to their places. A task that is run again writes under new names,
and what failed attempts left goes with the staging folder, so no file is ever seen in part.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "blobscope_files"


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """The store and the folder that a path or a URI names."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def inside(path: str) -> str:
    """A path below the root, without a leading slash."""
    clean = posixpath.normpath(path.lstrip("/"))
    if clean in (".", "..") or clean.startswith("../") or "/../" in f"/{path}/":
        raise ValueError(f"{path!r} lies outside the folder that files are written to")
    return clean


@dataclass
class Written(WriterCommitMessage):
    """A task's files: name in the staging folder, and place below the root."""

    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.staging = root, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = open_root(self.root)
        store.create_dir(f"{base}/{self.staging}", recursive=True)
        files = []
        for b in iterator:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = uuid.uuid4().hex
                place = inside(path)
                with store.open_output_stream(f"{base}/{self.staging}/{name}") as out:
                    out.write(content.as_py())
                files.append((name, place))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = open_root(self.root)
        made: set[str] = set()
        for name, place in (f for m in messages if m for f in m.files):
            folder = posixpath.dirname(f"{base}/{place}")
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            store.move(f"{base}/{self.staging}/{name}", f"{base}/{place}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = open_root(self.root)
        if store.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.staging}")


class FileSink(DataSource):
    """spark.write.format("blobscope_files"): rows of a path and bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["root"])


def write_files(files: DataFrame, root: str, path_col: str = "path", content_col: str = "content") -> None:
    """Write each row's bytes to its path below `root` (a folder that all executors share, or a URI). Rows
    without a path or without content are left out; a file that is there is replaced; of rows with one path the
    last moved stays. The driver moves the files and holds their names."""
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    rows = files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).where(F.col("path").isNotNull() & F.col("content").isNotNull())
    rows.write.format(FORMAT).mode("append").option("root", root).save()
