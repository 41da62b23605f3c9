"""A sink that leaves named files: one for each path, in a folder tree that people and compilers read.

``save(parts, folder)`` takes ``parts(path, content)``; a path's rows, in the
given order, are the parts of its file.  Rows of a path are dealt to one task
and streamed to its file, so no file is held whole and nothing is collected.

Writing is in two phases.  A task writes below a staging folder under the name
of its attempt; the driver then moves the files of the attempts that succeeded
into one new tree and puts that in place of the old one.  A failed task or job
leaves nothing but what was there before.  The folder may be anything that
``pyarrow.fs`` opens, as long as driver and executors both see it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "corploom_files"
#: Files that the driver moves at a time.
MOVERS = 16


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, local unless a scheme says otherwise, and its path there."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def sound_path(path: str) -> str:
    """A relative path without empty or dotted steps; anything else is an error."""
    steps = (path or "").split("/")
    if any(s in ("", ".", "..") for s in steps) or steps[0].startswith("_staging-"):
        raise ValueError(f"no path below the folder: {path!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, whole: bool):
        self.folder, self.overwrite, self.whole = folder, overwrite, whole
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.folder)
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}"
        now, out, parents, n = None, None, set(), 0
        try:
            for batch in iterator:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    if path != now or self.whole:
                        if out is not None:
                            out.close()
                        now, at = path, f"{root}/{self.staging}/{attempt}/{sound_path(path)}"
                        if fs.get_file_info(at).type != pafs.FileType.NotFound:
                            raise ValueError(f"two files of one name: {path!r}")
                        parent = at.rpartition("/")[0]
                        if parent not in parents:
                            fs.create_dir(parent, recursive=True)
                            parents = {parent} if len(parents) > 10_000 else parents | {parent}
                        out, n = fs.open_output_stream(at), n + 1
                    out.write((content or "").encode("utf-8", "surrogatepass"))
        finally:
            if out is not None:
                out.close()
        return Written(attempt, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.folder)
        staging = f"{root}/{self.staging}"
        new, old = f"{staging}/new", f"{staging}/old"
        fs.create_dir(new, recursive=True)

        def moved(source: str, target: str, parents: set[str]) -> None:
            parent = target.rpartition("/")[0]
            if parent not in parents:
                fs.create_dir(parent, recursive=True)
                parents.add(parent)
            if fs.get_file_info(target).type != pafs.FileType.NotFound:
                raise ValueError(f"two files of one name: {target.removeprefix(root + '/')!r}")
            fs.move(source, target)

        with ThreadPoolExecutor(MOVERS) as pool:
            for m in messages:
                if m is None or not m.files:
                    continue
                top, parents = f"{staging}/{m.attempt}", set()
                found = [x.path for x in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if x.type == pafs.FileType.File]
                into = new if self.overwrite else root
                list(pool.map(lambda p: moved(p, into + p[len(top) :], parents), found))  # noqa: B023  run before the next one
        if self.overwrite:
            fs.create_dir(old)
            for x in fs.get_file_info(pafs.FileSelector(root)):
                if not x.base_name.startswith("_staging-"):
                    fs.move(x.path, f"{old}/{x.base_name}")
            for x in fs.get_file_info(pafs.FileSelector(new)):
                fs.move(x.path, f"{root}/{x.base_name}")
        fs.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.folder)
        staging = f"{root}/{self.staging}"
        if fs.get_file_info(f"{staging}/old").type == pafs.FileType.Directory:  # what was there before comes back
            for x in fs.get_file_info(pafs.FileSelector(f"{staging}/old")):
                if fs.get_file_info(f"{root}/{x.base_name}").type == pafs.FileType.NotFound:
                    fs.move(x.path, f"{root}/{x.base_name}")
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


class FileSink(DataSource):
    """``df.write.format("corploom_files").option("folder", …)``; with ``whole`` a path given twice is an error, not a file of two parts."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        missing = {"path", "content"} - {f.name for f in schema.fields}
        if missing:
            raise ValueError(f"a file needs {', '.join(sorted(missing))}")
        return _Writer(self.options["folder"].rstrip("/"), overwrite, self.options.get("whole", "false").lower() == "true")


def save(parts: DataFrame, folder: str, order: list[str | Column] | None = None, mode: str = "overwrite") -> None:
    """Write ``parts(path, content, …)``; ``order`` sorts the parts of a path, without it a path is one row."""
    parts.sparkSession.dataSource.register(FileSink)
    dealt = parts.repartition("path")
    dealt = dealt.sortWithinPartitions("path", *order) if order else dealt
    dealt.select("path", "content").write.format(FORMAT).mode(mode).option("folder", folder).option("whole", str(not order).lower()).save()


def read(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, content`` of the files below a folder whose names fit."""
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    at = F.col("_metadata.file_path")
    base = folder.rstrip("/").removeprefix("file:").lstrip("/")
    return found.select(F.substring_index(at, base + "/", -1).alias("path"), F.col("value").alias("content"))
