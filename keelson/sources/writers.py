"""Sinks with file names of their own, as data sources with commit and abort.

Tasks write into a staging folder beside the result; what successful attempts wrote is moved into place when the job commits, and the folder goes with whatever
failed attempts left in it. Paths are URIs that pyarrow's file systems open, or local ones."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from keelson.operators.order import numbered
from keelson.session import release

#: Files that the driver moves at once.
MOVES = 32


@dataclass
class Wrote(WriterCommitMessage):
    """Files of an attempt: (name to be, staged path)."""

    files: list[tuple[str, str]]


class _Staged(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.target, self.overwrite, self.options = options["path"].rstrip("/"), overwrite, options
        self.staging = f"{self.target}/.staging-{uuid.uuid4().hex}"

    def _open(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def _own(self) -> str:
        """This attempt's folder."""
        task = TaskContext.get()
        system, own = self._open(f"{self.staging}/{task.partitionId()}-{task.taskAttemptId()}")
        system.create_dir(own)
        return own

    def commit(self, messages: list[Wrote | None]) -> None:
        """Names must differ, or nothing is moved. An overwrite's former files go once all new ones are in place."""
        system, target = self._open(self.target)
        files = [f for m in messages if m is not None for f in m.files]
        names = {n for n, _ in files}
        if len(names) < len(files):
            self.abort(messages)
            raise ValueError(f"{len(files) - len(names)} of {len(files)} file names occur more than once")
        system.create_dir(target)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda f: system.move(f[1], f"{target}/{f[0]}"), files))
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(target)):
                if info.type == fs.FileType.File and info.base_name not in names:
                    system.delete_file(info.path)
        self._clear()

    def abort(self, messages: list[Wrote | None]) -> None:
        """Other tasks of a failed job may still write while they are being stopped, so the folder is looked for until it stays away."""
        away = 0
        for _ in range(50):
            away = away + 1 if not self._clear() else 0
            if away > 5:
                break
            time.sleep(0.1)

    def _clear(self) -> bool:
        """Whether there was something to delete."""
        system, staging = self._open(self.staging)
        if system.get_file_info(staging).type == fs.FileType.NotFound:
            return False
        with contextlib.suppress(OSError):  # a file that a task adds meanwhile: the next call deletes it
            system.delete_dir(staging)
        return True


class FilePerRow(DataSource):
    """Writes rows of name and content (text or binary) as files of that name."""

    @classmethod
    def name(cls) -> str:
        return "file_per_row"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if [f.name for f in schema] != ["name", "content"]:
            raise ValueError("file_per_row writes the columns name and content")
        return _FilePerRowWriter(self.options, overwrite)


class _FilePerRowWriter(_Staged):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        own, files = self._own(), []
        system, _ = self._open(self.staging)
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"{name!r} can't be a file's name")
                with system.open_output_stream(f"{own}/{len(files)}", compression=None) as out:
                    out.write((content or "").encode() if not isinstance(content, bytes) else content)
                files.append((name, f"{own}/{len(files)}"))
        return Wrote(files)


class SplitParquet(DataSource):
    """Writes rows in order of their first two columns, file and files, as Parquet without them: SPLIT-FILE-of-FILES.parquet, with the rows of a file in one task."""

    @classmethod
    def name(cls) -> str:
        return "split_parquet"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if [f.name for f in schema][:2] != ["file", "files"]:
            raise ValueError("split_parquet's first columns are file and files")
        return _SplitParquetWriter(self.options, overwrite)


class _SplitParquetWriter(_Staged):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        own, files, now, out = self._own(), [], None, None
        system, _ = self._open(self.staging)
        for batch in iterator:
            numbers = batch.column(0).to_pylist()
            rows = batch.drop_columns(["file", "files"])
            ends = [i for i in range(1, len(numbers) + 1) if i == len(numbers) or numbers[i] != numbers[i - 1]] if numbers else []
            start = 0
            for end in ends:
                if numbers[start] != now:
                    if out:
                        out.close()
                    now, total = numbers[start], batch.column(1)[start].as_py()
                    files.append((f"{self.options.get('split', 'part')}-{now:05d}-of-{total:05d}.parquet", f"{own}/{len(files)}"))
                    out = pq.ParquetWriter(files[-1][1], rows.schema, filesystem=system, compression="snappy")
                out.write_batch(rows.slice(start, end - start))
                start = end
        if out:
            out.close()
        return Wrote(files)


def register(spark: SparkSession) -> None:
    for source in (FilePerRow, SplitParquet):
        spark.dataSource.register(source)


def write_sidecars(rows: DataFrame, path: str, name: str = "video_id", mode: str = "append") -> None:
    """One JSON file for each row, NAME.json, with all columns that have a value. Files of the same names are replaced."""
    register(rows.sparkSession)
    content = F.to_json(F.struct(*rows.columns), {"pretty": "true"})
    rows.select(F.concat(F.col(name).cast("string"), F.lit(".json")).alias("name"), content.alias("content")).write.format("file_per_row").mode(mode).save(path)


def write_split(rows: DataFrame, path: str, split: str, order: str = "video_id", rows_a_file: int = 100_000, mode: str = "overwrite") -> None:
    """Rows in order as Parquet files SPLIT-00000-of-NNNNN.parquet of rows_a_file rows each, but for the last."""
    register(rows.sparkSession)
    placed = numbered(rows, [F.col(order)])
    files = placed.select(F.ceil(F.count("*") / rows_a_file).cast("int").alias("files")).scalar()
    named = placed.select(F.floor(F.col("position") / rows_a_file).cast("int").alias("file"), files.alias("files"), "position", *rows.columns)
    dealt = named.repartitionByRange("file").sortWithinPartitions("file", "position").drop("position")
    dealt.write.format("split_parquet").option("split", split).mode(mode).save(path)
    release(placed)
