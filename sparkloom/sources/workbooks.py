"""Workbooks written and read by the executors, as a Python data source: ``df.write.format("workbooks")`` and ``spark.read.format("workbooks")``.

A task writes a workbook for each value of ``shard`` that its rows have, one after the other, into a hidden folder of the job. Only when
all tasks have ended do the workbooks of the attempts that counted get their names; what is left of others goes with the folder. If a
task fails in the end, nothing is there.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from sparkloom.sources import sheets


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """(shard, place in the hidden folder) of a task's workbooks."""

    files: list[tuple[int, str]]


class Workbooks(DataSource):
    """Options: path, a folder; name, which begins the names of the workbooks. A folder of workbooks is read by their headers; the
    column ``shard`` is the number in a workbook's name."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], self.options.get("name", "export"), schema.names, overwrite)

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"], schema.names)


class WorkbookWriter(DataSourceWriter):
    def __init__(self, path: str, name: str, columns: list[str], overwrite: bool) -> None:
        self.path, self.prefix, self.columns, self.overwrite = path.rstrip("/"), name, columns, overwrite
        self.hidden = f"{self.path}/.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, hidden = _place(self.hidden)
        system.create_dir(hidden, recursive=True)
        at, files = self.columns.index("shard"), []
        header = [c for c in self.columns if c != "shard"]
        for shard, rows in groupby(iterator, key=lambda r: r[at]):
            place = f"{hidden}/{uuid.uuid4().hex}"
            with system.open_output_stream(place) as f:
                sheets.write(f, header, (["" if v is None else v for i, v in enumerate(r) if i != at] for r in rows))
            files.append((shard, place))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, hidden = _place(self.hidden)
        folder = hidden.rsplit("/", 1)[0]
        files = [f for m in messages if m is not None for f in m.files]
        shards = [s for s, _ in files]
        if len(set(shards)) < len(shards):
            self.abort(messages)
            raise ValueError("rows of one shard were in several tasks, or apart in one: deal and sort them by shard")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if re.fullmatch(rf"{re.escape(self.prefix)}-\d+\.xlsx", old.base_name):
                    system.delete_file(old.path)
        for shard, place in files:
            system.move(place, f"{folder}/{self.prefix}-{shard}.xlsx")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, hidden = _place(self.hidden)
        if system.get_file_info(hidden).type == fs.FileType.Directory:
            system.delete_dir(hidden)


class Workbook(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def partitions(self) -> list[Workbook]:
        system, folder = _place(self.path)
        found = system.get_file_info(fs.FileSelector(folder))
        return [Workbook(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".xlsx")]

    def read(self, partition: Workbook) -> Iterator[tuple]:
        system, _ = _place(self.path)
        number = re.search(r"-(\d+)\.xlsx$", partition.path)
        shard = int(number[1]) if number else None
        with system.open_input_file(partition.path) as f:
            for row in sheets.read(f, [c for c in self.columns if c != "shard"]):
                yield tuple(shard if c == "shard" else row[c] for c in self.columns)


def write_shards(rows: DataFrame, order: list[str], path: str, name: str = "export") -> None:
    """A workbook for each value of ``shard`` (not null), its rows in ``order``; other columns as texts, nulls empty."""
    rows.sparkSession.dataSource.register(Workbooks)
    dealt = rows.repartition("shard").sortWithinPartitions("shard", *order)
    texts = dealt.select("shard", *(dealt[c].cast("string").alias(c) for c in rows.columns if c != "shard"))
    texts.write.format("workbooks").option("path", path).option("name", name).mode("overwrite").save()


def read_shards(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """shard and the named columns of all workbooks of a folder."""
    spark.dataSource.register(Workbooks)
    return spark.read.format("workbooks").schema("shard int, " + ", ".join(f"`{c}` string" for c in columns)).option("path", path).load()
