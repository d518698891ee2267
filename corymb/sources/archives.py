"""Zip archives as a Spark data source: a row a member, read without unpacking.

``spark.read.format("zip_members").load(folder)`` gives (archive, member, size, content).  Planning lists the folder
and opens only archives whose members may be more than ``partitionBytes`` (16 MB), as deflate packs up to 1032 to 1, to share
them out by their directories; the directories of others are read by the task.  Archives and members share a partition up to
that size (an opened file counts 64 kB at least).  Members that a filter on ``member`` (equal, in, ends or starts with, contains) or the
option ``suffix`` rules out are never read.  Filters reach the source where the session has
``spark.sql.python.filterPushdown.enabled``; :func:`members` sets it.

An archive is a file that ends in ``.zip`` below the folder, or the path itself.  Folders in an archive have no
rows; an empty folder gives none.  A member that is damaged raises.  The store must be one that pyarrow reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "archive string, member string, size long, content binary"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Members(InputPartition):
    """Archives with the members to read of each; None: what is wanted, by its directory."""

    parts: list[tuple[str, list[str] | None]]


#: Bytes that opening an archive counts as, and how many bytes one deflated byte may stand for.
OPEN, RATIO = 64 << 10, 1032


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.most = options["path"], options.get("suffix", ""), int(options.get("partitionbytes", 16 << 20))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (the interface's name)
        for f in filters:
            if isinstance(f, (EqualTo, In, StringContains, StringEndsWith, StringStartsWith)) and f.attribute == ("member",):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        if name.endswith("/") or not name.endswith(self.suffix):
            return False
        holds = {EqualTo: lambda v: name == v, In: lambda v: name in v, StringContains: lambda v: v in name, StringEndsWith: name.endswith, StringStartsWith: name.startswith}
        return all(holds[type(f)](f.value) for f in self.tests)

    def partitions(self) -> list[InputPartition]:
        """Small archives together, large ones by members; a partition for the driver to send, never an archive's bytes."""
        from zipfile import ZipFile

        from pyarrow import fs

        store, root = _store(self.path)
        if root.endswith(".zip"):
            found = [store.get_file_info(root)]
        else:
            found = sorted((i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith(".zip")), key=lambda i: i.path)
        out: list[InputPartition] = []
        small, held = [], 0

        def share(archive: str, names: list[str] | None, size: int) -> None:
            nonlocal small, held
            if small and held + max(size, OPEN) > self.most:
                out.append(Members(small))
                small, held = [], 0
            small.append((archive, names))
            held += max(size, OPEN)

        for info in found:
            if info.size * RATIO <= self.most:
                share(info.path, None, info.size)
                continue
            names, size = [], 0
            with store.open_input_file(info.path) as f, ZipFile(f) as z:
                for m in z.infolist():
                    if self._wanted(m.filename):
                        if names and size + m.file_size > self.most:
                            out.append(Members([(info.path, names)]))
                            names, size = [], 0
                        names.append(m.filename)
                        size += m.file_size
            if names:
                share(info.path, names, size)
        if small:
            out.append(Members(small))
        return out or [Members([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from zipfile import ZipFile

        store, _ = _store(self.path)
        rows, held = [], 0
        for archive, names in partition.parts:
            with store.open_input_file(archive) as f, ZipFile(f) as z:
                for name in z.namelist() if names is None else names:
                    if names is None and not self._wanted(name):
                        continue
                    content = z.read(name)
                    rows.append((archive.rpartition("/")[2], name, len(content), content))
                    held += len(content)
                    if len(rows) >= 1000 or held >= 1 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, size, content) of the members with a suffix in all archives below a path."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("suffix", suffix).load(path)


def packed(df: DataFrame, archive: str, member: str, content: str) -> DataFrame:
    """(name, content): a zip archive for each ``archive``, of its rows' bytes; one archive is one task's."""

    def pack(table: pa.Table) -> pa.Table:
        from io import BytesIO
        from zipfile import ZIP_DEFLATED, ZipFile, ZipInfo

        to = BytesIO()
        with ZipFile(to, "w", ZIP_DEFLATED) as z:
            for name, raw in sorted(zip(table["m"].to_pylist(), table["c"].to_pylist(), strict=True)):
                z.writestr(ZipInfo(name), raw, ZIP_DEFLATED)  # without a time: reruns agree
        return pa.table({"name": [table["a"][0].as_py() + ".zip"], "content": pa.array([to.getvalue()], pa.binary())})

    d = df.select(F.col(archive).cast("string").alias("a"), F.col(member).alias("m"), F.col(content).cast("binary").alias("c"))
    return d.groupBy("a").applyInArrow(pack, "name string, content binary")
