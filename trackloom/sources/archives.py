"""ZIP archives as tables: a row per member in, an archive per task out.

    archives.register(spark)
    members = spark.read.format("zip_members").option("suffixes", ".gpx").load("s3://bucket/uploads")
    rows.write.format("zip_archives").mode("append").save("s3://bucket/bundles")        # archive, name, content

Archives are read member by member, one archive in one task; their index alone is held. Writing, every task streams
the archives of its own rows, which must lie together (`bundled` sees to it).
"""

from __future__ import annotations

import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage
from pyspark.sql.window import Window

from .stores import base_name, dealt, listed, opened

MEMBER = "archive string, path string, name string, ord int, content binary, error string"

#: What Python's reader raises for archives that are cut short, damaged, encrypted or packed in ways it does not know.
BROKEN = (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, ValueError, OSError, EOFError)

#: How ZIP files begin.
MAGIC = b"PK\x03\x04"


class ZipMembers(DataSource):
    """Read: path (file or folder), suffixes (comma-separated, none: all members), recursive. An archive that can't be
    read gives one row with `error` and no content, and hinders no other."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())
        self.recursive = options.get("recursive", "true").lower() == "true"

    def partitions(self):
        return dealt(listed(self.uri, (".zip",), self.recursive), 1)

    def read(self, partition) -> Iterator[tuple]:
        store, _ = opened(self.uri)
        for path in partition.paths:
            try:
                with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    for k, info in enumerate(z.infolist()):
                        if not info.is_dir() and (not self.suffixes or info.filename.lower().endswith(self.suffixes)):
                            yield path, info.filename, base_name(info.filename), k, z.read(info), None
            except BROKEN as e:
                yield path, None, None, None, None, f"{type(e).__name__}: {e}"


class ZipArchives(DataSource):
    """Write rows (archive, name, content) as archives `<archive>.zip` in the folder `path`. The rows of an archive must
    be in one partition and together."""

    @classmethod
    def name(cls) -> str:
        return "zip_archives"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        names = [f.name for f in schema.fields]
        if missing := {"archive", "name", "content"} - set(names):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return ZipWriter(self.options["path"], [names.index(c) for c in ("archive", "name", "content")], overwrite)


@dataclass
class Written(WriterCommitMessage):
    """Archives of one task, (written as, to be named)."""

    files: list[tuple[str, str]]


class ZipWriter(DataSourceWriter):
    """Tasks write under names of their own; a commit gives the archives of the tasks that count their final names, so
    a task that is run twice, or a job that fails, leaves no archive behind."""

    def __init__(self, uri: str, at: list[int], overwrite: bool):
        self.uri, self.at, self.overwrite = uri, at, overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator) -> Written:
        store, folder = opened(self.uri)
        store.create_dir(f"{folder}/_{self.run}", recursive=True)
        files, archive, out, z = [], None, None, None
        for row in iterator:
            key, name, content = (row[i] for i in self.at)
            if key != archive or z is None:
                if z is not None:
                    z.close()
                    out.close()
                own = f"{folder}/_{self.run}/{uuid.uuid4().hex}.zip"
                files.append((own, f"{folder}/{key}.zip"))
                out = store.open_output_stream(own)
                z, archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), key
            z.writestr(name, bytes(content) if isinstance(content, bytes | bytearray) else str(content))
        if z is not None:
            z.close()
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, folder = opened(self.uri)
        files = [f for m in messages if m for f in m.files]
        finals = [to for _, to in files]
        if len(set(finals)) < len(finals):
            self.abort(messages)
            raise ValueError("rows of one archive lie in several tasks; bring them together with bundled()")
        if self.overwrite:
            for path, _ in listed(self.uri, (".zip",), recursive=False):
                store.delete_file(path)
        for own, to in files:
            store.move(own, to)
        store.delete_dir(f"{folder}/_{self.run}")

    def abort(self, messages) -> None:
        store, folder = opened(self.uri)
        store.create_dir(f"{folder}/_{self.run}", recursive=True)
        store.delete_dir(f"{folder}/_{self.run}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipMembers)
    spark.dataSource.register(ZipArchives)


def bundled(rows: DataFrame, size: int, order: str = "ord", prefix: str = "bundle") -> DataFrame:
    """archive, name, content of rows (name, content, order), `size` members to an archive, laid out for writing. Of
    rows with one name the last in order holds, as in an archive that is filled one after another. Rows are numbered by
    ranges of their names, so that no task sees them all."""
    one = rows.groupBy("name").agg(F.max_by("content", order).alias("content"))
    # Archives are numbered within ranges of names; a range's last archive may be smaller.
    ranged = one.repartitionByRange("name").withColumn("__range", F.spark_partition_id())
    k = F.row_number().over(Window.partitionBy("__range").orderBy("name")) - 1
    named = ranged.withColumn("archive", F.format_string("%s-%05d-%05d", F.lit(prefix), "__range", F.floor(k / size).cast("int")))
    return named.repartition("archive").sortWithinPartitions("archive", "name").select("archive", "name", "content")


def unwrapped(payloads: DataFrame, content: str = "content", suffixes: tuple[str, ...] = (".tif", ".tiff")) -> DataFrame:
    """payloads with their content unwrapped: of a ZIP the member with the shortest name (the first of equals) that ends
    in one of the suffixes, null if there is none or the archive is broken; other bytes as they are. Null stays null."""
    import pyarrow as pa

    def one(data: bytes | None) -> bytes | None:
        import io
        if data is None or not data.startswith(MAGIC):
            return data
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = [n for n in z.namelist() if n.lower().endswith(suffixes)]
                return z.read(min(names, key=len)) if names else None
        except BROKEN:
            return None

    at, schema = payloads.columns.index(content), payloads.schema

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                cols = row.columns
                cols[at] = pa.array([one(row.column(at)[0].as_py())], pa.binary())
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return payloads.mapInArrow(run, schema)
