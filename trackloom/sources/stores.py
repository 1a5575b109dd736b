"""Files that Spark's own readers can't take apart, opened inside tasks through Arrow's file systems: local folders,
HDFS, S3 and others, by their URI."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql.datasource import InputPartition


def opened(uri: str):
    """(file system, path) of a URI or a local path."""
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def listed(uri: str, suffixes: tuple[str, ...], recursive: bool = True) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a URI, or the file itself, whose names end in one of the suffixes (in any case)."""
    from pyarrow import fs

    store, path = opened(uri)
    info = store.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=recursive))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffixes))


@dataclass
class Files(InputPartition):
    """Some files of one partition."""

    paths: list[str]


def dealt(files: list[tuple[str, int]], most: int) -> list[Files]:
    """Partitions of `most` files each: a partition's names are all that goes to its task."""
    return [Files([p for p, _ in files[i : i + most]]) for i in range(0, len(files), most)] or [Files([])]


def base_name(path: str) -> str:
    return posixpath.basename(path)
