"""A directory tree as a data source: spark.read.format("worktree").load(root).

Regular files and symbolic links below root, without following links; names that begin
with a dot are kept, unlike with Spark's own file source. The partitions are the root's
entries; unreadable ones are skipped. Columns: path (relative, forward slashes), kind,
mode, size, mtime_secs, mtime_nanos, and content (SHA-256) if option ``hash`` is true.
The tree must be on a disk that the executors see.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, kind string, mode int, size long, mtime_secs long, mtime_nanos int, content string"
READ_BYTES = 1 << 20


def hash_file(path: str) -> str | None:
    """Hash of a regular file's bytes; a link in its place isn't followed."""
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
    except OSError:
        return None
    digest = hashlib.sha256()
    with os.fdopen(fd, "rb") as file:
        while block := file.read(READ_BYTES):
            digest.update(block)
    return digest.hexdigest()


def walk(root: str, rel: str) -> Iterator[tuple[str, os.stat_result]]:
    """Paths below root/rel in the order of names in each directory."""
    full = os.path.join(root, rel)
    try:
        info = os.lstat(full)
    except OSError:
        return
    if not stat.S_ISDIR(info.st_mode):
        if stat.S_ISREG(info.st_mode) or stat.S_ISLNK(info.st_mode):
            yield rel, info
        return
    try:
        names = sorted(os.listdir(full))
    except OSError:
        return
    for name in names:
        yield from walk(root, f"{rel}/{name}")


class WorktreeReader(DataSourceReader):
    def __init__(self, root: str, hashed: bool):
        self.root, self.hashed = os.path.abspath(root), hashed

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in sorted(os.listdir(self.root))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for rel, info in walk(self.root, partition.value):
            kind = "symlink" if stat.S_ISLNK(info.st_mode) else "file"
            content = hash_file(os.path.join(self.root, rel)) if self.hashed and kind == "file" else None
            secs, nanos = divmod(info.st_mtime_ns, 1_000_000_000)
            yield rel, kind, stat.S_IMODE(info.st_mode) & 0o777, info.st_size, secs, nanos, content


class WorktreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorktreeReader(self.options["path"], self.options.get("hash", "false").lower() == "true")


def read_worktree(spark: SparkSession, root: str, hashed: bool = False):
    spark.dataSource.register(WorktreeSource)
    return spark.read.format("worktree").option("hash", str(hashed).lower()).load(root)
