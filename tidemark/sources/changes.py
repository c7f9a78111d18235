"""Changes of a directory tree as a stream: (root, path) of what was made, changed or removed since the last look.

The tree is compared by size and modification time at each trigger; offsets carry the
stamps seen, so that a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidemark.sources.worktree import walk


def stamps(root: str) -> dict[str, str]:
    out = {}
    for name in sorted(os.listdir(root)):
        for path, info in walk(root, name):
            out[path] = f"{info.st_size}.{info.st_mtime_ns}"
    return out


class ChangeReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = os.path.abspath(root)

    def initialOffset(self) -> dict:
        return {"stamps": stamps(self.root)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now, before = stamps(self.root), start["stamps"]
        changed = sorted(p for p in now.keys() | before.keys() if now.get(p) != before.get(p))
        return iter([(self.root, p) for p in changed]), {"stamps": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        old, new = start["stamps"], end["stamps"]
        return iter([(self.root, p) for p in sorted(p for p in old.keys() | new.keys() if old.get(p) != new.get(p))])


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "worktree-changes"

    def schema(self) -> str:
        return "root string, path string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return ChangeReader(self.options["path"])


def stream_changes(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("worktree-changes").load(root)

