"""A source driver as a Python data source: batch reads are all changes, streams are changes since an offset, and
snapshot() folds the changes of a batch read.

Options: path, a folder of JSON-lines files named by revision (`000000000001.jsonl`), each with one change a line:
{"object_id": …, "parent_id": …, "name": …, "action": "upsert" or "delete"}. Each file is one partition of a change read,
so reading is parallel and replays give the same rows. Files are reached through pyarrow's file systems: a path without
scheme is local, others go by their scheme.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from revlake.operators.asof import latest

SCHEMA = "revision bigint, object_id string, parent_id string, name string, action string"


def _revisions(path: str) -> list[int]:
    store, root = fs.FileSystem.from_uri(path)
    return sorted(int(x.base_name[:-6]) for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".jsonl"))


def _rows(path: str, revision: int):
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/{revision:012d}.jsonl") as f:
        for line in f.read().splitlines():
            r = json.loads(line)
            yield revision, r["object_id"], r.get("parent_id"), r.get("name"), r["action"]


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The live objects after all changes: the newest change of each, deletes left out."""
    spark.dataSource.register(RevisionLog)
    changes = spark.read.format(RevisionLog.name()).option("path", path).load()
    return latest(changes, ["object_id"], "revision").where("action = 'upsert'").drop("action")


class Change(InputPartition):
    def __init__(self, revision: int):
        self.revision = revision


class AllChanges(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Change(r) for r in _revisions(self.path)]

    def read(self, partition):
        yield from _rows(self.path, partition.revision)


class Changes(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):  # noqa: N802
        return {"revision": 0}

    def latestOffset(self):  # noqa: N802
        return {"revision": max(_revisions(self.path), default=0)}

    def partitions(self, start, end):
        return [Change(r) for r in _revisions(self.path) if start["revision"] < r <= end["revision"]]

    def read(self, partition):
        yield from _rows(self.path, partition.revision)


class RevisionLog(DataSource):
    @classmethod
    def name(cls):
        return "revision_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return AllChanges(self.options["path"])

    def streamReader(self, schema):  # noqa: N802
        return Changes(self.options["path"])
