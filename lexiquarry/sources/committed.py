"""JSON files under a commit: an append is seen whole or not at all, and one made again adds nothing.

A folder holds ``parts``, the files that tasks wrote, and ``commits``, one small file for each commit that names its parts. Readers go by these names. So what a killed, repeated or
speculative task left behind is never seen; a commit appears by one rename, and a commit whose name is there already is dropped.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lexiquarry.session import exists

MANIFEST = "at double, whole boolean, files array<string>"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Part(WriterCommitMessage):
    file: str | None


class Writer(DataSourceWriter):
    def __init__(self, options: dict, fields: list[str], overwrite: bool):
        self.path, self.commit_id = options["path"].rstrip("/"), options.get("commit") or uuid.uuid4().hex
        self.key, self.overwrite, self.fields = options.get("key"), overwrite, fields
        if "/" in self.commit_id:
            raise ValueError("a commit's name is a file's name")

    def write(self, iterator: Iterator) -> Part:
        """A task's rows: a line for each, or with ``key`` the members of one JSON object. A task without rows writes nothing."""
        system, base = _system(self.path)
        name, out = f"parts/{self.commit_id}/{uuid.uuid4().hex}.json", None
        for row in iterator:
            value = row.asDict(recursive=True)
            if out is None:
                system.create_dir(f"{base}/parts/{self.commit_id}", recursive=True)
                out = system.open_output_stream(f"{base}/{name}")
                lead = "{\n" if self.key else ""
            text = f"{json.dumps(value.pop(self.key))}: " if self.key else ""
            out.write((lead + text + json.dumps(value, ensure_ascii=False, default=str)).encode())
            lead = ",\n" if self.key else "\n"
        if out is None:
            return Part(None)
        out.write(b"\n}\n" if self.key else b"\n")
        out.close()
        return Part(name)

    def commit(self, messages: list) -> None:
        system, base = _system(self.path)
        at = f"{base}/commits/{self.commit_id}.json"
        if system.get_file_info(at).type.name != "NotFound":
            return self.abort(messages)
        system.create_dir(f"{base}/commits", recursive=True)
        system.create_dir(f"{base}/staged", recursive=True)
        staged = f"{base}/staged/{uuid.uuid4().hex}"
        with system.open_output_stream(staged) as out:
            out.write(json.dumps({"at": time.time(), "whole": self.overwrite, "files": [m.file for m in messages if m and m.file]}).encode())
        system.move(staged, at)

    def abort(self, messages: list) -> None:
        system, base = _system(self.path)
        for m in messages:
            if m and m.file:
                system.delete_file(f"{base}/{m.file}")


class Committed(DataSource):
    """``df.write.format("committed_json")`` with path, and optionally commit (a name for this append) and key (a column: files are objects keyed by it)."""

    @classmethod
    def name(cls) -> str:
        return "committed_json"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema.names, overwrite)


def write(df: DataFrame, path: str, commit: str | None = None, key: str | None = None, append: bool = True) -> None:
    """Append ``df``, or let it take the place of what is there."""
    df.sparkSession.dataSource.register(Committed)
    options = {"path": path} | ({"commit": commit} if commit else {}) | ({"key": key} if key else {})
    df.write.format("committed_json").mode("append" if append else "overwrite").options(**options).save()


def parts(spark: SparkSession, path: str) -> list[str]:
    """The files of the commits, those before the last whole one left out."""
    path = path.rstrip("/")
    if not exists(spark, f"{path}/commits"):
        return []
    made = spark.read.schema(MANIFEST).json(f"{path}/commits")
    since = made.where("whole").agg(F.coalesce(F.max("at"), F.lit(0.0))).first()[0]
    return sorted(f"{path}/{r.f}" for r in made.where(F.col("at") >= since).select(F.explode("files").alias("f")).collect())


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All committed rows; none where nothing was committed."""
    found = parts(spark, path)
    return spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)
