"""A collection of passages with vectors: hash partitions of its videos, versions of each, one commit record a change.

    meta.json           the embedding contract, written once
    v<n>/part=<p>/      rows of the partitions that commit n wrote
    _log/<n>.json       commit n: the version of every partition that has rows, and the rows' schema

A commit is one rename of its record, so readers see the state before or after it, and what a crash leaves behind is
never read. A change rewrites only the partitions of the videos that it touches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.models import ModelSpec, check_compatible, contract_of
from tessera.operators.incremental import replace_videos
from tessera.sources.storage import drop, file_system, store

PARTS = 64
KEPT = 2  # commits whose versions stay, for readers that have already opened them


def part_of(video: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(video.cast("string"), F.lit(""))), F.lit(PARTS)).cast("int")


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object in a small file; None if the file is missing, damaged or holds anything else."""
    files, where = file_system(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except json.JSONDecodeError:
        return None
    except Py4JJavaError as failure:
        if "ChecksumException" not in str(failure.java_exception):
            raise
        return None
    finally:
        stream.close()
    return found if isinstance(found, dict) else None


def write_json(spark: SparkSession, path: str, value: dict) -> bool:
    """Writes a new file in one step; False if there is one already."""
    files, beside = file_system(spark, f"{path}.tmp")
    out = files.create(beside, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
    out.close()
    _, where = file_system(spark, path)
    return not files.exists(where) and files.rename(beside, where)


@dataclass
class Collection:
    spark: SparkSession
    path: str

    @staticmethod
    def open(spark: SparkSession, path: str, spec: ModelSpec | None = None, *, create: bool = False, permit: bool = False) -> Collection:
        """The collection at a path, made with the contract if `create` asks for it and it is absent.

        An existing one must have been made with the same contract, else IncompatibleModel; `permit` makes it a warning.
        """
        found = Collection(spark, path.rstrip("/"))
        meta = read_json(spark, f"{found.path}/meta.json")
        if meta is None:
            if not create:
                raise FileNotFoundError(path)
            write_json(spark, f"{found.path}/meta.json", contract_of(spec) if spec else {})
        elif spec:
            check_compatible(meta, spec, permit)
        return found

    def meta(self) -> dict:
        return read_json(self.spark, f"{self.path}/meta.json") or {}

    def _commits(self) -> list[int]:
        files, where = file_system(self.spark, f"{self.path}/_log")
        names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _state(self) -> dict:
        """The last commit that can be read."""
        for n in reversed(self._commits()):
            found = read_json(self.spark, f"{self.path}/_log/{n}.json")
            if found:
                return found
        return {"parts": {}, "schema": None}

    def read(self, parts: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some partitions; None if nothing was ever written."""
        state = self._state()
        if state["schema"] is None:
            return None
        schema = T.StructType.fromJson(state["schema"])
        paths = [f"{self.path}/v{v}/part={p}" for p, v in state["parts"].items() if parts is None or int(p) in parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def replace(self, rows: DataFrame, video: str = "video_id", key: str = "id") -> None:
        """All rows of the rows' videos and all rows with their keys go, then the rows come; of equal keys one."""
        rows = store(rows.dropDuplicates([key]))
        self._change(rows, rows.select(video).distinct(), video, key)

    def delete(self, videos: DataFrame, video: str = "video_id", key: str = "id") -> None:
        self._change(None, videos.select(video).distinct(), video, key)

    def _change(self, rows: DataFrame | None, videos: DataFrame, video: str, key: str) -> None:
        commits, state = self._commits(), self._state()
        touched = [r[0] for r in videos.select(part_of(F.col(video)).alias("p")).distinct().collect()]  # at most PARTS
        old = self.read(touched)
        if old is None and rows is None:
            return
        now = rows if old is None else old.join(videos, video, "left_anti") if rows is None else replace_videos(old, rows, video, key)
        now = now.select(*(rows if rows is not None else old).columns)
        n = commits[-1] + 1 if commits else 1
        to = f"{self.path}/v{n}"
        drop(self.spark, to)  # a crashed attempt
        now.withColumn("part", part_of(F.col(video))).repartition("part").write.partitionBy("part").parquet(to)
        files, where = file_system(self.spark, to)
        written = {s.getPath().getName().removeprefix("part=") for s in files.listStatus(where) if s.isDirectory()}
        parts = {p: v for p, v in state["parts"].items() if int(p) not in touched} | {p: n for p in sorted(written)}
        if not write_json(self.spark, f"{self.path}/_log/{n}.json", {"parts": parts, "schema": now.schema.jsonValue()}):
            raise RuntimeError(f"another writer has changed {self.path}")
        self._vacuum()

    def _vacuum(self) -> None:
        """Versions that none of the last commits uses, and older commits."""
        commits = self._commits()
        used: set[int] = set()
        for n in commits[-KEPT:]:
            used |= set((read_json(self.spark, f"{self.path}/_log/{n}.json") or {"parts": {}})["parts"].values())
        for n in commits[:-KEPT]:
            drop(self.spark, f"{self.path}/_log/{n}.json")
        files, where = file_system(self.spark, self.path)
        for s in files.listStatus(where):
            name = s.getPath().getName()
            if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) <= commits[-1] and int(name[1:]) not in used:
                drop(self.spark, s.getPath().toString())

    def remove(self) -> None:
        drop(self.spark, self.path)
