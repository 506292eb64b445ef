"""Indexing from end to end: select transcripts, cut passages, encode them, replace their videos, keep the manifest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import models
from tessera.operators.chunks import chunk_transcripts
from tessera.operators.incremental import CHUNKER_VERSION, rebuild_manifest, select_videos
from tessera.operators.lexical import LexicalIndex
from tessera.sources.collection import Collection
from tessera.sources.storage import drop, scratch, store
from tessera.sources.transcripts import append_jsonl, segment_rows

MANIFEST = "video_id string, chunks long, mtime double, chunker int, fingerprint string"


@dataclass
class Outcome:
    """What was selected, what came of it. Selected videos without passages are neither processed nor recorded."""

    to_process: int
    ignored: int
    altered: int
    processed: int
    empty: int
    chunks: int


@dataclass
class Library:
    """A folder that holds a collection of passages, its manifest and its lexical index."""

    spark: SparkSession
    path: str

    @property
    def collection_path(self) -> str:
        return f"{self.path}/passages"

    def manifest(self) -> DataFrame:
        """The manifest; rebuilt from the collection if it is missing or unreadable, so that all its videos are stale."""
        empty = self.spark.createDataFrame([], MANIFEST)
        try:
            kept = Collection.open(self.spark, f"{self.path}/manifest").read()
        except FileNotFoundError:
            kept = None
        if kept is not None:
            return kept.select(*empty.columns)
        try:
            passages = Collection.open(self.spark, self.collection_path).read()
        except FileNotFoundError:
            passages = None
        if passages is None:
            return empty
        unknown = [F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields[2:]]
        return rebuild_manifest(passages).select("video_id", "chunks", *unknown)

    def clear(self) -> None:
        """Everything goes: passages, manifest, lexical index."""
        drop(self.spark, self.path)

    def lexical(self) -> LexicalIndex:
        """The saved index of the collection as it is now; a changed collection gets a new one, an absent one none."""
        passages = Collection.open(self.spark, self.collection_path).read()
        if passages is None:
            passages = self.spark.createDataFrame([], "id string, document string")
        return LexicalIndex.open(passages, f"{self.path}/lexical")

    def index(
        self,
        files: DataFrame,
        spec: models.ModelSpec,
        encode: Callable[[list[str]], np.ndarray],
        *,
        force: bool = False,
        reindex: bool = False,
        limit: int = 0,
        batch: int = 16,
        export: str | None = None,
        **chunking,
    ) -> Outcome:
        """Indexes transcript files (as read_transcripts gives them) that are new or have changed.

        `limit` cuts the list of files to process, in the order of their paths, after they were counted. `reindex`
        starts over, whatever model the collection was made with. The passages are committed before the manifest:
        a crash in between only makes the next run do some videos again.
        """
        if reindex:
            self.clear()
        collection = Collection.open(self.spark, self.collection_path, spec, create=True, permit=reindex)
        with scratch(self.spark):
            known = self.manifest()
            selected = store(select_videos(files.select("video_id", "path", "mtime"), known, force=force))
            counts = selected.agg(
                *[F.coalesce(F.count_if(c), F.lit(0)) for c in (F.col("action") == "process", F.col("action") == "skip", F.col("altered"))]
            ).first()
            todo = selected.where("action = 'process'")
            if limit > 0:
                todo = todo.orderBy("path").limit(limit)
            # of several files of a video the last by path counts
            last = Window.partitionBy("video_id").orderBy(F.col("path").desc())
            todo = store(todo.withColumn("i", F.row_number().over(last)).where("i = 1").select("video_id", "path", "mtime"))
            mine = files.join(todo.select("path"), "path", "left_semi")
            passages = chunk_transcripts(segment_rows(mine), mine.select("video_id", "title", "upload_date", "webpage_url"), **chunking)
            vector = models.encoder(spec, encode, batch)(models.document_input(F.col("document"), spec))
            passages = store(passages.withColumn("embedding", vector))
            per_video = store(passages.groupBy("video_id").agg(F.count(F.lit(1)).alias("chunks")))
            done = per_video.agg(F.count(F.lit(1)), F.coalesce(F.sum("chunks"), F.lit(0))).first()
            if done[0]:
                collection.replace(passages)
                if export:
                    append_jsonl(passages, export)
                fresh = per_video.join(todo, "video_id").select(
                    "video_id", "chunks", "mtime", F.lit(CHUNKER_VERSION).alias("chunker"), F.lit(spec.fingerprint).alias("fingerprint")
                )
                manifest = Collection.open(self.spark, f"{self.path}/manifest", create=True)
                if manifest.read() is None:
                    # the first time, what was rebuilt from the passages is recorded too
                    fresh = known.join(fresh, "video_id", "left_anti").unionByName(fresh)
                manifest.replace(fresh, key="video_id")
            n_todo = todo.count()
        return Outcome(*map(int, counts), processed=int(done[0]), empty=n_todo - int(done[0]), chunks=int(done[1]))
