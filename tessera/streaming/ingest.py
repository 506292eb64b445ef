"""Incremental indexing of transcript files as a stream: each micro-batch goes through the same path as a batch run."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.models import ModelSpec
from tessera.operators.indexing import Library
from tessera.sources import transcripts as io


def ingest(
    spark: SparkSession, source: str, library: str, checkpoint: str, spec: ModelSpec, encode: Callable[[list[str]], np.ndarray], **options
) -> StreamingQuery:
    """Indexes new transcript files into the library until none is left.

    A micro-batch rewrites only the partitions of its videos. One that is repeated after a crash finds its files in
    the manifest and changes nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        paths = [r["path"] for r in rows.select("path").distinct().collect()]  # a micro-batch's file names
        if paths:
            Library(spark, library).index(io.read_transcripts(spark, paths), spec, encode, **options)

    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    stream = names.option("pathGlobFilter", "*.json").load(source).select("path")
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
