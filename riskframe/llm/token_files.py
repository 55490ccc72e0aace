"""Token ids of documents as binary shard files of Simple-8b frames, written and read by Spark.

A shard is a Parquet file whose rows are frames: `payload` is a Simple-8b stream (see simple8b) over the ids of some
whole documents one after another, `doc_ids` and `lengths` say whose, `shard` and `frame` give the order, and
`before` counts the ids of the shard ahead of the frame. Spark's writer commits whole tasks, so a lost executor
leaves no half shard, and any store that Spark can write will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .word_tokens import shared_coder

END_ID = 1
FRAME_IDS = 200_000
BATCH_ROWS = 500
_FRAME = pa.schema([("shard", pa.int32()), ("frame", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
_FRAME_DDL = ("shard int, frame long, before long, n_ids long, doc_ids array<long>, lengths array<long>, "
              "payload binary")


def write_token_files(documents: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id",
                      text: str = "text") -> None:
    """Encode every whole text, append end_id, and write the ids in ascending id order (null ids first, ties by text).

    A null text counts as empty and gives the end id alone. Other columns are not written. An empty table gives a
    folder without frames. Rows are dealt by ranges of the id, each range is one shard.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared_coder(vocabulary)
        shard = TaskContext.get().partitionId()
        frame = before = held = 0
        ids: list = []
        parts: list[np.ndarray] = []
        end = np.array([end_id], np.uint32)

        def packed() -> pa.RecordBatch:
            stream = simple8b.encode(np.concatenate([x for p in parts for x in (p, end)]))
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "frame": frame, "before": before, "n_ids": held, "doc_ids": ids,
                "lengths": [len(p) + 1 for p in parts], "payload": stream}], schema=_FRAME)

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = coder.encode(value.as_py() or "")
                ids.append(doc)
                parts.append(coded)
                held += len(coded) + 1
                if held >= FRAME_IDS:
                    yield packed()
                    frame, before, held, ids, parts = frame + 1, before + held, 0, [], []
        if ids:
            yield packed()

    # Short batches: a batch of long texts is held by the JVM and by Python at once, beside the sort.
    conf, name = documents.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(name)
    conf.set(name, BATCH_ROWS)
    try:
        (documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
         .repartitionByRange("id").sortWithinPartitions("id", "text")
         .mapInArrow(run, _FRAME_DDL).write.mode("errorifexists").parquet(folder))
    finally:
        conf.set(name, usual)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document of the files, start counting the ids of all documents before."""
    frames = spark.read.schema(_FRAME_DDL).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, starts, counts, ids, cuts in _documents(batches):
            rows = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([docs, pa.array(starts), pa.array(counts), rows],
                                             names=["id", "start", "n_tokens", "ids"])
    return _placed(frames).mapInArrow(run, "id long, start long, n_tokens long, ids array<long>")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of the files; the checksum is over uint32 little-endian."""
    frames = spark.read.schema(_FRAME_DDL).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, starts, counts, ids, cuts in _documents(batches):
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([docs, pa.array(starts), pa.array(counts), pa.array(sums, pa.int64())],
                                             names=["id", "start", "n_tokens", "ids_crc32"])
    return _placed(frames).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def _placed(frames: DataFrame) -> DataFrame:
    """Frames with `start`, the number of ids in all shards and frames before; one row per shard is summed up."""
    totals = frames.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("offset"))
    return (frames.join(offsets, "shard")
            .select((F.col("offset") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload"))


def _documents(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for row in range(batch.num_rows):
            docs = batch.column(1)[row].values
            counts = batch.column(2)[row].values.to_numpy()
            cuts = np.concatenate(([0], np.cumsum(counts)))
            ids = simple8b.decode(batch.column(3)[row].as_buffer())
            yield docs, batch.column(0)[row].as_py() + cuts[:-1], counts, ids, cuts
