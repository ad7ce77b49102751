"""The streams, run over whole tables until all of their files are read, with what a batch query would give in SQL.

Tables and checkpoints of a run go into a folder of its own under spark.checkpoint.dir, where they stay for the
result's reader.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.plans.catalog import ORACLE_SQL, QUERIES, query
from lectern.plans.documents import READ_SQL
from lectern.streaming.progress import read_progress, stream_progress, stream_sentences

FILES_A_BATCH = 64


def _folder(spark: SparkSession) -> str:
    """A new name in the folder that driver and executors share; one of our own only on a single machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='lectern-')}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, in batches of a bounded number of files. It reads a pattern, as a plain path would
    have to be a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(f"{path}*")


def streamed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions kept by the stream; the events come twice, as after a lost checkpoint, which changes nothing."""
    folder = _folder(spark)
    events = _stream(spark, f"{sf_dir}/events.parquet")
    rows = events.select(F.col("user_id").alias("doc_id"), F.floor(F.col("value") / 10).alias("sentence_index"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"), "event_id")
    for turn in ("first", "again"):
        stream_progress(rows, f"{folder}/table", f"{folder}/{turn}").trigger(availableNow=True).start().awaitTermination()
    return read_progress(spark, f"{folder}/table")


def streamed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of new documents, appended batch by batch."""
    folder = _folder(spark)
    docs = _stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", F.lit("txt").alias("source"), "text")
    said = stream_sentences(docs).select("doc_id", "sentence_id", "block_no", "text")
    sink = said.writeStream.format("parquet").option("path", f"{folder}/said").option("checkpointLocation", f"{folder}/first")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(said.schema).parquet(f"{folder}/said").select(*[F.col(c).cast("long") if c != "text" else F.col(c) for c in said.columns])


QUERIES |= {"streamed_progress": streamed_progress, "streamed_sentences": streamed_sentences}
ORACLE_SQL |= {
    "streamed_progress": "SELECT user_id AS doc_id, CAST(floor(arg_max(value, (ts, event_id)) / 10) AS BIGINT) AS sentence_index, max(epoch_us(ts)) AS updated_at, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id",
    "streamed_sentences": f"SELECT doc_id, sentence_id, block_no, text FROM ({READ_SQL})",
}


@query("SELECT doc_id, md5(bare) AS bare FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x1F]', '', 'g') AS bare FROM documents) WHERE bare <> ''")
def drop_unmapped(t, spark):
    """Whole texts without control characters; those with nothing left are dropped."""
    bare = t("documents").select("doc_id", X.drop_unmapped(F.col("text")).alias("bare"))
    return bare.where("bare <> ''").select("doc_id", F.md5("bare").alias("bare"))
