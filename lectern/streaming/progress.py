"""Streams: positions into the progress table, and new documents into sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lectern.sources.corpus import parse_documents
from lectern.sources.snapshots import LEASE_HOURS, Snapshots

ROWS = "doc_id long, sentence_index long, updated_at long, event_id long"
COMPACT = 20


def _latest(rows: DataFrame) -> DataFrame:
    """The row of the greatest (updated_at, event_id) of each document; merging rows twice changes nothing."""
    last = F.max_by(F.struct("sentence_index", "updated_at", "event_id"), F.struct("updated_at", "event_id"))
    return rows.groupBy("doc_id").agg(last.alias("r")).select("doc_id", "r.*")


def read_progress(spark: SparkSession, folder: str, hours: float = LEASE_HOURS) -> DataFrame:
    """The table that stream_progress() keeps, as of now: its parts stay for so many hours, whatever the stream does."""
    snapshots = Snapshots(spark, folder)
    version = snapshots.current()
    snapshots.lease(version, hours)
    parts = snapshots.read(snapshots.parts(version), ROWS)
    return spark.createDataFrame([], ROWS) if parts is None else _latest(parts)


def stream_progress(events: DataFrame, folder: str, checkpoint: str, compact: int = COMPACT) -> DataStreamWriter:
    """Keeps the greatest (updated_at, event_id) of each document, for read_progress().

    A batch writes its own latest rows as a new part and names it in a new version; a replayed batch adds rows that
    change nothing. Once `compact` parts are alive, they are merged into one: a batch costs its own rows and a share
    of 1 / compact of the table.
    """
    snapshots = Snapshots(events.sparkSession, folder)

    def part(rows: DataFrame) -> dict:
        path = snapshots.new_path("progress")
        _latest(rows.select(*[c.split()[0] for c in ROWS.split(", ")])).write.parquet(f"{folder}/{path}")
        return {"table": "progress", "path": path}

    def write(batch: DataFrame, _: int) -> None:
        version = snapshots.current()
        parts = [*snapshots.parts(version), part(batch)]
        if len(parts) > compact:
            parts = [part(snapshots.read(parts, ROWS))]
        snapshots.commit(parts, version)
        snapshots.clean()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_sentences(docs: DataFrame) -> DataFrame:
    """Sentences of a stream of documents (doc_id, source, text), each parsed by its source; stateless."""
    return parse_documents(docs)
