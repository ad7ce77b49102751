import random

import pytest

from lectern.sources.snapshots import Snapshots
from lectern.streaming.progress import read_progress, stream_progress, stream_sentences


@pytest.mark.parametrize("compact", [20, 2])
def test_progress_is_kept_over_batches_replays_and_merges(spark, tmp_path, compact):
    schema, draw = "doc_id long, sentence_index long, updated_at long, event_id long", random.Random(3)
    source, out, wanted = str(tmp_path / "in"), str(tmp_path / "out"), {}
    for turn in range(7):
        rows = [(draw.randrange(9), draw.randrange(50), draw.randrange(30), turn * 10 + i) for i in range(6)]
        for doc, at, time, event in rows:
            wanted[doc] = max(wanted.get(doc, (-1,)), (time, event, at))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_progress(stream, out, str(tmp_path / "cp"), compact).trigger(availableNow=True).start().awaitTermination()
        assert {r.doc_id: (r.updated_at, r.event_id, r.sentence_index) for r in read_progress(spark, out).collect()} == wanted
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_progress(stream, out, str(tmp_path / "again"), compact).trigger(availableNow=True).start().awaitTermination()
    assert {r.doc_id: r.sentence_index for r in read_progress(spark, out).collect()} == {d: w[2] for d, w in wanted.items()}
    snapshots = Snapshots(spark, out)
    alive = {p["path"].split("/")[1] for v in snapshots.versions() for p in snapshots.parts(v)}
    assert len(snapshots.parts()) <= compact and {f.name for f in (tmp_path / "out" / "data").iterdir()} == alive


def test_a_reader_keeps_its_version(spark, tmp_path):
    """A table that was read once counts right after 50 more batches; its parts go when its lease has ended."""
    schema, out = "doc_id long, sentence_index long, updated_at long, event_id long", str(tmp_path / "out")
    source = str(tmp_path / "in")

    def add(first, files):
        spark.range(first, first + files, 1, files).selectExpr("id % 5 AS doc_id", "id AS sentence_index", "id AS updated_at", "id AS event_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream_progress(stream, out, str(tmp_path / "cp"), 4).trigger(availableNow=True).start().awaitTermination()

    add(0, 3)
    held, short = read_progress(spark, out), read_progress(spark, out, hours=-1)
    add(3, 50)
    assert sorted((r.doc_id, r.sentence_index) for r in held.collect()) == [(0, 0), (1, 1), (2, 2)]
    assert sorted(r.sentence_index for r in read_progress(spark, out).collect()) == [48, 49, 50, 51, 52]
    snapshots = Snapshots(spark, out)
    first = {p["path"] for p in snapshots.parts(3)}
    for name in snapshots._names("leases"):
        snapshots.release(f"{out}/leases/{name}")
    snapshots.clean()
    assert len(snapshots.versions()) == 3 and not any((tmp_path / "out" / p).exists() for p in first) and short is not None


def test_sentences_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "txt", "One. Two."), (2, "md", "## 1. Three"), (3, "md", None)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "docs"))
    stream = stream_sentences(spark.readStream.schema("doc_id long, source string, text string").parquet(str(tmp_path / "docs")))
    query = stream.writeStream.format("memory").queryName("said").start()
    query.processAllAvailable()
    query.stop()
    assert [r.text for r in spark.sql("SELECT * FROM said ORDER BY doc_id, sentence_id").collect()] == ["One.", "Two.", "1 Three"]
