"""Saving, replacing and deleting documents with images: only touched buckets, all tables at once."""

import pytest
from pyspark.sql import functions as F

from lectern.sources import snapshots as N

DOCS = "doc_id long, title string, saved_at long, blocks array<struct<kind:string,text:string>>"
IMAGES = "image_id string, doc_id long, bytes binary, width int"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, v, [("heading", t)]) for i, t, v in rows], DOCS)


def images(spark, *rows):
    return spark.createDataFrame([(n, i, n.encode(), 10) for n, i in rows], IMAGES)


def titles(store, **options):
    return {r.doc_id: r.title for r in store.load(**options).collect()}


@pytest.fixture
def store(spark, tmp_path):
    found = N.LibraryStore(spark, str(tmp_path / "library"), buckets=8)
    found.save(docs(spark, *[(i, f"t{i}", 1) for i in range(40)]), images(spark, ("a", 1), ("b", 1), ("c", 2)))
    return found


def test_upsert_with_images(spark, store):
    store.save(docs(spark, (1, "new", 2), (2, "older", 0), (99, "added", 1)), images(spark, ("d", 1)))
    got = titles(store)
    assert len(got) == 41 and (got[1], got[2], got[99]) == ("new", "t2", "added")
    assert sorted((r.doc_id, r.image_id) for r in store.load("images").collect()) == [(1, "d")]
    assert store.image("d").first().bytes == b"d" and store.image("d", 1).count() == 1 and store.image("a").count() == 0
    assert titles(store, ids=spark.createDataFrame([(1,), (7,), (1000,)], "doc_id long")) == {1: "new", 7: "t7"}


def test_only_touched_buckets_are_written(spark, store):
    before = {(p["table"], p["bucket"]): p["path"] for p in store.snapshots.parts()}
    ids = spark.createDataFrame([(3,), (4,)], "doc_id long")
    touched = store._touched(ids)
    store.delete(ids)
    after = {(p["table"], p["bucket"]): p["path"] for p in store.snapshots.parts()}
    assert len(touched) < 8 and all((after[k] != before[k]) == (k[1] in touched) for k in after)
    assert sorted(titles(store)) == [i for i in range(40) if i not in (3, 4)]
    plan = store.load(ids=spark.createDataFrame([(5,)], "doc_id long")).inputFiles()
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in plan} == store._touched(spark.createDataFrame([(5,)], "doc_id long"))


def test_delete_cascades(spark, store):
    store.save_progress(spark.createDataFrame([(1, 5, 10, 1), (2, 6, 10, 2)], "doc_id long, sentence_index long, updated_at long, event_id long"))
    store.save_progress(spark.createDataFrame([(1, 4, 9, 3), (2, 7, 10, 3)], "doc_id long, sentence_index long, updated_at long, event_id long"))
    assert sorted((r.doc_id, r.sentence_index) for r in store.load("progress").collect()) == [(1, 5), (2, 7)]
    store.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert [r.doc_id for r in store.load("progress").collect()] == [2] and [r.image_id for r in store.load("images").collect()] == ["c"] and 1 not in titles(store)


def test_a_crash_between_two_tables(spark, store, monkeypatch):
    """A writer that dies after the documents and before the images, or before the version, leaves the old state."""
    write = N.LibraryStore._write

    def dies(self, table, rows):
        if table == "images":
            raise OSError("lost")
        return write(self, table, rows)

    monkeypatch.setattr(N.LibraryStore, "_write", dies)
    with pytest.raises(OSError, match="lost"):
        store.save(docs(spark, (1, "half", 5)), images(spark, ("x", 1)))
    monkeypatch.undo()
    monkeypatch.setattr(N.Snapshots, "commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        store.save(docs(spark, (1, "half", 5)), images(spark, ("x", 1)))
    monkeypatch.undo()
    assert titles(store)[1] == "t1" and sorted(r.image_id for r in store.load("images").collect()) == ["a", "b", "c"]
    store.save(docs(spark, (1, "whole", 6)))
    assert titles(store)[1] == "whole" and [r.image_id for r in store.load("images").collect()] == ["c"]


def test_two_writers(spark, store):
    at = store.snapshots.current()
    store.save(docs(spark, (1, "first", 9)))
    with pytest.raises(RuntimeError, match="another writer"):
        store.snapshots.commit([], at)


def test_old_and_new_layouts_together(spark, tmp_path):
    """Files with paragraphs, with blocks and with both are read as one table; blocks win, null paragraphs give none."""
    store = N.LibraryStore(spark, str(tmp_path / "mixed"), buckets=2)
    old = spark.createDataFrame([(1, "old", 1, ["One.", "", "Two."]), (2, "bare", 1, None)], "doc_id long, title string, saved_at long, paragraphs array<string>")
    store.save(old)
    store.save(docs(spark, (3, "new", 1)))
    got = {r.doc_id: [(b.kind, b.text) for b in r.blocks] for r in store.load().collect()}
    assert got == {1: [("paragraph", "One."), ("paragraph", ""), ("paragraph", "Two.")], 2: [], 3: [("heading", "new")]}
    assert "paragraphs" not in store.load().columns
    wide = old.withColumn("blocks", F.lit(None).cast("array<struct<block_no:int,kind:string,level:int,runs:array<struct<text:string,bold:boolean,italic:boolean,code:boolean>>>>"))
    rows = {r.doc_id: r.blocks for r in N.L.doc_blocks(wide).collect()}
    assert [(b.block_no, b.kind, b.level, b.runs[0].text) for b in rows[1]] == [(0, "paragraph", None, "One."), (1, "paragraph", None, ""), (2, "paragraph", None, "Two.")]
