"""The clip manifest holds every request."""

import duckdb

from lectern.operators import library as L
from lectern.plans import catalog

DOCS = [(0, "Intro\nOne."), (1, "Intro\nTwo."), (2, "Intro\nIntro\nThree."), (3, "Intro"), (5, "Intro"), (-1, "Minus\n"), (-3, "Intro"), (None, "None\nIntro"), (4, None), (6, ""), (7, "a|b\n\n")]


def test_every_request_is_counted(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalog.QUERIES["clip_manifest"](spark, str(tmp_path)).select("clip_key", "voice_id", "text", "uses").collect()]
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(duck.sql(f"SELECT clip_key, voice_id, text, uses FROM ({catalog.ORACLE_SQL['clip_manifest']})").fetchall())
    assert sum(r[3] for r in got) == sum(len(text.split("\n")) for _, text in DOCS if text is not None)
    assert {r[1:] for r in got if r[2] == "Intro"} == {("kokoro:af_sky", "Intro", 3), ("kokoro:bm_george", "Intro", 1), ("system:old", "Intro", 4)}


def test_catalogue_narrows_the_manifest(spark):
    requests = spark.createDataFrame([(1, 0, "kokoro:af_sky", 1.0, "a"), (2, 0, "system:old", 1.0, "a"), (3, 0, "system:old", 1.0, "a")], "doc_id long, sentence_id int, voice_id string, rate double, text string")
    assert sorted((r.voice_id, r.uses) for r in L.clip_manifest(requests).collect()) == [("kokoro:af_sky", 1), ("system:old", 2)]
    assert [(r.voice_id, r.uses) for r in L.clip_manifest(requests, L.voices(spark)).collect()] == [("kokoro:af_sky", 1)]
