"""Spans by a sweep, and clips with their positions."""

import random
import time

from pyspark.sql import functions as F

from lectern.operators import blocks as B
from lectern.operators import library as L

RUNS = "doc_id long, block_no int, child_no int, run_no int, start int, end int, text string, bold boolean, italic boolean, code boolean"


def random_block(draw, doc, block, child):
    runs, said, at = [], [], 0
    for i in range(draw.randrange(1, 12)):
        n = draw.randrange(1, 9)
        runs.append((doc, block, child, i, at, at + n, "".join(draw.choices("abc d", k=n)), draw.random() < 0.5, False, False))
        at += n
    start = draw.randrange(3)
    while start < at:
        end = min(at, start + draw.randrange(1, 10))
        said.append((doc, len(said), block, child, start, end, "x"))
        start = end + draw.randrange(3)
    return runs, said


def test_sweep_against_every_pair(spark):
    draw = random.Random(7)
    runs, said = [], []
    for doc in range(40):
        for block in range(3):
            for child in (None, 0, 1):
                for table, rows in zip((runs, said), random_block(draw, doc, block, child), strict=True):
                    table += rows
    said = [(d, 1000 * b + 100 * (c or 0) + (c is None) * 50 + i, b, c, s, e, t) for d, i, b, c, s, e, t in said]
    want = sorted((d, i, n, max(s, a), min(e, z), text[max(s, a) - a : min(e, z) - a], bold) for d, i, b, c, s, e, _ in said for d2, b2, c2, n, a, z, text, bold, _, _ in runs if (d, b, c) == (d2, b2, c2) and a < e and z > s)
    got = B.sentence_run_spans(spark.createDataFrame(said, B.SENTENCES), spark.createDataFrame(runs, RUNS)).collect()
    assert sorted(tuple(r)[:7] for r in got) == want


def test_sweep_of_one_large_block(spark):
    n = 100_000
    runs = spark.range(n).selectExpr("1L AS doc_id", "0 AS block_no", "CAST(NULL AS INT) AS child_no", "CAST(id AS INT) AS run_no", "CAST(7 * id AS INT) AS start", "CAST(7 * id + 7 AS INT) AS end", "'abcdefg' AS text", "false AS bold", "false AS italic", "false AS code")
    said = spark.range(n).selectExpr("1L AS doc_id", "CAST(id AS INT) AS sentence_id", "0 AS block_no", "CAST(NULL AS INT) AS child_no", "CAST(7 * id + 3 AS INT) AS start", "CAST(7 * id + 10 AS INT) AS end", "'x' AS text")
    began = time.time()
    got = B.sentence_run_spans(said, runs).agg(F.count("*"), F.sum(F.length("text"))).first()
    assert (got[0], got[1]) == (2 * n - 1, 7 * n - 3) and time.time() - began < 60


def test_manifest_and_positions_join(spark):
    """3,000 copies of one sentence, rare ones, and refused voices: what the manifest counts is what the positions hold."""
    voice = "CASE id % 3 WHEN 0 THEN 'kokoro:af_sky' WHEN 1 THEN 'kokoro:bm_lewis' ELSE 'system:old' END"
    requests = spark.range(9000).selectExpr("id AS doc_id", "0 AS sentence_id", f"{voice} AS voice_id", "1.0D AS rate", "CASE WHEN id % 3 = 0 THEN 'Introduction' WHEN id % 7 = 0 THEN NULL ELSE concat('own ', id % 500) END AS text").cache()
    catalogue = L.voices(spark)
    clips = L.clip_manifest(requests, catalogue).withColumn("path", F.concat(F.lit("clip-"), "clip_key"))
    assert clips.where("voice_id = 'system:old'").count() == 0 and clips.agg(F.max("uses"), F.sum("uses")).first()[:] == (3000, 6000)
    for hot in (1, 3, 1000):
        got = L.clip_positions(requests, catalogue, clips, hot)
        assert got.count() == 6000 and got.select("doc_id").distinct().count() == 6000
        counted = got.groupBy("clip_key", "path", "uses").count()
        assert counted.where("count <> uses").count() == 0 and counted.count() == clips.count()


def test_default_voice(spark):
    users = spark.createDataFrame([(1, "kokoro:bf_emma"), (2, None), (3, "system:old")], "user_id long, voice_id string")
    assert sorted((r.user_id, r.voice_id) for r in L.pick_voice(users, L.voices(spark)).collect()) == [(1, "kokoro:bf_emma"), (2, "kokoro:af_heart"), (3, "kokoro:af_heart")]
