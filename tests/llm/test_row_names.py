"""Different texts under one id (null here) whose hashes agree in their 31 lowest bits stay apart."""

import pytest
import sentencepiece
from pyspark.sql import functions as F

from lectern.llm import common, near_dedup, pieces, substring_dedup, suffix_dedup


@pytest.fixture(scope="module")
def pair(spark):
    """Two texts of 16 words of their own, equal in the low 31 bits of xxhash64."""
    word = [F.sha2(F.concat_ws("-", "id", F.lit(i)), 256) for i in range(16)]
    texts = spark.range(200_000).select(F.concat_ws(" ", *word).alias("text"))
    low = texts.select("text", F.xxhash64("text").bitwiseAND(0x7FFFFFFF).alias("low"))
    found = low.groupBy("low").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").orderBy("low").first()
    return found.a, found.b


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_names_differ(spark, pair):
    assert len({(r.k, r.f) for r in common.keyed(table(spark, [(None, t) for t in pair])).collect()}) == 2


def test_suffix_dedup(spark, pair):
    a, b = pair
    got = suffix_dedup.remove_long_matches(table(spark, [(None, a), (None, b + " and more"), (None, b), (1, a)])).collect()
    assert sorted(bytes(r.text).decode() for r in got) == ["", "", "", " and more"]
    got = suffix_dedup.remove_long_matches(table(spark, [(None, a), (None, b), (1, a)])).collect()
    assert sorted(bytes(r.text).decode() for r in got) == ["", "", b]
    # segments whose text must be compared
    got = suffix_dedup.remove_long_matches(table(spark, [(None, a), (None, b), (1, "head " + a[100:700] + " tail")])).collect()
    assert sorted(bytes(r.text).decode() for r in got) == sorted([a[:100] + a[700:], b, "head  tail"])


def test_substring_dedup(spark, pair):
    a, b = pair
    got = substring_dedup.remove_repeats(table(spark, [(None, a), (None, b), (1, a)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.text) for r in got) == sorted([(0, 16, ""), (0, 0, b), (1, 0, a)])


def test_near_dedup(spark, pair):
    a, b = pair
    rows = table(spark, [(None, a), (None, b), (1, a + " new"), (2, b + " new")])
    assert sorted(r.class_id for r in near_dedup.near_duplicates(rows).collect()) == [1, 1, 2, 2]
    kept = near_dedup.keep_one(rows.where("coalesce(doc_id, 1) = 1")).collect()
    assert sorted(r.text for r in kept) == sorted([a + " new", b])


def test_pieces(spark, pair):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encode(table(spark, [(None, t) for t in pair]), chunk=200).collect()
    assert {r.text: r.ids for r in got} == {t: library.encode(t) for t in pair}
