"""Every stage of the pipeline against brute force over the rows that it was given."""

import re
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import pieces, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Name of each stage: the rows that it read, and those that it wrote."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found[name] = (before, docs.collect())
    return found


def words(text, pattern=rb"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").encode())


def normal(text):
    return [w.lower() for w in words(text, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def test_toxicity(spark, tables):
    """The stage drops what the operator rates at the threshold or above, and no document labelled clean.

    How many toxic ones it finds depends on the labels, and is tested below: from the six of this size it learns no lexicon.
    """
    before, after = tables["toxicity"]
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    score = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if score[r.doc_id] < toxicity.THRESHOLD)
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()} & {r.doc_id for r in before}
    assert clean <= {r.doc_id for r in after}


def test_toxicity_held_out(spark):
    """Labels that training does not see, sf0.1: 128 of 144 toxic documents were found and no clean one of 1,200 when this was written."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(~toxicity.is_training(F.col("doc_id")))
    count = Counter((r.toxic, r.toxicity >= toxicity.THRESHOLD) for r in scored.select("toxic", "toxicity").collect())
    assert count[1, True] >= 0.85 * (count[1, True] + count[1, False])
    assert count[0, True] <= 0.005 * (count[0, True] + count[0, False])


def test_near_dedup(tables):
    before, after = tables["near_dedup"]
    bags = []
    for r in before:
        w = words(r.text)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    size = [sum(b.values()) if b else 0 for b in bags]
    for i in range(len(before)):
        for j in range(i):
            if bags[i] and bags[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]):
                common = sum((bags[i] & bags[j]).values())
                if common >= 0.8 * (size[i] + size[j] - common):
                    root[find(i)] = find(j)
    kept = {}
    for i, r in enumerate(before):
        kept[find(i)] = min(kept.get(find(i), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(kept.values())
    assert len(after) < len(before)


def test_substring_dedup(tables):
    before, after = tables["substring_dedup"]
    first = {}
    for r in before:
        w = words(r.text)
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, r.doc_id), r.doc_id)
    wanted = {}
    for r in before:
        w = words(r.text)
        gone = {x for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < r.doc_id for x in range(i, i + 13)}
        if len(gone) < len(w) or not w:
            wanted[r.doc_id] = [x for i, x in enumerate(w) if i not in gone]
    assert {r.doc_id: words(r.text) for r in after} == wanted


def test_decontamination(spark, tables):
    before, after = tables["decontamination"]
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = normal(r.text)
        n = min(10, len(w))
        windows.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n)
    wanted = {}
    for r in before:
        w = normal(r.text)
        gone = {x for n, found in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in found for x in range(i, i + n)}
        if len(gone) <= 0.8 * len(w):
            wanted[r.doc_id] = [x for i, x in enumerate(w) if i not in gone]
    assert {r.doc_id: normal(r.text) for r in after} == wanted


def test_sentencepiece(tables):
    before, after = tables["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert {r.doc_id: r.ids for r in after} == {r.doc_id: None if r.text is None else library.encode(r.text) for r in before}
    assert all(r.round_trip in (True, None) for r in after)
