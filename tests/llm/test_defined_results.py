"""Clashing columns, long texts, ids of other types, and results row by row against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import common, decontaminate, lm_score, near_dedup, pieces, quality, substring_dedup, suffix_dedup, token_counts, toxicity

CLASHES = ["toxicity", "n_words", "n_removed", "n_bytes", "n_spans", "ids", "decoded", "_hit", "_items", "items", "n_hit", "over_coverage", "k", "f", "g", "bucket", "marks", "_text", "_new", "set", "root", "t", "c", "c_0", "c_1"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def clashing(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choices([f"w{i}" for i in range(300)], k=60)) for _ in range(5)] + [None, ""]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 1, int(i == 2)) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_clashing_columns(spark, clashing, tables, name, stage):
    got = stage(spark, clashing, tables)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert len(rows) >= 6 and all(r[c] == f"own {c}" for r in rows for c in CLASHES)


def test_last_stage_with_clashing_columns(spark, clashing, tables):
    assert all(r.round_trip in (True, None) for r in corpus_pipeline.STAGES[-1][1](spark, clashing, tables).collect())


def test_added_columns_replace_others(clashing):
    for got, names in ((substring_dedup.remove_repeats(clashing), ["n_words"]), (suffix_dedup.remove_long_matches(clashing), ["n_bytes"]), (pieces.encode(clashing, decoded="decoded"), ["ids", "decoded"]), (decontaminate.decontaminate(clashing, clashing.limit(0).withColumnRenamed("doc_id", "item_id")), ["n_hit", "items"])):
        assert len(set(got.columns)) == len(got.columns)
        assert all(r[n] != f"own {n}" for r in got.collect() for n in names)


@pytest.mark.parametrize("work", [substring_dedup.remove_repeats, suffix_dedup.remove_long_matches, near_dedup.near_duplicates, quality.rule_statistics, token_counts.token_counts])
def test_other_ids_are_refused(spark, work):
    with pytest.raises(TypeError, match="integers"):
        work(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Cluster)


def test_texts_over_a_slice(spark):
    """Texts of over SLICE_BYTES, one of them a copy inside another."""
    draw = random.Random(1)
    long = " ".join(draw.choices([f"v{i}" for i in range(5000)], k=120_000))
    assert len(long) > common.SLICE_BYTES
    docs = spark.createDataFrame([(1, long), (2, "head " + long + " tail"), (3, "short")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()} == {(1, 0), (2, 120_000), (3, 0)}
    assert {(r.doc_id, bytes(r.text)) for r in suffix_dedup.remove_long_matches(docs).collect()} == {(1, b""), (2, b"head  tail" if not long.startswith(" ") else b""), (3, b"short")}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: r for r in pieces.encode(docs, decoded="d").collect()}
    assert all(got[i].ids == library.encode(got[i].text) and got[i].d == got[i].text for i in got)
    assert {(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_edges_do_not_depend_on_the_bracketing(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["internationalization " * 40, "ab" * 300, "x " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for fan in (2, 3, 32):
        assert {r.doc_id: r.ids for r in pieces.encode(docs, chunk=50, fan=fan).collect()} == {i: library.encode(t) for i, t in enumerate(texts)}


def test_transfers_combine_associatively():
    draw = np.random.default_rng(0)
    states = [[(i, i + j) for i in range(3)] for j in range(5)]
    parts = [(a, b, np.where(draw.random((3, 3)) < 0.6, 0.0, -np.inf)) for a, b in zip(states, states[1:], strict=False)]
    left = pieces.then(pieces.then(pieces.then(parts[0], parts[1]), parts[2]), parts[3])
    right = pieces.then(parts[0], pieces.then(parts[1], pieces.then(parts[2], parts[3])))
    tree = pieces.then(pieces.then(parts[0], parts[1]), pieces.then(parts[2], parts[3]))
    assert np.array_equal(left[2], right[2]) and np.array_equal(left[2], tree[2])


def test_token_counts_row_by_row(spark):
    encode = token_counts.byte_bpe(token_counts.load_ranks(f"{token_counts.TOKENIZERS}/byte_bpe_50k.tiktoken")).encode_ordinary
    texts = [None, "", "a b c", "word " * 700, "é" * 50, "x", "word " * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 3):
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs.repartition(parts), block=64).collect()} == {i: len(encode(t or "")) for i, t in enumerate(texts)}


def test_lm_scores_row_by_row(spark):
    """base_score, the held-out split and score, with exact counts in the filter's place (counts that are powers of two)."""
    draw = random.Random(8)
    texts = [" ".join(draw.choices("Ab b C d e f".split(), k=draw.randint(0, 9))) for _ in range(40)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2}
    tokens = {i: [None, *words((t or "").lower()), None] for i, t in enumerate(texts)}
    one, two = Counter(), Counter()
    for i in set(tokens) - held:
        one.update(tokens[i][1:])
        two.update(zip(tokens[i], tokens[i][1:], strict=False))
    n, v = sum(one.values()), len(one)
    got = lm_score.score_lm(docs, ~F.col("doc_id").isin(*held), per_shard=7, group_bytes=60, bits=40).collect()
    assert held and len(got) == len(texts)

    def score(i, prior, gone=()):
        """The text's log10 probability by the counts without those of the documents in `gone`."""
        own = tokens[i]
        less = Counter(w for d in gone for w in tokens[d][1:])
        less_two = Counter(p for d in gone for p in zip(tokens[d], tokens[d][1:], strict=False))
        rest, out = n - sum(less.values()), 0.0
        for h, w in zip(own, own[1:], strict=False):
            pair = 2.0 ** math.floor(math.log2(two[h, w])) if two[h, w] else 0.0
            pair, seen = max(pair - less_two[h, w], 0), one[h] - less[h]
            out += math.log10((pair + prior * (one[w] - less[w] + 1) / (rest + v + 1)) / (max(seen, pair) + prior))
        return out

    prior = max(lm_score.PRIORS, key=lambda m: (sum(score(i, m, (i,)) for i in set(tokens) - held), -m))
    assert prior not in (lm_score.PRIORS[0],)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in held, len(own) - 1, sum(w in one for w in own[1:]), n)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in own[1:]))
        assert r.score == pytest.approx(score(r.doc_id, prior))


def test_toxicity_row_by_row(spark):
    """Scores by a plain search for every lexicon word, without an automaton."""
    lexicon, weights = {"idiot": 2.0, "stup": 1.0, "trash": 1.5}, np.array([1.0, 0.5, -2.0])
    texts = ["you 1dіot", "stupid trash can", "trash trash", "clean words here", "", None, "xidiot ST-UP stupor"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_toxicity(docs, (lexicon, weights)).collect():
        folded = toxicity.fold(r.text)
        harmless = [(m.start(), m.end()) for p in toxicity.EXCEPTIONS for m in re.finditer(re.escape(toxicity.fold(p)), folded)]
        hits = [w for p, w in lexicon.items() for m in re.finditer(re.escape(" " + p), folded) if not any(a <= m.start() and m.end() <= b for a, b in harmless)]
        x = np.array([math.log1p(sum(hits)), math.log1p(100 * sum(hits) / (folded.count(" ") + 19))])
        assert r.toxicity == pytest.approx(1 / (1 + math.exp(-(x @ weights[:2] + weights[2]))))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert lm_score.score_lm(none, F.lit(True)).isEmpty()
    assert toxicity.score_toxicity(none, toxicity.train(none, labels)).isEmpty()
    stats = quality.rule_statistics(none)
    assert quality.judge(stats, quality.train(stats, labels)).isEmpty()


def test_one_window_in_every_document(spark):
    """A window that all documents share leaves one posting a document, and the first document keeps it."""
    shared = " ".join(f"s{i}" for i in range(13))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared + " own"), F.col("id").cast("string")).alias("text"))
    got = substring_dedup.remove_repeats(docs, per_bucket=500)
    assert {(r.n, r.m) for r in got.groupBy(F.col("n_removed").alias("n")).agg(F.count("*").alias("m")).collect()} == {(0, 1), (13, 2999)}
