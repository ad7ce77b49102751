"""The operators against brute force on small tables with nulls, empty and repeated rows, and clashing columns."""

import random
import re
from collections import Counter

import pytest
import sentencepiece

from lectern.llm import decontaminate, html_text, lm_score, near_dedup, pieces, quality, substring_dedup, suffix_dedup, token_counts, toxicity

A = " ".join(f"w{i}" for i in range(60))
B = " ".join(f"v{i}" for i in range(40))
TEXTS = [(1, A), (2, A), (3, f"{B} {A[:120]} tail"), (4, None), (5, ""), (6, "x" * 450), (7, f"head {B}"), (7, f"head {B}"), (None, A), (8, A.replace("w30 ", "changed "))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "z", "q") for i, t in TEXTS], "doc_id long, text string, k string, f string")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_suffix_dedup(docs):
    seen = Counter()
    for _, t in TEXTS:
        b = (t or "").encode()
        seen.update(b[j : j + 200] for j in range(len(b) - 199))
    wanted = []
    for _, t in TEXTS:
        b = (t or "").encode()
        gone = {x for j in range(len(b) - 199) if seen[b[j : j + 200]] > 1 for x in range(j, j + 200)}
        wanted.append((len(b), len(gone), bytes(c for x, c in enumerate(b) if x not in gone)))
    got = suffix_dedup.remove_long_matches(docs, per_bucket=9, bucket_bytes=700).collect()
    assert sorted((r.n_bytes, r.n_removed, bytes(r.text)) for r in got) == sorted(wanted)
    assert got[0].k == "z"


def test_substring_dedup(docs):
    first = {}
    for i, t in TEXTS:
        w, key = words(t), (1 << 62) if i is None else i
        for j in range(len(w) - 12):
            g = tuple(w[j : j + 13])
            first[g] = min(first.get(g, key), key)
    wanted = []
    for i, t in TEXTS:
        w, key = words(t), (1 << 62) if i is None else i
        gone = {x for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < key for x in range(j, j + 13)}
        wanted.append((len(w), len(gone), [x for j, x in enumerate(w) if j not in gone]))
    got = substring_dedup.remove_repeats(docs, per_bucket=20).collect()
    assert sorted((r.n_words, r.n_removed, words(r.text)) for r in got) == sorted(wanted)


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, B.upper()), (2, "v3, v4"), (3, None), (4, ""), (5, A[:40])], "item_id long, text string")
    got = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in decontaminate.decontaminate(docs, items).collect()}
    assert (1, 10, ()) not in got and (4, 0, ()) in got and (5, 0, ()) in got
    assert {x for x in got if x[0] == 7} == {(7, 40, ("1", "2"))}


def test_near_duplicates(docs):
    got = {(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (None, 1), (8, 1), (4, 4), (5, 5), (7, 7)} <= got
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()) == [1, 3, 4, 5, 6, 7]


@pytest.mark.parametrize("block", [1 << 20, 6000])
def test_large_buckets_lose_no_link(spark, block):
    """Texts around the bound, several hundred in few buckets: classes equal those of all candidate pairs, verified."""
    draw = random.Random(7)
    texts = []
    for theme in range(3):
        base = [f"t{theme}x{i}" for i in range(90)]
        for _ in range(60):
            own = list(base)
            for at in draw.sample(range(90), draw.randint(1, 4)):
                own[at] = f"n{draw.random()}"
            texts.append(" ".join(own))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed, roots = near_dedup.classes(rows, rows=1, rounds=1, small=3, block=block)
    placed = {r.k: (r.set, r["keys"]) for r in signed.collect()}
    root = {r.set: r.root for r in roots.collect()}
    bags = [{tuple(words(t)[i : i + 5]) for i in range(86)} for t in texts]
    alone = {s: s for s, _ in placed.values()}

    def find(x):
        while alone[x] != x:
            x = alone[x]
        return x

    for i in placed:
        for j in range(i):
            if set(placed[i][1]) & set(placed[j][1]) and len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j]):
                alone[find(placed[i][0])] = find(placed[j][0])
    pairs = {(find(s), root.get(s, s)) for s, _ in placed.values()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_pieces_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [A, B, "", None, "internationalization" * 9, " " * 90, "a  b\né\U0001d538" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (40, 1 << 15):
        for r in pieces.decode(pieces.encode(rows, chunk=chunk)).collect():
            assert r.decoded == r.text
            assert r.ids == (None if r.text is None else library.encode(r.text))


def test_token_counts(docs):
    encode = token_counts.byte_bpe(token_counts.load_ranks(f"{token_counts.TOKENIZERS}/byte_bpe_50k.tiktoken")).encode_ordinary
    got = token_counts.token_counts(docs, block=40).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(encode(t or "")) for _, t in TEXTS)


def test_lm_base_scores(spark, docs):
    from pyspark.sql import functions as F

    got = lm_score.score_lm(docs, F.lit(True), per_shard=20).collect()
    count = Counter(x for _, t in TEXTS for x in [*words((t or "").lower()), None])
    assert {r.train_tokens for r in got} == {sum(count.values())}
    assert sorted(r.n_tokens for r in got) == sorted(len(words(t)) + 1 for _, t in TEXTS)
    assert all(r.n_known == r.n_tokens for r in got)


def test_quality_and_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    stats = quality.rule_statistics(docs)
    judged = quality.judge(stats, quality.train(stats, none)).collect()
    assert {r.kept for r in judged if r.n_words < 20} == {False} and any(r.kept for r in judged)
    assert {r.toxicity for r in toxicity.score_toxicity(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert toxicity.fold("1dіot $tup1d and$$$") == " idiot stupid and "


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<body><nav>menu</nav><article><h1>T</h1><p>One &amp; two<p>Th<b>re</b>e</article><footer>f</footer>", "T One & two Three"), ("<div class='comments'><p>no</p></div><div><p>yes yes</p></div><p", "yes yes")])
def test_html(page, text):
    assert html_text.main_text(page) == text


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for got in (suffix_dedup.remove_long_matches(none), substring_dedup.remove_repeats(none), near_dedup.near_duplicates(none), pieces.encode(none), token_counts.token_counts(none), decontaminate.decontaminate(docs, items).where("n_hit > 0")):
        assert got.isEmpty()
