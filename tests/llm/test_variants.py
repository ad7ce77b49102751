"""op13 against every possible edit of every word, and its defined results."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import common, variants


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters = sorted({c for w in words for c in w})
    near, form = {}, {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in letters if j <= len(w)}
        near[w] = [x for x in edits - {w} if x in words]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(docs):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(docs).collect()}


def test_against_all_edits(spark):
    draw = random.Random(13)
    words = ["".join(draw.choices("aabÀéÿz", k=draw.randrange(4, 9))) for _ in range(250)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "bababab", "Straße", "STRASSE", "STRAßE", "x×yz÷a"]
    rows = [(draw.choice([None, -7, *range(60)]), " ".join(w.upper() if w.isascii() and draw.random() < 0.2 else w for w in draw.choices(words, k=60))) for _ in range(90)]
    rows += [(1, None), (2, ""), (3, "日本 a1b2 naïve-naïve’naïve"), rows[0], rows[0]]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_chains_and_ties(spark):
    """Forms lead over several words to one root; equally frequent neighbours are taken in code-point order."""
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc"]
    rows = [(i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(chain)]
    rows += [(9, " ".join(["mnopq"] * 3 + ["mnopr"] * 6 + ["mnopé"] * 6 + ["mnop"] * 9 + ["mnopqq"] * 6))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and got["aaaaa"][1] == got["aaabb"][1] and got["mnopq"][0] == "mnopqq"


def test_long_texts_and_batches(spark):
    """Portions of a long text end between runs, and groups that cross batches stay whole."""
    text = " ".join(f"{w}" for w in random.Random(2).choices(["abcde", "abcdf", "abcd", "bcdef", "xabcde"], k=400_000))
    assert len(text) > 2 * variants.PORTION and sum(len(variants._RUN.findall(p)) for p in variants.portions(text)) == 400_000
    rows = [(5, text)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tables(spark):
    docs = spark.createDataFrame([(1, "abcde abcde abcde")] * 500, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("word", "n", "id", "prefix")])
    assert found(docs) == {"abcde": (None, "abcde", 1500, 0, None)}
    assert found(docs.limit(0)) == {}
    with pytest.raises(TypeError, match="integers"):
        variants.group_variants(docs.withColumn("doc_id", F.lit("x")))
    assert found(docs.withColumn("doc_id", F.lit(None).cast("long")))["abcde"][2] == 1500
    assert common.whole_ids(docs, "doc_id") is docs
