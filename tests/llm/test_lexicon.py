"""Rare toxic words stay in the lexicon whatever the number of more frequent ordinary ones."""

import random

from lectern.llm import toxicity


def test_rare_words_beside_many_frequent_ones(spark):
    draw = random.Random(3)
    common = " ".join("".join(draw.choices("abcdefghijkmnopqrstuvwxy", k=12)) for _ in range(7000))
    rows = [(f"{common} {'zzgrim' if i < 8 else ''}", 1) for i in range(10)]
    rows += [(common if i < 10 else "plain", 0) for i in range(40)]
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), 10, 40)
    assert list(got) == ["zzgrim"]


def test_the_lexicon_has_no_cap(spark):
    """Every word beginning with evidence is learned, over 2,000 of them too."""
    words = ["".join("abcdefghij"[int(d)] for d in f"{i:04d}") for i in range(2_500)]
    rows = [(f"{' '.join(words)} r{i}", 1) for i in range(30)] + [(f"plain text {i}", 0) for i in range(30)]
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), 30, 30)
    assert all(any(w[:n] in found for n in range(3, 13)) for w in words)
    wide = [f"{w}q{w}" for w in words]
    rows = [(f"{' '.join(wide)} r{i}", 1) for i in range(30)] + [(f"{' '.join(w[:4] for w in wide)} {i}", 0) for i in range(30)]
    assert len(toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), 30, 30)) >= 2_500
