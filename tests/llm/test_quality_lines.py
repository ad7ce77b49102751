"""op2's base columns against brute force, over texts whose neighbours in a slice begin and end with line feeds."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from lectern.llm import common, quality

PIECES = ["a", "b", "a b", "\n", "\n", "\n\n", " ", "\t\n", "#", "é", "x y z w v u t s", "x y z w v u t s "]


def brute(text, span=quality.REPEAT_WORDS):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + span]) for i in range(len(words) - span + 1)]
    seen = Counter(windows)
    repeated = {x for i, w in enumerate(windows) if seen[w] > 1 for x in range(i, i + span)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>") if text else 0, len(lines) - len(set(lines)), len(repeated)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def drawn(n):
    draw = random.Random(5)
    return [None if draw.random() < 0.05 else "".join(draw.choices(PIECES, k=draw.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("texts", [["a\na", "\nb"], ["a\na\n", "", None, "\n\nb\nb", "\n"], ["\n", "\n", "a\na"], [""], drawn(3000)])
def test_base_columns_of_a_slice(texts):
    got = quality.statistics(common.Flat(pa.array(texts, pa.string())))
    assert list(zip(*(got[s].tolist() for s in BASE), strict=True)) == [brute(t) for t in texts]


def test_base_columns_over_slices(spark):
    texts = drawn(800)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: brute(t) for i, t in enumerate(texts)}
    for parts in (1, 7):
        got = quality.rule_statistics(rows.repartition(parts)).collect()
        assert {r.doc_id: tuple(r[s] for s in BASE) for r in got} == want
    cut = [quality.statistics(common.Flat(b.column("text"))) for b in common.slices([pa.record_batch({"text": pa.array(texts, pa.string())})], limit=64)]
    assert len(cut) > 9
    assert [x for got in cut for x in zip(*(got[s].tolist() for s in BASE), strict=True)] == [brute(t) for t in texts]
