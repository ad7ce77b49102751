"""op4 over several blocks of items, and op8 over token files of any size."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import decontaminate, token_counts


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def wanted(text, items, window):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        them = words(item)
        n = min(window, len(them))
        wins = {tuple(them[i : i + n]) for i in range(len(them) - n + 1)} if them else ()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add(str(name))
    return len(own), len(hit), sorted(names)


def test_many_blocks_against_brute_force(spark):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([2, 3, 9, 25])))) for i in range(30)] + [(30, None), (31, "")]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randrange(60))) for _ in range(40)] + [f"Say {t.upper()}. End" for _, t in items[:12]] + [f"{items[0][1]} x {items[5][1]}"] * 200 + [None] * 50 + [""] * 3
    docs = spark.createDataFrame([(i, t, "own", "own") for i, t in enumerate(texts)], "doc_id long, text string, _h1 string, _salt string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = {i: wanted(t, items, 4) for i, t in enumerate(texts)}
    for block_words in (60, 400_000):
        assert len(list(decontaminate.item_blocks(bench, 4, block_words, "item_id", "text"))) == 1 or block_words < 1000
        got = decontaminate.decontaminate(docs, bench, window=4, block_words=block_words).collect()
        assert len(got) == len(texts) and all(r._h1 == r._salt == "own" for r in got)
        assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == expected


def test_token_file_past_two_gigabytes(spark, tmp_path):
    """A sparse file of 2.2 GB with three separators, one past 2**31 bytes; an odd byte at its end; an empty file."""
    large, ends = tmp_path / "with space.bin", [10, 5_000_000, 1_090_000_000]
    size = 1_100_000_000
    with open(large, "wb") as out:
        for at in ends:
            out.seek(2 * at)
            out.write(np.array([token_counts.END], "<u2").tobytes())
        out.truncate(2 * size + 1)
    (tmp_path / "empty.bin").touch()
    blocks = token_counts.read_token_files(spark, str(tmp_path), block=1 << 21)
    got = token_counts.scan(blocks).orderBy("document").select(F.col("document"), F.col("n_tokens")).collect()
    assert [tuple(r) for r in got] == [(0, 10), (1, 5_000_000 - 11), (2, 1_090_000_000 - 5_000_001), (3, size - 1_090_000_001)]
