"""op12 against all pairs of fingerprints, and its defined results."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import common, simhash_trie


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    found = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def plain_classes(prints):
    """By fingerprint, the least fingerprint that is reachable."""
    prints = sorted(set(prints))
    up = {p: p for p in prints}

    def top(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                a, b = sorted((top(p), top(q)))
                up[b] = a
    return {p: top(p) for p in prints}


def near_prints(n, seed):
    """Random fingerprints, many of which are a few bits from others, at all places."""
    draw, out = random.Random(seed), []
    for _ in range(n):
        p = draw.choice(out) if out and draw.random() < 0.6 else draw.getrandbits(64)
        for b in draw.sample(range(64), draw.randrange(6)):
            p ^= 1 << b
        out.append(p)
    return [*out, 0, 1, 7, 15, (1 << 64) - 1, 1 << 63, 3 << 31, 3 << 62]


def classes_of(links):
    up = {}

    def top(p):
        while up.setdefault(p, p) != p:
            p = up[p]
        return p

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {p: top(p) for p in up}


@pytest.mark.parametrize("frontier", [16, 1 << 18])
def test_walk(monkeypatch, frontier):
    """Both tries, whole and split in two nodes, find the links of all pairs, with a small frontier too."""
    monkeypatch.setattr(simhash_trie, "FRONTIER", frontier)
    prints = near_prints(300, frontier)
    half = np.uint64(32)
    found = []
    for turn in (False, True):
        keys = np.unique(np.array(prints, np.uint64))
        keys = np.sort(keys << half | keys >> half) if turn else keys
        low, high = keys[keys < 1 << 63], keys[keys >= 1 << 63]
        for a, b in (simhash_trie.walk(low, None, 1, 0), simhash_trie.walk(high, None, 1, 0), simhash_trie.walk(low, high, 1, 1)):
            found += [(int(x << half | x >> half), int(y << half | y >> half)) if turn else (int(x), int(y)) for x, y in zip(a, b, strict=True)]
    want = plain_classes(prints)
    assert {p: c for p, c in classes_of(found).items()} == {p: c for p, c in want.items() if list(want.values()).count(c) > 1}


@pytest.mark.parametrize("limit", [2, 40, simhash_trie.LIMIT])
def test_node_pairs(spark, limit):
    """The links through Spark's tables of node pairs, however far down they are split."""
    prints = near_prints(200, limit)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints)]
    steps = common.Steps(spark)
    keys = steps.store(simhash_trie.tries(spark.createDataFrame(signed, "print long")))
    got = simhash_trie.links(keys, simhash_trie.node_pairs(keys, len(signed), limit, steps)).collect()
    steps.done()
    name = {int(common.mix(np.array([p], np.uint64)).view(np.int64)[0]): p for p in prints}
    want = plain_classes(prints)
    assert classes_of([(name[r.a], name[r.b]) for r in got]) == {p: c for p, c in want.items() if list(want.values()).count(c) > 1}


def test_documents(spark):
    """Prints and components of long, short, empty and repeated texts; clashing columns and null ids."""
    draw = random.Random(5)
    base = [draw.choice(["Alpha", "beta", "GAMMA", "delta", "été", "x"]) + str(draw.randrange(50)) for _ in range(4000)]
    texts = [" ".join(base), " ".join(base[:-1]), "\t".join(base).upper().replace("É", "é"), None, "", " \n ", "one", "one two", "one two three", "One\ntwo  three", " "]
    texts += [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(0, 4000, 400)]
    texts.append(" ".join(f"w{i}" for i in range(90_000)))
    ids = [None, *range(len(texts) - 2, -1, -1)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    docs = docs.select("*", *[F.lit("own").alias(c) for c in ("print", "set", "id", "root", "c_0", "_text", "fingerprint")])
    got = simhash_trie.components(docs)
    assert got.columns == ["doc_id", "print", "set", "id", "root", "c_0", "_text", "fingerprint", "component_id"]
    prints = [plain_print(t) for t in texts]
    top, least = plain_classes(prints), {}
    for i, p in zip(ids, prints, strict=True):
        if i is not None:
            least[top[p]] = min(least.get(top[p], i), i)
    want = sorted((-1 if i is None else i, f"{p:016x}", least[top[p]]) for i, p in zip(ids, prints, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want
    assert simhash_trie.components(docs.limit(0)).count() == 0
    alone = simhash_trie.components(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).collect()
    assert [r.component_id for r in alone] == [None]
    with pytest.raises(TypeError, match="integers"):
        simhash_trie.components(docs.withColumn("doc_id", F.lit("x")))


def test_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same three words").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    got = simhash_trie.components(docs).where("doc_id % 3 > 0")
    assert got.select("component_id").distinct().collect() == [(1,)] and got.count() == 2000
