"""Classes against those of all pairs of the documents of sf0.01, by a count of shared shingles for every pair."""

import os
import re
from collections import Counter, defaultdict

import duckdb

from lectern.llm import near_dedup

SF = os.environ.get("TEST_RECALL_DIR", "/root/testdata/sf0.01")


def similar_pairs(texts, least):
    """Pairs (i, j) whose multisets of five-word shingles have a weighted Jaccard similarity of at least that."""
    bags = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bags.append(Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter())
    where = defaultdict(list)
    for i, bag in enumerate(bags):
        for s, n in bag.items():
            where[s].append((i, n))
    shared = Counter()
    for rows in where.values():
        for x, (i, n) in enumerate(rows):
            for j, m in rows[x + 1 :]:
                shared[i, j] += min(n, m)
    size = [sum(b.values()) for b in bags]
    return [(i, j) for (i, j), n in shared.items() if n >= least * (size[i] + size[j] - n)]


def test_all_pairs(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    pairs = [(rows[i][0], rows[j][0]) for i, j in similar_pairs([t for _, t in rows], near_dedup.SIMILARITY)]
    found = {r.doc_id: r.class_id for r in near_dedup.op9_bag_minhash(spark, SF).collect()}
    assert len(found) == len(rows) and len(pairs) > 50
    recall = sum(found[i] == found[j] for i, j in pairs) / len(pairs)
    assert recall >= 0.99
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    if recall == 1:
        assert found == {i: find(i) for i, _ in rows}
    print(len(pairs), recall)
