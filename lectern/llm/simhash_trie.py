"""SimHash near-dedup: fingerprints of three-word shingles, linked by a self-join of a binary trie.

Two nodes of a trie are traversed together: the bits in which their prefixes differ accumulate, and a pair of nodes is
left as soon as they exceed the error budget. Two fingerprints that differ in 3 bits at most agree in one half of their
bits but for one, so that two tries are walked, one over the bits in order and one with the halves exchanged, each with
a budget of one error in its first half and three in all.

In Spark, the upper levels are tables of node pairs: where the fingerprints below a pair exceed `limit`, its children
are paired anew, four bits at a time; every other pair is a group, in which a task walks the rest of both subtrees, a
bounded part of the frontier at a time. A group gives a forest of its links, not all pairs; classes are then joined by
contraction. Only different fingerprints enter the join.

Defined results: a text that is null, empty or without words has the fingerprint zero, which links like any other; one
or two words are one shingle; repeated rows share a component; a null doc_id counts as larger than all others, and a
component of null ids alone has a null component_id; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as C
from lectern.llm.near_dedup import contract

SHINGLE = 3
BUDGET = 3
HALF_BUDGET = 1
SEED = 42
LIMIT = 1 << 14
STRIDE = 4
PORTION = 1 << 18
FRONTIER = 1 << 18
LINKS = 1 << 20
_SPACES = b" \t\n\v\f\r"


def hashes(text: bytes, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text's words, A-Z lower-cased, for a portion of the text at a time."""
    from xxhash import xxh64_intdigest

    held: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        to = at + PORTION
        while to < len(text) and text[to] not in _SPACES:
            to += 1
        words = held + text[at:to].lower().split()
        at = to
        if len(words) >= width:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(size) - 1
            starts, stops = (ends - size + 1)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
            yield np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
            some, words = True, words[1 - width :]
        held = words
    if held and not some:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for found in hashes(text):
        for part in np.array_split(found, len(found) // 65536 + 1):
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(found)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", to: str = "print") -> DataFrame:
    """docs without the text, with its fingerprint as a long."""
    rest = [c for c in docs.columns if c != text_col]
    named = docs.select(*[docs[c].alias(f"c_{i}") for i, c in enumerate(rest)], docs[text_col].cast("string").alias("_text"))

    def run(batches):
        for batch in C.slices(batches, "_text"):
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], names=[*batch.schema.names[:-1], "_print"])

    done = named.mapInArrow(run, ", ".join([*(f"`c_{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)), "_print long"]))
    return done.select(*[done[f"c_{i}"].alias(c) for i, c in enumerate(rest)], done["_print"].alias(to))


def budget(depth: int) -> int:
    """Bits that two prefixes of that length may differ in."""
    return HALF_BUDGET if depth <= 32 else BUDGET


def tries(prints: DataFrame) -> DataFrame:
    """(trie, key) of every fingerprint in both tries."""
    turned = F.shiftleft("print", 32).bitwiseOR(F.shiftrightunsigned("print", 32))
    return prints.select(F.explode(F.array(F.struct(F.lit(0).alias("trie"), F.col("print").alias("key")), F.struct(F.lit(1).alias("trie"), turned.alias("key")))).alias("at")).select("at.*")


def _prefix(depth: int):
    return F.shiftrightunsigned("key", 64 - depth)


def node_pairs(keys: DataFrame, total: int, limit: int, steps: C.Steps) -> list[tuple[int, DataFrame]]:
    """(depth, pairs (trie, p, q)) of nodes whose prefixes are within budget, with `limit` fingerprints at most below
    them, such that every two fingerprints within budget are below one pair."""
    depth = STRIDE
    while depth < 32 and total >> depth > limit // 4:
        depth += STRIDE
    nodes = steps.store(keys.groupBy("trie", _prefix(depth).alias("p")).agg(F.count("*").alias("n")))
    flips = F.explode(F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(depth)]))
    open_ = nodes.select("trie", "p", "n", flips.alias("mask")).withColumn("errors", F.bit_count("mask"))
    open_ = open_.select("trie", "p", "n", "errors", F.col("p").bitwiseXOR(F.col("mask")).alias("q")).where("p <= q")
    found = []
    while True:
        of_q = nodes.select("trie", F.col("p").alias("q"), F.col("n").alias("m"))
        sized = steps.store(open_.join(of_q, ["trie", "q"]).select("trie", "p", "q", "errors", (F.col("n") + F.col("m")).alias("size")))
        found.append((depth, sized.where(F.col("size") <= limit)))
        heavy = sized.where(F.col("size") > limit)
        if heavy.isEmpty():
            return found
        below = depth + STRIDE
        inside = heavy.select("trie", F.explode(F.array("p", "q")).alias("parent")).distinct()
        own = keys.select("trie", _prefix(depth).alias("parent"), _prefix(below).alias("p")).join(inside, ["trie", "parent"], "left_semi")
        nodes = steps.store(own.groupBy("trie", "parent", "p").agg(F.count("*").alias("n")))
        masks = F.explode(F.array(*[F.lit(i).cast("long") for i in range(1 << STRIDE)]))
        wide = heavy.select("trie", F.col("p").alias("parent"), "q", "errors").join(nodes, ["trie", "parent"]).select("trie", "parent", "q", "p", "n", "errors", masks.alias("mask"))
        wide = wide.withColumn("errors", F.col("errors") + F.bit_count("mask")).where(F.col("errors") <= budget(below))
        other = F.shiftleft("q", STRIDE).bitwiseOR(F.col("p").bitwiseXOR(F.col("mask")).bitwiseAND(F.lit((1 << STRIDE) - 1)))
        open_ = wide.select("trie", "p", "n", "errors", "parent", F.col("q").alias("parent_q"), other.alias("q")).where("parent <> parent_q OR p <= q").drop("parent", "parent_q")
        nodes, depth = nodes.drop("parent"), below


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects what the links (i, j) connect: every node with the least of its class."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j, least = at[: len(i)], at[len(i) :], np.arange(len(nodes))
    while len(i):
        low, high = np.minimum(least[i], least[j]), np.maximum(least[i], least[j])
        np.minimum.at(least, high, low)
        while (least != (up := least[least])).any():
            least = up
        still = least[i] != least[j]
        i, j = i[still], j[still]
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[moved], nodes[least[moved]]


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between the sorted keys of two nodes (b None: within one), as keys.

    The frontier holds pairs of nodes as ranges of a and b; at each bit a pair gives up to four pairs of children.
    """
    alone = b is None
    b = a if alone else b
    top = np.uint64(0xFFFFFFFF00000000)
    todo = [(np.array([[0, len(a), 0, len(b), errors]], np.int64), depth)]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    while todo:
        pairs, bit = todo.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            todo += [(pairs[:half], bit), (pairs[half:], bit)]
            continue
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        x, y = a[pairs[single, 0]], b[pairs[single, 2]]
        differ = x ^ y
        near = (np.bitwise_count(differ & top) <= HALF_BUDGET) & (np.bitwise_count(differ) <= BUDGET) & (differ > 0)
        if near.any():
            held.append((x[near], y[near]))
            count += int(near.sum())
            if count > LINKS:
                held = [forest(*(np.concatenate(v) for v in zip(*held, strict=True)))]
                count = len(held[0][0])
        pairs = pairs[~single]
        if not len(pairs):
            continue
        shift, one = np.uint64(64 - bit), np.uint64(1) << np.uint64(63 - bit)
        middle = []
        for keys, low, high in ((a, 0, 1), (b, 2, 3)):
            prefix = keys[pairs[:, low]] >> shift << shift if bit else np.zeros(len(pairs), np.uint64)
            middle.append(np.clip(np.searchsorted(keys, prefix | one), pairs[:, low], pairs[:, high]))
        same = (pairs[:, 0] == pairs[:, 2]) & alone
        children = []
        for left, right in ((0, 0), (1, 1), (0, 1), (1, 0)):
            child = pairs.copy()
            child[:, 1 - left], child[:, 3 - right] = middle
            child[:, 4] += left != right
            keep = (child[:, 0] < child[:, 1]) & (child[:, 2] < child[:, 3]) & (child[:, 4] <= budget(bit + 1))
            if (left, right) == (1, 0):
                keep &= ~same
            if left == right:
                keep &= ~(same & (child[:, 1] - child[:, 0] == 1))
            children.append(child[keep])
        todo.append((np.concatenate(children), bit + 1))
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(*(np.concatenate(v) for v in zip(*held, strict=True)))


def links(keys: DataFrame, units: list[tuple[int, DataFrame]]) -> DataFrame:
    """(a, b): a forest of the links of every pair of nodes; a name is the fingerprint, scrambled by a bijection."""
    sides = None
    for depth, pairs in units:
        side = F.explode(F.array_distinct(F.array("p", "q"))).alias("side")
        met = pairs.select("trie", "p", "q", "errors", side).join(keys.withColumn("side", _prefix(depth)), ["trie", "side"]).select("trie", F.lit(depth).alias("depth"), "p", "q", "errors", "side", "key")
        sides = met if sides is None else sides.unionByName(met)

    def run(key, table):
        trie, depth, p, q, errors = (k.as_py() for k in key)
        keys = table.column("key").to_numpy().view(np.uint64)
        if p == q:
            found = walk(np.sort(keys), None, depth, errors)
        else:
            first = table.column("side").to_numpy() == p
            found = walk(np.sort(keys[first]), np.sort(keys[~first]), depth, errors)
        if trie:
            found = tuple(x << np.uint64(32) | x >> np.uint64(32) for x in found)
        return pa.table({n: pa.array(C.mix(x).view(np.int64)) for n, x in zip("ab", found, strict=True)})

    return sides.groupBy("trie", "depth", "p", "q", "errors").applyInArrow(run, "a long, b long")


def named(prints: DataFrame) -> DataFrame:
    """prints with their names in the links."""

    def run(batches):
        for batch in batches:
            name = C.mix(batch.column("print").to_numpy().view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name)], names=[*batch.schema.names, "set"])

    return prints.mapInArrow(run, "print long, id long, set long")


def components(docs: DataFrame, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the text, with fingerprint (16 hexadecimal digits) and component_id."""
    docs = C.prepared(C.whole_ids(docs, id_col), "fingerprint", "component_id")
    steps = C.Steps(docs.sparkSession)
    to, found_id = C.fresh(docs, "print"), C.fresh(docs, "id")
    rows = steps.store(fingerprints(docs, text_col=text_col, to=to))
    prints = steps.store(rows.groupBy(F.col(to).alias("print")).agg(F.min(F.col(id_col).cast("long")).alias("id")))
    keys = steps.store(tries(prints))
    found = steps.store(links(keys, node_pairs(keys, prints.count(), limit, steps)).distinct())
    ends = found.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    roots = contract(ends.withColumn("root", F.col("set")), found, steps)
    placed = steps.store(named(prints).join(roots, "set", "left").select("print", "id", F.coalesce("root", "set").alias("root")))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    known = steps.store(placed.join(least, "root").select(F.col("print").alias(to), F.col("component_id").alias(found_id)))
    steps.done(rows, known)
    rest = [c for c in docs.columns if c != text_col]
    digits = F.lower(F.lpad(F.hex(F.col(to)), 16, "0")).alias("fingerprint")
    return rows.join(known, to).select(*rest, digits, F.col(found_id).alias("component_id"))


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return components(docs).select("doc_id", "fingerprint", "component_id")
