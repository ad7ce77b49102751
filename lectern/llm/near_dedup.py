"""MinHash near-dedup: BagMinHash signatures of word-shingle multisets, banded; candidates' multiset overlap
is verified and links become classes.

The weight axis of every shingle is cut at 0, 1, 2, 4, 8, ...; each stretch has a Poisson process of the
stretch's width as rate, whose points carry a weight, a slot and a time. A document sees the points whose
weight its count reaches, and keeps the earliest of each slot: two documents agree in a slot with the
probability of their weighted Jaccard similarity. Points are generated only up to the time by which all
slots are filled, about m log m points a document whatever its length.

Documents with equal multisets are one text from then on, found by partial aggregation. Texts that agree in
a band share a bucket. Rounds come first: each verifies every member against pivots of its buckets, others
each round, links join classes, and only members of different classes go on. Then what is still apart is
verified in full. Buckets of at most `small` members list the pairs between their classes. Larger ones are
dealt into blocks of bounded size, a class too large for a block into blocks of its own; two blocks meet in
one group, unless both are of one class, and give only the links found. A pair is looked at in the first
bucket that both texts share. So every candidate pair is verified or already within one class.

Defined results: texts of fewer than `words` words (but not none) are one shingle; texts without words, null
ones included, are classes of their own; equal texts are one class whatever their ids; the class id is the
smallest doc_id in the class (null where all are null); extra columns are ignored or pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as C

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
ROUNDS = 2
SMALL = 16
BLOCK = 1 << 20
MEMBER = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OCC = np.uint64(0xC2B2AE3D27D4EB4F)
SHINGLE_BYTES = 5


def shingles(flat: C.Flat, words: int):
    """(text row, hash) of every shingle, in text order; a short text is one shingle."""
    starts, ends, before = flat.words()
    hashes = flat.word_hashes(starts, ends)
    roller = C.Roller(hashes)
    count = np.diff(before)
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(flat.n), n)
    first = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + before[row]
    return row, C.mix(roller.spans(first, first + np.minimum(count[row], words)))


def multiset(row: np.ndarray, value: np.ndarray):
    """Sorted (row, value, count) of a multiset for each row."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    firsts, ends = C.runs(row, value)
    return row[firsts], value[firsts], ends - firsts


def bag_minhash(row: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, slots: int) -> np.ndarray:
    """An n x slots array of earliest times; rows without weight stay infinite."""
    weight = np.bincount(row, count, n)
    best = np.full(n * slots, np.inf)
    level = np.frexp(count.astype(float))[1] - (count & (count - 1) == 0)
    reps = level + 1
    element = np.repeat(np.arange(len(row)), reps)
    depth = np.arange(len(element)) - np.repeat(np.cumsum(reps) - reps, reps)
    width = np.where(depth > 0, 2.0 ** (depth - 1), 1.0)
    base = np.where(depth > 0, 2.0 ** (depth - 1), 0.0)
    seed = C.mix(value[element] + depth.astype(np.uint64) * _OCC)
    owner, most = row[element], count[element].astype(float)
    limit = slots * (np.log(slots) + 6) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        live = np.flatnonzero(todo[owner])
        time, j = np.zeros(len(live)), 0
        while len(live):
            j += 1
            draw = C.mix(seed[live] + C.times(_ODD, j))
            time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width[live]
            on = time < limit[owner[live]]
            live, time, draw = live[on], time[on], draw[on]
            again = C.mix(draw ^ _OCC)
            slot = (again >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
            seen = base[live] + width[live] * (again & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 < most[live]
            np.minimum.at(best, owner[live][seen] * slots + slot[seen].astype(np.int64), time[seen])
        todo &= np.isinf(best.reshape(n, slots)).any(axis=1)
        limit[todo] *= 2
    return best.reshape(n, slots)


def band_keys(times: np.ndarray, bands: int) -> np.ndarray:
    bits = times.view(np.uint64).reshape(len(times), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _OCC, bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        key = C.mix(key * _ODD + bits[:, :, i])
    return key


def signatures(docs: DataFrame, words: int, bands: int, rows: int, **columns: str) -> DataFrame:
    """k, f, set (a 128-bit print of the multiset; null without words) and the band keys."""

    def run(batches):
        for batch in C.slices(batches):
            flat = C.Flat(batch.column("text"))
            row, value, count = multiset(*shingles(flat, words))
            keys = band_keys(bag_minhash(row, value, count, flat.n, bands * rows), bands)
            prints = np.zeros((flat.n, 2), np.uint64)
            for i, salt in enumerate((_ODD, _OCC)):
                np.add.at(prints[:, i], row, C.mix((value ^ salt) + count.astype(np.uint64) * _ODD))
            some = np.bincount(row, minlength=flat.n) > 0
            sets = pa.array([p.tobytes() if s else None for p, s in zip(prints, some, strict=True)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(flat.n + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("f"), sets, lists], ["k", "f", "set", "keys"])

    return C.keyed(docs, **columns).mapInArrow(run, "k long, f long, set binary, keys array<long>")


def shared_buckets(signed: DataFrame) -> DataFrame:
    """(bucket, set) of the buckets that hold several texts."""
    texts = signed.where("set IS NOT NULL").groupBy("set").agg(F.first("keys").alias("keys"))
    rows = texts.select("set", F.explode("keys").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("set").alias("a"), F.max("set").alias("b")).where("a <> b").select("bucket")
    return rows.join(shared, "bucket")


def shingle_sets(docs: DataFrame, signed: DataFrame, buckets: DataFrame, words: int, **columns: str) -> DataFrame:
    """(set, keys, size, blob) of the texts in shared buckets: the multiset's hashes, a count's repetitions told apart."""
    some = signed.where("set IS NOT NULL").groupBy("set").agg(F.min(F.struct("k", "f", "keys")).alias("at"))
    wanted = some.join(buckets.select("set").distinct(), "set", "left_semi").select("set", "at.k", "at.f", "at.keys")
    left = C.zipped(docs, keep=[], **columns)
    both = left.join(wanted, (left["_k"] == wanted["k"]) & (left["_f"] == wanted["f"])).select("set", "keys", "_text")

    def run(batches):
        import zstandard

        open_one = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in C.slices([batch], "_text", C.SLICE_BYTES // 4):
                flat = C.Flat(pa.array([open_one(x) for x in part.column("_text").to_pylist()], pa.binary()))
                row, value, count = multiset(*shingles(flat, words))
                occurrence = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                value = C.mix(np.repeat(value, count) + occurrence.astype(np.uint64) * _OCC) & np.uint64((1 << 8 * SHINGLE_BYTES) - 1)
                row = np.repeat(row, count)
                value = value[np.lexsort((value, row))]
                at = np.searchsorted(row, np.arange(flat.n + 1))
                blobs = [C.planes(value[a:b], SHINGLE_BYTES) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("set"), part.column("keys"), pa.array(np.diff(at)), pa.array(blobs, pa.binary())], ["set", "keys", "size", "blob"])

    return both.mapInArrow(run, "set binary, keys array<long>, size long, blob binary").dropDuplicates(["set"])


def alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets' Jaccard similarity reaches the bound."""
    if min(len(p), len(q)) < similarity * max(len(p), len(q)):
        return False
    common = len(np.intersect1d(p, q, assume_unique=True))
    return common >= similarity * (len(p) + len(q) - common)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets' weighted Jaccard similarity reaches the bound."""
    one = sets.select(F.col("set").alias("a"), F.col("blob").alias("blob_a"))
    two = sets.select(F.col("set").alias("b"), F.col("blob").alias("blob_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "blob_a", "blob_b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("blob_a"), batch.column("blob_b"), strict=True):
                keep.append(alike(*(C.unplanes(v.as_py(), np.uint64, SHINGLE_BYTES) for v in (x, y)), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def contract(roots: DataFrame, links: DataFrame, steps: C.Steps) -> DataFrame:
    """roots after joining the classes that links (a, b) between roots connect.

    Each step moves every class to the least neighbour and renames the links' ends likewise; classes joined
    stay joined, and the links left between different classes become none within a few steps.
    """
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = steps.store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        one, two = (least.select(F.col("a").alias(x), F.col("to").alias(f"to_{x}")) for x in ("a", "b"))
        links = steps.store(links.join(one, "a").join(two, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct())
        moved = least.withColumnRenamed("a", "root")
        roots = steps.store(roots.join(moved, "root", "left").select("set", F.coalesce("to", "root").alias("root")))
    return roots


PIVOTS, TESTS = 2, 8


def open_pairs(buckets: DataFrame, roots: DataFrame, turn: int):
    """(members of buckets with several classes, pairs of each with its bucket's pivots of other classes)."""
    members = buckets.join(roots, "set")
    pick = F.array_distinct(F.array(*[F.min_by("set", F.xxhash64("set", F.lit(turn * PIVOTS + i))) for i in range(PIVOTS if turn else 1)])).alias("pivots")
    mixed = members.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("n"), pick).where("r <> s").select("bucket", "pivots", "n")
    rest = members.join(mixed, "bucket")
    named = roots.select(F.col("set").alias("pivot"), F.col("root").alias("pivot_root"))
    tests = rest.select("set", "root", F.explode("pivots").alias("pivot")).join(named, "pivot").where("root <> pivot_root")
    count = TESTS if turn else 1
    drawn = F.array_distinct(F.array(*[F.min_by("pivot", F.xxhash64("pivot", F.lit(-1 - turn * TESTS - i))) for i in range(count)]))
    pairs = tests.groupBy("set").agg(drawn.alias("pivots")).select("set", F.explode("pivots").alias("pivot"))
    return rest, pairs.select(F.greatest("set", "pivot").alias("a"), F.least("set", "pivot").alias("b"))


def blocks(members: DataFrame, limit: int) -> DataFrame:
    """members (bucket, set, root, size) with block_a and block_b, the two blocks that meet, and their own, block.

    A block holds texts of about `limit` shingles at most, every text counting `MEMBER` more. Classes heavier
    than that have blocks of their own, the others are dealt by class, so that no block meets its own class alone.
    """
    weight = F.sum(F.col("size") + MEMBER).alias("weight")
    heavy = members.groupBy("bucket", "root").agg(weight).withColumn("own", F.when(F.col("weight") > limit, F.hex("root")).otherwise(""))
    parts = heavy.groupBy("bucket", "own").agg(F.ceil(F.sum("weight") / limit).alias("parts"))
    placed = members.join(heavy.select("bucket", "root", "own"), ["bucket", "root"]).join(parts, ["bucket", "own"])
    dealt = F.pmod(F.xxhash64(F.when(F.col("own") == "", F.col("root")).otherwise(F.col("set"))), F.col("parts"))
    placed = placed.select("bucket", "set", "root", F.concat_ws(":", "own", dealt).alias("block"))
    one = parts.select("bucket", F.col("own").alias("own_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("bucket", "own_a", F.concat_ws(":", "own_a", "part").alias("block_a"))
    two = one.select("bucket", F.col("own_a").alias("own_b"), F.col("block_a").alias("block_b"))
    meet = one.join(two, "bucket").where("block_a <= block_b AND (own_a = '' OR own_a <> own_b)")
    sides = meet.select("bucket", "block_a", "block_b", F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    return placed.join(sides, ["bucket", "block"])


def block_links(members: DataFrame, sets: DataFrame, similarity: float, limit: int) -> DataFrame:
    """The links (a, b) between different classes of members (bucket, set, root) whose first shared bucket it is."""

    def run(key, table):
        if table.column("block_a")[0] != table.column("block_b")[0] and len(set(table.column("block").to_pylist())) < 2:
            return table.select(["set"]).slice(0, 0).append_column("b", pa.array([], pa.binary())).rename_columns(["a", "b"])
        names, bucket = table.column("set").to_pylist(), key[0].as_py()
        root = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
        side = np.unique(np.array(table.column("block").to_pylist(), object), return_inverse=True)[1]
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        tokens = [C.unplanes(v, np.uint64, SHINGLE_BYTES) for v in table.column("blob").to_pylist()]
        size, across = np.array([len(t) for t in tokens]), len(set(side)) > 1
        found = []
        for i in range(len(names) - 1):
            j = np.arange(i + 1, len(names))
            j = j[(root[j] != root[i]) & (np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]))]
            if across:
                j = j[side[j] != side[i]]
            first = (keys[j] == keys[i]).argmax(axis=1)
            found += [(names[i], names[x]) for x in j[keys[i][first] == bucket] if alike(tokens[i], tokens[x], similarity)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    sized = members.join(sets.select("set", "size"), "set")
    rows = blocks(sized, limit).join(sets.select("set", "keys", "blob"), "set")
    return rows.groupBy("bucket", "block_a", "block_b").applyInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS, small: int = SMALL, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"):
    """(signed, roots): the settled signatures of all rows, and (set, root) of every text that has a link."""
    columns = {"id_col": id_col, "text_col": text_col}
    docs, steps = C.prepared(docs), C.Steps(docs.sparkSession)
    signed = steps.store(signatures(docs, words, bands, rows, **columns))
    buckets = steps.store(shared_buckets(signed))
    sets = steps.store(shingle_sets(docs, signed, buckets, words, **columns))
    roots = buckets.select("set", F.col("set").alias("root")).distinct()
    for turn in range(rounds + 1):
        rest, pairs = open_pairs(buckets, roots, turn)
        if turn == rounds:
            one = rest.where(F.col("n") <= small).select("bucket", F.col("set").alias("a"), "root")
            two = one.select("bucket", F.col("a").alias("b"), F.col("root").alias("root_b"))
            pairs = one.join(two, "bucket").where("root <> root_b AND a > b").select("a", "b")
        links = verified(pairs.distinct(), sets, similarity)
        if turn == rounds:
            links = links.unionByName(block_links(rest.where(F.col("n") > small).select("bucket", "set", "root"), sets, similarity, block))
        of_a, of_b = (roots.select(F.col("set").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b"))
        links = steps.store(links.join(of_a, "a").join(of_b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
        roots = steps.store(contract(roots, links, steps)) if turn == rounds else contract(roots, links, steps)
    steps.done(signed, roots)
    return signed, roots


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(k, f, doc_id, class_id) for every row of docs."""
    signed, roots = classes(docs, **options)
    placed = signed.select("k", "f", "set").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    ids = placed.where("root IS NOT NULL").groupBy("root").agg(F.min(F.nullif("k", F.lit(C.NULL_KEY))).alias("class_id"))
    own = F.nullif(F.col("k"), F.lit(C.NULL_KEY))
    return placed.join(ids, "root", "left").select("k", "f", own.alias("doc_id"), F.when(F.col("root").isNull(), own).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: that of the smallest id, then of the smallest text print."""
    columns = {"id_col": id_col, "text_col": text_col}
    signed, roots = classes(docs, **columns, **options)
    placed = signed.select("k", "f", "set").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    kept = placed.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("k", "f")).alias("at")).select("at.k", "at.f")
    alone = placed.where("root IS NULL").select("k", "f").distinct()
    marks = kept.unionByName(alone).withColumn("marks", F.lit(None).cast("binary"))
    done = C.rewrite(docs, marks, lambda texts, _: (texts,), "", how="inner", **columns)
    repeated = not signed.where("set IS NOT NULL").groupBy("k", "f").count().where("count > 1").isEmpty()
    return done.dropDuplicates([id_col, text_col]) if repeated else done


def op9_bag_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents")).select("doc_id", "class_id")
