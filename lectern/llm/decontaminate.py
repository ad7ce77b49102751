"""Benchmark decontamination: a generalised suffix automaton of the normalised test items; training tokens
stream through it, longest matching lengths are tracked, and spans over the length or coverage limits go.

The items are cut into blocks of about `block_words` words, which bounds what is sent to the workers; each
block's automaton is one map over the documents, without any shuffle, so that a worker holds one automaton however
many items there are. Where there are several blocks, each pass writes what it hit alone, once for each text, named by
128 bits of its hashes; the documents themselves are not written between passes, and one join brings their hits back.
A vectorised look at word pairs finds the stretches whose every pair occurs in some item, and only those stretches step through
the automaton, on the words themselves: between them the matching length is at most one word, so nothing is
lost, and a hash never decides.

Defined results: a null or wordless text has no hits; a null or wordless item, or one without an id, has no
windows; items with equal texts are all named; repeated documents are judged alike; extra columns pass
through; without items every document is clean.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import common as C

WINDOW = 10
BLOCK_WORDS = 400_000
COVERAGE = 0.8

NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_PAIR = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: bytes | None) -> list[bytes]:
    flat = C.Flat(pa.array([text], pa.binary()))
    starts, ends, _ = flat.words(NOT_WORD)
    return [text[a:b].lower() for a, b in zip(starts, ends, strict=True)]


class Automaton:
    """A generalised suffix automaton over words, with the items of each window at the states that hold it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.names = [name for name, _ in items]
        ends: list[list[int]] = []
        for _, words in items:
            at = 0
            ends.append([at := self._add(at, w) for w in words])
        self.owners: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for n, (_, words) in enumerate(items):
            if len(words) < window:
                at = 0
                for w in words:
                    at = self.step[at][w]
                if words:
                    self.short.setdefault(at, []).append((len(words), n))
            else:
                for at in ends[n][window - 1 :]:
                    self.owners.setdefault(self._holder(at), set()).add(n)
        lengths = [min(len(w), window) for _, w in items if w]
        self.least = min(lengths, default=window)

    def _add(self, last: int, word: bytes) -> int:
        step, link, size = self.step, self.link, self.size
        if word in step[last]:
            to = step[last][word]
            return to if size[to] == size[last] + 1 else self._split(last, word, to)
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            to = step[at][word]
            link[new] = to if size[to] == size[at] + 1 else self._split(at, word, to)
        return new

    def _split(self, at: int, word: bytes, to: int) -> int:
        twin = len(self.step)
        self.step.append(dict(self.step[to]))
        self.size.append(self.size[at] + 1)
        self.link.append(self.link[to])
        self.link[to] = twin
        while at >= 0 and self.step[at].get(word) == to:
            self.step[at][word] = twin
            at = self.link[at]
        return twin

    def _holder(self, at: int) -> int:
        """The suffix state that holds the last `window` words of a state's longest string."""
        while self.size[self.link[at]] >= self.window:
            at = self.link[at]
        return at

    def scan(self, words: list[bytes]):
        """(start, end, item) of every occurrence of a window in the words."""
        step, link, size, window = self.step, self.link, self.size, self.window
        at = length = 0
        for i, word in enumerate(words):
            while at and word not in step[at]:
                at = link[at]
                length = size[at]
            if word in step[at]:
                at, length = step[at][word], length + 1
            else:
                length = 0
            if length >= window:
                for n in self.owners.get(self._holder(at), ()):
                    yield i + 1 - window, i + 1, n
            if self.short:
                up = at
                while up > 0:
                    for size_n, n in self.short.get(up, ()):
                        if size_n <= length:
                            yield i + 1 - size_n, i + 1, n
                    up = link[up]

    def hashes(self) -> np.ndarray:
        """Sorted hashes of the words (least window 1) or word pairs that can begin or carry a match."""
        words = list({w for d in self.step for w in d})
        flat = C.Flat(pa.array(words, pa.binary()))
        of = dict(zip(words, flat.word_hashes(flat.offsets[:-1], flat.offsets[1:]), strict=True))
        if self.least == 1:
            return np.unique(np.array(list(of.values()), np.uint64))
        pairs = {(a, b) for d in self.step for a, s in d.items() for b in self.step[s]}
        first, second = (np.array([of[p[i]] for p in pairs], np.uint64) for i in (0, 1))
        return np.unique(pair_hash(first, second))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return C.mix(first * _PAIR + second)


class Known:
    """Membership among sorted hashes, by a bit table first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = np.zeros(1 << 22, bool)
        self.bits[hashes >> np.uint64(42)] = True

    def __call__(self, values: np.ndarray) -> np.ndarray:
        found = self.bits[values >> np.uint64(42)]
        at = np.flatnonzero(found)
        place = np.minimum(np.searchsorted(self.hashes, values[at]), max(0, len(self.hashes) - 1))
        found[at] = self.hashes[place] == values[at] if len(self.hashes) else False
        return found


def item_blocks(items: DataFrame, window: int, block_words: int, id_col: str, text_col: str):
    """Automata of blocks of items; the driver holds one block of bounded size at a time."""
    named = items.select(items[id_col].cast("string").alias("n"), items[text_col].cast("string").alias("t")).where("n IS NOT NULL AND t IS NOT NULL")
    total = named.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = int(total // (4 * block_words)) + 1
    for b in range(count):
        block = named if count == 1 else named.where(F.pmod(F.xxhash64("n"), F.lit(count)) == b)
        got = [(n, normal_words(t.encode())) for n, t in block.toLocalIterator()]
        if got:
            yield Automaton(got, window)


def hits(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with _hit (a bit for each word: inside an occurring window) and _items (names of those items)."""
    return _hits(docs, items, None, None, window, block_words, text_col, item_id_col, item_text_col)


def _hits(docs: DataFrame, items: DataFrame, finish, schema, window: int, block_words: int, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    """hits(), passed on to finish() in the pass over the last block of items if there is one to do it."""
    place, scan = docs.columns.index(text_col), None
    automata = item_blocks(items, window, block_words, item_id_col, item_text_col)
    first, second = next(automata, None), next(automata, None)
    if second is not None:
        found = _hits_of_many(docs, chain((first, second), automata), text_col)
    else:
        found = _unhit(docs)
        if first is not None:
            scan = scanner(docs.sparkSession.sparkContext.broadcast((first, first.hashes())), place)
    if finish is None:
        return found if scan is None else found.mapInArrow(scan, found.schema)
    last = scan or iter
    return found.mapInArrow(lambda batches: finish(last(batches)), schema)


SALTS = 16


def _unhit(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_hit": F.lit(None).cast("binary"), "_items": F.lit(None).cast("array<string>")})


def _hits_of_many(docs: DataFrame, automata, text_col: str) -> DataFrame:
    """docs with _hit and _items of several automata: a pass over the texts for each, which writes the hit ones.

    Equal texts are one row of what is joined back; rows are salted by their partition, as one text may be a third of
    all rows, and so may null.
    """
    text, context = docs[text_col], docs.sparkSession.sparkContext
    steps, names = C.Steps(docs.sparkSession), [C.fresh(docs, x) for x in ("_h1", "_h2", "_salt")]
    keys = dict(zip(names, (F.xxhash64(text), F.xxhash64(F.lit(1), text), F.pmod(F.spark_partition_id(), F.lit(SALTS))), strict=True))
    narrow = _unhit(docs.select(text.alias("_t"), *[keys[n].alias(n) for n in names[:2]]))
    passes = []
    for automaton in automata:
        shared = context.broadcast((automaton, automaton.hashes()))
        hit = narrow.mapInArrow(scanner(shared, 0), narrow.schema).where("_hit IS NOT NULL").drop("_t")
        passes.append(steps.store(hit.dropDuplicates(names[:2])))
        shared.destroy()
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    listed = every.groupBy(*names[:2]).agg(F.collect_list("_hit").alias("_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))

    def merge(batches):
        for batch in batches:
            bits = [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in blobs]).tobytes() for blobs in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bits, pa.binary()), batch.column(3)], batch.schema.names)

    marks = steps.store(listed.mapInArrow(merge, every.schema))
    steps.done(marks)
    salted = marks.withColumn(names[2], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumns(keys).join(salted, names, "left").select(*[F.col(c) for c in docs.columns], "_hit", "_items")


def scanner(shared, place: int):
    def run(batches):
        automaton, hashes = shared.value
        known, least = Known(hashes), automaton.least
        for batch in _sliced(batches, place):
            flat = C.Flat(batch.column(place))
            starts, ends, before = flat.words(NOT_WORD)
            values = flat.word_hashes(starts, ends, lower=True)
            row = np.repeat(np.arange(flat.n), np.diff(before))
            if least == 1:
                ok, reach = known(values), 1
            else:
                ok, reach = known(pair_hash(values[:-1], values[1:])) & (row[:-1] == row[1:]), 2
            edge = np.flatnonzero(np.diff(ok.astype(np.int8), prepend=0, append=0))
            firsts, lasts = edge[::2], edge[1::2] + reach - 1
            keep = lasts - firsts >= least
            hit, names = np.zeros(len(starts), bool), {}
            for a, b in zip(firsts[keep], lasts[keep], strict=True):
                for from_, to in _same_row(row, a, b):
                    words = [flat.data[s:e].tobytes().lower() for s, e in zip(starts[from_:to], ends[from_:to], strict=True)]
                    for x, y, n in automaton.scan(words):
                        hit[from_ + x : from_ + y] = True
                        names.setdefault(int(row[from_]), set()).add(automaton.names[n])
            bits, named = batch.column("_hit").to_pylist(), batch.column("_items").to_pylist()
            for r, got in names.items():
                own = hit[before[r] : before[r + 1]]
                bits[r] = np.packbits(own | _bits(bits[r], len(own))).tobytes()
                named[r] = sorted(got | set(named[r] or ()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(bits, pa.binary()), pa.array(named, pa.list_(pa.string()))], schema=batch.schema)

    return run


def _sliced(batches, place: int):
    for batch in batches:
        yield from C.slices([batch], batch.schema.names[place])


def _same_row(row: np.ndarray, a: int, b: int):
    """A stretch of words, cut where the document changes."""
    cuts = [a, *(a + 1 + np.flatnonzero(np.diff(row[a:b]))), b]
    return zip(cuts, cuts[1:], strict=False)


def _bits(blob: bytes | None, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool) if blob else np.zeros(n, bool)


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with hit spans cut from the text, and n_words, n_hit, items (sorted names), over_coverage.

    Every span in the result's loss is at least one window long. A text whose hit words are more than
    `coverage` of all words counts as a copy of test items: over_coverage is true, and a caller drops it.
    """
    docs = C.prepared(docs, "n_words", "n_hit", "items", "over_coverage")
    named = docs.select(*[docs[c].alias(f"c_{i}") for i, c in enumerate(docs.columns)])
    place, width = docs.columns.index(text_col), len(docs.columns)
    extra = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("over_coverage", T.BooleanType())]
    schema = T.StructType([*[T.StructField("c_text", T.StringType()) if i == place else T.StructField(f"c_{i}", f.dataType) for i, f in enumerate(docs.schema.fields)], *extra])

    def finish(batches):
        for batch in _sliced(batches, place):
            flat = C.Flat(batch.column(place))
            starts, _, before = flat.words(NOT_WORD)
            n_words = np.diff(before)
            n_hit = np.zeros(flat.n, np.int64)
            texts = batch.column(place)
            bits = batch.column(width).to_pylist()
            touched = [r for r in range(flat.n) if bits[r]]
            if touched:
                new = texts.to_pylist()
                for r in touched:
                    gone = _bits(bits[r], int(n_words[r]))
                    n_hit[r] = gone.sum()
                    raw = flat.data[flat.offsets[r] : flat.offsets[r + 1]].tobytes()
                    new[r] = C.cut(raw, starts[before[r] : before[r + 1]] - flat.offsets[r], gone).decode("utf-8", "replace")
                texts = pa.array(new, pa.string())
            columns = [texts.cast(pa.string()) if i == place else batch.column(i) for i in range(width)]
            names = ["c_text" if i == place else f"c_{i}" for i in range(width)]
            over = n_hit > coverage * n_words
            items_ = pa.array([x or [] for x in batch.column(width + 1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words.astype(np.int64)), pa.array(n_hit), items_, pa.array(over)], names=[*names, "n_words", "n_hit", "items", "over_coverage"])

    done = _hits(named, items, finish, schema, window, block_words, f"c_{place}", item_id_col, item_text_col)
    return done.select(*[done["c_text" if i == place else f"c_{i}"].alias(c) for i, c in enumerate(docs.columns)], *[done[f.name] for f in extra])


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), wins AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM wins
), found AS (
  SELECT d.doc_id, d.i, d.n, w.item FROM (
    SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (
      SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n)) d
  JOIN wins w ON w.n = d.n AND w.g = d.g
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
