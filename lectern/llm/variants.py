"""Spelling variant grouping by permuterm rotations.

A word ends in a terminator, and its rotations are sorted. A rotation without its last character, y$x for x c y, is the
prefix that all words share which have another character in place of c, and it is the whole rotation of the word x y,
which lacks c. So every word gives the rotations without their last character, and its whole rotations; Spark deals both
out by the shared prefix and sorts them, and one scan over the sorted rows finds the groups. A group holds a word for
each character at most, and gives a row for each member with the number of its neighbours and the most frequent of
them; pairs are never formed. Where c repeats the character before it, x y also comes from dropping that one, so that
only the first of equal characters counts for a missing one.

A word's form is its most frequent neighbour (ties: the smallest word) if that is at least twice as frequent; counts
grow along forms, so that pointer jumping finds the root in about as many rounds as a chain has binary digits.

Defined results: null, empty and short texts give no words; a null doc_id is written as nothing before the colon;
repeated rows count repeatedly; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as C

SHORTEST, LEAST, RATIO, SLIP = 5, 3, 2, 97
PORTION = 1 << 20
HELD = 1 << 18
"""Different words that a task counts before it passes them on."""

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
END = b"$"
WHOLE = -1


def portions(text: str) -> Iterator[str]:
    """The text in portions that end between runs."""
    at = 0
    while at < len(text):
        edge = _BREAK.search(text, at + PORTION)
        to = edge.start() if edge else len(text)
        yield text[at:to]
        at = to


def slipped(word: str, start: int) -> str:
    """The word, or what is left of it where its hash with the document's id says that a code point is missing."""
    h = zlib.crc32(word.encode(), start)
    if h % SLIP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of SHORTEST code points that occur LEAST times."""
    texts = docs.select(C.whole_ids(docs, id_col)[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"))

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in C.slices(batches):
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for part in portions(text or ""):
                    for word, n in Counter(_RUN.findall(part.encode().lower().decode())).items():
                        if len(word := slipped(word, start)) >= SHORTEST:
                            counts[word] += n
                    if len(counts) >= HELD:
                        yield rows(counts)
                        counts = Counter()
        yield rows(counts)

    found = texts.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, c, n): of each word, all rotations without their last character c, and all whole ones with c WHOLE."""

    def flat(parts: list[np.ndarray], c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        matrix = np.ascontiguousarray(np.concatenate(parts, axis=1))
        offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
        prefix = pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])
        return pa.RecordBatch.from_arrays([prefix, pa.array(c.astype(np.int16)), pa.array(n)], ["prefix", "c", "n"])

    def run(batches):
        for batch in batches:
            letters = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            size, count = np.array([len(w) for w in letters], np.int64), batch.column("n").to_numpy()
            for length in np.unique(size):
                of = np.flatnonzero(size == length)
                n, table = count[of], np.frombuffer(b"".join(letters[i] for i in of), np.uint8).reshape(-1, length)
                end = np.full((len(of), 1), END[0], np.uint8)
                for i in range(length + 1):
                    yield flat([table[:, i:], end, table[:, :i]], np.full(len(of), WHOLE), n)
                    if i < length:
                        yield flat([table[:, i + 1 :], end, table[:, :i]], table[:, i], n)

    return words.mapInArrow(run, "prefix binary, c short, n long")


def spelled(prefix: bytes, c: int) -> str:
    """The word x c y of the prefix y$x; without a character, x y."""
    y, x = prefix.split(END)
    return (x + (bytes([c]) if c >= 0 else b"") + y).decode("latin-1")


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rotations to (word, near, lack, best): how many neighbours a group has for a word, and the most frequent of
    them with its count's negative; ties go to the smallest."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        prefix = batch.column("prefix")
        last = int(np.flatnonzero(np.append(True, _changes(prefix)))[-1])
        held = batch.slice(last)
        yield from _groups(batch.slice(0, last))
    if held is not None:
        yield from _groups(held)


def _changes(prefix: pa.Array) -> np.ndarray:
    return pc.not_equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy(zero_copy_only=False)


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows < 2:
        return
    group = np.append(0, np.cumsum(_changes(batch.column("prefix"))))
    size = np.bincount(group)
    some = np.flatnonzero(size[group] > 1)
    if not len(some):
        return
    prefix = batch.column("prefix").take(pa.array(some)).to_pylist()
    group, c, n = group[some], batch.column("c").to_numpy()[some].astype(int), batch.column("n").to_numpy()[some]
    order = np.lexsort((c, -n, c != WHOLE, group))
    out: dict[str, list] = {"word": [], "near": [], "lack": [], "best": []}

    def add(prefix: bytes, c: int, near: int, best: int) -> None:
        for name, value in zip(out, (spelled(prefix, c), near, -int(n[best]), spelled(prefix, int(c_[best]))), strict=True):
            out[name].append(value)

    c_ = c
    for a, b in zip(*C.runs(group[order]), strict=True):
        rows = order[a:b]
        key = prefix[rows[0]]
        whole = rows[0] if c[rows[0]] == WHOLE else None
        skips = rows if whole is None else rows[1:]
        if len(skips) > 1:
            for i in skips:
                add(key, int(c[i]), len(skips) - 1, skips[1] if i == skips[0] else skips[0])
        if whole is not None:
            longer = [i for i in skips if key[-1] != c[i]]
            if longer:
                add(key, WHOLE, len(longer), longer[0])
            for i in longer:
                add(key, int(c[i]), 1, whole)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, lack, best) of the words that have neighbours."""
    dealt = rotations(words).repartition("prefix").sortWithinPartitions("prefix")
    found = dealt.mapInArrow(scan, "word string, near long, lack long, best string")
    best = F.min(F.struct("lack", "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("at")).select("word", "n_near", "at.lack", "at.best")


def roots(forms: DataFrame, steps: C.Steps) -> DataFrame:
    """(word, root) of (word, form): from each word along the forms to the last."""
    reached = steps.store(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = steps.store(reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        reached = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return reached


def group_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words."""
    docs = C.prepared(docs)
    steps = C.Steps(docs.sparkSession)
    words = steps.store(word_counts(docs, id_col=id_col, text_col=text_col))
    near = near_words(words)
    is_form = -F.col("lack") >= RATIO * F.col("n")
    found = steps.store(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, -F.col("lack")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL"), steps)
    whole = steps.store(found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    steps.done(whole)
    return whole


def op13_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(C.table(spark, sf_dir, "documents"))
