"""Quality rules: an isolation forest on rule statistics; path lengths over random splits find anomalous
documents, with a threshold calibrated from labelled rows.

One pass computes the statistics with vectorised byte counts; they are a hundred bytes a document and are
settled, so that the text is read once. The trees grow level by level over all labelled rows that pass the base
rules: a job counts the rows of every node and finds the ranges of their features, and the driver draws the splits,
so that it holds TREES times 2 ** DEPTH nodes whatever the corpus. Nodes at DEPTH stay leaves; their rows count with the
expected rest of their paths. The threshold is the one with the best mean of the two classes' accuracies over the same
rows, found among all their scores by running sums within bins of scores. Neither depends on how rows are partitioned.

Defined results: null, empty and wordless texts have zero statistics and fail the base rules; a row without
label is judged like any other; without good and bad labelled rows that pass the base rules only these decide, as where no
threshold is better than none; several labels of an id count as good if one does; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import common as C

TREES, DEPTH, SEED = 200, 8, 7
BINS = 65_536
REPEAT_WORDS = 8
LEAST_WORDS, MOST_REPEATED = 20, 30

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_calls", "n_bars")
FEATURES = ("chars_per_word", "symbols_per_word", "repeat_words", "upper", "calls_per_word", "bars_per_word")


def _table(characters: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(characters)] = True
    return mask


_SYMBOLS, _UPPER = _table(b"#*$%&|<>"), _table(bytes(range(65, 91)))
_LETTERS = _UPPER | _table(bytes(range(97, 123)))
_CALLS = _table(b"!?")
_POINT = ~_table(bytes(range(0x80, 0xC0)))


def statistics(flat: C.Flat, span: int = REPEAT_WORDS) -> dict[str, np.ndarray]:
    """The rule statistics of every text."""
    data, offsets, n = flat.data, flat.offsets, flat.n

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[offsets])

    starts, ends, before = flat.words()
    roller = C.Roller(C.BYTE_HASH[data])
    out = {"n_words": np.diff(before)}
    out["word_chars"] = count(_POINT[data] & ~C.SPACE[data])
    out["n_symbols"] = count(_SYMBOLS[data])
    # lines: cut at the ends of texts and at line feeds, in this order where a text that begins with one follows
    feeds = np.flatnonzero(data == 10)
    line_ends = np.concatenate([offsets[1:], feeds])
    order = np.argsort(line_ends, kind="stable")
    line_ends = line_ends[order]
    line_row = np.concatenate([np.arange(n), np.searchsorted(offsets, feeds, "right") - 1])[order]
    line_starts = np.concatenate([[0], line_ends[:-1] + (data[np.minimum(line_ends[:-1], max(0, len(data) - 1))] == 10 if len(data) else 0)])
    first = np.ones(len(line_row), bool)
    first[1:] = line_row[1:] != line_row[:-1]
    line_starts[first] = offsets[line_row[first]]
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    size = line_ends[worded] - line_starts[worded]
    prints = C.mix(roller.spans(line_starts[worded], line_ends[worded]) + size.astype(np.uint64))
    lines = np.bincount(line_row[worded], minlength=n)
    order = np.lexsort((prints, line_row[worded]))
    kinds, _ = C.runs(line_row[worded][order], prints[order])
    out["n_dup_lines"] = lines - np.bincount(line_row[worded][order][kinds], minlength=n)
    # windows of words that occur again in their text
    words = C.mix(roller.spans(starts, ends) + (ends - starts).astype(np.uint64))
    row = np.repeat(np.arange(n), out["n_words"])
    repeat = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= span:
        windows = C.mix(C.Roller(words).windows(span))
        at = np.flatnonzero(row[: len(windows)] == row[span - 1 :])
        order = at[np.lexsort((windows[at], row[at]))]
        a, b = C.runs(row[order], windows[order])
        again = order[np.repeat(b - a > 1, b - a)]
        np.add.at(repeat, again, 1)
        np.add.at(repeat, again + span, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(repeat[:-1]) > 0], minlength=n)
    out["n_upper"], out["n_letters"], out["n_calls"] = (count(m[data]) for m in (_UPPER, _LETTERS, _CALLS))
    bars = (ends - starts == 1) & (_SYMBOLS[data[starts]] if len(data) else False)
    out["n_bars"] = np.bincount(row[bars], minlength=n)
    return out


def rule_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and STATISTICS of every row."""

    def run(batches):
        for batch in C.slices(batches):
            got = statistics(C.Flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[s].astype(np.int64)) for s in STATISTICS)], ["doc_id", *STATISTICS])

    docs = C.whole_ids(C.prepared(docs), id_col)
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS))


def features(rows: dict[str, np.ndarray]) -> np.ndarray:
    s = {k: np.asarray(rows[k], float) for k in STATISTICS}
    words, letters = np.maximum(s["n_words"], 1), np.maximum(s["n_letters"], 1)
    return np.column_stack([s["word_chars"] / words, np.minimum(s["n_symbols"] / words, 4), s["n_repeat_words"] / words, s["n_upper"] / letters, np.minimum(s["n_calls"] / words, 4), s["n_bars"] / words])


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n keys."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays of nodes by tree; the children of node i are 2 i + 1 and 2 i + 2. Leaves hold the
    expected path from the root."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH):
        self.depth, self.size = depth, 0
        self.feature = np.full((trees, 2 ** (depth + 1) - 1), -1, np.int8)
        self.cut = np.zeros(self.feature.shape)
        self.path = np.zeros(self.feature.shape)

    def nodes(self, x: np.ndarray, tree: int, level: int) -> np.ndarray:
        """The node of every row, a leaf above level or one at it."""
        feature, cut, rows = self.feature[tree], self.cut[tree], np.arange(len(x))
        at = np.zeros(len(x), np.int64)
        for _ in range(level):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]))
        return at

    def split(self, level: int, tree: np.ndarray, node: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, random) -> bool:
        """Draws the splits of a level's nodes from their rows' number and ranges of features; whether there are any."""
        if level == 0:
            self.size = int(n[0]) if len(n) else 0
        self.path[tree, node] = level + expected_path(n)
        draws = random.random((2, len(self.feature), 2**level))[:, tree, node - (2**level - 1)]
        wide = high > low
        choices = wide.sum(axis=1)
        some = (n > 1) & (choices > 0) & (level < self.depth)
        f = (np.cumsum(wide, axis=1) > np.floor(draws[0] * choices)[:, None]).argmax(axis=1)[some]
        a, b = low[some, f], high[some, f]
        self.feature[tree[some], node[some]] = f
        self.cut[tree[some], node[some]] = a + draws[1][some] * (b - a)
        return bool(some.any())

    def score(self, x: np.ndarray) -> np.ndarray:
        """The anomaly score, 0 to 1: 2 to the power of minus the relative mean path length."""
        total = np.zeros(len(x))
        for tree in range(len(self.feature)):
            total += self.path[tree, self.nodes(x, tree, self.depth)]
        return 2.0 ** (-total / (len(self.feature) * max(1e-9, float(expected_path(self.size)))))


def node_ranges(rows: DataFrame, forest: Forest, level: int) -> pa.Table:
    """tree, node, n, low and high of the features for every node at a level, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    names = [f"{end}_{f}" for end in ("low", "high") for f in FEATURES]

    def run(batches):
        forest = shared.value
        trees, first, width = len(forest.feature), 2**level - 1, 2**level
        n = np.zeros((trees, width), np.int64)
        low, high = np.full((len(FEATURES), trees, width), np.inf), np.full((len(FEATURES), trees, width), -np.inf)
        for batch in batches:
            x = features({s: batch.column(s).to_numpy() for s in STATISTICS})
            columns = np.ascontiguousarray(x.T)
            for tree in range(trees):
                at = forest.nodes(x, tree, level) - first
                order = np.argsort(at.astype(np.int16 if level < 15 else np.int64), kind="stable")[np.count_nonzero(at < 0) :]
                counts = np.bincount(at[order], minlength=width)
                some = np.flatnonzero(counts)
                if len(some):
                    n[tree] += counts
                    starts, own = (np.cumsum(counts) - counts)[some], columns[:, order]
                    low[:, tree, some] = np.minimum(low[:, tree, some], np.minimum.reduceat(own, starts, axis=1))
                    high[:, tree, some] = np.maximum(high[:, tree, some], np.maximum.reduceat(own, starts, axis=1))
        tree, node = np.nonzero(n)
        ends = [pa.array(v) for v in (*low[:, tree, node], *high[:, tree, node])]
        yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array((node + first).astype(np.int32)), pa.array(n[tree, node]), *ends], ["tree", "node", "n", *names])

    found = rows.select(*STATISTICS).mapInArrow(run, "tree int, node int, n long, " + ", ".join(f"{c} double" for c in names))
    merged = found.groupBy("tree", "node").agg(F.sum("n").alias("n"), *[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in names])
    table = merged.toArrow()
    shared.destroy()
    return table


def grow(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """Isolation trees over all rows."""
    forest, random = Forest(trees, depth), np.random.default_rng(seed)
    for level in range(depth + 1):
        seen = node_ranges(rows, forest, level)
        tree, node, n = (seen.column(c).to_numpy() for c in ("tree", "node", "n"))
        low, high = (np.column_stack([seen.column(f"{end}_{f}").to_numpy() for f in FEATURES]) for end in ("low", "high"))
        if not forest.split(level, tree, node, n, low, high, random):
            break
    return forest


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """anomaly and good of every labelled row."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            anomaly = shared.value.score(features({s: batch.column(s).to_numpy() for s in STATISTICS}))
            yield pa.RecordBatch.from_arrays([pa.array(anomaly), batch.column("good")], ["anomaly", "good"])

    return rows.select(*STATISTICS, "good").mapInArrow(run, "anomaly double, good boolean")


def distinct_scores(scores: DataFrame) -> DataFrame:
    """Every score with its numbers of good and bad rows."""
    return scores.groupBy("anomaly").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))


def calibrate(cells: DataFrame) -> float:
    """The score from which on rows are rejected, with the best mean of both classes' accuracies, of the lowest if
    several are best; infinite if none is better than to keep all. cells: distinct_scores().

    The sums below a score are those of the lower bins, of which there are BINS, and a running sum within its own.
    """
    cells = cells.withColumn("bin", F.floor(F.col("anomaly") * BINS))
    lower = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("bin").orderBy("anomaly").rowsBetween(W.unboundedPreceding, -1)
    sizes = cells.groupBy("bin").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    below = sizes.select("bin", *[F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"{c}_lower") for c in "gb"])
    good, bad = (F.col(f"{c[0]}_lower") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in ("good", "bad"))
    n_good, n_bad = cells.agg(F.sum("good"), F.sum("bad")).first()
    if not n_good or not n_bad:
        return float("inf")
    gain = good.cast("decimal(18,0)") * F.lit(n_bad).cast("decimal(18,0)") - bad.cast("decimal(18,0)") * F.lit(n_good).cast("decimal(18,0)")
    best = cells.join(F.broadcast(below), "bin").select("anomaly", gain.alias("gain")).orderBy(F.desc("gain"), "anomaly").first()
    if best.gain <= 0:
        return float("inf")
    before = cells.where(F.col("anomaly") < best.anomaly).agg(F.max("anomaly")).first()[0]
    middle = (before + best.anomaly) / 2
    return middle if middle > before else best.anomaly


def train(stats: DataFrame, labels: DataFrame, *, trees: int = TREES, depth: int = DEPTH):
    """(forest, threshold) from all labelled rows that pass the base rules, or None without both kinds."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") == 1).alias("good"))
    passing = stats.where((F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words")))
    steps = C.Steps(stats.sparkSession)
    try:
        rows = steps.store(passing.join(own, F.col("doc_id") == F.col("id")).select(*STATISTICS, "good"))
        if rows.select("good").distinct().count() < 2:
            return None
        forest = grow(rows, trees, depth)
        return forest, calibrate(steps.store(distinct_scores(scored(rows, forest))))
    finally:
        steps.done()


def judge(stats: DataFrame, model) -> DataFrame:
    """stats with base_failed, anomaly and kept."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = {s: batch.column(s).to_numpy() for s in STATISTICS}
            failed = (rows["n_words"] < LEAST_WORDS) | (100 * rows["n_repeat_words"] > MOST_REPEATED * rows["n_words"])
            if shared.value is None:
                anomaly, kept = np.zeros(batch.num_rows), ~failed
            else:
                forest, threshold = shared.value
                anomaly = forest.score(features(rows))
                kept = ~failed & (anomaly < threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(anomaly), pa.array(kept)], [*batch.schema.names, "base_failed", "anomaly", "kept"])

    return stats.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", base_failed boolean, anomaly double, kept boolean")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    stats = C.settle(rule_statistics(C.table(spark, sf_dir, "documents")))
    judged = judge(stats, train(stats, C.table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept")
