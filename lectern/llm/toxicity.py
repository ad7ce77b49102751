"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding homoglyphs and digit substitutions,
normalised by length, with exception phrases.

The lexicon is learned from labelled rows: word beginnings of the folded text that occur in far more toxic
than other documents, by a likelihood ratio, none of them the beginning of another. A document's score is a
logistic of its total weight and of its weight per hundred words. A hit inside an exception phrase is none.

Learning reads at most `labelled` labelled rows, those with the smallest hash of the id, and so the model,
which goes to every worker, is bounded by `labelled`: a word begins in LEAST_DF toxic rows at least and needs evidence
of EVIDENCE, which is all that chooses the lexicon; scoring is one map without a shuffle.

Defined results: null, empty and wordless texts have no hits and get the score of no hits; without labels of
both kinds every score is 0; rows with a null id are scored, not learned from, and not held out; several labels for an id count as toxic if one does; repeated rows score alike;
extra columns pass through unread.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import common as C

LABELLED = 40_000
LEAST_DF = 3
EVIDENCE = 12.0
PREFIX = (3, 12)
THRESHOLD = 0.7

# Characters that look like a Latin letter, and the letter.
HOMOGLYPHS = "аa еe оo рp сc хx уy кk мm тt вb нh іi ѕs јj ԁd ԛq ԝw αa βb εe ιi κk νv οo ρp τt υu χx ıi ɑa ɡg"
DIGITS = "0o 1i 3e 4a 5s 7t 8b 9g @a $s li"
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clown shoes", "sore loser rule", "pond scum")

_FOLD = {ord(pair[0]): pair[1] for pair in f"{HOMOGLYPHS} {DIGITS}".split()} | {ord("ӏ"): "i"} | dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF), None)
_WORD = re.compile(r"[^\W_]+")
_JUNK = re.compile(r"[$@]+(?![^\W_])|(?<![^\W_])[$@]+(?=[$@\s])")


def fold(text: str | None) -> str:
    """The text in lower case with look-alikes as Latin letters, one space before each word and one at the end."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "$" in text or "@" in text:
        text = _JUNK.sub(" ", text)
    return " " + " ".join(_WORD.findall(text.translate(_FOLD))) + " "


def prefixes(text: str | None) -> set[str]:
    least, most = PREFIX
    return {w[:n] for w in set(fold(text).split()) for n in range(least, min(len(w), most) + 1)}


def is_training(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def learn_lexicon(sample: DataFrame, n_toxic: int, n_other: int) -> dict[str, float]:
    """Word beginnings and weights. sample: text and toxic, bounded; two counts of document frequencies, joined."""

    def count(batches):
        for batch in batches:
            found: dict[str, int] = {}
            for text in batch.column("text").to_pylist():
                for p in prefixes(text):
                    found[p] = found.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["p", "n"])

    def total(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("text").mapInArrow(count, "p string, n long").groupBy("p").agg(F.sum("n").alias(name))

    base = n_toxic / (n_toxic + n_other)
    toxic = total(sample.where("toxic = 1"), "t").where(F.col("t") >= LEAST_DF)
    both = toxic.join(total(sample.where("toxic = 0"), "m"), "p", "left").select("p", "t", F.coalesce("m", F.lit(0)).alias("n"))
    t, n = F.col("t"), F.col("n")
    evidence = t * F.log(t / ((t + n) * base)) + F.when(n > 0, n * F.log(n / ((t + n) * (1 - base)))).otherwise(0.0)
    rated = both.withColumn("evidence", evidence).where((t > n) & (F.col("evidence") >= EVIDENCE)).orderBy(F.desc("evidence"), F.desc(F.length("p")), "p")
    chosen: dict[str, float] = {}
    begun: set[str] = set()
    for p, t, n, _ in rated.toLocalIterator():
        if p not in begun and not any(p[:n] in chosen for n in range(PREFIX[0], len(p) + 1)):
            chosen[p] = math.log((t + 0.5) / (n_toxic + 1)) - math.log((n + 0.5) / (n_other + 1))
            begun.update(p[:n] for n in range(PREFIX[0], len(p) + 1))
    return chosen


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, weight in lexicon.items():
            self.automaton.add_word(" " + p, (len(p) + 1, weight))
        for phrase in exceptions:
            self.automaton.add_word(fold(phrase), (len(fold(phrase)), 0.0))
        self.automaton.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """Logarithms of the total weight, and of the weight per hundred words."""
        folded = fold(text)
        hits, harmless = [], []
        for end, (size, weight) in self.automaton.iter(folded):
            (hits if weight else harmless).append((end + 1 - size, end + 1, weight))
        if harmless:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in harmless)]
        weight = sum(h[2] for h in hits)
        return math.log1p(weight), math.log1p(100 * weight / (folded.count(" ") + 19))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 50) -> np.ndarray:
    """Coefficients with the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.array([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, exceptions: tuple[str, ...] = EXCEPTIONS, id_col: str = "doc_id", text_col: str = "text"):
    """(lexicon, coefficients), or None without both kinds of label."""
    docs = C.prepared(docs)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(is_training(F.col("doc_id")))
    chosen = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    sample = C.settle(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").dropDuplicates(["text", "toxic"]))
    count = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not count.get(1) or not count.get(0):
        return None
    words = learn_lexicon(sample, count[1], count[0])

    def run(batches):
        matcher = Matcher(words, exceptions)
        for batch in batches:
            got = [matcher.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in got], pa.float64()) for i in (0, 1)), batch.column("toxic").cast(pa.int32())], ["a", "b", "toxic"])

    seen = sample.mapInArrow(run, "a double, b double, toxic int").groupBy("a", "b", "toxic").count().toPandas()
    x = np.repeat(seen[["a", "b"]].to_numpy(), seen["count"], axis=0)
    return words, fit_logistic(x, np.repeat(seen["toxic"].to_numpy(), seen["count"]).astype(float))


def score_toxicity(docs: DataFrame, model, *, exceptions: tuple[str, ...] = EXCEPTIONS, text_col: str = "text", to: str = "toxicity") -> DataFrame:
    """docs and toxicity (0 to 1), in a column of that name or another."""
    docs = C.prepared(docs, to)
    place = docs.columns.index(text_col)
    named = docs.select(*[docs[c].alias(f"c_{i}") for i, c in enumerate(docs.columns)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        words, weights = shared.value or ({}, None)
        matcher = Matcher(words, exceptions)
        for batch in batches:
            if weights is None:
                scores = np.zeros(batch.num_rows)
            else:
                x = np.array([matcher.features(t.as_py()) for t in batch.column(place)], float).reshape(-1, 2)
                scores = 1 / (1 + np.exp(-np.clip(x @ weights[:2] + weights[2], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "toxicity"])

    done = named.mapInArrow(run, T.StructType([*named.schema.fields, T.StructField("toxicity", T.DoubleType())]))
    return done.select(*[done[f"c_{i}"].alias(c) for i, c in enumerate(docs.columns)], done["toxicity"].alias(to))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~F.coalesce(is_training(F.col("doc_id")), F.lit(True))).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
