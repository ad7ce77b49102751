"""Training-data preparation of the documents table: five stages, each written as Parquet and read again.

Every stage takes all that its predecessor kept and, but for the last, returns the columns of documents.

Defined results: rows with null or empty texts pass every stage (their ids are null or none) unless a
predecessor judges them; rows with a null doc_id are documents like others, the largest by id; exact
repetitions of a row leave one row after near_dedup; empty tables give empty tables; further columns of any name
pass through the first four stages, and the last drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common as C
from lectern.llm import decontaminate, near_dedup, pieces, substring_dedup, toxicity


def _apart(docs: DataFrame, work) -> DataFrame:
    """The columns of documents after work(), which sees only doc_id and text under their own names, so that no
    other column can clash with those that an operator adds; n_chars is counted again."""
    names = {c: c if c in ("doc_id", "text") else f"c_{i}" for i, c in enumerate(docs.columns)}
    done = work(docs.select(*[docs[c].alias(n) for c, n in names.items()]))
    out = [F.col(n).alias(c) for c, n in names.items()]
    if "n_chars" in names:
        out[docs.columns.index("n_chars")] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return done.select(*out)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon accepts."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    to = C.fresh(docs, "toxicity")
    return toxicity.score_toxicity(docs, model, to=to).where(F.col(to) < toxicity.THRESHOLD).drop(to)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word windows that an earlier document has; those left without words go."""
    some = (F.col("n_words") > F.col("n_removed")) | (F.col("n_words") == 0)
    return _apart(docs, lambda own: substring_dedup.remove_repeats(own).where(some))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _apart(docs, lambda own: decontaminate.decontaminate(own, items).where(~F.col("over_coverage")))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids, with the text decoded from them."""
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), decoded="decoded")
    return encoded.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", one_of_each),
    ("substring_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("sentencepiece", to_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table is removed from the shared folder once the next one is written."""
    steps = C.Steps(spark)
    docs = C.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = steps.store(stage(spark, docs, sf_dir))
        steps.done(docs)
    return docs
