"""The library's tables: documents, positions, settings, voices and the clips to be made.

Latest-per-key always aggregates with max_by over the full order key, so that map tasks combine; only what
needs neighbours uses a window, and those partition by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import estimate as E

# The voice catalogue (id, name, British, grade), best grade first.
VOICES = (
    ("af_heart", "Heart", False, "A"),
    ("af_bella", "Bella", False, "A-"),
    ("af_nicole", "Nicole", False, "B-"),
    ("bf_emma", "Emma", True, "B-"),
    ("af_aoede", "Aoede", False, "C+"),
    ("af_kore", "Kore", False, "C+"),
    ("af_sarah", "Sarah", False, "C+"),
    ("am_fenrir", "Fenrir", False, "C+"),
    ("am_michael", "Michael", False, "C+"),
    ("am_puck", "Puck", False, "C+"),
    ("af_alloy", "Alloy", False, "C"),
    ("af_nova", "Nova", False, "C"),
    ("bf_isabella", "Isabella", True, "C"),
    ("bm_george", "George", True, "C"),
    ("bm_fable", "Fable", True, "C"),
    ("af_sky", "Sky", False, "C-"),
    ("bm_lewis", "Lewis", True, "D+"),
    ("af_jessica", "Jessica", False, "D"),
    ("af_river", "River", False, "D"),
    ("am_echo", "Echo", False, "D"),
    ("am_eric", "Eric", False, "D"),
    ("am_liam", "Liam", False, "D"),
    ("am_onyx", "Onyx", False, "D"),
    ("bf_alice", "Alice", True, "D"),
    ("bf_lily", "Lily", True, "D"),
    ("bm_daniel", "Daniel", True, "D"),
    ("am_santa", "Santa", False, "D-"),
    ("am_adam", "Adam", False, "F+"),
)
VOICE_PREFIX = "kokoro:"
DEFAULTS = {"voice_id": None, "rate": 1.0, "pitch": 1.0, "theme": "system", "accepted": False}


def voices(spark: SparkSession) -> DataFrame:
    rows = [(i, VOICE_PREFIX + voice, name, "en-GB" if british else "en-US", True, grade) for i, (voice, name, british, grade) in enumerate(VOICES)]
    return spark.createDataFrame(rows, "rank int, id string, name string, lang string, on_device boolean, grade string")


def upsert(base: DataFrame, updates: DataFrame, key: str, version: Column | str) -> DataFrame:
    """One row for each key, that of the greatest version."""
    both = base.unionByName(updates)
    row = F.struct(*both.columns)
    return both.groupBy(key).agg(F.max_by(row, F.col(version) if isinstance(version, str) else version).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in both.columns])


def list_docs(docs: DataFrame, n: int | None = None, body: tuple[str, ...] = ("text",)) -> DataFrame:
    ordered = docs.drop(*body).orderBy(F.desc("added_at"), F.desc("doc_id"))
    return ordered if n is None else ordered.limit(n)


def load_docs(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids, "doc_id", "left_semi")


def delete_docs(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids, "doc_id", "left_anti")


def latest_progress(events: DataFrame) -> DataFrame:
    """The last position of each document by (updated_at, event_id)."""
    return events.groupBy("doc_id").agg(F.max_by("sentence_index", F.struct("updated_at", "event_id")).alias("sentence_index"))


def progress_by_doc(docs: DataFrame, progress: DataFrame) -> DataFrame:
    return docs.select("doc_id").join(progress, "doc_id", "left").select("doc_id", F.coalesce("sentence_index", F.lit(0)).alias("sentence_index"))


def resume_index(position: Column, sentences: Column) -> Column:
    return F.when(position >= sentences, 0).otherwise(position)


def library_cards(docs: DataFrame, progress: DataFrame, rate: float = 1.0) -> DataFrame:
    """Fraction heard and label of each document; `sentences`, where docs have it and it is known, is the total."""
    at = docs.join(progress, "doc_id", "left").withColumn("position", F.coalesce("sentence_index", F.lit(0)))
    guess = F.greatest(F.lit(1), E.half_up(F.col("word_count") / E.WORDS_PER_SENTENCE))
    total = F.coalesce(F.col("sentences"), guess) if "sentences" in docs.columns else guess
    at = at.withColumn("fraction", F.least(F.lit(1.0), F.col("position") / total))
    rest = E.half_up(F.col("word_count") * (1 - F.col("fraction")))
    whole = E.format_remaining(E.speaking_seconds(F.col("word_count"), F.lit(rate)))
    label = F.when(F.col("fraction") >= 1, "FINISHED").when(F.col("fraction") == 0, F.concat(F.lit("NOT STARTED · "), F.regexp_replace(whole, " left", "")))
    label = label.otherwise(F.concat(E.half_up(F.col("fraction") * 100).cast("string"), F.lit("% · "), E.format_remaining(E.speaking_seconds(rest, F.lit(rate)))))
    return at.select("doc_id", F.round("fraction", 6).alias("fraction"), label.alias("label"))


def fold_settings(patches: DataFrame) -> DataFrame:
    """Defaults overlaid by each user's patches, field by field; acceptance, once given, stays."""
    last = [F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))), F.lit(DEFAULTS[c])).alias(c) for c in ("voice_id", "rate", "pitch", "theme")]
    return patches.groupBy("user_id").agg(*last, F.coalesce(F.bool_or("accepted"), F.lit(False)).alias("accepted"))


def model_ids(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rows with model_id: the voice's id without prefix, null for a voice that is not offered."""
    names = catalogue.select(F.col("id").alias("voice_id"), F.substring("id", len(VOICE_PREFIX) + 1, 99).alias("model_id"))
    return rows.join(F.broadcast(names), "voice_id", "left")


def pick_voice(users: DataFrame, catalogue: DataFrame, first: str = VOICE_PREFIX + VOICES[0][0]) -> DataFrame:
    """The voice that a user chose if it is still offered, else the first."""
    names = catalogue.select(F.col("id").alias("voice_id"), F.col("id").alias("chosen"))
    return users.join(F.broadcast(names), "voice_id", "left").select("user_id", F.coalesce("chosen", F.lit(first)).alias("voice_id"))


def by_document() -> W:
    return W.partitionBy("doc_id").orderBy("sentence_id")


def sentence_clock(sentences: DataFrame, rate: float = 1.0) -> DataFrame:
    before = F.coalesce(F.sum("words").over(by_document().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("words").over(W.partitionBy("doc_id"))
    return sentences.select("doc_id", "sentence_id", F.round(E.speaking_seconds(before, F.lit(rate)), 4).alias("elapsed"), F.round(E.speaking_seconds(total, F.lit(rate)), 4).alias("total"))


def lookahead(sentences: DataFrame, k: int = 2) -> DataFrame:
    return sentences.select("doc_id", "sentence_id", F.collect_list("sentence_id").over(by_document().rowsBetween(1, k)).alias("next_ids"))


def sentence_states(sentences: DataFrame, progress: DataFrame) -> DataFrame:
    at = sentences.join(progress, "doc_id", "left").withColumn("p", F.coalesce("sentence_index", F.lit(0)))
    state = F.when(F.col("sentence_id") < F.col("p"), "spoken").when(F.col("sentence_id") == F.col("p"), "active").otherwise("upcoming")
    return at.select("doc_id", "sentence_id", state.alias("state"))


def with_clip_key(requests: DataFrame) -> DataFrame:
    """requests with the key of the clip that each position plays: equal for equal voice, rate and text."""
    key = F.sha2(F.concat_ws("|", F.coalesce("voice_id", F.lit("")), F.col("rate").cast("decimal(6,2)").cast("string"), "text"), 256)
    return requests.withColumn("clip_key", key)


def offered_requests(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """requests but for those with a voice that is not offered, which get no clip."""
    return requests.join(F.broadcast(catalogue.select(F.col("id").alias("voice_id"))), "voice_id", "left_semi")


def clip_manifest(requests: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """One clip for each voice, rate and text, grouped by their hash, with the number of its uses; with a catalogue, of
    offered voices only."""
    keyed = with_clip_key(requests if catalogue is None else offered_requests(requests, catalogue))
    return keyed.groupBy("clip_key").agg(F.first("voice_id").alias("voice_id"), F.first("rate").alias("rate"), F.first("text").alias("text"), F.count("*").alias("uses"))


def clip_positions(requests: DataFrame, catalogue: DataFrame, clips: DataFrame, hot: int = 1000) -> DataFrame:
    """Every position of an offered voice with its clip's columns (clips: clip_key, uses and more, what was made of them).

    The `hot` most used clips, a bounded number of rows, go to every task; each of the others has less than one part in
    `hot` of the positions, and is joined by a shuffle. So a sentence that all documents share is no task of its own.
    """
    keyed = with_clip_key(offered_requests(requests, catalogue)).select("doc_id", "sentence_id", "clip_key")
    often = F.broadcast(clips.orderBy(F.desc("uses"), "clip_key").limit(hot))
    rest = keyed.join(often.select("clip_key"), "clip_key", "left_anti")
    return keyed.join(often, "clip_key").unionByName(rest.join(clips, "clip_key"))


def images_for_docs(images: DataFrame, docs: DataFrame) -> DataFrame:
    """The images of some documents, without their bytes."""
    return images.drop("bytes").join(docs.select("doc_id"), "doc_id", "left_semi")


def doc_blocks(docs: DataFrame) -> DataFrame:
    """docs with blocks, from `paragraphs` where a row is older than blocks are; either column may be absent.

    A paragraph becomes a block in whatever fields blocks have: its kind, its number, and its text or its one run.
    """
    if "paragraphs" not in docs.columns:
        return docs
    blocks = docs.schema["blocks"].dataType if "blocks" in docs.columns else T._parse_datatype_string("array<struct<kind:string,text:string>>")

    def block(p, i):
        known = {"kind": F.lit("paragraph"), "text": p, "block_no": i}
        if "runs" in blocks.elementType.names:
            run = {"text": p, "bold": F.lit(False), "italic": F.lit(False), "code": F.lit(False)}
            known["runs"] = F.array(F.struct(*[c.alias(n) for n, c in run.items()]))
        return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in blocks.elementType])

    old = F.transform(F.coalesce("paragraphs", F.array().cast("array<string>")), block)
    return docs.withColumn("blocks", F.coalesce("blocks", old) if "blocks" in docs.columns else old).drop("paragraphs")


def voice_counts(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("lang", "grade").agg(F.count("*").alias("voices"))


def combine(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Documents of several sources as one library; columns that a source lacks are null."""
    for other in more:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
