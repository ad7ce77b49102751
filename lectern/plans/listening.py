"""Queries on listening to sentences: clocks, positions, cards and clips, and the same in DuckDB SQL.

said_* run over the sentences of the notes that documents.py projects, read_* over the sentences of the whole texts
of `documents`, cut by the Unicode rules. Positions come from events; over notes, which have 13 sentences, they are
wrapped so that some documents are finished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import blocks as B
from lectern.operators import library as L
from lectern.plans.catalog import PROGRESS_SQL, REMAINING, SECONDS, _events, query
from lectern.plans.documents import READ_SQL, SAID_SQL, _filled, _notes

WORDS_SQL = "len(regexp_extract_all(text, '\\S+'))"
KEY_SQL = "sha256(voice_id || '|' || rate || '|' || text)"
VOICE_SQL = "CASE doc_id % 3 WHEN 0 THEN 'kokoro:af_sky' WHEN 1 THEN 'kokoro:bm_george' ELSE 'system:old' END"


def _register(prefix: str, segment, said_sql: str, wrap: int | None) -> None:
    """The listening queries over the sentences that segment() gives; wrap: one more than the last position."""
    at_sql = f"SELECT doc_id, sentence_index{f' % {wrap}' if wrap else ''} AS pos FROM ({PROGRESS_SQL})"
    totals_sql = f"SELECT doc_id, CAST(sum({WORDS_SQL}) AS BIGINT) AS word_count, count(*) AS sentences FROM ({said_sql}) GROUP BY doc_id"
    requests_sql = f"SELECT doc_id, sentence_id, {VOICE_SQL} AS voice_id, CASE WHEN doc_id % 2 = 0 THEN '1.00' ELSE '1.25' END AS rate, text FROM ({said_sql})"

    def said(t) -> DataFrame:
        return segment(t).withColumn("words", X.count_words(F.col("text")))

    def progress(t) -> DataFrame:
        at = F.col("sentence_index")
        return L.latest_progress(_events(t)).withColumn("sentence_index", at % wrap if wrap else at)

    def totals(t) -> DataFrame:
        return B.document_word_counts(said(t)).withColumnRenamed("words", "word_count")

    def requests(t) -> DataFrame:
        d = F.col("doc_id")
        voice = F.element_at(F.array(*map(F.lit, ("kokoro:af_sky", "kokoro:bm_george", "system:old"))), (d % 3 + 1).cast("int"))
        return said(t).select("doc_id", "sentence_id", voice.alias("voice_id"), F.when(d % 2 == 0, 1.0).otherwise(1.25).alias("rate"), "text")

    def named(sql: str | None):
        def add(f):
            f.__name__ = f"{prefix}_{f.__name__}"
            return query(sql)(f)

        return add

    @named(f"""SELECT doc_id, sentence_id, round(coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 160.0 * 60, 4) AS elapsed,
        round(sum(w) OVER (PARTITION BY doc_id) / 160.0 * 60, 4) AS total FROM (SELECT *, {WORDS_SQL} AS w FROM ({said_sql}))""")
    def elapsed(t, spark):
        return L.sentence_clock(said(t))

    @named(f"SELECT s.doc_id, sentence_id, CASE WHEN sentence_id < coalesce(pos, 0) THEN 'spoken' WHEN sentence_id = coalesce(pos, 0) THEN 'active' ELSE 'upcoming' END AS state FROM ({said_sql}) s LEFT JOIN ({at_sql}) p USING (doc_id)")
    def states(t, spark):
        return L.sentence_states(said(t), progress(t))

    @named(f"SELECT doc_id, source, word_count, sentences FROM documents JOIN ({totals_sql}) USING (doc_id)")
    def headers(t, spark):
        return t("documents").select("doc_id", "source").join(totals(t), "doc_id")

    @named(f"SELECT doc_id, sentence_id, block_no, child_no FROM ({said_sql}) JOIN ({at_sql}) USING (doc_id) WHERE sentence_id = pos")
    def active_blocks(t, spark):
        """The path of the block that holds the sentence at the position."""
        at = progress(t).withColumnRenamed("sentence_index", "sentence_id")
        return _filled(said(t).join(at, ["doc_id", "sentence_id"], "left_semi").select("doc_id", "sentence_id", "block_no", "child_no"))

    @named(f"""SELECT doc_id, round(fraction, 6) AS fraction, CASE WHEN fraction >= 1 THEN 'FINISHED'
        WHEN fraction = 0 THEN 'NOT STARTED · ' || replace({REMAINING.format(SECONDS.format('word_count'))}, ' left', '')
        ELSE CAST(CAST(floor(fraction * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% · ' || {REMAINING.format(SECONDS.format('rest'))} END AS label
        FROM (SELECT *, floor(word_count * (1 - fraction) + 0.5) AS rest FROM (SELECT doc_id, word_count, least(1.0, CAST(coalesce(pos, 0) AS DOUBLE) / sentences) AS fraction
        FROM ({totals_sql}) LEFT JOIN ({at_sql}) USING (doc_id)))""")
    def cards(t, spark):
        """Library cards whose totals are sentence counts."""
        return L.library_cards(totals(t), progress(t))

    @named(f"SELECT doc_id, CASE WHEN pos >= sentences THEN 0 ELSE pos END AS resume, pos >= sentences AS finished FROM ({at_sql}) JOIN ({totals_sql}) USING (doc_id)")
    def positions(t, spark):
        """Where listening goes on, and whether the document is finished."""
        at, n = F.col("sentence_index"), F.col("sentences")
        return progress(t).join(totals(t), "doc_id").select("doc_id", L.resume_index(at, n).alias("resume"), (at >= n).alias("finished"))

    @named(f"SELECT {KEY_SQL} AS clip_key, voice_id, text, count(*) AS uses FROM ({requests_sql}) WHERE voice_id <> 'system:old' GROUP BY ALL")
    def clips(t, spark):
        return L.clip_manifest(requests(t), L.voices(spark)).drop("rate")

    @named(f"SELECT doc_id, sentence_id, {KEY_SQL} AS clip_key FROM ({requests_sql}) WHERE voice_id <> 'system:old'")
    def clip_positions(t, spark):
        """The clip that every position with an offered voice plays."""
        voices = L.voices(spark)
        return L.clip_positions(requests(t), voices, L.clip_manifest(requests(t), voices).select("clip_key", "uses")).drop("uses")

    @named(f"SELECT doc_id, sentence_id, coalesce(array_to_string(list(sentence_id) OVER (PARTITION BY doc_id ORDER BY sentence_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS next_ids FROM ({said_sql})")
    def lookahead(t, spark):
        return L.lookahead(said(t)).withColumn("next_ids", F.array_join(F.col("next_ids").cast("array<string>"), ","))

    @named(f"SELECT doc_id, sentence_id, voice_id FROM ({requests_sql}) WHERE voice_id = 'system:old'")
    def clip_rejects(t, spark):
        """Positions whose voice is not offered."""
        offered = L.voices(spark).select(F.col("id").alias("voice_id"))
        return requests(t).join(F.broadcast(offered), "voice_id", "left_anti").select("doc_id", "sentence_id", "voice_id")


_register("said", lambda t: B.segment_documents(_notes(t)), SAID_SQL, 14)
_register("read", lambda t: B.segment_paragraphs(t("documents")), READ_SQL, None)
