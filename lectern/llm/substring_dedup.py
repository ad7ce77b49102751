"""Substring dedup: Rabin-Karp hashes of every token window, counted in Spark; repeated windows merge into
maximal removal intervals.

Each map task hashes every window of its texts with one rolling pass and packs the hashes into buckets of
the hash space. A reducer sorts a bucket, takes the smallest document of each hash, and names the windows
of all later documents. Those window starts, packed by groups of documents, go back by the documents'
keys, where overlapping windows merge into maximal intervals and the words go.

Cost: one shuffle of about nine bytes a window, one of the removed starts, one of the compressed texts. A
bucket holds `per_bucket` windows on average whatever the input, and so bounds a reducer's memory; a window
that a third of all documents share adds one posting a document to its bucket, and no pair is ever formed.

Defined results: a null text has no words; a null id counts as larger than any other; rows with the same id
never remove each other's windows, nor do repetitions within one document; texts under 13 words stay; extra
columns pass through unread. Two hashes agree by chance with probability 2**-56 / buckets a pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as C

WINDOW = 13
PER_BUCKET = 1_000_000


def window_postings(docs: DataFrame, window: int, buckets: int, **columns: str) -> DataFrame:
    def look(flat: C.Flat):
        starts, ends, before = flat.words()
        if len(starts) < window:
            return None
        hashes = C.mix(C.Roller(flat.word_hashes(starts, ends)).windows(window))
        row = np.repeat(np.arange(flat.n, dtype=np.int32), np.diff(before))
        whole = np.flatnonzero(row[: len(hashes)] == row[window - 1 :])
        return hashes[whole], row[whole], whole - before[row[whole]], None

    return C.keyed(docs, **columns).mapInArrow(lambda batches: C.pack_slices(batches, buckets, look), C.POSTINGS)


def later_windows(postings: DataFrame, groups: int) -> DataFrame:
    """Starts of the windows that also start in a document with a smaller id, by document."""

    def run(frame):
        import pandas as pd

        got = C.unpack(frame)
        order = np.argsort(got["key"])
        text, place = got["text"][order], got["place"][order]
        firsts, ends = C.runs(got["key"][order])
        k = got["ks"][text]
        later = k > np.repeat(np.minimum.reduceat(k, firsts), ends - firsts)
        return pd.DataFrame(C.pack_marks(groups, k[later], got["fs"][text[later]], place[later]), columns=["g", "ks", "fs", "counts", "places", "tags"])

    return C.merge_marks(postings.groupBy("bucket").applyInPandas(run, C.MARKS).drop("tags"), np.uint32)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, per_bucket: int = PER_BUCKET, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the repeated windows cut from the text, and n_words, n_removed.

    A text that loses nothing stays as it is; else each maximal run of removed words goes with the white
    space after it.
    """
    columns = {"id_col": id_col, "text_col": text_col}
    docs = C.prepared(docs, "n_words", "n_removed")
    buckets = C.bucket_count(C.text_bytes(docs, text_col) / 6, per_bucket)
    marks = later_windows(window_postings(docs, window, buckets, **columns), buckets)

    def change(texts, blobs):
        new, n_words, n_removed = [], [], []
        for text, blob in zip(texts, blobs, strict=True):
            flat = C.Flat(C.pa.array([text], C.pa.binary()))
            starts, ends, _ = flat.words()
            gone = C.covered(C.places(blob, np.uint32), window, len(starts))
            n_words.append(len(starts))
            n_removed.append(int(gone.sum()))
            new.append(C.cut(text, starts, gone) if n_removed[-1] else text)
        return new, n_words, n_removed

    return C.rewrite(docs, marks, change, "n_words bigint, n_removed bigint", keep=keep, **columns)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = remove_repeats(C.table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), firsts AS (
  SELECT g, min(doc_id) AS first_id FROM win GROUP BY g HAVING min(doc_id) <> max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, j FROM (
    SELECT win.doc_id, unnest(range(win.i, win.i + 13)) AS j
    FROM win JOIN firsts USING (g) WHERE win.doc_id > first_id)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w
), kept AS (
  SELECT words.doc_id, count(gone.j) AS n_removed,
         string_agg(word, ' ' ORDER BY words.j) FILTER (WHERE gone.j IS NULL) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.j = gone.j GROUP BY words.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
