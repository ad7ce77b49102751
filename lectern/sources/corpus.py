"""Mixed corpora: read, routed by extension, parsed to blocks, and split into good rows and rejects.

A file is never the reason that a job fails: what cannot be decoded has a null text, and becomes a reject.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import blocks as B
from lectern.operators import routing as R

# Names in the XML of Word documents.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_CHOICE = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Choice"
_BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, zlib.error, KeyError, ValueError, NotImplementedError, RuntimeError, EOFError, OSError)


def word_text(content: bytes) -> str | None:
    """The paragraphs of a Word document, with a blank line after each; None if it cannot be read.

    Of alternative contents the fallback counts; elements are dropped as soon as they are read.
    """
    out: list[str] = []
    skipped = 0
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as whole, whole.open("word/document.xml") as file:
            for event, element in ElementTree.iterparse(file, ("start", "end")):
                if element.tag == _CHOICE:
                    skipped += 1 if event == "start" else -1
                if event == "start":
                    continue
                if not skipped and element.tag == f"{_WORD}t":
                    out.append(element.text or "")
                elif not skipped and element.tag == f"{_WORD}tab":
                    out.append("\t")
                elif not skipped and element.tag == f"{_WORD}p":
                    out.append("\n\n")
                element.clear()
    except _BROKEN:
        return None
    return "".join(out)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, filename, source, title, text) of the files under a path.

    doc_id follows from the path and the bytes. Markdown and plain texts are UTF-8 (without a byte order mark), Word
    documents are unpacked; a text is null where that fails, and for a pdf, whose pieces come as a table of their own.
    """

    @F.pandas_udf("string")
    def unpacked(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else word_text(bytes(c)))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files = files.unionByName(_empty_files(files))
    name = F.element_at(F.split("path", "/"), -1)
    routed = files.select(F.xxhash64("path", "content").alias("doc_id"), "path", name.alias("filename"), "content")
    routed = routed.withColumns({"source": X.source_for_filename(F.col("filename")), "title": X.title_for_filename(F.col("filename"))})
    plain = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), r"\A\x{FEFF}", "")
    word = unpacked(F.when(F.col("source") == "docx", F.col("content")))
    return routed.withColumn("text", F.when(F.col("source").isin("md", "txt"), plain).when(F.col("source") == "docx", word)).drop("content")


def _empty_files(files: DataFrame) -> DataFrame:
    """(path, content) of the files without a byte, which a scan leaves out: those of its listing, which the driver
    holds anyway, that the scan does not give."""
    names = [re.sub(r"\A(\w+):///", r"\1:/", unquote(n)) for n in files.inputFiles()]
    listed = files.sparkSession.createDataFrame([(n,) for n in names], "path string")
    return listed.join(files.select("path"), "path", "left_anti").select("path", F.lit(b"").alias("content"))


def from_pasted(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"source": F.lit("paste"), "title": F.lit("Pasted text")})


def split_rejects(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): unsupported kinds, unreadable and empty texts go with a reason, and no job fails."""
    kind = F.when(F.col("source").isNull(), "unsupported").when(F.col("text").isNull(), "unreadable").when(~X.has_words(F.col("text")), "empty")
    marked = docs.withColumn("kind", kind)
    return marked.where("kind IS NULL").drop("kind"), marked.where("kind IS NOT NULL").select("doc_id", "kind")


def parse_documents(docs: DataFrame) -> DataFrame:
    """Sentences of documents (doc_id, source, text): Markdown by its blocks, other texts by their paragraphs."""
    is_markdown = F.col("source") == "md"
    return B.segment_documents(docs.where(is_markdown)).unionByName(B.segment_paragraphs(docs.where(~is_markdown)))


def named(docs: DataFrame) -> DataFrame:
    """docs (doc_id, filename, text) with source and title from the name."""
    return docs.withColumns({"source": X.source_for_filename(F.col("filename")), "title": X.title_for_filename(F.col("filename"))})


def pdf_documents(pieces: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """(doc_id, words, sentences, blocks) of pieces, routed by structure; blocks come in order."""
    return R.gathered(pieces, figures)


def parse_corpus(docs: DataFrame, pieces: DataFrame | None = None, figures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejects) of (doc_id, filename, text), as read_corpus() gives them.

    parsed: doc_id, title, source, words, sentences and blocks of each document that has something to say, its blocks
    from Markdown, from plain paragraphs (texts and Word documents), or for a pdf from its styled pieces and figures.
    rejects: doc_id and the reason: unsupported, unreadable (a text that could not be decoded, a pdf without pieces)
    or empty.
    """
    all_named = named(docs).select("doc_id", "title", "source", "text")
    is_pdf = F.coalesce(F.col("source") == "pdf", F.lit(False))
    good, rejects = split_rejects(all_named.where(~is_pdf))
    markdown = F.when(F.col("source") == "md", F.col("text"))
    read = B.whole_documents(good, markdown, F.when(markdown.isNull(), X.plain_paragraphs(F.col("text")))).drop("text")
    pdfs = all_named.where(is_pdf).drop("text")
    if pieces is None:
        rejects = rejects.unionByName(pdfs.select("doc_id", F.lit("unreadable").alias("kind")))
    else:
        own = pieces.join(pdfs.select("doc_id"), "doc_id", "left_semi")
        laid = pdfs.join(pdf_documents(own, figures), "doc_id", "left")
        read = read.unionByName(laid.where("blocks IS NOT NULL"))
        there = own.select("doc_id").distinct().withColumn("has", F.lit(True))
        missing = laid.where("blocks IS NULL").join(there, "doc_id", "left")
        rejects = rejects.unionByName(missing.select("doc_id", F.when(F.col("has"), "empty").otherwise("unreadable").alias("kind")))
    return read.where("sentences > 0"), rejects.unionByName(read.where("sentences = 0").select("doc_id", F.lit("empty").alias("kind")))
