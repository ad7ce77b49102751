"""A folder of files of all kinds to blocks, words and rejects."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import blocks as B
from lectern.sources import corpus

WORDML = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
STYLED = "doc_id long, page_no int, piece_no int, str string, x double, y double, width double, height double, bold boolean, italic boolean, mono boolean"


def word_file(path, *paragraphs):
    body = "".join(f"<w:p><w:r><w:t xml:space='preserve'>{p}</w:t></w:r></w:p>" for p in paragraphs)
    extra = "<w:p><mc:AlternateContent><mc:Choice><w:t>twice</w:t></mc:Choice><mc:Fallback><w:r><w:t>once</w:t><w:tab/><w:t>more</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p>"
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("word/document.xml", f"<?xml version='1.0'?><w:document {WORDML}><w:body>{body}{extra}</w:body></w:document>")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "deep").mkdir()
    (root / "my_notes.md").write_text("# 1. Title\n\nOne *two*. Three.\n\n- item\n```sql\nselect 1\n```\n")
    (root / "deep" / "plain.txt").write_bytes("﻿Éléphant one.\r\nStill one.\r\n\r\nTwo.".encode())
    (root / "latin.txt").write_bytes("caf\xe9 au lait".encode("latin-1"))
    (root / "cut.md").write_bytes("ends in half a ☃".encode()[:-1])
    (root / "blank.txt").write_text(" \n\t\n")
    (root / "nothing.md").write_bytes(b"")
    (root / "rule.md").write_text("---\n\n***\n")
    (root / "archive.zip").write_bytes(b"PK\x03\x04")
    (root / "README").write_text("no extension")
    word_file(root / "letter.docx", "Dear reader.", "", "Yours, A &amp; B.")
    (root / "broken.docx").write_bytes(b"PK\x03\x04 not a zip at all")
    with zipfile.ZipFile(root / "other.docx", "w") as out:
        out.writestr("something.xml", "<a/>")
    with zipfile.ZipFile(root / "torn.docx", "w") as out:
        out.writestr("word/document.xml", "<w:document>")
    for name in ("report.pdf", "scan.pdf", "lost.pdf", "table.pdf"):
        (root / name).write_bytes(b"%PDF-1.7 \xff\xfe " + name.encode())
    return str(root)


@pytest.fixture(scope="module")
def files(spark, folder):
    return corpus.read_corpus(spark, folder).cache()


def test_reading(files):
    rows = {r.filename: r for r in files.collect()}
    assert len(rows) == 17 and len({r.doc_id for r in rows.values()}) == 17
    assert rows["plain.txt"].text.startswith("Éléphant") and rows["letter.docx"].text == "Dear reader.\n\n\n\nYours, A & B.\n\nonce\tmore\n\n"
    assert all(rows[n].text is None for n in ("latin.txt", "cut.md", "broken.docx", "other.docx", "torn.docx", "report.pdf", "archive.zip", "README"))
    assert (rows["my_notes.md"].title, rows["archive.zip"].source, rows["nothing.md"].text) == ("my notes", None, "")


def pieces_of(spark, files):
    """report.pdf: plain lines with running heads over three pages; table.pdf: headings and a list; scan.pdf: blanks."""
    ids = {r.filename: r.doc_id for r in files.collect()}
    rows = []
    for page in range(3):
        for n, (text, y) in enumerate([(f"Report, page {page}", 760.0), *[(f"line {page}{i} of the text goes on", 700.0 - 14 * i) for i in range(8)], (f"It ends {('one', 'two', 'six')[page]} here.", 580.0)]):
            rows.append((ids["report.pdf"], page, n, text, 72.0, y, 200.0, 10.0, False, False, False))
    for n, (text, x, y, h, bold) in enumerate([("Title", 72.0, 700.0, 24.0, True), ("ℹ Mind this", 80.0, 660.0, 10.0, False), ("1. first", 85.0, 640.0, 10.0, False), *[(f"body {i} goes on", 72.0, 600.0 - 14 * i, 10.0, False) for i in range(4)]]):
        rows.append((ids["table.pdf"], 0, n, text, x, y, 100.0, h, bold, False, False))
    rows.append((ids["scan.pdf"], 0, 0, " ", 72.0, 700.0, 5.0, 10.0, False, False, False))
    return spark.createDataFrame(rows, STYLED)


def test_every_file_once(spark, files):
    parsed, rejects = corpus.parse_corpus(files, pieces_of(spark, files))
    name = {r.doc_id: r.filename for r in files.collect()}
    good = {name[r.doc_id]: r for r in parsed.collect()}
    assert {n: (r.words, r.sentences, [b.kind for b in r.blocks]) for n, r in good.items()} == {
        "my_notes.md": (9, 5, ["heading", "paragraph", "list-item", "code"]),
        "plain.txt": (5, 3, ["paragraph", "paragraph"]),
        "letter.docx": (8, 3, ["paragraph"] * 3),
        "report.pdf": (3 * (8 * 7 + 4), 6, ["paragraph"] * 6),
        "table.pdf": (1 + 2 + 1 + 16, 4, ["heading", "callout", "paragraph", "list-item", "paragraph"]),
    }
    assert good["table.pdf"].blocks[1].icon == "ℹ" and good["report.pdf"].title == "report"
    reasons = [(name[r.doc_id], r.kind) for r in rejects.collect()]
    assert sorted(reasons) == sorted([(n, "unreadable") for n in ("latin.txt", "cut.md", "broken.docx", "other.docx", "torn.docx", "lost.pdf")] + [(n, "empty") for n in ("blank.txt", "nothing.md", "rule.md", "scan.pdf")] + [("archive.zip", "unsupported"), ("README", "unsupported")])


def test_without_pieces(files):
    parsed, rejects = corpus.parse_corpus(files)
    assert parsed.count() == 3 and rejects.where("kind = 'unreadable'").count() == 9


def test_words_are_those_of_the_sentences(spark):
    texts = ["# A b\nOne. Two three!", "x ** y", "see https://www.example.org/a b", None, "…", "a b\x1cc"]
    docs = spark.createDataFrame([(i, s, t) for i, t in enumerate(texts) for s in ("md", "txt")], "doc_id long, source string, text string").withColumn("doc_id", F.col("doc_id") * 2 + (F.col("source") == "md").cast("int"))
    markdown = F.when(F.col("source") == "md", F.coalesce("text", F.lit("")))
    whole = B.whole_documents(docs, markdown, X.plain_paragraphs(F.col("text"))).where("sentences > 0").select("doc_id", "words", "sentences")
    assert sorted(whole.collect()) == sorted(B.document_word_counts(corpus.parse_documents(docs)).collect())


def test_segment_blocks(spark):
    docs = spark.createDataFrame([(1, "# 1. T\nOne. Two.\n<aside>\n💡\n\nInside. It.\n</aside>\n```\nx\n```"), (2, "- a\n- b")], "doc_id long, text string")
    assert sorted(B.segment_blocks(B.markdown_blocks(docs)).collect()) == sorted(B.segment_documents(docs).collect())
