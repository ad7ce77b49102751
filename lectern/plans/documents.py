"""Queries on document structure (blocks, runs, sentences) and on PDF layout, with their SQL.

Notes are a Markdown text projected from every document's columns and all words of its text, so that SQL can say which
blocks and sentences come out; pieces and lines of pages are placed by the position of words, or taken from orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import blocks as B
from lectern.operators import library as L
from lectern.operators import markdown as M
from lectern.operators import pdf as P
from lectern.plans.catalog import FILES_SQL, SOURCE_SQL, _files, query
from lectern.sources import corpus

# ---------------------------------------------------------------- notes

NOTES = (
    "# 4.2. Notes on @S\nRead `doc_id` of @L. It is number @N.\n- first item\n  goes on\n- second @T\n\n3. third\n\n"
    "<aside>\n⚠️\n\n**Mind** the gap.\n\n</aside>\n*Figure 3 — Words of @N.*\n\n"
    "| Key | Value |\n| --- | --- |\n| lang | @L |\n| id | **@N** |\n```sql\nselect @N\n```\n"
)
#: (sentence_id, block_no, child_no, kind, text) of what is said.
SAID = [
    (0, 0, None, "heading", "4.2 Notes on @S"), (1, 1, None, "paragraph", "Read doc id of @L."), (2, 1, None, "paragraph", "It is number @N."),
    (3, 2, None, "list-item", "first item goes on"), (4, 3, None, "list-item", "second @T"), (5, 4, None, "list-item", "third"),
    (6, 5, 0, "paragraph", "Mind the gap."), (7, 6, None, "caption", "Figure 3 — Words of @N."), (8, 7, None, "paragraph", "Key: lang."),
    (9, 7, None, "paragraph", "Value: @L."), (10, 8, None, "paragraph", "Key: id."), (11, 8, None, "paragraph", "Value: @N."), (12, 9, None, "code", "sql code block."),
]
_WORDS = "array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ')"
_FILLED = f"replace(replace(replace(replace(t, '@N', CAST(doc_id AS VARCHAR)), '@L', lang), '@S', source), ' @T', CASE WHEN {_WORDS} <> '' THEN ' ' || {_WORDS} ELSE '' END)"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


SAID_SQL = f"SELECT doc_id, sentence_id, block_no, coalesce(child_no, -1) AS child_no, kind, {_FILLED} AS text FROM documents, (VALUES {_values(SAID)}) v(sentence_id, block_no, child_no, kind, t)"


def _notes(t) -> DataFrame:
    text = F.lit(NOTES)
    for mark, value in (("@N", F.col("doc_id").cast("string")), ("@L", F.col("lang")), ("@S", F.col("source")), ("@T", F.coalesce(F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), " "), F.lit("")))):
        text = F.replace(text, F.lit(mark), value)
    return t("documents").select("doc_id", text.alias("text"))


def _filled(rows: DataFrame) -> DataFrame:
    """Absent numbers as -1, as both engines then return whole numbers."""
    return rows.na.fill(-1)


@query(f"SELECT doc_id, sentence_id, block_no, child_no, text FROM ({SAID_SQL})")
def segment_documents(t, spark):
    return _filled(B.segment_documents(_notes(t)).drop("start", "end"))


@query(f"SELECT doc_id, block_no, child_no, string_agg(text, ' ' ORDER BY sentence_id) AS text FROM ({SAID_SQL}) GROUP BY doc_id, block_no, child_no")
def spoken_paragraphs(t, spark):
    return _filled(B.spoken_paragraphs(B.segment_documents(_notes(t))))


@query(f"SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words, count(*) AS sentences FROM ({SAID_SQL}) GROUP BY doc_id")
def document_word_counts(t, spark):
    return B.document_word_counts(B.segment_documents(_notes(t)))


@query(f"SELECT doc_id, block_no, child_no, string_agg(CAST(sentence_id AS VARCHAR), ',' ORDER BY sentence_id) AS ids FROM ({SAID_SQL}) GROUP BY doc_id, block_no, child_no")
def sentences_by_block(t, spark):
    return _filled(B.sentences_by_block(B.segment_documents(_notes(t))).select(*B.PATH, F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))


@query("SELECT doc_id, 0 AS block_no, -1 AS child_no, 1 AS level, '4.2 Notes on ' || source AS text FROM documents")
def heading_sentences(t, spark):
    return _filled(B.heading_sentences(B.markdown_blocks(_notes(t))))


KINDS_SQL = _values([(0, None, "heading", "4.2. Notes on @S"), (1, None, "paragraph", "Read doc_id of @L. It is number @N."), (2, None, "list-item", "first item goes on"), (3, None, "list-item", "second @T"), (4, None, "list-item", "third"), (5, None, "callout", None), (5, 0, "paragraph", "Mind the gap."), (6, None, "caption", "Figure 3 — Words of @N."), (7, None, "paragraph", "Key: lang. Value: @L."), (8, None, "paragraph", "Key: id. Value: @N."), (9, None, "code", "select @N")])
BLOCKS_SQL = f"SELECT doc_id, block_no, coalesce(child_no, -1) AS child_no, kind, {_FILLED} AS text FROM documents, (VALUES {KINDS_SQL}) v(block_no, child_no, kind, t)"


@query(BLOCKS_SQL)
def markdown_blocks(t, spark):
    return _filled(P.block_texts(B.markdown_blocks(_notes(t))))


@query(f"SELECT doc_id, block_no, text FROM ({BLOCKS_SQL}) WHERE kind = 'caption'")
def markdown_captions(t, spark):
    return B.captions(B.markdown_blocks(_notes(t))).drop("child_no")


@query(f"SELECT doc_id, block_no, '⚠️' AS icon, string_agg(text, '|' ORDER BY child_no) AS children FROM ({BLOCKS_SQL}) WHERE child_no >= 0 GROUP BY doc_id, block_no")
def markdown_callouts(t, spark):
    return B.callouts(B.markdown_blocks(_notes(t))).withColumn("children", F.array_join("children", "|"))


@query(f"""SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS \"{k}\"" for k in B.KINDS)} FROM ({BLOCKS_SQL}) GROUP BY doc_id""")
def block_kind_counts(t, spark):
    return B.block_profile(B.markdown_blocks(_notes(t)))


@query(f"SELECT doc_id, -1 AS parent, 1 AS list_no, false AS ordered, -1 AS start, string_agg(text, '|' ORDER BY block_no) AS items FROM ({BLOCKS_SQL}) WHERE kind = 'list-item' GROUP BY doc_id")
def list_groups(t, spark):
    return _filled(B.group_lists(B.markdown_blocks(_notes(t))).withColumn("items", F.array_join("items", "|")))


@query(f"SELECT doc_id, block_no, child_no, text FROM ({BLOCKS_SQL}) WHERE kind NOT IN ('code', 'callout')")
def display_text(t, spark):
    return _filled(B.markdown_blocks(_notes(t)).where("runs IS NOT NULL").select(*B.PATH, B.display_text(F.col("runs")).alias("text")))


@query("SELECT doc_id, line_no, text FROM (SELECT doc_id, 18 AS line_no, 'Key: lang. Value: ' || lang || '.' AS text FROM documents UNION ALL SELECT doc_id, 19, 'Key: id. Value: ' || doc_id || '.' FROM documents)")
def markdown_tables(t, spark):
    return M.table_rows(M.classify_lines(M.markdown_lines(_notes(t))))


@query(f"SELECT doc_id, v.line_no, coalesce(v.n, -1) AS ordered, {_FILLED} AS text FROM documents, (VALUES (2, NULL, 'first item goes on'), (4, NULL, 'second @T'), (6, 3, 'third')) v(line_no, n, t)")
def markdown_list_items(t, spark):
    return _filled(M.list_items(M.classify_lines(M.markdown_lines(_notes(t)))))


RUNS = [(0, 0, "4.2. Notes on @S", 0), (1, 0, "Read ", 0), (1, 1, "doc_id", 1), (1, 2, " of @L. It is number @N.", 0)]


@query(f"SELECT doc_id, run_no, {_FILLED} AS text, false AS bold, false AS italic, code = 1 AS code FROM documents, (VALUES {_values([r for r in RUNS if r[0] == 1])}) v(block_no, run_no, t, code)")
def inline_runs(t, spark):
    return B.inline_runs(_notes(t).select("doc_id", F.element_at(F.split("text", "\n"), 2).alias("text")))


@query("SELECT doc_id, 'a ' || lang || '|' || source || ' b' AS runs FROM documents")
def normalize_runs(t, spark):
    def run(text, bold):
        return F.struct(text.alias("text"), F.lit(bold).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("code"))

    runs = F.array(run(F.lit("  a​ "), False), run(F.concat(F.lit("  "), F.col("lang")), False), run(F.lit(""), False), run(F.concat(F.col("source"), F.lit("  ")), True), run(F.lit(" b  "), True))
    return t("documents").select("doc_id", F.array_join(F.transform(B.normalize_runs(runs), lambda r: r["text"]), "|").alias("runs"))


def _spans(t) -> DataFrame:
    notes = _notes(t)
    return B.sentence_run_spans(B.segment_documents(notes), B.run_rows(B.markdown_blocks(notes)))


SPANS = _values([(0, 0, "4.2. Notes on @S"), (1, 0, "Read "), (1, 1, "doc_id"), (1, 2, " of @L."), (2, 2, "It is number @N."), (3, 0, "first item goes on"), (4, 0, "second @T"), (5, 0, "third"), (6, 0, "Mind"), (6, 1, " the gap."), (7, 0, "Figure 3 — Words of @N."), (8, 0, "Key: lang."), (9, 0, "Value: @L."), (10, 0, "Key: id."), (11, 0, "Value: @N.")])


@query(f"SELECT doc_id, sentence_id, run_no, {_FILLED} AS text FROM documents, (VALUES {SPANS}) v(sentence_id, run_no, t)")
def sentence_run_spans(t, spark):
    return _spans(t).select("doc_id", "sentence_id", "run_no", "text")


@query(f"SELECT doc_id, sentence_id, replace(text, '4.2 ', '4.2. ') AS text FROM ({SAID_SQL}) WHERE kind <> 'code'")
def spoken_slices(t, spark):
    return B.spoken_slices(_spans(t))


@query("SELECT doc_id, unnest(range(3)) AS block_no, 'paragraph' AS kind, unnest([source, '', lang]) AS text FROM documents")
def paragraph_blocks(t, spark):
    return B.paragraphs_to_blocks(t("documents"), F.array("source", F.lit(""), "lang"))


@query("SELECT doc_id, 'see ' || source || ' in max Tokens of ' || lang || ' now at ' || 'example.org' AS text FROM documents")
def speakable_text(t, spark):
    text = F.concat(F.lit("![i](a.png)see [**"), F.col("source"), F.lit("**](http://x.y/z) in `maxTokens` <b>of</b> *"), F.col("lang"), F.lit("* _now_ at https://www.example.org/a?b"))
    return t("documents").select("doc_id", X.speakable(text).alias("text"))


@query("SELECT doc_id, md5('x ' || source || ' parent id 2 * 3 ' || text) AS bare FROM documents WHERE NOT regexp_matches(text, '[*_`<\\[]')")
def strip_inline_markdown(t, spark):
    text = F.concat(F.lit("![i](a.png)x **"), F.col("source"), F.lit("** `parent_id` 2 * 3 "), F.col("text"))
    return t("documents").where(~F.col("text").rlike(r"[*_`<\[]")).select("doc_id", F.md5(X.strip_inline(text)).alias("bare"))


# ---------------------------------------------------------------- plain documents


_CLOSE = "[\"''()]*"
_ABBREVIATED = f"(^|[^\\pL])({'|'.join(X.ABBREVIATIONS)})(\\. *)\x1f"
#: Pattern, replacement: a mark after every terminator, then those out again that end no sentence.
_CUTS = [
    (f"([.!?]+{_CLOSE} *)", "\\1\x1f"), ("\\.\x1f(\\pN)", ".\\1"), *[("(\\p{Lu}|\\p{Ll})\\.\x1f(\\p{Lu})", "\\1.\\2")] * 2,
    (f"(\\.{_CLOSE} *)\x1f([^\\pL\x1f.!?]*\\p{{Ll}})", "\\1\\2"), ("\x1f([-,:;.!?])", "\\1"), *[(_ABBREVIATED, "\\1\\2\\3")] * 2,
]


def _cut_sql(text: str) -> str:
    """Text cut into sentences with the space behind them, for what occurs in the driver's prose."""
    for pattern, new in _CUTS:
        text = f"regexp_replace({text}, '{pattern}', '{new}', '{'gi' if pattern == _ABBREVIATED else 'g'}')"
    return f"string_split({text}, '\x1f')"


def _ranges_sql(paragraphs: str) -> str:
    """(doc_id, block_no, i, start, end, text) of the non-blank pieces of paragraphs (doc_id, block_no, p)."""
    pieces = f"SELECT doc_id, block_no, unnest(range(len(cut))) AS i, unnest(cut) AS piece FROM (SELECT doc_id, block_no, {_cut_sql('p')} AS cut FROM ({paragraphs}))"
    placed = f"SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, block_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({pieces})"
    return f"SELECT doc_id, block_no, i, start, start + length(rtrim(piece)) AS \"end\", rtrim(piece) AS text FROM ({placed}) WHERE trim(piece) <> ''"


PROSE_SQL = "SELECT doc_id, list_filter([trim(regexp_replace(p, '\\s+', ' ', 'g')) FOR p IN string_split_regex(text, '\\n\\s*\\n')], lambda p: regexp_matches(p, '[\\pL\\pN]')) AS ps FROM documents"
#: Sentences of the whole texts, from their plain paragraphs.
READ_SQL = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, i) - 1 AS sentence_id, block_no, -1 AS child_no, start, "end", text
 FROM ({_ranges_sql(f"SELECT doc_id, unnest(range(len(ps))) AS block_no, unnest(ps) AS p FROM ({PROSE_SQL})")}) WHERE regexp_matches(text, '[\\pL\\pN]')"""


@query(f'SELECT doc_id, sentence_id, block_no, start, "end", text FROM ({READ_SQL})')
def segment_paragraphs(t, spark):
    return B.segment_paragraphs(t("documents")).drop("child_no")


@query(f"""SELECT doc_id, start, "end" FROM ({_ranges_sql("SELECT doc_id, 0 AS block_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS p FROM documents")})""")
def sentence_ranges(t, spark):
    return B.sentence_splits(t("documents").withColumn("text", X.normalize_whitespace(F.col("text"))))


@query(None)
def parse_corpus(t, spark):
    parsed, rejects = corpus.parse_corpus(_files(t), _styled_pieces(t))
    return L.combine(parsed.select("doc_id", "title", "source", "words", "sentences", F.size("blocks").alias("blocks")), rejects)


@query(f"""SELECT doc_id, source, title, 1 AS n_blocks, md5(said) AS text_md5, CAST(len(regexp_extract_all(said, '\\S+')) AS BIGINT) AS n_words FROM (SELECT doc_id, {SOURCE_SQL} AS source,
 trim(regexp_replace(regexp_replace(filename, '^(.+)\\.[^.]+$', '\\1'), '[_-]+', ' ', 'g')) AS title, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS said FROM ({FILES_SQL})) WHERE source = 'txt' AND regexp_matches(said, '[\\pL\\pN]')""")
def parsed_texts(t, spark):
    """Whole texts through the parser: one paragraph each, as none has a blank line."""
    parsed, _ = corpus.parse_corpus(_files(t).where(X.source_for_filename(F.col("filename")) == "txt"))
    said = B.display_text(F.get("blocks", F.lit(0))["runs"])
    return parsed.select("doc_id", "source", "title", F.size("blocks").alias("n_blocks"), F.md5(said).alias("text_md5"), X.count_words(said).cast("long").alias("n_words"))


@query(None)
def pdf_documents(t, spark):
    read = corpus.pdf_documents(_styled_pieces(t))
    return read.select("doc_id", "words", "sentences", F.size("blocks").alias("blocks"))


@query("SELECT doc_id, kind FROM (SELECT doc_id, 'paste' AS kind FROM (SELECT conv_id * 1000 + turn AS doc_id FROM conversations) UNION ALL SELECT doc_id, coalesce(" + SOURCE_SQL + ", 'none') FROM (" + FILES_SQL + "))")
def combined_library(t, spark):
    pasted = corpus.from_pasted(t("conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("source").alias("kind"))
    files = _files(t).select("doc_id", F.coalesce(X.source_for_filename(F.col("filename")), F.lit("none")).alias("kind"))
    return L.combine(pasted, files)


@query("SELECT doc_id, image_id, width FROM (SELECT doc_id, 'i' || doc_id || '-' || k AS image_id, (doc_id * k) % 900 AS width FROM documents, (VALUES (1), (2)) v(k)) WHERE doc_id IN (SELECT doc_id FROM labels)")
def images_by_document(t, spark):
    k = F.explode(F.array(F.lit(1), F.lit(2)))
    images = t("documents").select("doc_id", k.alias("k"), F.encode("text", "UTF-8").alias("bytes"))
    images = images.select("doc_id", F.concat(F.lit("i"), F.col("doc_id").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("image_id"), "bytes", ((F.col("doc_id") * F.col("k")) % 900).alias("width"))
    return L.images_for_docs(images, t("labels"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'heading:' || lang WHEN 1 THEN 'paragraph:' || source || '|paragraph:' || lang ELSE '' END AS blocks FROM documents")
def legacy_doc_blocks(t, spark):
    kind = F.col("doc_id") % 3
    new = F.when(kind == 0, F.array(F.struct(F.lit("heading").alias("kind"), F.col("lang").alias("text"))))
    rows = t("documents").select("doc_id", new.alias("blocks"), F.when(kind == 1, F.array("source", "lang")).alias("paragraphs"))
    return L.doc_blocks(rows).select("doc_id", F.array_join(F.transform("blocks", lambda b: F.concat(b["kind"], F.lit(":"), b["text"])), "|").alias("blocks"))


VOICE_ROWS = _values([(i, L.VOICE_PREFIX + v, n, "en-GB" if b else "en-US", g) for i, (v, n, b, g) in enumerate(L.VOICES)])


@query(f"SELECT c_custkey, id, name, lang, grade FROM customer JOIN (VALUES {VOICE_ROWS}) v(rank, id, name, lang, grade) ON c_custkey % {len(L.VOICES)} = rank")
def voice_catalogue(t, spark):
    voices = F.broadcast(L.voices(spark))
    return t("customer").join(voices, F.col("c_custkey") % len(L.VOICES) == F.col("rank")).select("c_custkey", "id", "name", "lang", "grade")


@query(f"SELECT lang, grade, count(*) AS voices FROM customer JOIN (VALUES {VOICE_ROWS}) v(rank, id, name, lang, grade) ON c_custkey % {len(L.VOICES)} = rank GROUP BY lang, grade")
def voice_counts(t, spark):
    return L.voice_counts(voice_catalogue(t, spark))


# ---------------------------------------------------------------- PDF pieces, from the places of words

PER_LINE, PER_PAGE = 8, 30
PIECES_SQL = f"""SELECT doc_id, i, i // {PER_LINE} AS l, CAST(i // {PER_LINE * PER_PAGE} AS BIGINT) AS page_no, word AS str, 72.0 + (i % {PER_LINE}) * 50 AS x,
 700.0 - (i // {PER_LINE}) % {PER_PAGE} * 20 - ((i // {PER_LINE}) % {PER_PAGE} // 5) * 12 AS base, CASE WHEN i % 7 = 0 THEN NULL WHEN i % 5 = 0 THEN 50.0 ELSE 44.0 END AS width
 FROM (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents))"""
ROWS_SQL = f"""SELECT doc_id, page_no, CAST(1 + (l % {PER_PAGE}) AS BIGINT) AS row_no, CAST(max(base) + max(CASE WHEN i % 2 = 1 THEN 0.5 ELSE 0 END) AS DOUBLE) AS y, string_agg(glue || str, '' ORDER BY i) AS text
 FROM (SELECT *, CASE WHEN i % {PER_LINE} = 0 OR x - lag(x + width) OVER (PARTITION BY doc_id, l ORDER BY i) < 0.8 THEN '' ELSE ' ' END AS glue FROM ({PIECES_SQL})) GROUP BY doc_id, page_no, l"""
PAGES_SQL = f"SELECT doc_id, CAST(unnest(range((n - 1) // {PER_LINE * PER_PAGE} + 1)) AS BIGINT) AS page_no FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS n FROM documents) WHERE n > 0"
LINES_SQL = f"""SELECT * FROM ({ROWS_SQL}) UNION ALL SELECT doc_id, page_no, 0, 760.0, 'Report ' || page_no FROM ({PAGES_SQL})
 UNION ALL SELECT doc_id, page_no, 1 + (SELECT max(row_no) FROM ({ROWS_SQL}) r WHERE r.doc_id = p.doc_id AND r.page_no = p.page_no), 10.0, 'Page ' || (page_no + 1) FROM ({PAGES_SQL}) p"""


def _words(t) -> DataFrame:
    return t("documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("i", "str"))


def _pieces(t) -> DataFrame:
    i, line = F.col("i"), F.floor(F.col("i") / PER_LINE).cast("int")
    row, page = line % PER_PAGE, F.floor(line / PER_PAGE).cast("int")
    y = F.lit(700.0) - row * 20 - F.floor(row / 5) * 12 + F.when(i % 2 == 1, 0.5).otherwise(0.0)
    width = F.when(i % 7 == 0, None).when(i % 5 == 0, 50.0).otherwise(44.0)

    def piece(number, text, x, y, width):
        return F.struct(number.cast("int").alias("piece_no"), text.alias("str"), x.alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"))

    word = piece(i, F.col("str"), F.lit(72.0) + (i % PER_LINE) * 50, y, width)
    margins = [(-1, F.concat(F.lit("Report "), page.cast("string")), 760.0), (1 << 30, F.concat(F.lit("Page "), (page + 1).cast("string")), 10.0), ((1 << 30) + 1, F.lit("  "), 5.0)]
    with_margins = F.array(word, *[piece(F.lit(n), text, F.lit(72.0), F.lit(y), F.lit(40.0)) for n, text, y in margins])
    all_pieces = F.when(i % (PER_LINE * PER_PAGE) == 0, with_margins).otherwise(F.array(word))
    return _words(t).select("doc_id", page.alias("page_no"), F.inline(all_pieces))


def _page_lines(t) -> DataFrame:
    return P.page_rows(_pieces(t))


@query(f"SELECT doc_id, page_no, i AS piece_no, 1 + l % {PER_PAGE} AS row_no FROM ({PIECES_SQL})")
def pdf_baseline_rows(t, spark):
    return P.baseline_rows(_pieces(t)).where(f"piece_no BETWEEN 0 AND {(1 << 30) - 1}").select("doc_id", "page_no", "piece_no", "row_no")


@query(f"SELECT doc_id, page_no, row_no AS line_no, text FROM ({LINES_SQL})")
def pdf_lines(t, spark):
    return P.group_into_lines(_pieces(t))


@query(f"""SELECT doc_id, page_no, row_no, coalesce(typical > 0 AND step > typical * 1.4, false) AS gap FROM (SELECT *, median(step) OVER (PARTITION BY doc_id, page_no) AS typical
 FROM (SELECT *, lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY row_no) - y AS step FROM ({LINES_SQL})))""")
def pdf_paragraph_breaks(t, spark):
    return P.paragraph_breaks(_page_lines(t)).select("doc_id", "page_no", "row_no", "gap")


LONG_SQL = f"SELECT doc_id FROM ({PAGES_SQL}) GROUP BY doc_id HAVING count(*) >= 3"


@query(f"SELECT doc_id, unnest(['report #', 'page #']) AS key FROM ({LONG_SQL})")
def running_headers(t, spark):
    return P.running_keys(P.group_into_lines(_pieces(t)))


@query(f"SELECT doc_id, page_no, row_no AS line_no, text FROM ({LINES_SQL}) WHERE y BETWEEN 11 AND 759 OR doc_id NOT IN ({LONG_SQL})")
def drop_running_headers(t, spark):
    return P.drop_running_headers(P.group_into_lines(_pieces(t)))


@query(None)
def pdf_plain_paragraphs(t, spark):
    return P.plain_paragraphs(_page_lines(t))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR NOT regexp_matches(text, '[A-Za-z]')")
def scanned_documents(t, spark):
    pieces = _words(t).select("doc_id", F.floor(F.col("i") / 500).cast("int").alias("page_no"), F.col("i").alias("piece_no"), F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("str")).alias("str"), (F.col("i") * 50.0).alias("x"), F.lit(700.0).alias("y"), F.lit(44.0).alias("width"))
    return P.scanned_documents(t("documents").select("doc_id"), P.group_into_lines(pieces))


FONTS = ("BAAAAA+Inter_700wght", "Times-BoldItalic", "Courier", "Arial-Oblique", "Inter_400wght")


@query("SELECT o_orderkey, o_orderkey % 5 IN (0, 1) AS bold, o_orderkey % 5 IN (1, 3) AS italic, o_orderkey % 5 = 2 AS mono FROM orders")
def piece_font_styles(t, spark):
    n = F.col("o_orderkey") % 5
    named = t("orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, FONTS)), (n + 1).cast("int")).alias("font_name"), F.when(n == 2, "monospace").otherwise("serif").alias("font_family"))
    return P.piece_styles(named).select("o_orderkey", "bold", "italic", "mono")


# ---------------------------------------------------------------- styled lines, from orders: a customer is a document

ONLY_SQL = f"regexp_matches(text, '^({P.PICTOGRAPH}| )+$')"
STYLED_SQL = """SELECT o_custkey AS doc_id, o_orderkey % 3 AS page_no, o_orderkey AS line_no, CASE o_orderkey % 11 WHEN 0 THEN 90.0 WHEN 1 THEN 80.0 ELSE 72.0 END AS x, 3000000.0 - 12 * o_orderkey AS y,
 CASE o_orderkey % 13 WHEN 0 THEN 24.0 WHEN 1 THEN 15.0 WHEN 2 THEN 12.5 ELSE 10.0 END AS height, o_orderkey % 7 = 0 AS all_mono, o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 AS bold,
 CASE o_orderkey % 6 WHEN 0 THEN 'Figure 2 ' || o_orderpriority WHEN 1 THEN '12. item' WHEN 2 THEN o_orderstatus || ':' WHEN 3 THEN 'ℹ ' || o_orderpriority WHEN 4 THEN '✓ ' || o_orderpriority ELSE CASE WHEN o_orderkey % 30 = 5 THEN '📖 ℹ' ELSE o_orderpriority END END AS text FROM orders"""
METRICS_SQL = f"""SELECT doc_id, coalesce(body, 12.0) AS body, coalesce(margin, 72.0) AS margin, mono_share FROM (SELECT doc_id, avg(CAST(all_mono AS DOUBLE)) AS mono_share FROM ({STYLED_SQL}) GROUP BY doc_id)
 LEFT JOIN (SELECT doc_id, arg_min(v, (-n, p, l)) AS body FROM (SELECT doc_id, floor(height * 10 + 0.5) / 10 AS v, count(*) AS n, min((page_no, line_no))[1] AS p, min((page_no, line_no))[2] AS l FROM ({STYLED_SQL}) WHERE NOT all_mono AND NOT ({ONLY_SQL}) GROUP BY 1, 2) GROUP BY doc_id) USING (doc_id)
 LEFT JOIN (SELECT doc_id, arg_min(v, (-n, p, l)) AS margin FROM (SELECT doc_id, floor(x + 0.5) AS v, count(*) AS n, min((page_no, line_no))[1] AS p, min((page_no, line_no))[2] AS l FROM ({STYLED_SQL}) WHERE NOT all_mono AND NOT ({ONLY_SQL}) GROUP BY 1, 2) GROUP BY doc_id) USING (doc_id)"""
LEADING_SQL = f"""SELECT doc_id, median(step) AS "leading" FROM (SELECT doc_id, CASE WHEN fits AND lag(fits) OVER w AND lag(y) OVER w > y THEN lag(y) OVER w - y END AS step
 FROM (SELECT s.*, NOT all_mono AND abs(height - body) < 0.5 AS fits FROM ({STYLED_SQL}) s JOIN ({METRICS_SQL}) USING (doc_id)) WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)) GROUP BY doc_id"""
FULL_METRICS_SQL = f'SELECT doc_id, body, margin, coalesce(nullif("leading", 0), body * 1.5) AS "leading", mono_share FROM ({METRICS_SQL}) LEFT JOIN ({LEADING_SQL}) USING (doc_id)'
KIND_SQL = f"""SELECT *, CASE WHEN regexp_matches(text, '^{P.PICTOGRAPH}') AND x >= margin + 5 THEN 'callout-open' WHEN {ONLY_SQL} THEN 'drop' WHEN NOT all_mono AND height >= 2.2 * body THEN 'h1' WHEN NOT all_mono AND bold AND height >= 1.4 * body THEN 'h2' WHEN NOT all_mono AND bold AND height >= 1.2 * body THEN 'h3'
 WHEN all_mono AND x >= margin + 5 THEN 'code' WHEN bold AND text LIKE '%:' THEN 'meta' WHEN text LIKE 'Figure 2%' THEN 'caption' WHEN x >= margin + 8 AND x < margin + 30 THEN 'list' ELSE 'paragraph' END AS k FROM ({STYLED_SQL}) JOIN ({FULL_METRICS_SQL}) USING (doc_id)"""
KINDS_REFINED_SQL = f"""SELECT *, CASE WHEN k = 'list' AND NOT regexp_matches(text, '^\\d+[.)]') AND coalesce(abs(lead(x) OVER w - margin) <= 4 AND y - lead(y) OVER w <= 1.2 * "leading", false) THEN 'paragraph' ELSE k END AS kind
 FROM ({KIND_SQL}) WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)"""


def _styled(t) -> DataFrame:
    n = F.col("o_orderkey")
    text = F.when(n % 6 == 0, F.concat(F.lit("Figure 2 "), "o_orderpriority")).when(n % 6 == 1, "12. item").when(n % 6 == 2, F.concat("o_orderstatus", F.lit(":"))).when(n % 6 == 3, F.concat(F.lit("ℹ "), "o_orderpriority")).when(n % 6 == 4, F.concat(F.lit("✓ "), "o_orderpriority")).when(n % 30 == 5, "📖 ℹ").otherwise(F.col("o_orderpriority"))
    mono, x = n % 7 == 0, F.when(n % 11 == 0, 90.0).when(n % 11 == 1, 80.0).otherwise(72.0)
    height = F.when(n % 13 == 0, 24.0).when(n % 13 == 1, 15.0).when(n % 13 == 2, 12.5).otherwise(10.0)
    run = F.struct(text.alias("text"), ((n % 5 == 0) & ~mono).alias("bold"), F.lit(False).alias("italic"), mono.alias("code"))
    return t("orders").select(F.col("o_custkey").cast("long").alias("doc_id"), (n % 3).cast("int").alias("page_no"), n.cast("int").alias("line_no"), x.alias("x"), x.alias("body_x"), (F.lit(3000000.0) - 12 * n).cast("double").alias("y"), height.alias("height"), mono.alias("all_mono"), F.array(run).alias("runs"), text.alias("text"))


@query(f'SELECT doc_id, round(body, 4) AS body, margin, round(CAST("leading" AS DOUBLE), 4) AS "leading", round(mono_share, 6) AS mono_share FROM ({FULL_METRICS_SQL})')
def pdf_doc_metrics(t, spark):
    return P.doc_metrics(_styled(t)).select("doc_id", F.round("body", 4).alias("body"), "margin", F.round("leading", 4).alias("leading"), F.round("mono_share", 6).alias("mono_share"))


@query(f"SELECT doc_id, page_no, line_no, kind FROM ({KINDS_REFINED_SQL})")
def pdf_line_kinds(t, spark):
    lines = _styled(t)
    return P.classify_lines(lines).select("doc_id", "page_no", "line_no", "kind")


@query(f"SELECT doc_id, round(CASE WHEN max(mono_share) > 0.5 THEN 0.0 ELSE avg(CAST(kind <> 'paragraph' AS DOUBLE)) END, 6) AS ratio FROM ({KINDS_REFINED_SQL}) GROUP BY doc_id")
def pdf_structure_ratio(t, spark):
    return P.structure_ratio(_styled(t)).withColumn("ratio", F.round("ratio", 6))


@query(f"""SELECT doc_id, string_agg(s, chr(10) ORDER BY page_no, line_no) AS code_text FROM (SELECT doc_id, page_no, line_no, repeat(chr(10), CAST(coalesce(greatest(floor((lag(y) OVER w - y) / (1.5 * height) + 0.5) - 1, 0), 0) AS INT))
 || repeat(' ', CAST(floor((x - min(x) OVER (PARTITION BY doc_id)) / (0.6 * height) + 0.5) AS INT)) || text AS s FROM ({STYLED_SQL}) WHERE all_mono WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)) GROUP BY doc_id""")
def pdf_code_text(t, spark):
    near = _styled(t).where("all_mono")
    return P.code_text(near)


def _styled_pieces(t) -> DataFrame:
    n = F.col("piece_no")
    styles = {"height": F.when(n % 9 == 0, 14.0).otherwise(10.0), "bold": n % 9 == 0, "italic": n % 11 == 0, "mono": n % 5 == 0}
    return _pieces(t).withColumns(styles)


@query(f"""SELECT doc_id, page_no, 1 + (l % {PER_PAGE}) AS row_no, arg_min(height, (-n, first)) AS height FROM (SELECT doc_id, page_no, l, CASE WHEN i % 9 = 0 THEN 14.0 ELSE 10.0 END AS height, sum(len(str)) AS n, min(i) AS first
 FROM (SELECT *, max(CAST(i % 5 <> 0 AS INT)) OVER (PARTITION BY doc_id, l) = 1 AS prose FROM ({PIECES_SQL})) WHERE i % 5 <> 0 OR NOT prose GROUP BY ALL) GROUP BY doc_id, page_no, l""")
def pdf_line_heights(t, spark):
    return P.line_heights(_styled_pieces(t)).where(f"piece_no BETWEEN 0 AND {(1 << 30) - 1}").drop("piece_no")


@query(None)
def pdf_styled_lines(t, spark):
    return P.styled_lines(_styled_pieces(t)).select("doc_id", "page_no", "line_no", "x", "y", "height", "all_mono", "text")


@query(None)
def pdf_blocks(t, spark):
    lines = _styled(t)
    return P.block_texts(P.build_blocks(lines, _figures(t)))


BOXES_SQL = "SELECT o_custkey AS doc_id, o_orderkey % 3 AS page_no, o_orderkey AS box_no, 3000000.0 - 12 * o_orderkey - 5 AS y, 20.0 + o_orderkey % 600 AS width, 40.5 + o_orderkey % 700 AS height FROM orders WHERE o_orderkey % 4 = 0"
FIGURES_SQL = f"SELECT doc_id, page_no, sha256(doc_id || '|' || page_no || '|' || box_no) AS image_id, y + height AS y, CAST(floor(width + 0.5) AS INT) AS width, CAST(floor(height + 0.5) AS INT) AS height FROM ({BOXES_SQL}) WHERE width >= 48 AND height >= 48 AND width * height <= 0.75 * 500 * 700"


def _figures(t) -> DataFrame:
    n = F.col("o_orderkey")
    boxes = t("orders").where(n % 4 == 0).select(F.col("o_custkey").cast("long").alias("doc_id"), (n % 3).cast("int").alias("page_no"), n.alias("box_no"), F.lit(10.0).alias("x"), (F.lit(3000000.0) - 12 * n - 5).cast("double").alias("y"), (F.lit(20.0) + n % 600).alias("width"), (F.lit(40.5) + n % 700).alias("height"))
    pages = boxes.select("doc_id", "page_no").distinct().withColumns({"page_width": F.lit(500.0), "page_height": F.lit(700.0)})
    return P.figure_marks(P.figure_boxes(boxes, pages))


@query(FIGURES_SQL)
def pdf_figures(t, spark):
    return _figures(t)


@query(f"""SELECT doc_id, page_no, type, ref, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, type DESC, k, ref) - 1 AS item_no FROM (SELECT doc_id, page_no, y, 'line' AS type, CAST(line_no AS VARCHAR) AS ref, line_no AS k FROM ({STYLED_SQL})
 UNION ALL SELECT doc_id, page_no, y, 'figure', image_id, NULL FROM ({FIGURES_SQL}))""")
def pdf_page_items(t, spark):
    return P.page_items(_styled(t), _figures(t)).drop("y")
