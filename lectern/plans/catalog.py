"""The queries by name, each over whole tables, and the same in DuckDB SQL.

The driver's tables hold plain prose, so inputs with structure (file names, Markdown, positions) are projected
from them inside each query, and again in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import estimate as E
from lectern.functions import text as X
from lectern.operators import library as L
from lectern.operators import markdown as M
from lectern.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name) for f in df.schema.fields])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: _longs(f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- inputs

FILES_SQL = """SELECT doc_id, text, (CASE doc_id % 4 WHEN 0 THEN 'report_' WHEN 1 THEN 'my-long__notes-' WHEN 2 THEN '.' ELSE 'v1.2 notes ' END)
 || CAST(doc_id AS VARCHAR) || (CASE doc_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' WHEN 3 THEN '.doc' WHEN 4 THEN '' WHEN 5 THEN '.markdown' ELSE '.' END) AS filename FROM documents"""
SOURCE_SQL = """CASE WHEN regexp_matches(filename, '^.+\\.[^.]+$') THEN
 CASE lower(regexp_extract(filename, '^.+\\.([^.]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'md' THEN 'md' WHEN 'markdown' THEN 'md' WHEN 'txt' THEN 'txt' WHEN 'text' THEN 'txt' END END"""
LINES_SQL = "SELECT doc_id, unnest(range(len(ls))) AS sentence_id, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
SENTENCES_SQL = f"SELECT doc_id, sentence_id, text, len(regexp_extract_all(text, '\\S+')) AS words FROM ({LINES_SQL})"
PROGRESS_SQL = "SELECT user_id AS doc_id, CAST(floor(arg_max(value, (ts, event_id)) / 10) AS BIGINT) AS sentence_index FROM events GROUP BY user_id"
LIBRARY_SQL = "SELECT doc_id, 'Document ' || doc_id AS title, source, (doc_id * 7919) % 1009 AS added_at, len(regexp_extract_all(text, '\\S+')) AS word_count FROM documents"
COUNTS_SQL = f"SELECT doc_id, count(*) AS n FROM ({LINES_SQL}) GROUP BY doc_id"
SECONDS = "(CASE WHEN {0} <= 0 THEN 0.0 ELSE {0} / 160.0 * 60 END)"
REMAINING = "(CASE WHEN floor({0} + 0.5) <= 0 THEN 'finished' WHEN floor(floor({0} + 0.5) / 60 + 0.5) < 1 THEN 'under a minute left' ELSE CAST(CAST(floor(floor({0} + 0.5) / 60 + 0.5) AS BIGINT) AS VARCHAR) || ' min left' END)"


def _files(t) -> DataFrame:
    d = F.col("doc_id")
    stem = F.element_at(F.array(*map(F.lit, ("report_", "my-long__notes-", ".", "v1.2 notes "))), (d % 4 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".PDF", ".md", ".txt", ".doc", "", ".markdown", "."))), (d % 7 + 1).cast("int"))
    return t("documents").select("doc_id", "text", F.concat(stem, d.cast("string"), ending).alias("filename"))


def _lines(t) -> DataFrame:
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("sentence_id", "text"))


def _sentences(t) -> DataFrame:
    return _lines(t).withColumn("words", X.count_words(F.col("text")))


def _events(t) -> DataFrame:
    return t("events").select("event_id", F.col("user_id").alias("doc_id"), F.floor(F.col("value") / 10).alias("sentence_index"), F.col("ts").alias("updated_at"))


def _library(t) -> DataFrame:
    return t("documents").select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "source", "text", ((F.col("doc_id") * 7919) % 1009).alias("added_at"), X.count_words(F.col("text")).alias("word_count"))


def _counts(t) -> DataFrame:
    return t("documents").select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"))


# ---------------------------------------------------------------- sources and names


@query(f"SELECT doc_id, filename, {SOURCE_SQL} AS kind FROM ({FILES_SQL})")
def source_for_filename(t, spark):
    return _files(t).select("doc_id", "filename", X.source_for_filename(F.col("filename")).alias("kind"))


@query(f"""SELECT doc_id, CASE WHEN x = '' THEN 'Untitled' ELSE x END AS title FROM (
 SELECT doc_id, trim(regexp_replace(regexp_replace(filename, '^(.+)\\.[^.]+$', '\\1'), '[_-]+', ' ', 'g')) AS x FROM ({FILES_SQL}))""")
def title_for_filename(t, spark):
    return _files(t).select("doc_id", X.title_for_filename(F.col("filename")).alias("title"))


@query(f"SELECT coalesce({SOURCE_SQL}, 'unsupported') AS kind, count(*) AS n FROM ({FILES_SQL}) GROUP BY 1")
def corpus_by_source(t, spark):
    return _files(t).groupBy(F.coalesce(X.source_for_filename(F.col("filename")), F.lit("unsupported")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, 'paste' AS source, 'Pasted text' AS title, len(regexp_extract_all(text, '\\S+')) AS word_count FROM conversations")
def pasted_documents(t, spark):
    return corpus.from_pasted(t("conversations")).select("conv_id", "turn", "source", "title", X.count_words(F.col("text")).alias("word_count"))


@query(f"""SELECT doc_id, CASE WHEN {SOURCE_SQL} IS NULL THEN 'unsupported' WHEN text IS NULL THEN 'unreadable' ELSE 'empty' END AS kind
 FROM ({FILES_SQL}) WHERE {SOURCE_SQL} IS NULL OR text IS NULL OR NOT regexp_matches(text, '[\\pL\\pN]')""")
def rejected_documents(t, spark):
    return corpus.split_rejects(_files(t).withColumn("source", X.source_for_filename(F.col("filename"))))[1]


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS source, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents
 UNION ALL SELECT doc_id + 1000000000, source, 2 FROM documents WHERE doc_id % 5 = 0""")
def upsert_documents(t, spark):
    base = t("documents").select("doc_id", "source", F.lit(1).alias("version"))
    new = base.where("doc_id % 5 = 0").select((F.col("doc_id") + 1000000000).alias("doc_id"), "source", F.lit(2).alias("version"))
    updates = base.where("doc_id % 3 = 0").select("doc_id", F.upper("source").alias("source"), F.lit(2).alias("version")).unionByName(new)
    return L.upsert(base, updates, "doc_id", "version")


# ---------------------------------------------------------------- scalar text


@query("SELECT doc_id, md5(trim(regexp_replace('  ' || replace(text, ' ', chr(160) || ' ') || chr(8203), '[\\s\\x{A0}\\x{200B}]+', ' ', 'g'))) AS clean FROM documents")
def normalize_whitespace(t, spark):
    messy = F.concat(F.lit("  "), F.regexp_replace("text", " ", "  "), F.lit("​"))
    return t("documents").select("doc_id", F.md5(X.normalize_whitespace(messy)).alias("clean"))


@query("SELECT doc_id, unnest(range(len(ls))) AS line_no, md5(unnest(ls)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
def split_lines(t, spark):
    crlf = F.regexp_replace("text", "\n", "\r\n")
    return t("documents").select("doc_id", F.posexplode(X.split_lines(crlf)).alias("line_no", "line")).withColumn("line", F.md5("line"))


@query(f"SELECT doc_id, sentence_id FROM ({LINES_SQL}) WHERE doc_id % 3 = 0 OR NOT regexp_matches(text, '[\\pL\\pN]')")
def wordless_filter(t, spark):
    """Lines without words; those of every third document are made wordless first."""
    text = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"[\p{L}\p{N}]", "*")).otherwise(F.col("text"))
    return _lines(t).withColumn("text", text).where(~X.has_words(F.col("text"))).select("doc_id", "sentence_id")


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(c, '[_-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')) AS spoken
 FROM (SELECT p_partkey, 'HTTPPart_' || p_partkey || 'sizeOf' || (p_partkey % 10) || 'XMLItem' AS c FROM part)""")
def spoken_identifier(t, spark):
    key = F.col("p_partkey").cast("string")
    code = F.concat(F.lit("HTTPPart_"), key, F.lit("sizeOf"), (F.col("p_partkey") % 10).cast("string"), F.lit("XMLItem"))
    return t("part").select("p_partkey", X.spoken_identifier(code).alias("spoken"))


@query("SELECT page_id, 'See ' || regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^www\\.', '') || ', now.' AS spoken FROM pages")
def spoken_urls(t, spark):
    return t("pages").select("page_id", X.spoken_urls(F.concat(F.lit("See "), F.regexp_replace("url", "[.,;:!?]+$", ""), F.lit(", now."))).alias("spoken"))


@query("SELECT page_id, md5(regexp_replace(html, '</?[A-Za-z][A-Za-z0-9-]*(\\s[^<>]*)?/?>', ' ', 'g')) AS bare FROM pages")
def strip_html_tags(t, spark):
    return t("pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("bare"))


ROW_SQL = "'| ' || o_orderkey || ' | ' || o_orderpriority || '  |' || ' * |'"


@query(f"SELECT o_orderkey, unnest(range(3)) AS i, trim(unnest(string_split(regexp_replace(regexp_replace(trim({ROW_SQL}), '^\\|', ''), '\\|$', ''), '|'))) AS cell FROM orders")
def table_cells(t, spark):
    return t("orders").select("o_orderkey", F.posexplode(X.table_cells(_order_row())).alias("i", "cell"))


@query("SELECT o_orderkey, 'Key: ' || o_orderkey || '. Value: ' || o_orderpriority || '.' AS said FROM orders")
def spoken_table_rows(t, spark):
    headers = F.array(F.lit("Key"), F.lit("**Value**"), F.lit("Mark"))
    return t("orders").select("o_orderkey", X.spoken_table_row(headers, X.table_cells(_order_row())).alias("said"))


def _order_row():
    return F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_orderpriority"), F.lit("  | * |"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'e ([a-z])', 'e-' || chr(10) || '\\1', 'g'), '(\\pL)-' || chr(10) || '(\\p{Ll})', '\\1\\2', 'g')) AS joined FROM documents""")
def join_hyphenated_lines(t, spark):
    broken = F.regexp_replace("text", "e ([a-z])", "e-\n$1")
    return t("documents").select("doc_id", F.md5(F.array_join(X.join_hyphenated(X.split_lines(broken)), "\n")).alias("joined"))


PARAGRAPHS_SQL = "SELECT doc_id, list_filter([trim(regexp_replace(p, '\\s+', ' ', 'g')) FOR p IN string_split_regex(regexp_replace(text, '\\.\\n', '.' || chr(10) || ' ' || chr(10), 'g'), '\\n\\s*\\n')], lambda p: p <> '') AS ps FROM documents"


@query(f"SELECT doc_id, unnest(range(len(ps))) AS para_no, md5(unnest(ps)) AS para FROM ({PARAGRAPHS_SQL})")
def lines_to_paragraphs(t, spark):
    return _broken(t).select("doc_id", F.posexplode(X.lines_to_paragraphs(X.split_lines(F.col("text")))).alias("para_no", "para")).withColumn("para", F.md5(X.normalize_whitespace(F.col("para"))))


@query(f"SELECT doc_id, unnest(range(len(ps))) AS para_no, md5(unnest(ps)) AS para FROM (SELECT doc_id, list_filter(ps, lambda p: regexp_matches(p, '[\\pL\\pN]')) AS ps FROM ({PARAGRAPHS_SQL}))")
def plain_paragraphs(t, spark):
    return X.spread(_broken(t)).select("doc_id", F.posexplode(X.plain_paragraphs(F.col("text"))).alias("para_no", "para")).withColumn("para", F.md5("para"))


def _broken(t) -> DataFrame:
    return t("documents").select("doc_id", F.regexp_replace("text", r"\.\n", ".\n \n").alias("text"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words FROM documents")
def word_counts(t, spark):
    return t("documents").select("doc_id", X.count_words(F.col("text")).alias("words"))


@query("SELECT doc_id, regexp_replace((doc_id % 30) || '.' || (doc_id % 7) || '. Part ' || source, '^(\\d+(?:\\.\\d+)*)\\.\\s+', '\\1 ') AS heading FROM documents")
def heading_section_numbers(t, spark):
    raw = F.concat((F.col("doc_id") % 30).cast("string"), F.lit("."), (F.col("doc_id") % 7).cast("string"), F.lit(". Part "), F.col("source"))
    return t("documents").select("doc_id", X.strip_section_period(raw).alias("heading"))


@query(f"SELECT doc_id, sentence_id FROM ({LINES_SQL}) WHERE lower(regexp_extract(text, '(\\pL+)\\.\\s*$', 1)) IN ({', '.join(repr(a) for a in X.ABBREVIATIONS)})")
def abbreviation_endings(t, spark):
    return _lines(t).where(X.ends_with_abbreviation(F.col("text"))).select("doc_id", "sentence_id")


# ---------------------------------------------------------------- Markdown lines

MARKDOWN_SQL = """SELECT doc_id, '## ' || doc_id || '. Notes from ' || source || chr(10) || '**Language**: ' || lang || chr(10) || '```sql' || chr(10) || '# not a heading' || chr(10)
 || 'select ' || doc_id || chr(10) || '```' || chr(10) || '- first' || chr(10) || '1. second' || chr(10) || '* * *' || chr(10) || '| a | b |' || chr(10) || '| -- | :-: |' || chr(10) || chr(10) || '> quoted' || chr(10) || text
 || (CASE WHEN doc_id % 4 = 0 THEN chr(10) || '~~~' || chr(10) || 'lost' ELSE '' END) AS text FROM documents"""
RAW_CLASSED_SQL = f"""SELECT doc_id, line_no, line, fence_no, CASE WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 'fence' WHEN fence_no % 2 = 1 THEN 'code'
 WHEN regexp_matches(line, '^\\s*((-\\s*){{3,}}|(\\*\\s*){{3,}}|(_\\s*){{3,}})$') THEN 'rule' WHEN regexp_matches(line, '(?i)^\\s*!\\s*[\\w./-]+\\.(svg|png|jpe?g|gif|webp)\\s*$') THEN 'image'
 WHEN regexp_matches(line, '^\\s*(#{{1,6}})\\s+') THEN 'heading' WHEN regexp_matches(line, '^\\s*\\|(\\s*:?-{{2,}}:?\\s*\\|)+\\s*$') THEN 'separator' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'row'
 WHEN regexp_matches(line, '^\\s*\\*\\*[^*]+\\*\\*\\s*:') THEN 'meta' WHEN regexp_matches(line, '^\\s*[-*+]\\s+') THEN 'bullet' WHEN regexp_matches(line, '^\\s*\\d+[.)]\\s+') THEN 'numbered'
 WHEN regexp_matches(line, '^\\s*>') THEN 'quote' WHEN regexp_matches(line, '^\\s*$') THEN 'blank' ELSE 'text' END AS class0
 FROM (SELECT *, sum(CAST(regexp_matches(line, '^\\s*(```|~~~)') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS fence_no
 FROM (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM ({MARKDOWN_SQL}))))"""

CLASSED_SQL = f"""SELECT * EXCLUDE (class0, piped, heads, run_no, head), CASE WHEN NOT piped THEN class0 WHEN head IS NULL OR line_no < head THEN 'text' WHEN line_no = head THEN 'header' WHEN line_no = head + 1 THEN 'separator' ELSE 'row' END AS class
 FROM (SELECT *, min(CASE WHEN heads THEN line_no END) OVER (PARTITION BY doc_id, run_no) AS head FROM (SELECT *, sum(CAST(NOT piped AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS run_no,
 piped AND coalesce(lead(class0) OVER (PARTITION BY doc_id ORDER BY line_no) = 'separator', false) AS heads FROM (SELECT *, class0 IN ('row', 'separator') AS piped FROM ({RAW_CLASSED_SQL}))))"""


def _markdown(t) -> DataFrame:
    d = F.col("doc_id").cast("string")
    head = F.concat(F.lit("## "), d, F.lit(". Notes from "), F.col("source"), F.lit("\n**Language**: "), F.col("lang"), F.lit("\n```sql\n# not a heading\nselect "), d)
    rest = F.concat(F.lit("\n```\n- first\n1. second\n* * *\n| a | b |\n| -- | :-: |\n\n> quoted\n"), F.col("text"), F.when(F.col("doc_id") % 4 == 0, "\n~~~\nlost").otherwise(""))
    return M.classify_lines(M.markdown_lines(t("documents").select("doc_id", F.concat(head, rest).alias("text"))))


@query(f"SELECT doc_id, line_no, class FROM ({CLASSED_SQL})")
def markdown_line_classes(t, spark):
    return _markdown(t).select("doc_id", "line_no", "class")


@query(f"SELECT doc_id, line_no, least(len(regexp_extract(line, '^\\s*(#+)', 1)), 3) AS level, trim(regexp_replace(line, '^\\s*#+\\s+', '')) AS title FROM ({CLASSED_SQL}) WHERE class = 'heading'")
def markdown_headings(t, spark):
    return M.headings(_markdown(t))


@query(f"SELECT doc_id, line_no, regexp_extract(line, '^\\s*\\*\\*([^*]+)\\*\\*\\s*:\\s*(.*)$', 1) AS label, regexp_extract(line, '^\\s*\\*\\*([^*]+)\\*\\*\\s*:\\s*(.*)$', 2) AS value FROM ({CLASSED_SQL}) WHERE class = 'meta'")
def markdown_metadata(t, spark):
    return M.metadata(_markdown(t))


@query("SELECT doc_id, 1 AS block, 'sql' AS language, '# not a heading' || chr(10) || 'select ' || doc_id AS code_text, 'sql code block.' AS announcement FROM documents")
def markdown_code_blocks(t, spark):
    return M.code_blocks(_markdown(t))


# ---------------------------------------------------------------- listening time

RATE_SQL = "SELECT doc_id, n, (0.5 + (doc_id % 4) * 0.5) AS rate FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)"


@query(f"SELECT doc_id, round(CASE WHEN n <= 0 THEN 0.0 ELSE CAST(n AS DOUBLE) / (160.0 * CAST(rate AS DOUBLE)) * 60 END, 4) AS seconds FROM ({RATE_SQL})")
def speaking_seconds(t, spark):
    rate = (0.5 + (F.col("doc_id") % 4) * 0.5).cast("double")
    return t("documents").select("doc_id", F.round(E.speaking_seconds(X.count_words(F.col("text")), rate), 4).alias("seconds"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') ELSE CAST((s // 60) % 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock
 FROM (SELECT event_id, CAST(floor(greatest(value * 20 - 100, 0.0) + 0.5) AS BIGINT) AS s FROM events)""")
def format_clock(t, spark):
    return t("events").select("event_id", E.format_clock(F.col("value") * 20 - 100).alias("clock"))


@query(f"SELECT event_id, {REMAINING.format('(value * 20 - 100)')} AS remaining FROM events")
def format_remaining(t, spark):
    return t("events").select("event_id", E.format_remaining(F.col("value") * 20 - 100).alias("remaining"))


@query(f"""SELECT doc_id, sentence_id, round(coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 160.0 * 60, 4) AS elapsed,
 round(sum(words) OVER (PARTITION BY doc_id) / 160.0 * 60, 4) AS total FROM ({SENTENCES_SQL})""")
def sentence_elapsed(t, spark):
    return L.sentence_clock(_sentences(t))


@query(f"""SELECT doc_id, round(fraction, 6) AS fraction, CASE WHEN fraction >= 1 THEN 'FINISHED'
 WHEN fraction = 0 THEN 'NOT STARTED · ' || replace({REMAINING.format(SECONDS.format('word_count'))}, ' left', '')
 ELSE CAST(CAST(floor(fraction * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% · ' || {REMAINING.format(SECONDS.format('rest'))} END AS label
 FROM (SELECT *, floor(word_count * (1 - fraction) + 0.5) AS rest FROM (SELECT l.doc_id, word_count, least(1.0, CAST(coalesce(sentence_index, 0) AS DOUBLE) / greatest(1, floor(word_count / 18.0 + 0.5))) AS fraction
 FROM ({LIBRARY_SQL}) l LEFT JOIN ({PROGRESS_SQL}) p USING (doc_id)))""")
def library_cards(t, spark):
    return L.library_cards(_library(t), L.latest_progress(_events(t)))


@query(f"SELECT doc_id, greatest(0, least(n - 1, CAST(floor(f * n) AS BIGINT))) AS at, CASE WHEN n <= 0 THEN 0 ELSE CAST(floor(floor(f * n) / n * 68 + 0.5) AS BIGINT) END AS bars FROM (SELECT doc_id, n, (doc_id % 9) / 8.0 AS f FROM ({COUNTS_SQL}))")
def seek_positions(t, spark):
    f = (F.col("doc_id") % 9) / F.lit(8.0)
    return _counts(t).select("doc_id", E.seek_index(F.col("n"), f).alias("at"), E.progress_bars(F.floor(f * F.col("n")), F.col("n")).alias("bars"))


@query(f"SELECT s.doc_id, sentence_id, CASE WHEN sentence_id < coalesce(sentence_index, 0) THEN 'spoken' WHEN sentence_id = coalesce(sentence_index, 0) THEN 'active' ELSE 'upcoming' END AS state FROM ({LINES_SQL}) s LEFT JOIN ({PROGRESS_SQL}) p USING (doc_id)")
def sentence_states(t, spark):
    return L.sentence_states(_lines(t), L.latest_progress(_events(t)))


@query(f"SELECT doc_id, source, word_count, n AS sentences FROM ({LIBRARY_SQL}) JOIN ({COUNTS_SQL}) USING (doc_id)")
def document_headers(t, spark):
    return _library(t).join(_counts(t), "doc_id").select("doc_id", "source", "word_count", F.col("n").alias("sentences"))


@query(f"SELECT doc_id, sentence_id FROM ({LINES_SQL}) s JOIN ({PROGRESS_SQL}) p USING (doc_id) WHERE sentence_id = sentence_index")
def active_blocks(t, spark):
    at = L.latest_progress(_events(t)).withColumnRenamed("sentence_index", "sentence_id")
    return _lines(t).join(at, ["doc_id", "sentence_id"], "left_semi").select("doc_id", "sentence_id")


@query("SELECT o_orderkey, round(least(2.0, sqrt(16e6 / ((300 + o_orderkey % 9000) * (200 + o_custkey % 7000)))), 6) AS scale FROM orders")
def render_scales(t, spark):
    return t("orders").select("o_orderkey", F.round(E.render_scale(300 + F.col("o_orderkey") % 9000, 200 + F.col("o_custkey") % 7000), 6).alias("scale"))


# ---------------------------------------------------------------- library tables


@query(f"SELECT doc_id, title, source, added_at, word_count FROM ({LIBRARY_SQL}) ORDER BY added_at DESC, doc_id DESC")
def library_newest(t, spark):
    return L.list_docs(_library(t))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def load_documents(t, spark):
    return L.load_docs(t("documents").select("doc_id", "source"), t("labels").select("doc_id"))


@query(f"SELECT 'documents' AS what, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'progress', doc_id FROM ({PROGRESS_SQL}) WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'images', doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_cascade(t, spark):
    ids = t("labels").select("doc_id")
    parts = {"documents": t("documents"), "progress": L.latest_progress(_events(t)), "images": t("documents").where("doc_id % 2 = 0")}
    left = [L.delete_docs(df.select("doc_id"), ids).select(F.lit(what).alias("what"), "doc_id") for what, df in parts.items()]
    return L.combine(*left)


@query(PROGRESS_SQL)
def latest_progress(t, spark):
    return L.latest_progress(_events(t))


@query(f"SELECT doc_id, coalesce(sentence_index, 0) AS sentence_index FROM documents LEFT JOIN ({PROGRESS_SQL}) USING (doc_id)")
def progress_by_document(t, spark):
    return L.progress_by_doc(t("documents"), L.latest_progress(_events(t)))


@query(f"SELECT doc_id, CASE WHEN sentence_index >= n THEN 0 ELSE sentence_index END AS resume FROM ({PROGRESS_SQL}) JOIN ({COUNTS_SQL}) USING (doc_id)")
def resume_positions(t, spark):
    return L.latest_progress(_events(t)).join(_counts(t), "doc_id").select("doc_id", L.resume_index(F.col("sentence_index"), F.col("n")).alias("resume"))


@query(f"SELECT doc_id FROM ({PROGRESS_SQL}) JOIN ({COUNTS_SQL}) USING (doc_id) WHERE sentence_index = n")
def finished_documents(t, spark):
    return L.latest_progress(_events(t)).join(_counts(t), "doc_id").where("sentence_index = n").select("doc_id")


PATCHES_SQL = """SELECT user_id, event_id AS seq, CASE WHEN event_type = 'view' THEN 'kokoro:af_sky' WHEN event_type = 'click' THEN 'system:old' END AS voice_id,
 CASE WHEN event_type = 'purchase' THEN round(value, 2) END AS rate, CASE WHEN event_type = 'signup' THEN 1.5 END AS pitch, CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'dark' END AS theme,
 CASE WHEN event_type = 'view' AND event_id % 60 = 0 THEN true WHEN event_type = 'error' THEN false END AS accepted FROM events"""


def _patches(t) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    voice = F.when(kind == "view", "kokoro:af_sky").when(kind == "click", "system:old")
    accepted = F.when((kind == "view") & (n % 60 == 0), True).when(kind == "error", False)
    return t("events").select("user_id", n.alias("seq"), voice.alias("voice_id"), F.when(kind == "purchase", F.round("value", 2)).alias("rate"), F.when(kind == "signup", 1.5).alias("pitch"), F.when((kind == "error") & (n % 50 == 0), "dark").alias("theme"), accepted.alias("accepted"))


@query(f"""SELECT user_id, arg_max(voice_id, seq) FILTER (voice_id IS NOT NULL) AS voice_id, coalesce(arg_max(rate, seq) FILTER (rate IS NOT NULL), 1.0) AS rate, CAST(coalesce(arg_max(pitch, seq) FILTER (pitch IS NOT NULL), 1.0) AS DOUBLE) AS pitch,
 coalesce(arg_max(theme, seq) FILTER (theme IS NOT NULL), 'system') AS theme, coalesce(bool_or(accepted), false) AS accepted FROM ({PATCHES_SQL}) GROUP BY user_id""")
def settings_fold(t, spark):
    return L.fold_settings(_patches(t))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'af_sky' WHEN event_id % 3 = 1 THEN 'bm_george' END AS model_id FROM events")
def voice_model_ids(t, spark):
    asked = F.element_at(F.array(*map(F.lit, ("kokoro:af_sky", "kokoro:bm_george", "system:old"))), (F.col("event_id") % 3 + 1).cast("int"))
    return L.model_ids(t("events").select("event_id", asked.alias("voice_id")), L.voices(spark)).select("event_id", "model_id")


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'kokoro:bf_emma' ELSE 'kokoro:af_heart' END AS voice_id FROM customer")
def default_voices(t, spark):
    users = t("customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, "kokoro:bf_emma").when(F.col("c_custkey") % 3 == 0, "system:old").alias("voice_id"))
    return L.pick_voice(users, L.voices(spark))


# ---------------------------------------------------------------- clips

REQUESTS_SQL = f"SELECT doc_id, sentence_id, CASE doc_id % 3 WHEN 0 THEN 'kokoro:af_sky' WHEN 1 THEN 'kokoro:bm_george' ELSE 'system:old' END AS voice_id, text FROM ({LINES_SQL})"


def _requests(t) -> DataFrame:
    d = F.col("doc_id")
    voice = F.when(d % 3 == 0, "kokoro:af_sky").when(d % 3 == 1, "kokoro:bm_george").otherwise("system:old")
    return _lines(t).select("doc_id", "sentence_id", voice.alias("voice_id"), F.lit(1.0).alias("rate"), "text")


@query(f"SELECT sha256(voice_id || '|1.00|' || text) AS clip_key, voice_id, text, count(*) AS uses FROM ({REQUESTS_SQL}) GROUP BY voice_id, text")
def clip_manifest(t, spark):
    """One row for each voice and text that is asked for, voices that are no longer offered included."""
    return L.clip_manifest(_requests(t)).drop("rate")


@query(f"SELECT doc_id, sentence_id, voice_id FROM ({REQUESTS_SQL}) WHERE voice_id = 'system:old'")
def clip_rejects(t, spark):
    offered = L.voices(spark).select(F.col("id").alias("voice_id"))
    return _requests(t).join(F.broadcast(offered), "voice_id", "left_anti").select("doc_id", "sentence_id", "voice_id")


@query(f"SELECT doc_id, sentence_id, coalesce(array_to_string(list(sentence_id) OVER (PARTITION BY doc_id ORDER BY sentence_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS next_ids FROM ({LINES_SQL})")
def lookahead_window(t, spark):
    return L.lookahead(_lines(t)).withColumn("next_ids", F.array_join(F.col("next_ids").cast("array<string>"), ","))


@query(f"""SELECT doc_id, sentence_id, sha256(voice_id || '|1.00|' || text) AS clip_key, count(*) OVER (PARTITION BY voice_id, text) AS uses FROM ({REQUESTS_SQL}) WHERE voice_id <> 'system:old'""")
def clip_positions(t, spark):
    """The clip that every position plays, with the uses that the manifest counts."""
    voices = L.voices(spark)
    return L.clip_positions(_requests(t), voices, L.clip_manifest(_requests(t), voices).select("clip_key", "uses"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that take longest to hear."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.plain_paragraphs(F.col("text")).alias("ps"))
    words = F.aggregate("ps", F.lit(0), lambda a, p: a + X.count_words(p))
    timed = docs.select("doc_id", words.alias("words")).withColumn("seconds", E.speaking_seconds(F.col("words"), F.lit(1.0)))
    return timed.orderBy(F.desc("seconds"), "doc_id").limit(10).select("doc_id", "words", E.format_clock(F.col("seconds")).alias("clock"), E.format_remaining(F.col("seconds")).alias("remaining"))
