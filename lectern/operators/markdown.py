"""Markdown lines as a table: one row a line with its class, and what follows from the classes.

Fence parity and table membership come from running windows over a document's lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X

# The line grammar; the rule's three marks are three alternatives, as the SQL twin has no back references.
RULE = r"\A\s*(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})\z"
CLASSES = (
    ("aside open", r"(?i)\A\s*<aside>\s*\z"),
    ("aside close", r"(?i)\A\s*</aside>\s*\z"),
    ("rule", RULE),
    ("image", r"(?i)\A\s*!\s*[\w./-]+\.(svg|png|jpe?g|gif|webp)\s*\z"),
    ("heading", r"\A\s*(#{1,6})\s+"),
    ("separator", r"\A\s*\|(\s*:?-{2,}:?\s*\|)+\s*\z"),
    ("row", r"\A\s*\|.*\|\s*\z"),
    ("meta", r"\A\s*\*\*[^*\n]+\*\*\s*:"),
    ("bullet", r"\A\s*[-*+]\s+"),
    ("numbered", r"\A\s*\d+[.)]\s+"),
    ("quote", r"\A\s*>\s?"),
    ("blank", r"\A\s*\z"),
)
FENCE = r"\A\s*(```|~~~)"


def markdown_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every line."""
    return docs.select("doc_id", F.posexplode(X.split_lines(F.col("text"))).alias("line_no", "line"))


def classify_lines(lines: DataFrame) -> DataFrame:
    """lines with class, fence_no (the number of fence lines up to and with the line) and table_no (the line of the
    table's header).

    Of neighbouring lines between pipes, the first that a separator follows is a table's header, what comes after is
    its rows, and what comes before is text.
    """
    upto = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    is_fence = F.col("line").rlike(FENCE)
    named = lines.withColumn("fence_no", F.sum(is_fence.cast("int")).over(upto))
    kind = F.when(is_fence, "fence").when(F.col("fence_no") % 2 == 1, "code")
    for name, pattern in CLASSES:
        kind = kind.when(F.col("line").rlike(pattern), name)
    named = named.withColumn("class", kind.otherwise("text"))
    by_line, piped = W.partitionBy("doc_id").orderBy("line_no"), F.col("class").isin("row", "separator")
    named = named.withColumns({"run_no": F.sum((~piped).cast("int")).over(upto), "heads": piped & F.coalesce(F.lead("class").over(by_line) == "separator", F.lit(False))})
    head = F.min(F.when(F.col("heads"), F.col("line_no"))).over(W.partitionBy("doc_id", "run_no"))
    named = named.withColumn("table_no", F.when(piped, head))
    place = F.col("line_no") - F.col("table_no")
    table = F.when(place == 0, "header").when(place == 1, "separator").when(place > 1, "row").otherwise("text")
    return named.withColumn("class", F.when(piped, table).otherwise(F.col("class"))).drop("run_no", "heads")


def table_rows(classified: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): the rows of tables as they are spoken, each cell with its column's name."""
    heads = classified.where("class = 'header'").select("doc_id", F.col("line_no").alias("table_no"), X.table_cells(F.col("line")).alias("heads"))
    said = X.spoken_table_row(F.col("heads"), X.table_cells(F.col("line")))
    return classified.where("class = 'row'").join(heads, ["doc_id", "table_no"]).select("doc_id", "line_no", said.alias("text")).where(X.has_words(F.col("text")))


def list_items(classified: DataFrame) -> DataFrame:
    """(doc_id, line_no, ordered, text): items without their mark, with the plain lines that follow them."""
    upto = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    placed = classified.withColumn("item", F.sum((~F.col("class").isin("text", "quote")).cast("int")).over(upto))
    plain = F.regexp_replace("line", r"\A\s*>\s?", "")
    bare = F.regexp_replace(F.regexp_replace("line", r"\A\s*[-*+]\s+", ""), r"\A\s*\d+[.)]\s+", "")
    text = F.when(F.col("class").isin("bullet", "numbered"), bare).otherwise(plain)
    number = F.regexp_extract("line", r"\A\s*(\d+)[.)]\s", 1)
    parts = placed.groupBy("doc_id", "item").agg(F.min("line_no").alias("line_no"), F.min_by("class", "line_no").alias("class"), F.min_by(number, "line_no").alias("number"), F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))).alias("p"))
    items = parts.where(F.col("class").isin("bullet", "numbered"))
    joined = X.speakable(F.array_join(F.col("p.t"), " "))
    return items.select("doc_id", "line_no", F.when(F.col("class") == "numbered", F.col("number").cast("int")).alias("ordered"), joined.alias("text")).where(X.has_words(F.col("text")))


def headings(classified: DataFrame) -> DataFrame:
    title = X.normalize_whitespace(F.regexp_replace("line", r"\A\s*#{1,6}\s+", ""))
    level = F.least(F.length(F.regexp_extract("line", r"\A\s*(#{1,6})", 1)), F.lit(3))
    return classified.where("class = 'heading'").select("doc_id", "line_no", level.alias("level"), title.alias("title")).where(X.has_words(F.col("title")))


def metadata(classified: DataFrame) -> DataFrame:
    pattern = r"\A\s*\*\*([^*\n]+)\*\*\s*:\s*(.*)\z"
    return classified.where("class = 'meta'").select("doc_id", "line_no", F.regexp_extract("line", pattern, 1).alias("label"), X.trim_spaces(F.regexp_extract("line", pattern, 2)).alias("value"))


def code_blocks(classified: DataFrame) -> DataFrame:
    """Closed fences with their language and text; an unclosed one loses its lines."""
    inside = classified.where((F.col("fence_no") % 2 == 1) | (F.col("class") == "fence"))
    block = F.ceil(F.col("fence_no") / 2)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("class") == "code", F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    language = F.regexp_extract(F.min_by("line", "line_no"), r"\A\s*(?:```|~~~)\s*([A-Za-z0-9+#-]*)", 1)
    grouped = inside.groupBy("doc_id", block.alias("block")).agg(language.alias("language"), text.alias("code_text"), F.sum((F.col("class") == "fence").cast("int")).alias("fences"))
    said = F.when(F.col("language") == "", "Code block.").otherwise(F.concat("language", F.lit(" code block.")))
    return grouped.where("fences = 2").select("doc_id", "block", "language", "code_text", said.alias("announcement"))
