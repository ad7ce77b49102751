"""Scalar rules on text, as functions from Column to Column; all stay inside the JVM.

Offsets count code points. White space is every Unicode space and U+FEFF; words have a letter or a digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x{FEFF}]"
_ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
SOURCES = {"pdf": "pdf", "docx": "docx", "md": "md", "markdown": "md", "txt": "txt", "text": "txt"}


def _lit_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


_NARROW = ("Scan ", "FileScan", "Project", "Filter", "Generate", "Range", "LocalTableScan")


def _is_scan(plan) -> bool:
    """Whether a plan reads a table and does nothing else that another row bears on."""
    children = plan.children()
    return plan.nodeName().startswith(_NARROW) and all(_is_scan(children.apply(i)) for i in range(children.size()))


def spread(docs: DataFrame) -> DataFrame:
    """docs over as many partitions as there are cores, where a scan of few files has fewer: for work that costs
    more than moving the text. Anything else than a scan stays as it is."""
    if docs.isStreaming or not _is_scan(docs._jdf.queryExecution().sparkPlan()):
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def trim_spaces(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def normalize_whitespace(text: Column) -> Column:
    """Zero-width characters out, runs of spaces to one, ends trimmed."""
    return trim_spaces(F.regexp_replace(F.regexp_replace(text, _ZERO_WIDTH, ""), rf"{SPACE}+", " "))


def split_lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n", -1)


def has_words(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def count_words(text: Column) -> Column:
    """Stretches without white space, which U+FEFF is and other zero-width characters are not."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x{FEFF}]+"))


def source_for_filename(name: Column) -> Column:
    """The source by the last extension; null for none, a leading or a trailing dot, or an unknown one."""
    extension = F.lower(F.regexp_extract(name, r"(?s)\A.+\.([^.]+)\z", 1))
    return F.try_element_at(_lit_map(SOURCES), extension)


def title_for_filename(name: Column) -> Column:
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")
    title = trim_spaces(F.regexp_replace(stem, r"[_\-]+", " "))
    return F.when(title == "", "Untitled").otherwise(title)


def spoken_identifier(code: Column) -> Column:
    """A lone identifier as words; anything else as it is."""
    words = F.regexp_replace(code, "[_-]+", " ")
    words = F.regexp_replace(words, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.regexp_replace(words, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.when(code.rlike(r"\A[A-Za-z][A-Za-z0-9]*([_-][A-Za-z0-9]+)*\z"), trim_spaces(words)).otherwise(code)


def spoken_urls(text: Column) -> Column:
    """Bare addresses as their host; punctuation after one stays with the sentence."""
    stop, last = r"\s<>()", r"\s<>().,;:!?"
    with_path = rf"([^{stop}/]+)/(?:[^{stop}]*[^{last}])?"
    bare = rf"([^{stop}/]*[^{last}/])"
    return F.regexp_replace(text, rf"(?i)\bhttps?://(?:www\.(?=[^{stop}/]))?(?:{with_path}|{bare})", "$1$2")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"</?[A-Za-z][A-Za-z0-9-]*(\s[^<>]*)?/?>", " ")


# Inline Markdown, in the order in which it is stripped.
_NOT_SPACE = r"(?U:[^\s\x{FEFF}])"
_IMAGE = r"!\[[^\]]*\]\([^)]*\)"
_LINK = r"\[([^\]]*)\]\([^)]*\)"
_CODE = r"`([^`\n]+)`"
_BOLD = rf"(?s)\*\*(?={_NOT_SPACE})(.*?{_NOT_SPACE})\*\*"
_STAR = rf"(?<![\w*])\*(?={_NOT_SPACE})([^*\n]*?{_NOT_SPACE})\*(?![\w*])"
_UNDER = rf"(?<![\w_])_(?={_NOT_SPACE})([^_\n]*?{_NOT_SPACE})_(?![\w_])"


def strip_inline(text: Column) -> Column:
    """Inline Markdown down to its words: images out, links to their text, code spoken, emphasis and tags out."""
    bare = F.regexp_replace(F.regexp_replace(text, _IMAGE, ""), _LINK, "$1")
    codes = F.regexp_extract_all(bare, F.lit(_CODE), 1)
    joined = F.array_join(F.zip_with(F.split(bare, _CODE, -1), codes, lambda p, c: F.concat(p, F.coalesce(spoken_identifier(c), F.lit("")))), "")
    for pattern in (_BOLD, _STAR, _UNDER):
        joined = F.regexp_replace(joined, pattern, "$1")
    return strip_tags(joined)


def speakable(text: Column) -> Column:
    return spoken_urls(normalize_whitespace(strip_inline(text)))


def drop_unmapped(text: Column) -> Column:
    """Text without control characters, as which glyphs without a character arrive."""
    return F.regexp_replace(text, r"[\x00-\x1F]", "")


def table_cells(row: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(trim_spaces(row), r"\A\|", ""), r"\|\z", "")
    return F.transform(F.split(inner, r"\|", -1), trim_spaces)


def spoken_table_row(headers: Column, cells: Column) -> Column:
    """'Header: value.' for each cell with words, both as they are spoken; a header without words is left out."""
    pairs = F.transform(cells, lambda c, i: F.struct(speakable(c).alias("v"), speakable(F.coalesce(F.get(headers, i), F.lit(""))).alias("h")))
    said = F.transform(F.filter(pairs, lambda p: has_words(p["v"])), lambda p: F.concat(F.when(has_words(p["h"]), F.concat(p["h"], F.lit(": "))).otherwise(F.lit("")), p["v"], F.lit(".")))
    return F.array_join(said, " ")


def join_hyphenated(lines: Column) -> Column:
    """Lines with words broken at a line's end joined again, in cascades; lines are single lines."""
    whole = F.regexp_replace(F.array_join(lines, "\n"), r"(?<=\p{L})-\n(?=\p{Ll})", "")
    return F.when(F.size(lines) == 0, lines).otherwise(F.split(whole, "\n", -1))


def lines_to_paragraphs(lines: Column) -> Column:
    """Blank lines break; the lines between are trimmed and joined by a space."""
    marked = F.array_join(F.transform(lines, trim_spaces), "\n")
    parts = F.transform(F.split(marked, r"\n(?:\n)+", -1), lambda p: F.translate(p, "\n", " "))
    return F.filter(F.transform(parts, trim_spaces), lambda p: p != "")


def plain_paragraphs(text: Column) -> Column:
    """A plain text's paragraphs as they are spoken; those without words are dropped."""
    spoken = F.transform(lines_to_paragraphs(split_lines(text)), lambda p: spoken_urls(normalize_whitespace(p)))
    return F.filter(spoken, has_words)


def strip_section_period(text: Column) -> Column:
    return F.regexp_replace(text, r"\A(\d+(?:\.\d+)*)\.\s+", "$1 ")


# Abbreviations whose period does not end a sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "rev", "hon", "st", "sr", "jr", "gen", "col", "capt", "lt", "sgt", "pres",
    "inc", "ltd", "co", "corp", "dept", "est", "vs", "approx", "fig", "eq", "vol", "no", "pp", "cf", "al",
)


def ends_with_abbreviation(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"(\p{L}+)\.\s*\z", 1)).isin(*ABBREVIATIONS)
