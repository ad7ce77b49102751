"""Documents as blocks and as spoken sentences.

One Arrow pass a document parses or segments it and emits flat rows: the position in the pass is the block or
sentence number, so that neither needs a window or a shuffle. Blocks are keyed (doc_id, block_no, child_no);
child_no is null outside callouts, and a callout is a row of its own before its children.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import spoken as S
from lectern.functions import text as X

RUN = "struct<text:string,bold:boolean,italic:boolean,code:boolean>"
BLOCKS = f"doc_id long, block_no int, child_no int, kind string, level int, ordered int, language string, code_text string, icon string, runs array<{RUN}>"
SENTENCES = "doc_id long, sentence_id int, block_no int, child_no int, start int, end int, text string"
KINDS = ("heading", "paragraph", "caption", "meta", "list-item", "code", "callout")

# The line grammar of Markdown.
_W = S.WS
_FENCE = re.compile(rf"[{_W}]*(?:```|~~~)[{_W}]*([A-Za-z0-9+#-]*)")
_RULE = re.compile(rf"[{_W}]*([-*_])[{_W}]*(?:\1[{_W}]*){{2,}}\Z")
_IMAGE = re.compile(rf"[{_W}]*![{_W}]*[A-Za-z0-9_./-]+\.(?:svg|png|jpe?g|gif|webp)[{_W}]*\Z", re.I)
_ASIDE = re.compile(rf"[{_W}]*<(/?)aside>[{_W}]*\Z", re.I)
_ROW = re.compile(rf"[{_W}]*\|.*\|[{_W}]*\Z")
_SEPARATOR = re.compile(rf"[{_W}]*\|(?:[{_W}]*:?-{{2,}}:?[{_W}]*\|)+[{_W}]*\Z")
_HEADING = re.compile(rf"[{_W}]*(#{{1,6}})[{_W}]+")
_META = re.compile(rf"[{_W}]*\*\*[^*\n]+\*\*[{_W}]*:")
_BULLET = re.compile(rf"[{_W}]*[-*+][{_W}]+")
_NUMBER = re.compile(rf"[{_W}]*(\d+)[.)][{_W}]+", re.A)
_QUOTE = re.compile(rf"[{_W}]*>[{_W}]?")
_FIGURE = re.compile(rf"Figure[{_W}]+[0-9]+")

_STRIP = [(re.compile(r"!\[[^\]]*\]\([^)]*\)"), ""), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"`([^`\n]+)`"), lambda m: S.spoken_identifier(m[1]))]
_STRIP += [(S._INLINE[n], r"\1") for n in ("bold", "star", "under")] + [(S._TAG, " ")]


def speakable(text: str) -> str:
    for pattern, to in _STRIP:
        text = pattern.sub(to, text)
    return S.spoken_urls(S._SPACES.sub(" ", S._ZERO_WIDTH.sub("", text)).strip(S._ENDS))


def _cells(row: str) -> list[str]:
    return [c.strip(S._ENDS) for c in row.strip(S._ENDS).removeprefix("|").removesuffix("|").split("|")]


def spoken_row(headers: list[str], row: str) -> str:
    said = []
    for i, value in enumerate(map(speakable, _cells(row))):
        if S.WORDS.search(value):
            name = headers[i] if i < len(headers) else ""
            said.append(f"{name}: {value}." if S.WORDS.search(name) else f"{value}.")
    return " ".join(said)


def _events(lines: list[str]) -> Iterator[tuple]:
    """What the lines say, in order: ("text", item, string), ("said", string), ("heading", level, string),
    ("meta", string), ("code", language, string), ("aside", opens). item: None for prose, else (number,)."""
    held: list[str] = []
    item, fence, headers = None, None, None
    for line, following in zip(lines, [*lines[1:], ""], strict=True):
        if mark := _FENCE.match(line):
            if fence is not None:
                yield "code", fence[0] or None, "\n".join(fence[1:])
                fence = None
                continue
        elif fence is not None:
            fence.append(line)
            continue
        if headers is not None:
            if _ROW.match(line):
                yield "said", spoken_row(headers, line)
                continue
            headers = None
        bullet, number = _BULLET.match(line), _NUMBER.match(line)
        aside, heading = _ASIDE.match(line), _HEADING.match(line)
        table = _ROW.match(line) and _SEPARATOR.match(following)
        gap = not line.strip(S._ENDS) or _RULE.match(line) or _IMAGE.match(line)
        meta = _META.match(line)
        if held and (mark or aside or gap or table or heading or meta or bullet or number):
            yield "text", item, " ".join(held)
            held, item = [], None
        if mark:
            fence = [mark[1]]
        elif aside:
            yield "aside", not aside[1]
        elif gap:
            pass
        elif table:
            headers = [speakable(c) for c in _cells(line)]
        elif heading:
            yield "heading", min(len(heading[1]), 3), line[heading.end() :]
        elif meta:
            yield "meta", line
        elif bullet or number:
            item = (int(number[1]) if number else None,)
            held = [_NUMBER.sub("", _BULLET.sub("", line, count=1), count=1)]
        else:
            held.append(_QUOTE.sub("", line, count=1))
    if held:
        yield "text", item, " ".join(held)


def _block(kind: str, *, level=None, ordered=None, language=None, code=None, icon=None, runs=None) -> dict:
    return {"kind": kind, "level": level, "ordered": ordered, "language": language, "code_text": code, "icon": icon, "runs": runs}


def _leaf(event: tuple, wordless: Callable[[str], None]) -> dict | None:
    kind = event[0]
    if kind == "code":
        return _block("code", language=event[1], code=event[2])
    if kind == "said":
        return _block("paragraph", runs=[(event[1], False, False, False)]) if S.WORDS.search(event[1]) else None
    runs = S.inline_runs(event[-1])
    shown = S.display(runs)
    if kind == "meta":
        return _block("meta", runs=runs)
    if not S.WORDS.search(shown):
        if kind == "text" and shown:
            wordless(shown)
        return None
    if kind == "heading":
        return _block("heading", level=event[1], runs=runs)
    if event[1] is not None:
        return _block("list-item", ordered=event[1][0], runs=runs)
    return _block("caption" if _FIGURE.match(shown) and all(r[2] for r in runs) else "paragraph", runs=runs)


def parse(text: str) -> list[tuple[dict, list[dict]]]:
    """(block, children) of a Markdown text; only callouts have children."""
    out: list[tuple[dict, list[dict]]] = []
    callout: tuple[dict, list[dict]] | None = None

    def icon(shown: str) -> None:
        if callout and not callout[1] and callout[0]["icon"] is None:
            callout[0]["icon"] = shown

    for event in _events(re.split("\r\n|\r|\n", text)):
        if event[0] == "aside":
            if not event[1] and callout and callout[1]:
                out.append(callout)
            callout = (_block("callout"), []) if event[1] else None
        elif leaf := _leaf(event, icon):
            callout[1].append(leaf) if callout else out.append((leaf, []))
    if callout and callout[1]:
        out.append(callout)
    return out


def paragraphs(texts: list[str]) -> list[tuple[dict, list[dict]]]:
    return [(_block("paragraph", runs=[(t, False, False, False)] if t else []), []) for t in texts]


def _said(block: dict) -> Iterator[tuple[int, int, str]]:
    if block["kind"] == "code":
        yield 0, len(block["code_text"]), f"{block['language']} code block." if block["language"] else "Code block."
        return
    runs = block["runs"] or []
    shown = S.display(runs)
    is_heading = block["kind"] == "heading"
    for a, b in [S.trimmed(shown, 0, len(shown))] if is_heading else S.sentence_ranges(shown, S.code_spans(runs)):
        text = S.spoken_slice(runs, a, b)
        if is_heading:
            text = re.sub(rf"\A([0-9]+(?:\.[0-9]+)*)\.[{_W}]+", r"\1 ", text)
        if S.WORDS.search(text):
            yield a, b, text


def sentences(blocks: list[tuple[dict, list[dict]]]) -> Iterator[tuple]:
    """(block_no, child_no, start, end, text) of all sentences with words, in order."""
    for i, (block, children) in enumerate(blocks):
        for j, leaf in enumerate(children) if block["kind"] == "callout" else [(None, block)]:
            for piece in _said(leaf):
                yield i, j, *piece


def _flat_blocks(blocks):
    for i, (block, children) in enumerate(blocks):
        for j, leaf in [(None, block), *enumerate(children)]:
            yield i, j, *(leaf[c] for c in ("kind", "level", "ordered", "language", "code_text", "icon")), leaf["runs"] and [dict(zip(("text", "bold", "italic", "code"), r, strict=True)) for r in leaf["runs"]]


_RUN_TYPE = pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("code", pa.bool_())])
_BLOCK_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(_RUN_TYPE)]
_SENTENCE_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
ROWS_OUT = 20_000


def _rows(docs: DataFrame, schema: str, types: list, expand) -> DataFrame:
    """docs (doc_id, t) through expand(value), which yields the rows of one document; null texts have none."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if value is not None:
                    out += [(doc_id, *row) for row in expand(value)]
                if len(out) >= ROWS_OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return X.spread(docs).mapInArrow(run, schema)


def markdown_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """BLOCKS of every Markdown document."""
    return _rows(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("t")), BLOCKS, _BLOCK_TYPES, lambda t: _flat_blocks(parse(t)))


def segment_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """SENTENCES of every Markdown document."""
    return _rows(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("t")), SENTENCES, _SENTENCE_TYPES, lambda t: ((i, *s) for i, s in enumerate(sentences(parse(t)))))


def segment_paragraphs(docs: DataFrame, paragraphs_column: Column | None = None) -> DataFrame:
    """SENTENCES of docs' plain paragraphs, or of an array of paragraphs; blank ones keep their number."""
    ps = X.plain_paragraphs(F.col("text")) if paragraphs_column is None else paragraphs_column
    return _rows(docs.select(F.col("doc_id").cast("long"), ps.alias("t")), SENTENCES, _SENTENCE_TYPES, lambda t: ((i, *s) for i, s in enumerate(sentences(paragraphs(t)))))


BLOCK = f"struct<block_no:int,child_no:int,kind:string,level:int,ordered:int,language:string,code_text:string,icon:string,runs:array<{RUN}>,image_id:string,width:int,height:int>"
_BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")][1:]
_BLOCK_TYPE = pa.struct([*zip(_BLOCK_NAMES, _BLOCK_TYPES[1:], strict=True), ("image_id", pa.string()), ("width", pa.int32()), ("height", pa.int32())])
_WORD = re.compile(f"[^{S._ENDS}]+")


def whole_documents(docs: DataFrame, markdown: Column, ps: Column) -> DataFrame:
    """docs and words, sentences and blocks of every document in one pass without a shuffle: of a Markdown text, or
    where that is null of an array of plain paragraphs. words: those of the spoken sentences."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"words long, sentences long, blocks array<{BLOCK}>"])
    width = len(docs.columns)

    def read(text, plain):
        blocks = parse(text) if text is not None else paragraphs(plain or [])
        said = [s[-1] for s in sentences(blocks)]
        return sum(len(_WORD.findall(s)) for s in said), len(said), [dict(zip(_BLOCK_NAMES, b, strict=True)) for b in _flat_blocks(blocks)]

    def run(batches):
        for batch in batches:
            at, held, size = 0, [], 0
            for text, plain in zip(*(c.to_pylist() for c in batch.columns[width:]), strict=True):
                held.append(read(text, plain))
                size += len(held[-1][2])
                if size >= ROWS_OUT:
                    yield joined(batch.slice(at, len(held)), held)
                    at, held, size = at + len(held), [], 0
            if held:
                yield joined(batch.slice(at), held)

    def joined(own, held):
        types = {"words": pa.int64(), "sentences": pa.int64(), "blocks": pa.list_(_BLOCK_TYPE)}
        return pa.RecordBatch.from_arrays([*own.columns[:width], *(pa.array(c, t) for c, t in zip(zip(*held, strict=True), types.values(), strict=True))], names=[*own.schema.names[:width], *types])

    return X.spread(docs.select("*", markdown.alias("_markdown"), ps.alias("_paragraphs"))).mapInArrow(run, schema)


def _in_order(blocks: DataFrame) -> DataFrame:
    """Rows of blocks by document and in its order, with the fields of BLOCK; what they lack is null."""
    kinds = dict(f.split(":", 1) for f in BLOCK[len("struct<") : -1].replace(RUN, "@").split(","))
    fields = [F.col(n) if n in blocks.columns else F.lit(None).alias(n) for n in kinds]
    typed = [f.cast(k.replace("@", RUN)).alias(n) for f, (n, k) in zip(fields, kinds.items(), strict=True)]
    return blocks.select(F.col("doc_id").cast("long"), *typed).repartition("doc_id").sortWithinPartitions("doc_id", "block_no", F.col("child_no").asc_nulls_first())


def _leaf_of(row: dict) -> dict:
    return row | {"runs": row["runs"] and [(r["text"], r["bold"], r["italic"], r["code"]) for r in row["runs"]]}


def _is_said(kind: str) -> bool:
    return kind not in ("figure", "callout")


def segment_blocks(blocks: DataFrame) -> DataFrame:
    """SENTENCES of rows of blocks (those of a PDF, say): dealt out and sorted by document, then read in one pass that
    holds one block at a time."""

    def run(batches):
        out, doc, number = [], None, 0
        for row in (r for b in batches for r in b.to_pylist()):
            if row["doc_id"] != doc:
                doc, number = row["doc_id"], 0
            for start, end, text in _said(_leaf_of(row)) if _is_said(row["kind"]) else ():
                out.append((doc, number, row["block_no"], row["child_no"], start, end, text))
                number += 1
            if len(out) >= ROWS_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SENTENCE_TYPES, strict=True)], _SENTENCE_NAMES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SENTENCE_TYPES, strict=True)], _SENTENCE_NAMES)

    return _in_order(blocks).mapInArrow(run, SENTENCES)


GATHERED = f"doc_id long, words long, sentences long, blocks array<{BLOCK}>"


def gathered_rows(documents: Iterator[tuple[int | None, list[dict]]]) -> Iterator[pa.RecordBatch]:
    """GATHERED from (doc_id, rows of blocks), some thousand blocks at a time."""
    types, out, size = (pa.int64(), pa.int64(), pa.int64(), pa.list_(_BLOCK_TYPE)), [], 0

    def table():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "words", "sentences", "blocks"])

    for doc_id, rows in documents:
        said = [s[-1] for r in rows if _is_said(r["kind"]) for s in _said(_leaf_of(r))]
        # What is said has single spaces only.
        out.append((doc_id, sum(s.count(" ") + 1 for s in said), len(said), [{k: v for k, v in r.items() if k != "doc_id"} for r in rows]))
        size += len(rows)
        if size >= ROWS_OUT // 10:
            yield table()
            out, size = [], 0
    if out:
        yield table()


def gathered_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, words, sentences, blocks) from rows of blocks: those of a document, in order, with what they say."""

    def run(batches):
        return gathered_rows((doc_id, list(rows)) for doc_id, rows in groupby((r for b in batches for r in b.to_pylist()), key=itemgetter("doc_id")))

    return _in_order(blocks).mapInArrow(run, GATHERED)


_SENTENCE_NAMES = [c.split()[0] for c in SENTENCES.split(", ")]


def sentence_splits(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start, end) of the sentences of one paragraph a row."""
    return _rows(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("t")), "doc_id long, start int, end int", [pa.int64(), pa.int32(), pa.int32()], S.sentence_ranges)


def inline_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, run_no, text, bold, italic, code) of one line or paragraph a row."""
    types = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
    return _rows(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("t")), "doc_id long, run_no int, text string, bold boolean, italic boolean, code boolean", types, lambda t: ((i, *r) for i, r in enumerate(S.inline_runs(t))))


# ---------------------------------------------------------------- on the rows, by built-in functions

PATH = ["doc_id", "block_no", "child_no"]


def spoken_paragraphs(said: DataFrame) -> DataFrame:
    """(doc_id, block_no, child_no, text): a block's sentences joined by a space."""
    return sentences_by_block(said).select(*PATH, F.array_join("texts", " ").alias("text"))


def sentences_by_block(said: DataFrame) -> DataFrame:
    """(doc_id, block_no, child_no, ids, texts) in the order of the sentences."""
    ordered = F.array_sort(F.collect_list(F.struct("sentence_id", "text")))
    return said.groupBy(*PATH).agg(ordered.alias("s")).select(*PATH, F.col("s.sentence_id").alias("ids"), F.col("s.text").alias("texts"))


def document_word_counts(said: DataFrame) -> DataFrame:
    """(doc_id, words, sentences): words of the spoken paragraphs, which are those of their sentences."""
    return said.groupBy("doc_id").agg(F.sum(X.count_words(F.col("text"))).alias("words"), F.count("*").alias("sentences"))


def heading_sentences(blocks: DataFrame) -> DataFrame:
    """A heading as one utterance, its section number without the final period."""
    text = X.strip_section_period(X.spoken_urls(X.normalize_whitespace(display_text(F.col("runs")))))
    return blocks.where("kind = 'heading'").select(*PATH, "level", text.alias("text")).where(X.has_words(F.col("text")))


def display_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def group_lists(blocks: DataFrame) -> DataFrame:
    """(doc_id, parent, list_no, ordered, start, items): neighbouring list items of one level gathered; a list is
    numbered if its first item is. parent: the callout's block_no, null at top level."""
    from pyspark.sql import Window as W

    inside = F.col("child_no").isNotNull()
    placed = blocks.select("doc_id", F.when(inside, F.col("block_no")).alias("parent"), F.coalesce("child_no", "block_no").alias("no"), "kind", "ordered", "runs")
    w = W.partitionBy("doc_id", "parent").orderBy("no")
    new = (F.col("kind") == "list-item") & F.coalesce(F.lag("kind").over(w) != "list-item", F.lit(True))
    numbered = placed.withColumn("list_no", F.sum(new.cast("int")).over(w)).where("kind = 'list-item'")
    items = F.array_sort(F.collect_list(F.struct("no", display_text(F.col("runs")).alias("text"))))
    grouped = numbered.groupBy("doc_id", "parent", "list_no").agg(F.min_by("ordered", "no").alias("start"), items.alias("items"))
    return grouped.select("doc_id", "parent", "list_no", F.col("start").isNotNull().alias("ordered"), "start", F.col("items.text").alias("items"))


def block_profile(blocks: DataFrame) -> DataFrame:
    """Blocks of every kind by document."""
    return blocks.groupBy("doc_id").pivot("kind", list(KINDS)).count().na.fill(0)


def callouts(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_no, icon, children): the children's texts in order."""
    said = F.coalesce(display_text(F.col("runs")), F.col("code_text"))
    inside = blocks.where("child_no IS NOT NULL").groupBy("doc_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("child_no", said.alias("text")))).alias("c"))
    return blocks.where("kind = 'callout'").select("doc_id", "block_no", "icon").join(inside, ["doc_id", "block_no"]).select("doc_id", "block_no", "icon", F.col("c.text").alias("children"))


def captions(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'caption'").select(*PATH, display_text(F.col("runs")).alias("text"))


def paragraphs_to_blocks(docs: DataFrame, ps: Column) -> DataFrame:
    """(doc_id, block_no, kind, text) of an array of paragraphs, blanks kept."""
    return docs.select("doc_id", F.posexplode(ps).alias("block_no", "text")).select("doc_id", "block_no", F.lit("paragraph").alias("kind"), "text")


def normalize_runs(runs: Column) -> Column:
    """The rule of spoken.normalize_runs on an array of runs, as one fold."""
    clean = F.transform(runs, lambda r: F.struct(F.regexp_replace(F.regexp_replace(r["text"], X._ZERO_WIDTH, ""), rf"{X.SPACE}+", " ").alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"), r["code"].alias("code")))

    def add(done, run):
        last = F.element_at(done, -1)
        text = F.when((F.size(done) > 0) & last["text"].endswith(" ") & run["text"].startswith(" "), F.substring(run["text"], 2, 1 << 30)).otherwise(run["text"])
        style = ("bold", "italic", "code")
        same = (F.size(done) > 0) & (last["bold"] == run["bold"]) & (last["italic"] == run["italic"]) & (last["code"] == run["code"])
        joined = F.struct(F.concat(last["text"], text).alias("text"), *[last[s].alias(s) for s in style])
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(text == "", done).when(same, F.concat(head, F.array(joined))).otherwise(F.concat(done, F.array(F.struct(text.alias("text"), *[run[s].alias(s) for s in style]))))

    folded = F.aggregate(clean, F.array().cast(f"array<{RUN}>"), add)
    n = F.size(folded)

    def ends(r, i):
        text = F.when(i == 0, F.regexp_replace(r["text"], rf"\A{X.SPACE}+", "")).otherwise(r["text"])
        text = F.when(i == n - 1, F.regexp_replace(text, rf"{X.SPACE}+\z", "")).otherwise(text)
        return F.struct(text.alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"), r["code"].alias("code"))

    return F.filter(F.transform(folded, ends), lambda r: r["text"] != "")


def run_rows(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_no, child_no, run_no, start, end, text, bold, italic, code): runs with their offsets."""
    sizes = F.transform("runs", lambda r: F.length(r["text"]))
    starts = F.transform("runs", lambda r, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    exploded = blocks.where("runs IS NOT NULL").select(*PATH, F.posexplode(F.arrays_zip(F.col("runs").alias("run"), starts.alias("start"))).alias("run_no", "z"))
    return exploded.select(*PATH, "run_no", F.col("z.start").alias("start"), (F.col("z.start") + F.length("z.run.text")).alias("end"), "z.run.*")


def sentence_run_spans(said: DataFrame, runs: DataFrame) -> DataFrame:
    """The part of every run that a sentence covers, by a sweep over the edges of each block.

    Runs tile a block and its sentences do not overlap, so that a run and a sentence that share text first meet where
    the later of them starts: there, the other is the last that has started. Each block is sorted once, and the rows
    are as many as its runs and sentences together.
    """
    from pyspark.sql import Window as W

    run = F.struct("run_no", "start", "end", "text", "bold", "italic", "code")
    sentence = F.struct("sentence_id", "start", "end")
    edges = runs.select(*PATH, F.col("start").alias("at"), F.lit(0).alias("side"), run.alias("run"))
    edges = edges.unionByName(said.select(*PATH, F.col("start").alias("at"), F.lit(1).alias("side"), sentence.alias("sentence")), allowMissingColumns=True)
    w = W.partitionBy(*PATH).orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    met = edges.select(*PATH, F.last("run", ignorenulls=True).over(w).alias("r"), F.last("sentence", ignorenulls=True).over(w).alias("s"))
    both = met.where((F.col("r.start") < F.col("s.end")) & (F.col("r.end") > F.col("s.start")))
    start, end = F.greatest("s.start", "r.start"), F.least("s.end", "r.end")
    return both.select("doc_id", "s.sentence_id", "r.run_no", start.alias("start"), end.alias("end"), F.substring(F.col("r.text"), start - F.col("r.start") + 1, end - start).alias("text"), "r.bold", "r.italic", "r.code")


def spoken_slices(spans: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, text): what is said for each sentence, from its spans."""
    body = X.trim_spaces(F.col("text"))
    left, right = F.regexp_extract("text", rf"\A({X.SPACE}*)", 1), F.regexp_extract("text", rf"({X.SPACE}*)\z", 1)
    said = F.when(F.col("code") & (body != ""), F.concat(left, X.spoken_identifier(body), right)).otherwise(F.col("text"))
    parts = spans.groupBy("doc_id", "sentence_id").agg(F.array_sort(F.collect_list(F.struct("run_no", said.alias("t")))).alias("p"))
    whole = X.trim_spaces(F.regexp_replace(F.array_join(F.col("p.t"), ""), rf"{X.SPACE}+", " "))
    return parts.select("doc_id", "sentence_id", X.spoken_urls(whole).alias("text"))
