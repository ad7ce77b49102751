"""Documents from styled pieces and figures in one pass after one shuffle: lines, running lines, structure, and blocks
of those with structure or plain paragraphs of the others.

The rules are those of operators.pdf, where they are windows over tables of lines; here they are applied to the columns
of one document at a time, which is held until its last page, as its blocks are in its row of the result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import spoken as S
from lectern.operators import blocks as B
from lectern.operators import pages as G
from lectern.operators import pdf as P

_ENDED = re.compile(r"""[.:?!]["')\]]?[ \t\n\v\f\r]*\Z""")
_NO_BLOCK = dict.fromkeys(f.name for f in B._BLOCK_TYPE)
_BROKEN = re.compile(r"-\n")


def _matches(text: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False)


def _features(lines: pa.RecordBatch) -> dict[str, np.ndarray]:
    """What with_kinds() asks of each line of LINES alone, and its numbers."""
    text = lines.column("text")
    trimmed = pc.utf8_trim(text, S._ENDS)
    none = np.zeros(lines.num_rows, bool)
    wide = bool((G._data(text.cast(pa.large_string())) >= 0x80).any())
    runs = lines.column("runs")
    offsets, flat = np.asarray(runs.offsets), runs.values
    of_run = flat.field("text").cast(pa.large_string())
    bold_run = flat.field("bold").to_numpy(zero_copy_only=False)
    worded = G.has_text(of_run)
    count = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets])
    bold = (count(worded) > 0) & (count(worded & ~bold_run) == 0)
    labelled = none.copy()
    for i in np.flatnonzero((offsets[1:] > offsets[:-1]) & np.append(bold_run, False)[np.minimum(offsets[:-1], len(bold_run))]).tolist():
        a, b = int(offsets[i]), int(offsets[i + 1])
        labelled[i] = of_run[a].as_py().strip(S._ENDS).endswith(":") or (b > a + 1 and of_run[a + 1].as_py().strip(S._ENDS).startswith(":"))
    out = {n: lines.column(n).to_numpy(zero_copy_only=False) for n in ("x", "body_x", "y", "height", "all_mono")}
    out["page"] = lines.column("page_no").fill_null(-(1 << 31)).to_numpy(zero_copy_only=False)
    out |= {"opens": _matches(trimmed, rf"\A{P.PICTOGRAPH}") if wide else none, "only": _matches(trimmed, P.PICTOGRAPHS_ONLY.replace(r"\s", r"\s\x{b}")) if wide else none}
    return out | {"worded": _worded(text), "bold": bold, "labelled": labelled, "caption": _matches(trimmed, r"\AFigure \d+"), "numbered": _matches(text, r"\A\d+[.)]")}


def _worded(texts: pa.Array) -> np.ndarray:
    """Which texts are not empty once they are even."""
    first = G.first_bytes(texts.cast(pa.large_string()))
    out = (first > 0x20) & (first < 0x7F)
    for i in np.flatnonzero(~out).tolist():
        out[i] = P._even(texts[i].as_py()) != ""
    return out


def _cuts(page: np.ndarray) -> list[int]:
    return [0, *(1 + np.flatnonzero(page[1:] != page[:-1])).tolist(), len(page)]


def running(cuts: list[int], worded: np.ndarray, texts: pa.Array, least_pages: int = 3, share: float = 0.5) -> list[int]:
    """The lines of one document that marked_lines() marks: first and last ones with text, of the pages between cuts,
    whose key repeats on most pages."""
    pages = len(cuts) - 1
    if pages < least_pages:
        return []
    margin, seen = [], defaultdict(set)
    for page, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for i in () if not (some := np.flatnonzero(worded[a:b])).size else {a + int(some[0]), a + int(some[-1])}:
            key = re.sub("[0-9]+", "#", P._even(texts[i].as_py()).lower())
            seen[key].add(page)
            margin.append((i, key))
    return [i for i, key in margin if len(seen[key]) >= least_pages and len(seen[key]) > share * pages]


def _median(values: np.ndarray) -> float:
    """0 of none."""
    ranked, n = np.sort(values), len(values)
    return float(ranked[(n - 1) // 2] + ranked[n // 2]) / 2 if n else 0.0


def _commonest(values: np.ndarray, default: float) -> float:
    """The value seen first among the commonest."""
    if not len(values):
        return default
    if (values == values[0]).all():
        return float(values[0])
    kinds, first, counts = np.unique(values, return_index=True, return_counts=True)
    return float(kinds[np.lexsort((first, -counts))[0]])


KINDS = ("callout-open", "drop", "h1", "h2", "h3", "code", "meta", "caption", "list", "paragraph")


def kinds_of(d: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, float]]:
    """with_kinds(), as places in KINDS, and measured() of one document's lines."""
    x, y, height, mono, page = d["x"], d["y"], d["height"], d["all_mono"], d["page"]
    prose = ~mono & ~d["only"]
    body = _commonest(np.floor(height[prose & ~np.isnan(height)] * 10 + 0.5) / 10, P.BODY)
    margin = _commonest(np.floor(x[prose & ~np.isnan(x)] + 0.5), P.MARGIN)
    like = ~mono & (np.abs(height - body) < 0.5)
    follows = page[1:] == page[:-1]
    down = y[:-1] - y[1:]
    steps = down[follows & like[1:] & like[:-1] & (down > 0)]
    leading = _median(steps) or body * 1.5
    bold, listed = d["bold"] & ~mono, ((d["body_x"] != x) & (x >= margin - 4)) | ((x >= margin + 8) & (x < margin + 30))
    indent = np.zeros(len(x), bool)
    indent[:-1] = follows & (np.abs(x[1:] - margin) <= 4) & (down <= 1.2 * leading)
    listed &= ~(indent & (d["body_x"] == x) & ~d["numbered"])
    out = np.full(len(x), len(KINDS) - 1, np.int8)
    found = (d["opens"] & (x >= margin + 5), d["only"], ~mono & (height >= 2.2 * body), bold & (height >= 1.4 * body), bold & (height >= 1.2 * body), mono & (x >= margin + 5), d["labelled"], d["caption"], listed)
    for kind in reversed(range(len(found))):
        out[found[kind]] = kind
    return out, {"margin": margin, "leading": leading, "mono_share": np.count_nonzero(mono) / len(mono)}


def _placed(d: dict, kinds: np.ndarray, m: dict, figures: list[tuple], doc) -> Iterator[dict]:
    """laid_out() of one document."""
    rows = [{"doc_id": doc, "page_no": p, "kind": k, "x": x, "body_x": b, "y": y, "height": h, "runs": r, "text": t, "image_id": None, "width": None, "fig_height": None, "line_no": n} for p, k, x, b, y, h, r, t, n in zip(d["page"].tolist(), [KINDS[k] for k in kinds.tolist()], *(d[c].tolist() for c in ("x", "body_x", "y", "height")), d["runs"].to_pylist(), d["text"].to_pylist(), d["line_no"].tolist(), strict=True)]
    rows += [{"doc_id": doc, "page_no": -(1 << 31) if p is None else p, "kind": "figure", "x": None, "body_x": None, "y": y, "height": None, "runs": None, "text": None, "image_id": i, "width": w, "fig_height": h, "line_no": None} for p, y, i, w, h in figures]
    rows.sort(key=lambda r: (r["page_no"], -r["y"], r["line_no"] is None, r["line_no"] or 0, r["image_id"] or ""))
    last, above, inside = None, None, False
    for r in rows:
        kind, x = r["kind"], r["x"]
        deep = kind in ("meta", "caption", "list", "paragraph") and x >= m["margin"] + 30
        if kind == "callout-open":
            inside = True
        elif not (deep or kind == "drop" or (kind == "code" and ((last is not None and last[0] == "code") or x >= m["margin"] + 30))):
            inside = False
        step = above["y"] - r["y"] if above is not None and above["page_no"] == r["page_no"] and above["line_no"] is not None else None
        ended = None if last is None else last[2]
        near = ended is False if step is None else step <= 1.2 * m["leading"]
        beside = last is not None and last[1] is not None and x is not None
        r |= {"inside": inside, "straight": beside and abs(x - last[1]) <= 4, "returns": beside and last[1] > x and abs(x - m["margin"]) <= 4, "near_heading": step is not None and r["height"] is not None and step <= 1.3 * r["height"], "near_text": near}
        above = r
        if kind != "drop":
            last = kind, r["body_x"], None if r["text"] is None else _ENDED.search(r["text"]) is not None
            if inside and deep:
                r["kind"] = "callout"
            yield r


def _rejoined(text: str) -> str:
    """Lines with words broken at a line's end joined again, as join_hyphenated() does."""
    return _BROKEN.sub(lambda m: "" if unicodedata.category(text[m.start() - 1 : m.start()] or " ").startswith("L") and unicodedata.category(text[m.end() : m.end() + 1] or " ") == "Ll" else m[0], text)


def paragraphs_of(page: np.ndarray, y: np.ndarray, worded: np.ndarray, texts: pa.Array) -> list[str]:
    """plain_paragraphs() of one document."""
    cuts, out = _cuts(page), []
    dropped, lines, y = set(running(cuts, worded, texts)), texts.to_pylist(), y.tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        steps = [y[i - 1] - y[i] for i in range(a + 1, b)]
        ranked = sorted(steps)
        typical = (ranked[(len(ranked) - 1) // 2] + ranked[len(ranked) // 2]) / 2 if ranked else 0.0
        wide = typical * P.PARAGRAPH_GAP if typical > 0 else math.inf
        own = ["\n" + line if step > wide else line for step, line in zip([0.0, *steps], lines[a:b], strict=True)]
        joined = "\n".join([line for i, line in enumerate(own, a) if i not in dropped] if dropped else own)
        joined = _rejoined(joined) if "-\n" in joined else joined
        out += [p for part in re.split("\n\n+", joined) if (p := part.replace("\n", " ").strip(S._ENDS))]
    return out


def _whole(parts: list):
    if len(parts) == 1:
        return parts[0]
    return np.concatenate(parts) if isinstance(parts[0], np.ndarray) else pa.concat_arrays(parts)


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[dict]]]:
    """(doc_id, PDF_BLOCKS as dicts) of documents with blocks, from sorted packs and figures."""
    figures: dict[int | None, list[tuple]] = defaultdict(list)
    place = lambda doc: (doc is not None, doc or 0)

    def packs():
        for batch in batches:
            drawn = batch.column("pack").is_null()
            for doc, page, y, image, width, height in zip(*(c.to_pylist() for c in batch.filter(drawn).select(["doc_id", "page_no", "top", "image_id", "width", "height"]).columns), strict=True):
                figures[doc].append((page, y, image, width, height))
            yield batch.filter(pc.invert(drawn))

    def made(doc, lines, plain) -> tuple | None:
        own = figures.get(doc, [])
        while figures and place(next(iter(figures))) <= place(doc):
            figures.pop(next(iter(figures)))
        if not lines:
            return None
        d = {k: _whole([c[k] for c in lines]) for k in lines[0]}
        if dropped := running(_cuts(d["page"]), d["worded"], d["text"]):
            kept = np.ones(len(d["x"]), bool)
            kept[dropped] = False
            mask = pa.array(kept)
            d = {k: v[kept] if isinstance(v, np.ndarray) else v.filter(mask) for k, v in d.items()}
        if not len(d["x"]):
            return None
        kinds, m = kinds_of(d)
        if m["mono_share"] <= 0.5 and np.count_nonzero(kinds != len(KINDS) - 1) / len(kinds) >= P.LEAST_STRUCTURE:
            found = [_NO_BLOCK | b | ({"runs": P._struct(b["runs"])} if b.get("runs") is not None else {}) for b in P.joined_blocks(_placed(d, kinds, m, own, doc))]
        else:
            texts = paragraphs_of(*map(_whole, zip(*plain, strict=True))) if plain else []
            found = [{"doc_id": doc, "block_no": i, "kind": "paragraph", "runs": [{"text": t, "bold": False, "italic": False, "code": False}]} for i, t in enumerate(texts)]
        return (doc, found) if found else None

    def by_document(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, int]]:
        docs = batch.column("doc_id")
        v, null = docs.fill_null(0).to_numpy(zero_copy_only=False), docs.is_null().to_numpy(zero_copy_only=False)
        cuts = [0, *(1 + np.flatnonzero((v[1:] != v[:-1]) | (null[1:] != null[:-1]))).tolist(), len(v)]
        return ((docs[a].as_py(), a, b) for a, b in zip(cuts, cuts[1:], strict=False))

    held: dict[int | None, tuple[list, list]] = {}
    for ways in G.read_ways(packs(), (True, False), styled=True):
        last = None
        if ways[0] is not None:
            batch = P._lines(ways[0])
            columns = _features(batch) | {"line_no": batch.column("line_no").to_numpy(zero_copy_only=False), "runs": batch.column("runs"), "text": batch.column("text")}
            for doc, a, b in by_document(batch):
                held.setdefault(doc, ([], []))[0].append({k: v[a:b] for k, v in columns.items()})
                last = doc
        if ways[1] is not None:
            batch = P._plain(ways[1])
            page = batch.column("page_no").fill_null(-(1 << 31)).to_numpy(zero_copy_only=False)
            columns = page, batch.column("y").to_numpy(zero_copy_only=False), _worded(batch.column("text")), batch.column("text")
            for doc, a, b in by_document(batch):
                held.setdefault(doc, ([], []))[1].append(tuple(c[a:b] for c in columns))
                last = doc
        for doc in sorted((d for d in held if place(d) < place(last)), key=place):
            if (found := made(doc, *held.pop(doc))) is not None:
                yield found
    for doc in sorted(held, key=place):
        if (found := made(doc, *held[doc])) is not None:
            yield found


def _dealt_out(pieces: DataFrame, figures: DataFrame | None) -> DataFrame:
    """Packs and figures by document, page and place."""
    drawn = {"image_id": "string", "width": "int", "height": "int"}
    rows = G.packs(pieces).select("*", *[F.lit(None).cast(t).alias(n) for n, t in drawn.items()])
    if figures is not None:
        rows = rows.unionByName(figures.select(F.col("doc_id").cast("long"), F.col("page_no").cast("int"), F.col("y").cast("double").alias("top"), F.lit(None).cast("binary").alias("pack"), *[F.col(n).cast(t) for n, t in drawn.items()]))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "page_no", F.desc("top"))


def route(pieces: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """PDF_BLOCKS of styled pieces: running lines dropped; documents with little structure as plain paragraphs, the
    others as blocks with their figures. Documents without a line (scans) have no blocks."""

    def run(batches):
        rows = (tuple(b.get(n) for n in P._BLOCK_TYPES.names) for _, found in documents(batches) for b in found)
        yield from P._tables(rows, P._BLOCK_TYPES)

    return _dealt_out(pieces, figures).mapInArrow(run, P.PDF_BLOCKS)


def gathered(pieces: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """gathered_documents() of route(), in its pass."""
    return _dealt_out(pieces, figures).mapInArrow(lambda batches: B.gathered_rows(documents(batches)), B.GATHERED)
