"""Pieces in packs and rows of whole columns, against one piece at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.operators import pages as G
from lectern.operators import pdf as P

NAMES = ["doc_id", "page_no", "piece_no", "str", "x", "y", "width", "height", "flags"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int8()]
WORDS = ["word", "a", "two words", "é", "漢字", ", then", ")", "• ", "•", "▪", " lead", "tail ", "in  side", "t\tab", "zero​width", " ", "  ", "\x01", "\x02b", "\x1c", "q\x1cr", "　x", "", None, "x-"]


def some_pieces(seed, n, step, *, words=WORDS, mono=0.3):
    """Pieces of three pages in any order; step: how far apart their heights may be."""
    r = random.Random(seed)
    return [
        (1, r.randrange(3), i, r.choice(words), 10.0 * r.randrange(8), round(700 - step * r.randrange(60), 2), r.choice([None, 9.5, 10.0, 44.0, 2.0]), r.choice([10.0, 10.0, 14.0, 9.0]), r.random() < 0.3, r.random() < 0.2, r.random() < mono or None)
        for i in range(n)
    ]


def packs_of(rows, batch):
    """The packs of pieces that come in batches, sorted as Spark sorts them."""
    rows, out = [(*p[:8], sum(bit for on, bit in zip(p[8:], (G.BOLD, G.ITALIC, G.MONO), strict=True) if on)) for p in rows], []
    for a in range(0, len(rows), batch):
        found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + batch], strict=True), TYPES, strict=True)], NAMES)
        found = found.filter(pa.array(G.has_text(found.column("str").cast(pa.large_string()).fill_null(""))))
        if found.num_rows:
            out += G._packs(found).to_pylist()
    out.sort(key=lambda p: (p["doc_id"], p["page_no"] or 0, -p["top"]))
    return [pa.RecordBatch.from_pylist(out[i : i + 3], schema=pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("top", pa.float64()), ("pack", pa.binary())])) for i in range(0, len(out), 3)]


def rows_of(pieces, clean):
    """(doc_id, page_no, row_no, pieces from left to right as tuples of P._PIECE), one piece at a time."""
    own = []
    for d, p, n, raw, x, y, w, h, b, i, m in pieces:
        text = raw and "".join(c for c in raw if c >= " ") if clean else raw
        if text and text.strip(G.S._ENDS):
            own.append((d, p, y, x, n, w, text, raw, h, b, i, m))
    own.sort(key=lambda p: (p[0], p[1], -p[2], p[4]))
    out = []
    for (begins, number), piece in zip(P.row_starts(own), own, strict=True):
        if begins:
            out.append((*piece[:2], number, []))
        out[-1][3].append(piece)
    return [(d, p, n, sorted(row, key=lambda p: p[3:5])) for d, p, n, row in out]


CASES = [(s, n, step, batch, chunk, large) for s, (n, step) in enumerate([(400, 14.0), (400, 2.0), (300, 0.5), (900, 1.3)]) for batch, chunk, large in [(10_000, 50_000, 1024), (70, 40, 20), (900, 10, 5)]]


@pytest.mark.parametrize("seed, n, step, batch, chunk, large", CASES)
def test_lines_as_one_by_one(monkeypatch, seed, n, step, batch, chunk, large):
    monkeypatch.setattr(G, "CHUNK", chunk)
    monkeypatch.setattr(G, "LARGE", large)
    for pieces in (some_pieces(seed, n, step), some_pieces(seed, n, step, words=WORDS[:6], mono=0.9)):
        got = [tuple(r.values()) for rows in G.read_rows(iter(packs_of(pieces, batch)), styled=True, clean=True) for r in P._lines(rows).to_pylist()]
        want = [(d, p, k, *P._line(row)) for d, p, k, row in rows_of(pieces, True)]
        assert got == want and len(got) > 20


@pytest.mark.parametrize("seed, n, step, batch, chunk, large", CASES)
def test_plain_rows_as_one_by_one(monkeypatch, seed, n, step, batch, chunk, large):
    monkeypatch.setattr(G, "CHUNK", chunk)
    monkeypatch.setattr(G, "LARGE", large)
    pieces = some_pieces(seed, n, step)
    got = [tuple(r.values()) for rows in G.read_rows(iter(packs_of(pieces, batch)), styled=True) for r in P._plain(rows).to_pylist()]
    want = []
    for d, p, k, row in rows_of(pieces, False):
        seams = ["", *("" if a[5] is not None and b[3] - a[3] - a[5] < P.WORD_GAP else " " for a, b in zip(row, row[1:], strict=False))]
        want.append((d, p, k, max(q[2] for q in row), P._even("".join(s + q[6] for s, q in zip(seams, row, strict=True)))))
    assert got == want and len(got) > 20


@pytest.mark.parametrize("seed, n, step, batch, chunk, large", CASES)
def test_heights_as_one_by_one(monkeypatch, seed, n, step, batch, chunk, large):
    monkeypatch.setattr(G, "CHUNK", chunk)
    monkeypatch.setattr(G, "LARGE", large)
    pieces = some_pieces(seed, n, step)
    got = [(*p, h) for rows in G.read_rows(iter(packs_of(pieces, batch)), styled=True) for *p, h in zip(*(c.to_pylist() for c in rows.places()), P._main_heights(rows, P._of_prose(rows)[1]).tolist(), strict=True)]
    want = []
    for d, p, k, row in rows_of(pieces, False):
        counted = [q for q in row if not q[11]] or row
        sums = {h: sum(len(q[7]) for q in counted if q[8] == h) for h in dict.fromkeys(q[8] for q in counted)}
        want.append((d, p, k, max(sums, key=sums.get)))
    assert got == want


def test_a_page_in_parts(monkeypatch):
    """A page of any size goes out as it comes: what is held is less than a tenth of it."""
    monkeypatch.setattr(G, "CHUNK", 500)
    pieces = [(1, 1, i, "w", 10.0 * (i % 40), 40_000.0 - 14 * (i // 40), 5.0, 10.0, False, False, False) for i in range(40_000)]
    most, add = [0], G._Held.add

    def noted(self, *packs):
        add(self, *packs)
        most[0] = max(most[0], self.size)

    monkeypatch.setattr(G._Held, "add", noted)
    got = [r["line_no"] for rows in G.read_rows(iter(packs_of(pieces, 4000)), styled=True) for r in P._lines(rows).to_pylist()]
    assert got == list(range(1000)) and most[0] < 4000


def test_pieces_are_shuffled_in_packs(spark):
    """Where whole pages come together, a page is a row of the shuffle."""
    pieces = spark.range(30_000).selectExpr("id div 300 AS doc_id", "1 AS page_no", "CAST(id % 300 AS INT) AS piece_no", "'word' AS str", "72.0 + 40 * (id % 10) AS x", "700.0 - 14 * (id % 300 div 10) AS y", "38.0 AS width", "10.0 AS height", "false AS bold", "false AS italic", "false AS mono").coalesce(1)
    assert 100 <= G.packed(pieces).count() <= 110
    lines = P.styled_lines(pieces)
    assert lines.count() == 3000 and P.line_heights(pieces).agg({"height": "max"}).first()[0] == 10.0
    for table in (lines, P.line_heights(pieces), P.page_rows(pieces)):
        assert table._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_packs_keep_what_they_are_given():
    pieces = [(6, None, 5, "x" * 300, None, 1.5, None, 10.0, None, True, None), (7, 2, 3, "é", 2.0, 1.0, 3.0, None, True, False, True)]
    got = [(r.pages, r.raw.to_pylist(), r.piece_no.tolist(), r.flags.tolist(), np.isnan(r.width).tolist()) for r in G.read_rows(iter(packs_of(pieces, 2)), styled=True)]
    assert got == [([(6, None), (7, 2)], ["x" * 300, "é"], [5, 3], [G.ITALIC, G.BOLD | G.MONO], [True, False])]
