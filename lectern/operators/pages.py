"""Pieces of pages in columns: packed for the shuffle, and read again as whole rows of pieces.

A pack has pieces of one page, column by column, as bytes: a page of a few hundred pieces is a few rows of the shuffle
instead of hundreds. Packs are dealt out by page and sorted by their top edge, and one pass puts their pieces in rows,
some ten thousand at a time. Of a page that has more, rows go out as soon as no later pack reaches up to them; packs of
such pages are cut at every BAND units, so that a page's size bounds no memory unless its pieces lie scattered over the
whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import spoken as S

PAGE = ["doc_id", "page_no"]
SAME_LINE = 3.0
# Sizes: pieces read at once, pieces of one page in a batch from which its packs are cut by height, and how high those are.
CHUNK, LARGE, BAND = 50_000, 1024, 16.0
_NUMBERS = ("y", "x", "width", "height")
BOLD, ITALIC, MONO = 1, 2, 4
_STYLES = {"bold": BOLD, "italic": ITALIC, "mono": MONO}
_CONTROL = r"[\x00-\x1f]+"
#: What normalizing changes: white space other than single spaces between words, and zero-width characters.
_UNEVEN = "^ | $|  |[" + "".join(f"\\x{{{ord(c):x}}}" for c in S._ENDS if c != " ") + r"\x{1c}-\x{1f}\x{200b}-\x{200d}\x{2060}\x{feff}]"
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[*range(0x21), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True  # the bytes that begin such a character


def _offsets(strings: pa.LargeStringArray) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]


def _data(strings: pa.LargeStringArray) -> np.ndarray:
    """The bytes of strings without nulls."""
    offsets, data = _offsets(strings), strings.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(strings) else np.zeros(0, np.uint8)


def _strings(data: np.ndarray | bytes, offsets: np.ndarray) -> pa.LargeStringArray:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))


def first_bytes(strings: pa.LargeStringArray) -> np.ndarray:
    """Of each string; 0 of an empty one."""
    offsets, data = _offsets(strings), _data(strings)
    return np.where(np.diff(offsets) > 0, np.append(data, 0)[np.minimum(offsets[:-1] - offsets[0], len(data))], 0) if len(strings) else np.zeros(0, np.uint8)


def has_text(strings: pa.LargeStringArray) -> np.ndarray:
    """Whether a string has anything but white space."""
    first = first_bytes(strings)
    out = (first > 0x20) & (first < 0x7F)
    if len(rest := np.flatnonzero(~out)):
        out[rest] = pc.not_equal(pc.utf8_trim(strings.take(pa.array(rest)), S._ENDS), "").to_numpy(zero_copy_only=False)
    return out


def uneven(strings: pa.LargeStringArray) -> np.ndarray | None:
    """Which strings normalizing would change; None if there is none that might."""
    if not _SUSPECT[_data(strings)].any():
        return None
    return pc.match_substring_regex(strings, _UNEVEN).to_numpy(zero_copy_only=False)


# ---------------------------------------------------------------- packs


def _packs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, page_no, top, pack) of a batch of pieces."""
    keys = [c for name in PAGE for c in (batch.column(name).fill_null(0).to_numpy(zero_copy_only=False), batch.column(name).is_null().to_numpy(zero_copy_only=False))]
    at = np.lexsort(keys[::-1])
    y = batch.column("y").to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.append(True, np.logical_or.reduce([k[at][1:] != k[at][:-1] for k in keys])))
    more = []
    for a, b in zip(starts, np.append(starts[1:], len(at)), strict=True):
        if b - a > LARGE:
            own = at[a:b][np.argsort(-y[at[a:b]], kind="stable")]
            at[a:b] = own
            band = np.floor(y[own] / BAND)
            more.append(a + 1 + np.flatnonzero(band[1:] != band[:-1]))
    if more:
        starts = np.unique(np.concatenate([starts, *more]))
    if (at[1:] < at[:-1]).any():
        batch = batch.take(pa.array(at))
    numbers = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in _NUMBERS if n in batch.schema.names]
    flags = batch.column("flags").to_numpy(zero_copy_only=False).astype(np.uint8)
    numbered = batch.column("piece_no").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    text = batch.column("str").cast(pa.large_string())
    offsets, data = _offsets(text) - _offsets(text)[0], _data(text)
    lengths = np.diff(offsets)
    lengths = lengths.astype(np.uint8 if lengths.max() < 256 else np.int32)
    steps = np.diff(numbered, prepend=0)
    steps[starts] = numbered[starts]
    tops = np.fmax.reduceat(numbers[0], starts)
    packs = []
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(at)).tolist(), strict=True):
        packs.append(b"".join([np.array([b - a, lengths.itemsize], np.int32).tobytes(), *(c[a:b].tobytes() for c in (*numbers, steps, lengths, flags)), data[offsets[a] : offsets[b]].tobytes()]))
    first = pa.array(starts)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(first), batch.column("page_no").take(first), pa.array(tops), pa.array(packs, pa.binary())], names=[*PAGE, "top", "pack"])


def packed(pieces: DataFrame) -> DataFrame:
    """packs(), dealt out by page and sorted from its top."""
    return packs(pieces).repartition(*PAGE).sortWithinPartitions(*PAGE, F.desc("top"))


def packs(pieces: DataFrame) -> DataFrame:
    """Pieces with text as packs (doc_id, page_no, top, pack) of the pages in a batch."""

    def run(batches):
        for batch in batches:
            text = batch.column("str").cast(pa.large_string())
            kept = has_text(text.fill_null(""))
            if not kept.all():
                batch = batch.filter(pa.array(kept))
            if batch.num_rows:
                yield _packs(batch)

    there = set(pieces.columns)
    flags = sum((F.coalesce(F.col(n).cast("int"), F.lit(0)) * bit for n, bit in _STYLES.items() if n in there), F.lit(0))
    numbers = [F.col(n).cast("double").alias(n) for n in _NUMBERS if n in there]
    own = pieces.select(F.col("doc_id").cast("long"), F.col("page_no").cast("int"), F.col("piece_no").cast("long"), "str", *numbers, flags.cast("byte").alias("flags"))
    return own.mapInArrow(run, "doc_id long, page_no int, top double, pack binary")


def _unpacked(pack: bytes, styled: bool) -> tuple:
    """(y, x, width, height, piece_no, lengths, flags, bytes); height is None of pieces without styles."""
    n, width = np.frombuffer(pack, np.int32, 2).tolist()
    at, out = 8, []
    for kind in (*[np.float64] * (4 if styled else 3), np.int64, np.uint8 if width == 1 else np.int32, np.uint8):
        out.append(np.frombuffer(pack, kind, n, at))
        at += out[-1].nbytes
    out[-3] = np.cumsum(out[-3])
    return (*out[: 4 if styled else 3], *([] if styled else [None]), *out[-3:], pack[at:])


# ---------------------------------------------------------------- rows


@dataclass
class Rows:
    """Pieces in rows, from left to right. first, page and number are of rows: the place of a row's first piece, its
    page as a place in pages, and its number from the page's top. raw: text with its control characters."""

    y: np.ndarray
    x: np.ndarray
    width: np.ndarray
    height: np.ndarray | None
    piece_no: np.ndarray
    flags: np.ndarray
    raw: pa.LargeStringArray
    text: pa.LargeStringArray
    first: np.ndarray
    page: np.ndarray
    number: np.ndarray
    pages: list[tuple]

    def places(self) -> list[pa.Array]:
        """doc_id, page_no and the number of each row."""
        at = pa.array(self.page)
        return [pa.array([p[0] for p in self.pages], pa.int64()).take(at), pa.array([p[1] for p in self.pages], pa.int32()).take(at), pa.array(self.number, pa.int32())]

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.x)))

    def gaps(self) -> np.ndarray:
        """The space before each piece; NaN where the width of the one before is unknown, and anything at a row's begin."""
        out = np.full(len(self.x), np.nan)
        out[1:] = self.x[1:] - self.x[:-1] - self.width[:-1]
        return out

    def spaced(self, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, begins): the text with so many spaces before each piece, and where pieces begin in it, and its end."""
        lengths = np.diff(_offsets(self.text))
        shift = np.cumsum(spaces)
        out = np.full(int(lengths.sum() + (shift[-1] if len(shift) else 0)), 0x20, np.uint8)
        data = _data(self.text)
        out[np.arange(len(data)) + np.repeat(shift, lengths)] = data
        begins = np.append(_offsets(self.text)[:-1] - _offsets(self.text)[0] + shift, len(out))
        return out, begins


def _begins(page: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a piece begins a row: pieces from the top of each page, those within SAME_LINE of a row's first join it."""
    out = np.ones(len(y), bool)
    out[1:] = (page[1:] != page[:-1]) | (y[:-1] - y[1:] > SAME_LINE)
    starts = np.flatnonzero(out)
    ends = np.append(starts[1:], len(y))
    wide = y[starts] - y[ends - 1] > SAME_LINE
    for a, b in zip(starts[wide], ends[wide], strict=True):
        top = y[a]
        for i, value in enumerate(y[a:b].tolist(), a):
            if top - value > SAME_LINE:
                out[i], top = True, value
    return out


class _Held:
    """Packs of some pages, of which the last may go on: its rows begin at number."""

    def __init__(self):
        self.pages, self.columns, self.at, self.size, self.number, self.least = [], [], [], 0, 0, CHUNK

    def add(self, page: tuple, columns: tuple) -> None:
        if not self.pages or self.pages[-1] != page:
            self.pages.append(page)
        self.columns.append(columns)
        self.at.append(len(self.pages) - 1)
        self.size += len(columns[0])

    def rows(self, reach: float | None, clean: tuple[bool, ...]) -> list[Rows | None]:
        """For each of clean, all rows, or only those to which no piece from `reach` downwards can come; the pieces of
        the others stay. Where control characters are text to one and not to another, the page is waited for."""
        if not self.columns:
            return [None] * len(clean)
        columns = [None if c[0] is None else np.concatenate(c) for c in list(zip(*self.columns, strict=True))[:-1]]
        lengths = columns.pop(5)
        page = np.repeat(self.at, [len(c[0]) for c in self.columns])
        raw = _strings(b"".join(c[-1] for c in self.columns), np.append(0, np.cumsum(lengths, dtype=np.int64)))
        control = any(clean) and bool((_data(raw) < 0x20).any())
        if control and reach is not None and not all(clean):
            self.least = 2 * self.size
            return [None] * len(clean)
        pages, number = self.pages, self.number
        self.__init__()
        whole = self._made(pages, number, [*columns, page], raw, raw, reach) if not (control and all(clean)) else None
        if not control:
            return [whole] * len(clean)
        text = pc.replace_substring_regex(raw, _CONTROL, "")
        kept = has_text(text)
        mask = pa.array(kept)
        cleaned = self._made(pages, number, [None if c is None else c[kept] for c in (*columns, page)], raw.filter(mask), text.filter(mask), reach)
        return [cleaned if c else whole for c in clean]

    def _made(self, pages: list, first_number: int, columns: list, raw: pa.LargeStringArray, text: pa.LargeStringArray, reach: float | None) -> Rows | None:
        y, x, width, height, piece_no, flags, page = columns
        order = np.lexsort((np.where(np.isnan(y), -np.inf, -y), page))
        begins = _begins(page[order], y[order])
        row = np.cumsum(begins) - 1
        order = order[np.lexsort((piece_no[order], x[order], row))]
        first = np.flatnonzero(begins)
        of = page[order][first]
        number = np.arange(len(first)) - np.searchsorted(of, of) + np.where(of == 0, first_number, 0)
        n, last = len(first), len(pages) - 1
        if reach is not None:
            tops = np.fmax.reduceat(y[order], first) if n else y[:0]
            n = int(np.count_nonzero((of < last) | (tops - reach > SAME_LINE)))
        end = first[n] if n < len(first) else len(order)
        going, rest = order[:end], order[end:]
        if reach is not None:
            left = raw.take(pa.array(rest))
            self.add(pages[-1], (y[rest], x[rest], width[rest], None if height is None else height[rest], piece_no[rest], np.diff(_offsets(left)), flags[rest], _data(left).tobytes()))
            self.number = int(number[n - 1]) + 1 if n and of[n - 1] == last else first_number if last == 0 else 0
            self.least = max(CHUNK, 2 * len(rest))
        if not n:
            return None
        raw_going = raw.take(pa.array(going))
        same = raw_going if text is raw else text.take(pa.array(going))
        return Rows(y[going], x[going], width[going], None if height is None else height[going], piece_no[going], flags[going], raw_going, same, first[:n], of[:n], number[:n], pages)


def read_ways(batches: Iterator[pa.RecordBatch], clean: tuple[bool, ...], *, styled: bool = False) -> Iterator[list[Rows | None]]:
    """The rows of sorted packs, for each of clean: control characters do not count as text. styled: packs have heights
    and styles."""
    held = _Held()
    for batch in batches:
        for doc, page, top, pack in zip(*(batch.column(n).to_pylist() for n in (*PAGE, "top", "pack")), strict=True):
            if held.size >= held.least:
                going_on = held.pages[-1] == (doc, page)
                yield held.rows(top if going_on else None, clean)
            held.add((doc, page), _unpacked(pack, styled))
    yield held.rows(None, clean)


def read_rows(batches: Iterator[pa.RecordBatch], *, styled: bool = False, clean: bool = False) -> Iterator[Rows]:
    return (rows for rows, in read_ways(batches, (clean,), styled=styled) if rows is not None)
