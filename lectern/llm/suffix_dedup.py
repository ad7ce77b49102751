"""Suffix-array dedup: a run-compressed Burrows-Wheeler transform with sampled run ends; matching statistics
stream over it and mark long matches.

One index over a whole corpus can't be shuffled within its own size, so the corpus is first cut where equal
200-byte strings must meet: every window of `length` bytes has a smallest 100-byte hash inside it, equal
windows share it, and consecutive windows that share its place form a segment of at most 300 bytes.

1. Segments are shuffled as packed postings (hash, fingerprint, place), not as text. Equal segments under a
   hash are repeats outright; where a hash has different segments, one of each kind is a candidate.
2. The candidates' texts, few and all different, meet in buckets of hashes of bounded size. There a
   generalised suffix array gives the transform; only its run heads and run ends keep a sample, the longest
   match with the neighbour before or after. Along the text every other position's match is one shorter than
   that of the position before, so that the statistics stream from the samples; a match of `length` or more
   with another place marks the window.
3. Marks return to the documents by key, merge into maximal runs, and the bytes go.

Thousands of copies cost one posting a segment and one candidate text. Equality of whole segments rests on
99 bits of hashes; between different segments the transform decides on the bytes themselves.

Defined results: a null text is empty; texts under `length` bytes stay; repeated rows count as places of
their own and so remove each other; null ids are ordinary; extra columns pass through unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as C

LENGTH = 200
PER_BUCKET = 1_000_000
BUCKET_BYTES = 1 << 20
GROUP_BYTES = 32 << 20
_LOW = np.uint64(22)
_MASK = np.uint64((1 << 22) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of that many values."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.uint64(~np.uint64(0)))
    padded[: len(values)] = values
    cells = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(flat: C.Flat, length: int):
    """(key, start, windows, text row) of the maximal runs of windows with one smallest hash."""
    k = length // 2
    sizes = np.maximum(0, np.diff(flat.offsets) - length + 1)
    total = int(sizes.sum())
    if not total:
        return None
    roller = C.Roller(C.BYTE_HASH[flat.data])
    hashes = C.mix(roller.windows(k))
    marked = (hashes & ~_MASK) | (np.arange(len(hashes), dtype=np.uint64) & _MASK)
    least = sliding_min(marked, length - k + 1)
    row = np.repeat(np.arange(flat.n), sizes)
    at = np.arange(total) + np.repeat(flat.offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
    least = least[at]
    new = np.empty(total, bool)
    new[0], new[1:] = True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    firsts = np.flatnonzero(new)
    windows = np.diff(firsts, append=total)
    start = at[firsts]
    prints = C.mix(roller.spans(start, start + windows + length - 1))
    return C.mix(least[firsts] >> _LOW), start, windows, row[firsts], prints


def segment_postings(docs: DataFrame, length: int, buckets: int, **columns: str) -> DataFrame:
    def look(flat: C.Flat):
        if (got := segments(flat, length)) is None:
            return None
        key, start, windows, row, prints = got
        return key, row, start - flat.offsets[row], (prints & ~np.uint64(255)) | windows.astype(np.uint64)

    return C.keyed(docs, **columns).mapInArrow(lambda batches: C.pack_slices(batches, buckets, look), C.POSTINGS)


SORTED_OUT = f"wanted boolean, size long, {C.MARKS}"
_NAMES = ["g", "ks", "fs", "counts", "places", "tags"]


def sort_out(postings: DataFrame, length: int, groups: int) -> DataFrame:
    """Packed marks: of segments that occur again as a whole (wanted false), and of those whose text must be
    compared (wanted true, tagged with their key, with the bytes they have together)."""

    def run(frame):
        import pandas as pd

        got = C.unpack(frame)
        text = got["text"]
        order = np.lexsort((got["place"], got["fs"][text], got["ks"][text], got["tag"], got["key"]))
        key, tag, place, text = (got[n][order] for n in ("key", "tag", "place", "text"))
        k, f = got["ks"][text], got["fs"][text]
        firsts, ends = C.runs(key, tag)
        again = np.repeat(ends - firsts > 1, ends - firsts)
        by_key, key_ends = C.runs(key)
        kinds = np.bincount(np.searchsorted(by_key, firsts, "right") - 1, minlength=len(by_key))
        wanted = firsts[kinds[np.searchsorted(by_key, firsts, "right") - 1] > 1]
        value = (place.astype(np.uint64) << np.uint64(8)) | (tag & np.uint64(255))
        size = int((tag[wanted] & np.uint64(255)).sum()) + (length - 1) * len(wanted)
        rows = [(False, 0, *r) for r in C.pack_marks(groups, k[again], f[again], value[again])]
        rows += [(True, size if i == 0 else 0, *r) for i, r in enumerate(C.pack_marks(groups, k[wanted], f[wanted], value[wanted], key[wanted]))]
        return pd.DataFrame(rows, columns=["wanted", "size", *_NAMES])

    return postings.groupBy("bucket").applyInPandas(run, SORTED_OUT)


def _values(blob: bytes) -> np.ndarray:
    return np.cumsum(C.unplanes(blob, np.uint64), dtype=np.uint64)


CANDIDATES = "bucket int, ks binary, fs binary, counts binary, places binary, sizes binary, texts binary"


def candidate_texts(docs: DataFrame, wanted: DataFrame, length: int, buckets: int, **columns: str) -> DataFrame:
    """The wanted segments' texts: of some documents, those in a bucket of the keys as one row."""
    left = C.zipped(docs, keep=[], **columns)
    both = left.join(wanted, (left["_k"] == wanted["k"]) & (left["_f"] == wanted["f"])).dropDuplicates(["k", "f"]).select("k", "f", "_text", "marks", "tags")

    def run(batches):
        import zstandard

        open_one, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        kinds = [pa.int32(), *[pa.binary()] * 6]
        names = [c.split()[0] for c in CANDIDATES.split(", ")]
        for batch in batches:
            texts, ks, fs, starts, sizes, keys = [], [], [], [], [], []
            for k, f, packed, marks, tags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, values = open_one(packed), _values(marks)
                start, size = (values >> np.uint64(8)).astype(np.int64), (values & np.uint64(255)).astype(np.int64) + length - 1
                texts += [text[s : s + n] for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                ks.append(np.full(len(start), k, np.int64))
                fs.append(np.full(len(start), f, np.int64))
                starts.append(start)
                sizes.append(size)
                keys.append(C.unplanes(tags, np.uint64))
            if not texts:
                continue
            k, f, start, size = (np.concatenate(x) for x in (ks, fs, starts, sizes))
            bucket = (C.mix(np.concatenate(keys)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            out = []
            for a, b in zip(*C.runs(bucket[order]), strict=True):
                at = order[a:b]
                firsts, ends = C.runs(k[at], f[at])
                out.append((int(bucket[at[0]]), C.planes(k[at][firsts]), C.planes(f[at][firsts]), C.planes((ends - firsts).astype(np.uint32)), C.planes(start[at]), C.planes(size[at].astype(np.uint16)), squeeze(b"".join(texts[i] for i in at))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return both.mapInArrow(run, CANDIDATES)


class RunIndex:
    """The run-compressed transform of a set of texts, each with its own end mark, and its samples."""

    FIRST = 7

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.n = len(data)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(self.n)
        self.begins = np.cumsum(sizes) - sizes
        self.data = data
        array = self._suffix_array(int(sizes.max()))
        before = data[array - 1].astype(np.int16)
        at_start = np.zeros(self.n, bool)
        at_start[self.begins] = True
        before[at_start[array]] = -1
        change = np.ones(self.n + 1, bool)
        change[1:-1] = (before[1:] != before[:-1]) | (before[1:] < 0)
        heads, ends = np.flatnonzero(change[:-1]), np.flatnonzero(change[1:])
        self.runs = len(heads)
        self.samples = [(array[heads], self._common(np.where(heads > 0, array[heads - 1], -1), array[heads])), (array[ends], self._common(np.where(ends + 1 < self.n, array[np.minimum(ends + 1, self.n - 1)], -1), array[ends]))]
        del self.levels

    def _suffix_array(self, longest: int) -> np.ndarray:
        n, size = self.n, self.FIRST
        key = np.zeros(n, np.uint64)
        for j in range(size):
            c = np.zeros(n, np.uint64)
            c[: n - j] = self.data[j:].astype(np.uint64) + np.uint64(1)
            c[self.left <= j] = 0
            key = (key << np.uint64(9)) | c
        self.levels: list[tuple[int, np.ndarray]] = []
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0, dtype=np.int32) + 1
            self.levels.append((size, rank))
            if size >= longest or rank.max() == n:
                return order
            then = np.zeros(n, np.uint64)
            then[: max(0, n - size)] = rank[size:]
            then[self.left <= size] = 0
            key = (rank.astype(np.uint64) << np.uint64(32)) | then
            size *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common start of the texts' rests at a and b; 0 where a is -1."""
        none, x, y = a < 0, np.maximum(a, 0), b.copy()
        most = np.minimum(self.left[x], self.left[y])
        length = np.zeros(len(b), np.int64)
        for size, rank in reversed(self.levels):
            same = rank[x] == rank[y]
            length += size * same
            x, y = np.minimum(x + size * same, self.n - 1), np.minimum(y + size * same, self.n - 1)
        going = np.ones(len(b), bool)
        for _ in range(self.FIRST):
            going &= (self.data[x] == self.data[y]) & (length < most)
            length += going
            x, y = np.minimum(x + going, self.n - 1), np.minimum(y + going, self.n - 1)
        return np.where(none, 0, np.minimum(length, most))

    def statistics(self) -> np.ndarray:
        """At every place the length of its longest match with another place, streamed from the samples."""
        best = np.zeros(self.n, np.int64)
        for place, value in self.samples:
            order = np.argsort(place)
            place, value = place[order], value[order]
            since = np.searchsorted(place, np.arange(self.n), "right") - 1
            best = np.maximum(best, value[since] - (np.arange(self.n) - place[since]))
        return best


def compare(candidates: DataFrame, length: int, groups: int) -> DataFrame:
    """Packed marks of the candidate segments' windows that start elsewhere too."""

    def run(frame):
        import pandas as pd
        import zstandard

        open_one = zstandard.ZstdDecompressor().decompress
        counts = [C.unplanes(x, np.uint32).astype(np.int64) for x in frame["counts"]]
        k = np.concatenate([np.repeat(C.unplanes(x, np.int64), n) for x, n in zip(frame["ks"], counts, strict=True)])
        f = np.concatenate([np.repeat(C.unplanes(x, np.int64), n) for x, n in zip(frame["fs"], counts, strict=True)])
        start = np.concatenate([C.unplanes(x, np.int64) for x in frame["places"]])
        size = np.concatenate([C.unplanes(x, np.uint16).astype(np.int64) for x in frame["sizes"]])
        index = RunIndex(np.frombuffer(b"".join(map(open_one, frame["texts"])), np.uint8), size)
        found = np.flatnonzero(index.statistics() >= length)
        segment = np.searchsorted(index.begins, found, "right") - 1
        place = start[segment] + found - index.begins[segment]
        firsts, ends = C.runs(segment, found - np.arange(len(found)))
        value = (place[firsts].astype(np.uint64) << np.uint64(8)) | (ends - firsts).astype(np.uint64)
        return pd.DataFrame(C.pack_marks(groups, k[segment[firsts]], f[segment[firsts]], value), columns=_NAMES)

    return candidates.groupBy("bucket").applyInPandas(run, C.MARKS)


def remove_long_matches(docs: DataFrame, *, length: int = LENGTH, per_bucket: int = PER_BUCKET, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the text as the bytes that stay, and n_bytes, n_removed, n_spans."""
    columns = {"id_col": id_col, "text_col": text_col}
    docs = C.prepared(docs, "n_bytes", "n_removed", "n_spans")
    total = C.text_bytes(docs, text_col)
    buckets = C.bucket_count(total * 4 / length, per_bucket)
    groups = C.bucket_count(total, GROUP_BYTES)
    sorted_out = C.settle(sort_out(segment_postings(docs, length, buckets, **columns), length, groups))
    wanted = int(sorted_out.agg(F.sum("size")).first()[0] or 0)
    packed = sorted_out.where("NOT wanted").select(*_NAMES[:-1])
    if wanted:
        places = C.merge_marks(sorted_out.where("wanted").select(*_NAMES), np.uint64)
        texts = candidate_texts(docs, places, length, C.bucket_count(wanted, bucket_bytes), **columns)
        packed = packed.unionByName(compare(texts, length, groups).drop("tags"))
    marks = C.merge_marks(packed, np.uint64)

    def change(texts, blobs):
        new, n_bytes, n_removed, n_spans = [], [], [], []
        for text, blob in zip(texts, blobs, strict=True):
            data = np.frombuffer(text or b"", np.uint8)
            n_bytes.append(len(data))
            if not blob:
                new.append(text or b"")
                n_removed.append(0)
                n_spans.append(0)
                continue
            values = _values(blob)
            start, size = (values >> np.uint64(8)).astype(np.int64), (values & np.uint64(255)).astype(np.int64)
            ends = np.zeros(len(data) + 1, np.int64)
            np.add.at(ends, start, 1)
            np.add.at(ends, start + size + length - 1, -1)
            gone = np.cumsum(ends[:-1]) > 0
            new.append(data[~gone].tobytes())
            n_removed.append(int(gone.sum()))
            n_spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
        return new, n_bytes, n_removed, n_spans

    return C.rewrite(docs, marks, change, "n_bytes bigint, n_removed bigint, n_spans bigint", keep=keep, as_bytes=True, **columns)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = remove_long_matches(C.table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
