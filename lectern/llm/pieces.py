"""SentencePiece encoding and decoding: a max-plus parallel scan. Giant documents are split into chunks that
yield boundary-state transfer matrices, which combine associatively; each chunk is then traced back alone.

The public model at hand merges pairs (BPE), so the weights of the lattice are its merge rules: a path of
pieces weighs 0 if every two neighbours, merged by rank, come out as just these two, and minus infinity if
not. Exactly one path over a text has weight 0, and it is the model's own encoding; that holds for the text
between any two places too, so paths can be followed from any chunk's edge.

The state at an edge is the piece over the character before it. A chunk's matrix has weight 0 where a path
leads from the piece at its left edge to that at its right. The model has no piece with a word mark after
another character, so that in ordinary text a matrix is an outer product of what the edges' words allow, and
the inside goes to the library as it is; text without spaces is followed piece by piece. The matrices are
combined `fan` neighbours at a time, level by level, in Spark, so that the edges of one document are settled by
many tasks; products from the left and from the right leave one state at every edge.

Documents up to `chunk` characters are one chunk for the library. Decoding joins pieces and undoes the marks.

Defined results: null encodes to null, empty text to no ids; decoding gives the text back exactly, but for
U+2581, which the model writes as a space; repeated rows encode alike; extra columns pass through.
"""

from __future__ import annotations

import functools
import heapq
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import common as C

MODEL = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"
CHUNK = 1 << 15
FAN = 32
DECODE_IDS = 1 << 16
KNOWN = 1 << 16
MARK = "▁"
_SAFE = re.compile(f"(?<=[^{MARK}]){MARK}")
_WORKER: dict[bytes, Pieces] = {}


class Pieces:
    """A merging SentencePiece model, its rules on strings, and the library's processor."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        sp, n = self.library, self.library.get_piece_size()
        self.id_of = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id_of))
        self.alone: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    @classmethod
    def of(cls, proto: bytes) -> Pieces:
        if proto not in _WORKER:
            _WORKER[proto] = cls(proto)
        return _WORKER[proto]

    def merge(self, text: str) -> list[str]:
        """The model's pieces of a text of marks and characters, merged best first, leftmost first."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (s := self.score.get(both := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-s, i, both))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p is not None]

    def is_piece(self, text: str) -> bool:
        """Whether a text is a piece that merging can make; a lone unknown character counts."""
        if len(text) == 1:
            return True
        if text not in self.score:
            return False
        if text not in self.alone:
            if len(self.alone) >= KNOWN:
                self.alone.clear()
            self.alone[text] = self.merge(text) == [text]
        return self.alone[text]

    def weight(self, a: str, b: str) -> float:
        """0 if two neighbours stay as they are, minus infinity if merging would change them."""
        if a[-1] != MARK and b[0] == MARK:
            return 0.0
        if (a, b) not in self.fits:
            if len(self.fits) >= KNOWN:
                self.fits.clear()
            self.fits[a, b] = self.merge(a + b) == [a, b]
        return 0.0 if self.fits[a, b] else -np.inf

    def follow(self, text: str, at: int, piece: str, stop: int, same: dict[int, str] | None = None) -> dict[int, str]:
        """By place, the last piece of the path that ends there, of all paths from a piece that ends at `at`.

        same: such a result for another start; once the last pieces agree over a longest piece, the rest does.
        """
        ends = {at: piece}
        agreed = 0
        for i in range(at + 1, stop + 1):
            for j in range(i - 1, max(at, i - self.longest) - 1, -1):
                if j in ends and self.is_piece(text[j:i]) and self.weight(ends[j], text[j:i]) == 0:
                    ends[i] = text[j:i]
                    break
            if same is not None:
                agreed = agreed + 1 if ends.get(i) == same.get(i) else 0
                if agreed > self.longest and i - at > self.longest:
                    ends.update((x, p) for x, p in same.items() if x > i)
                    break
            if i - self.longest > at and not any(x in ends for x in range(i - self.longest + 1, i + 1)):
                break
        return ends

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.id_of.get(p)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in p.encode())
        return out

    def edges(self, text: str, at: int) -> list[tuple[int, int]]:
        """The states at an edge: places (start, end) of the pieces over the character before it."""
        return [(a, b) for a in range(max(0, at - self.longest), at) for b in range(at, min(len(text), a + self.longest) + 1) if self.is_piece(text[a:b])]

    def transfer(self, text: str, left: int, right: int, is_first: bool, is_last: bool):
        """(left states, right states, max-plus matrix) of the chunk text[left:right] within its surroundings."""
        entries = [(left, left)] if is_first else self.edges(text, left)
        exits = [(a, b) for a, b in self.edges(text, right) if a >= left and (b == right or not is_last)]
        through = [(a, b) for a, b in self.edges(text, right) if a < left]
        matrix = np.full((len(entries), len(exits) + len(through)), -np.inf)
        first = _SAFE.search(text, left, right)
        head = first.start() if first else None
        tail = text.rfind(MARK, left, right)
        while tail > left and text[tail - 1] == MARK:
            tail -= 1
        known: dict[int, str] | None = None
        if head is not None and tail >= head:
            word = self.follow(text, tail, "x", min(len(text), right + self.longest))
            ends = np.array([0.0 if word.get(b) == text[a:b] and a >= tail and a in word else -np.inf for a, b in exits])
        for row, (a, b) in enumerate(entries):
            start = "x" if is_first else text[a:b]
            if head is not None and tail >= head:
                ok = b <= head and head in self.follow(text, b, start, head)
                matrix[row, : len(exits)] = ends if ok else -np.inf
                continue
            if b >= right:
                matrix[row, len(exits) :] = [0.0 if (a, b) == t else -np.inf for t in through]
                if not is_first:
                    continue
            ends_ = self.follow(text, b, start, min(len(text), right + self.longest), known)
            known = known or ends_
            for column, (c, d) in enumerate(exits):
                if c >= b and c in ends_ and ends_.get(d) == text[c:d]:
                    matrix[row, column] = 0.0
        return entries, exits + through, matrix

    def trace(self, text: str, entry: tuple[int, int], exit_: tuple[int, int], is_first: bool) -> list[int]:
        """Ids of the pieces after the entry piece, up to and with the exit piece."""
        a, b = entry
        if exit_ == entry and not is_first:
            return []
        end = exit_[1]
        first = _SAFE.search(text, b, exit_[0] + 1)
        if first is None:
            return self.ids(self._path(text, b, "x" if is_first else text[a:b], end))
        head = first.start()
        tail = text.rfind(MARK, head, exit_[0] + 1)
        while text[tail - 1] == MARK:
            tail -= 1
        out = self.ids(self._path(text, b, "x" if is_first else text[a:b], head))
        if tail > head:
            out += self.library.encode(text[head + 1 : tail].replace(MARK, " "), out_type=int)
        return out + self.ids(self._path(text, tail, "x", end))

    def _path(self, text: str, at: int, piece: str, end: int) -> list[str]:
        ends = self.follow(text, at, piece, end)
        out = []
        while end > at:
            out.append(ends[end])
            end -= len(ends[end])
        return out[::-1]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices with maximum for the sum and sum for the product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), -np.inf)


State = tuple[int, int]
Transfer = tuple[list[State], list[State], np.ndarray]


def then(one: Transfer, two: Transfer) -> Transfer:
    """One transfer after another: the states at their common edge are matched, and the matrices multiplied."""
    entries, middle, left = one
    own, exits, right = two
    where = {s: j for j, s in enumerate(own)}
    aligned = np.full((len(middle), right.shape[1]), -np.inf)
    for j, s in enumerate(middle):
        if s in where:
            aligned[j] = right[where[s]]
    return entries, exits, max_plus(left, aligned)


def inner_states(parts: list[Transfer], entry: State, exit_: State) -> list[State]:
    """The states at the edges between consecutive parts, given those at both ends."""
    at = parts[0][0].index(entry)
    ahead = [([entry], parts[0][1], parts[0][2][at : at + 1])]
    for part in parts[1:]:
        ahead.append(then(ahead[-1], part))
    state, out = exit_, []
    for i in range(len(parts) - 1, 0, -1):
        entries, exits, matrix = parts[i]
        back = dict(zip(entries, matrix[:, exits.index(state)], strict=True))
        _, middle, weight = ahead[i - 1]
        state = max(zip(middle, weight[0], strict=True), key=lambda m: m[1] + back.get(m[0], -np.inf))[0]
        out.append(state)
    return out[::-1]


TRANSFERS = "k long, f long, c int, entries array<int>, exits array<int>, matrix binary"
EDGES = "k long, f long, c int, a int, b int, y int, z int"


def _pairs(flat) -> list[State]:
    return [tuple(x) for x in np.reshape(flat, (-1, 2)).tolist()]


def _transfers(frame) -> list[Transfer]:
    out = []
    for entries, exits, raw in zip(frame["entries"], frame["exits"], frame["matrix"], strict=True):
        entries, exits = _pairs(entries), _pairs(exits)
        out.append((entries, exits, np.frombuffer(raw, np.float32).reshape(len(entries), len(exits)).astype(float)))
    return out


def settle_edges(found: DataFrame, fan: int) -> DataFrame:
    """The states (a, b) and (y, z) at both edges of every chunk, from the chunks' transfers.

    A parallel scan: `fan` neighbours at a time are combined, level by level, until each document is one
    transfer, which settles its two ends; on the way down each group settles the edges between its parts.
    """

    def combine(key, frame):
        import pandas as pd

        entries, exits, matrix = functools.reduce(then, _transfers(frame.sort_values("c")))
        return pd.DataFrame([(*key, [x for e in entries for x in e], [x for e in exits for x in e], matrix.astype(np.float32).tobytes())], columns=["k", "f", "c", "entries", "exits", "matrix"])

    def ends(frames):
        for frame in frames:
            frame = frame.copy()
            whole = _transfers(frame)
            best = [t[1][int(np.argmax(t[2][0]))] for t in whole]
            for i, name in enumerate("ab"):
                frame[name] = [t[0][0][i] for t in whole]
            for i, name in enumerate("yz"):
                frame[name] = [e[i] for e in best]
            yield frame[["k", "f", "c", "a", "b", "y", "z"]]

    def resolve(frame):
        import pandas as pd

        frame = frame.sort_values("c")
        first, last = ((int(frame[x].iat[0]), int(frame[y].iat[0])) for x, y in ("ab", "yz"))
        inner = inner_states(_transfers(frame), first, last)
        rows = [(*e, *x) for e, x in zip([first, *inner], [*inner, last], strict=True)]
        return pd.DataFrame({"k": frame["k"].to_numpy(), "f": frame["f"].to_numpy(), "c": frame["c"].to_numpy()} | {n: [r[i] for r in rows] for i, n in enumerate("abyz")})

    def above(df: DataFrame):
        return df.withColumn("up", F.floor(F.col("c") / fan).cast("int"))

    levels, most = [found], found.agg(F.max("c")).first()[0] or 0
    while most > 0:
        grouped = above(levels[-1]).groupBy("k", "f", "up")
        levels.append(C.settle(grouped.applyInPandas(combine, TRANSFERS)))
        most //= fan
    edges = levels.pop().mapInPandas(ends, EDGES)
    while levels:
        parts = above(levels.pop()).join(edges.withColumnRenamed("c", "up"), ["k", "f", "up"])
        edges = parts.groupBy("k", "f", "up").applyInPandas(resolve, EDGES)
    return C.settle(edges)


def encode(docs: DataFrame, *, model: str = MODEL, chunk: int = CHUNK, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """docs and ids, the model's encoding of the text; decoded: a column for the text of the ids, made in the same pass."""
    docs = C.prepared(docs, "ids", *filter(None, [decoded]))
    with open(model, "rb") as file:
        proto = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(proto)
    size = F.length(docs[text_col])
    small = _encode_small(docs.where(size.isNull() | (size <= chunk)), shared, text_col, decoded)
    large = docs.where(size > chunk)
    found = _encode_large(large, shared, Pieces.of(proto).longest, chunk, fan, id_col, text_col)
    named = large.select(*[large[c].alias(f"c_{i}") for i, c in enumerate(docs.columns)], *[c.alias(n) for c, n in zip(C._key_columns(large, id_col, text_col)[:2], ("_k", "_f"), strict=True)])
    joined = named.join(found, (named["_k"] == found["k"]) & (named["_f"] == found["f"]))
    joined = joined.select(*[joined[f"c_{i}"].alias(c) for i, c in enumerate(docs.columns)], "ids")
    return small.unionByName(joined if decoded is None else decode(joined, model=model, to=decoded))


def _encode_small(docs: DataFrame, shared, text_col: str, decoded: str | None) -> DataFrame:
    place = docs.columns.index(text_col)
    named = docs.select(*[docs[c].alias(f"c_{i}") for i, c in enumerate(docs.columns)])

    def run(batches):
        library = Pieces.of(shared.value).library
        for batch in batches:
            for part in C.slices([batch], f"c_{place}", C.SLICE_BYTES // 2):
                texts = part.column(place).to_pylist()
                got = library.encode([t or "" for t in texts], out_type=int, num_threads=1)
                ids = pa.array([None if t is None else g for t, g in zip(texts, got, strict=True)], pa.list_(pa.int32()))
                more = {} if decoded is None else {"_decoded": pa.array([None if t is None else d for t, d in zip(texts, library.decode(got), strict=True)], pa.string())}
                yield pa.RecordBatch.from_arrays([*part.columns, ids, *more.values()], names=[*part.schema.names, "ids", *more])

    more = [] if decoded is None else [T.StructField("_decoded", T.StringType())]
    done = named.mapInArrow(run, T.StructType([*named.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *more]))
    return done.select(*[done[f"c_{i}"].alias(c) for i, c in enumerate(docs.columns)], "ids", *[done["_decoded"].alias(decoded) for _ in more])


CHUNKS = "k long, f long, n int, c int, left int, t string"


def cut_texts(batches, chunk: int, longest: int):
    """The texts (k, f, text) as CHUNKS: chunk c of n from place `left` of t, with a longest piece's surroundings on
    both sides. One pass over each text, and rows of about SLICE_BYTES of characters at a time."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    rows: list[tuple] = []
    size = 0

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["k", "f", "n", "c", "left", "t"])

    for batch in C.slices(batches):
        for k, f, text in zip(*(batch.column(x).to_pylist() for x in ("k", "f", "text")), strict=True):
            marked = MARK + text.replace(" ", MARK)
            n = -(-len(marked) // chunk)
            for c in range(n):
                start = max(0, c * chunk - longest)
                rows.append((k, f, n, c, c * chunk - start, marked[start : (c + 1) * chunk + longest]))
                size += len(rows[-1][5])
                if size >= C.SLICE_BYTES:
                    yield table()
                    rows, size = [], 0
    if rows:
        yield table()


def _encode_large(docs: DataFrame, shared, longest: int, chunk: int, fan: int, id_col: str, text_col: str) -> DataFrame:
    """(k, f, ids) of every different long text."""
    keys = C.keyed(docs, id_col=id_col, text_col=text_col).dropDuplicates(["k", "f"])
    chunks = keys.mapInArrow(lambda batches: cut_texts(batches, chunk, longest), CHUNKS).repartition("k", "f", "c")

    def spans(batch):
        for k, f, n, c, left, text in zip(*(x.to_pylist() for x in batch.columns[:6]), strict=True):
            yield k, f, n, c, left, min(len(text), left + chunk), text

    def look(batches):
        pieces = Pieces.of(shared.value)
        for batch in batches:
            rows = []
            for k, f, n, c, left, right, text in spans(batch):
                entries, exits, matrix = pieces.transfer(text, left, right, c == 0, c == n - 1)
                rows.append((k, f, c, [a - left for e in entries for a in e], [a - right for e in exits for a in e], matrix.astype(np.float32).tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["k", "f", "c", "entries", "exits", "matrix"])

    found = chunks.mapInArrow(look, TRANSFERS)
    states = settle_edges(C.settle(found), fan)

    def back(batches):
        pieces = Pieces.of(shared.value)
        for batch in batches:
            out = []
            for (_, _, _, c, left, right, text), a, b, y, z in zip(spans(batch), *(x.to_pylist() for x in batch.columns[6:]), strict=True):
                out.append(pieces.trace(text, (left + a, left + b), (right + y, right + z), c == 0))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("f"), batch.column("c"), pa.array(out, pa.list_(pa.int32()))], ["k", "f", "c", "ids"])

    traced = chunks.join(states, ["k", "f", "c"]).select("k", "f", "n", "c", "left", "t", "a", "b", "y", "z").mapInArrow(back, "k long, f long, c int, ids array<int>")
    ordered = traced.groupBy("k", "f").agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("parts"))
    return ordered.select("k", "f", F.flatten(F.col("parts.ids")).alias("ids"))


def decode(encoded: DataFrame, *, model: str = MODEL, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the text of the ids added; null ids give null."""
    encoded = C.prepared(encoded, to)
    with open(model, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())
    place = encoded.columns.index(ids_col)
    named = encoded.select(*[encoded[c].alias(f"c_{i}") for i, c in enumerate(encoded.columns)])

    def run(batches):
        library = Pieces.of(shared.value).library
        for batch in batches:
            for part in C.slices([batch], batch.schema.names[place], DECODE_IDS):
                ids = part.column(place).to_pylist()
                texts = library.decode([i or [] for i in ids]) if ids else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if i is None else t for i, t in zip(ids, texts, strict=True)], pa.string())], names=[*part.schema.names, to])

    done = named.mapInArrow(run, T.StructType([*named.schema.fields, T.StructField(to, T.StringType())]))
    return done.select(*[done[f"c_{i}"].alias(c) for i, c in enumerate(encoded.columns)], to)


def op1_pieces(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, decoded="decoded")
    return both.select("doc_id", F.length("text").alias("n_chars"), F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == F.col("text")).alias("round_trip"))
