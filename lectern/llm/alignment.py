"""Cross-tokenizer alignment: a byte-level BPE (A) and a merging SentencePiece model (B) over the same bytes.

Exact-text deduplication: documents are shuffled by full text, every distinct text is tokenised and aligned once,
its pairs count as often as it has documents, and the measures are joined back to the documents by SHA-256 of the text.

A token of A and one of B are linked where their byte ranges overlap; since both tile the same bytes, the links are
the stretches between neighbouring token ends of either. A text's links leave its task as (text, pair, times), packed
for PACK_BYTES of texts and a bucket of A ids. Bucket by bucket, the corpus-wide counts stream ahead of the packs that
ask for them, so that a task holds one bucket's counts (their number is bounded by the two vocabularies) and one pack.

Long texts are tokenised in portions that begin at a single space between two letters, where neither model joins.

Defined results: texts that are null, empty, or that B does not reproduce (those with U+2581) have no tokens, so zeros
and ''; repeated rows count once each for their pairs and have equal measures; null ids pass; extra columns pass
through, but for those of the same names as the measures; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as C
from lectern.llm.pieces import MODEL

BYTE_MODEL = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.json"
PACK_BYTES = 4 << 20
PORTION = 1 << 17
BUCKETS = 32
"""Parts of the pair counts, by A id."""
PACKS = 4096
"""Packs that share a copy of the pair counts."""

WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""Fixed: the words that byte-level BPE merges within."""

_EDGE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of each id of a model, and the ids as decimals with what may follow them."""

    def __init__(self, tokens: list[bytes], marks: tuple[str, str]):
        self.n = len(tokens)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.bytes = pa.array(tokens, pa.binary())
        self.names = pa.array([f"{i}{m}".encode() for m in marks for i in range(self.n)], pa.binary())
        self.widths = np.array([len(f"{i}") + 1 for i in range(self.n)] * 2, np.int64)


class Tokenizers:
    """Both models, as a worker keeps them."""

    def __init__(self, byte_model: bytes, piece_model: bytes):
        import sentencepiece
        import tiktoken

        model = json.loads(byte_model)
        special = {t["content"] for t in model["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[x] for x in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        for i, merge in enumerate(model["model"]["merges"]):
            if ranks[b"".join(bytes(letters[x] for x in part) for part in (merge if isinstance(merge, list) else merge.split(" ")))] != 256 + i:
                raise ValueError("the byte-level model does not number its merges in their order")
        by_id = {i: t for t, i in ranks.items()}
        self.a = Vocabulary([by_id.get(i, b"") for i in range(max(by_id) + 1)], (",", "|"))
        self.bpe = tiktoken.Encoding("byte-level", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sp = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        told = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
        self.b = Vocabulary(told, (",", ";"))

    @staticmethod
    @functools.cache
    def of(byte_model: bytes, piece_model: bytes) -> Tokenizers:
        return Tokenizers(byte_model, piece_model)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of the texts with a space before each."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            for part in portions(" " + text):
                parts.append(part)
                owner.append(i)
        a = [self.bpe.encode_to_numpy(p, disallowed_special=()).astype(np.int64) for p in parts]
        b = [np.array(x, np.int64) for x in self.pieces.encode([p[1:] for p in parts], num_threads=1)]
        if len(parts) == len(texts):
            return a, b
        at = np.searchsorted(owner, np.arange(len(texts) + 1))
        return tuple([np.concatenate(x[i:j]) for i, j in zip(at, at[1:], strict=False)] for x in (a, b))


def portions(text: str, size: int = PORTION) -> list[str]:
    """The text in portions of about that size, each of which begins with a space."""
    out, at = [], 0
    while len(text) - at > size and (edge := _EDGE.search(text, at + size)):
        out.append(text[at : edge.start()])
        at = edge.start()
    return [*out, text[at:]]


def reproduces(vocabulary: Vocabulary, ids: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Of each text, whether its tokens' bytes are the text."""
    sizes = np.array([int(vocabulary.size[x].sum()) for x in ids], np.int64)
    right = sizes == [len(t) for t in texts]
    some = np.flatnonzero(right)
    if len(some):
        joined = vocabulary.bytes.take(pa.array(np.concatenate([ids[i] for i in some]))).buffers()[2]
        got, want = (np.frombuffer(x or b"", np.uint8) for x in (joined, b"".join(texts[i] for i in some)))
        wrong = np.flatnonzero(got[: len(want)] != want)
        right[some[np.searchsorted(np.cumsum(sizes[some]), wrong, "right")]] = False
    return right


class Alignment:
    """The links and groups of some texts' tokens, in one row of bytes."""

    def __init__(self, both: Tokenizers, a: list[np.ndarray], b: list[np.ndarray]):
        self.both, self.n = both, len(a)
        self.count_a, self.count_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *ids]) for ids in (a, b))
        end_a, end_b = np.cumsum(both.a.size[self.a]), np.cumsum(both.b.size[self.b])
        total = int(end_a[-1]) if len(end_a) else 0
        in_a, in_b = np.zeros(total + 1, np.int8), np.zeros(total + 1, np.int8)
        in_a[end_a], in_b[end_b] = 1, 1
        ends = np.flatnonzero(in_a | in_b)
        self.of_a, self.of_b = (np.cumsum(x[ends]) - x[ends] for x in (in_a.astype(np.int64), in_b.astype(np.int64)))
        shared = (in_a & in_b)[ends] > 0
        self.last_a, self.last_b = self.of_a[shared], self.of_b[shared]
        text_of_a = np.repeat(np.arange(self.n), self.count_a)
        self.text = text_of_a[self.of_a]
        self.n_links = np.bincount(self.text, minlength=self.n)
        self.n_groups = np.bincount(self.text[shared], minlength=self.n)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of the different pairs of each text; a pair is its A id times B's size plus its B id."""
        width = np.int64(self.both.a.n * self.both.b.n)
        found, times = np.unique(self.text * width + self.a[self.of_a] * self.both.b.n + self.b[self.of_b], return_counts=True)
        return found // width, found % width, times

    def groups(self) -> list[bytes]:
        """Each text's groups as a1,a2|b1;a3|b2."""
        group_a, group_b = (np.searchsorted(last, np.arange(len(ids))) for last, ids in ((self.last_a, self.a), (self.last_b, self.b)))
        items = np.empty(len(self.a) + len(self.b), np.int64)
        ends_a, ends_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        ends_a[self.last_a], ends_b[self.last_b] = 1, 1
        before_b, upto_a = np.append(0, self.last_b + 1)[group_a], (self.last_a + 1)[group_b]
        shift = 2 * self.both.a.n
        items[np.arange(len(self.a)) + before_b] = self.a + ends_a * self.both.a.n
        items[np.arange(len(self.b)) + upto_a] = shift + self.b + ends_b * self.both.b.n
        names = pa.concat_arrays([self.both.a.names, self.both.b.names]).take(pa.array(items))
        widths = np.concatenate([self.both.a.widths, self.both.b.widths])[items]
        whole = (names.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        stops = np.append(0, np.cumsum(widths))[np.append(0, np.cumsum(self.count_a + self.count_b))]
        return [whole[i : max(i, j - 1)] for i, j in zip(stops, stops[1:], strict=False)]


def squeeze(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(C.planes(values))


def expand(blob: bytes, kind: type) -> np.ndarray:
    import zstandard

    return C.unplanes(zstandard.ZstdDecompressor().decompress(blob), kind)


TEXTS = "key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LINKS = "bucket int, texts binary, copies binary, counts binary, pairs binary, places binary, times binary"
_TABLE = pa.schema([("pack", pa.int64()), ("text", pa.int32()), ("key", pa.binary()), *[(n, pa.int64()) for n in MEASURES[:4]], ("groups_sha256", pa.string()), ("bucket", pa.int32()), *[(n, pa.binary()) for n in ("texts", "copies", "counts", "pairs", "places", "times")]])


def pack_links(pack: int, text: np.ndarray, pair: np.ndarray, times: np.ndarray, copies: np.ndarray, width: int, buckets: int) -> dict[str, list]:
    """A pack's (text, pair, times) as a row for each bucket of A ids."""
    out: dict[str, list] = {n: [] for n in _TABLE.names}
    bucket = (C.mix((pair // width).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts, ends = C.runs(bucket[order])
    for a, b in zip(cuts, ends, strict=True):
        at = order[a:b]
        pairs, place = np.unique(pair[at], return_inverse=True)
        texts, counts = np.unique(text[at], return_counts=True)
        row = {"pack": pack, "bucket": int(bucket[at[0]]), "texts": squeeze(texts), "copies": squeeze(copies[texts]), "counts": squeeze(counts), "pairs": squeeze(np.diff(pairs, prepend=0)), "places": squeeze(C.steps(place.astype(np.uint32), counts)), "times": squeeze(times[at].astype(np.uint32))}
        for name, values in out.items():
            values.append(row.get(name))
    return out


def align_texts(distinct: DataFrame, byte_model: str, piece_model: str, buckets: int) -> DataFrame:
    """Of (key, text, copies): a row of TEXTS for each text, by pack and text, and the rows of LINKS of every pack."""
    context = distinct.sparkSession.sparkContext
    shared = []
    for path in (byte_model, piece_model):
        with open(path, "rb") as file:
            shared.append(context.broadcast(file.read()))

    def run(batches):
        both = Tokenizers.of(*(s.value for s in shared))
        task, packs, held, copies, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def packed():
            text, pair, times = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict(pack_links(task + packs, text, pair, times, np.array(copies, np.int64), both.b.n, buckets), _TABLE)

        for batch in C.slices(batches, limit=C.SLICE_BYTES // 2):
            texts = batch.column("text").to_pylist()
            a, b = both.encode(texts)
            raw = [b" " + t.encode() for t in texts]
            right = reproduces(both.a, a, raw) & reproduces(both.b, b, raw)
            none = np.zeros(0, np.int64)
            found = Alignment(both, *([x if r else none for x, r in zip(ids, right, strict=True)] for ids in (a, b)))
            sums = [hashlib.sha256(g).hexdigest() if r else "" for g, r in zip(found.groups(), right, strict=True)]
            n, at = len(texts), len(copies)
            rows = {"pack": [task + packs] * n, "text": range(at, at + n), "key": batch.column("key"), "n_a": found.count_a, "n_b": found.count_b, "n_groups": found.n_groups, "n_links": found.n_links, "groups_sha256": sums}
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in _TABLE], schema=_TABLE)
            text, pair, times = found.pairs()
            held.append((text + at, pair, times))
            copies += batch.column("copies").to_pylist()
            size += sum(map(len, raw))
            if size >= PACK_BYTES:
                yield packed()
                packs, held, copies, size = packs + 1, [], [], 0
        if held:
            yield packed()

    return distinct.select("key", "text", "copies").mapInArrow(run, f"pack long, text int, {TEXTS}, {LINKS}")


def _entries(row: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, text of each entry, place of its pair, times) of a row of LINKS."""
    counts = expand(row["counts"], np.int64)
    return np.cumsum(expand(row["pairs"], np.int64)), np.repeat(expand(row["texts"], np.int64), counts), C.unsteps(expand(row["places"], np.uint32), counts).astype(np.int64), expand(row["times"], np.uint32).astype(np.int64)


def pair_counts(links: DataFrame) -> DataFrame:
    """(bucket, pair, documents): in how many documents each pair of ids is linked."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pairs, _, place, _ = _entries(row)
                copies = np.repeat(expand(row["copies"], np.int64), expand(row["counts"], np.int64))
                n = np.zeros(len(pairs), np.int64)
                np.add.at(n, place, copies)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["bucket"], np.int32)), pa.array(pairs), pa.array(n)], ["bucket", "pair", "documents"])

    per_pack = links.mapInArrow(run, "bucket int, pair long, documents long")
    return per_pack.groupBy("bucket", "pair").agg(F.sum("documents").alias("documents"))


class Counts:
    """The pair counts of one bucket: of a pair its documents, and whether no pair of its A id has more."""

    def __init__(self, pair: np.ndarray, documents: np.ndarray, width: int):
        order = np.argsort(pair)
        self.pair, self.documents = pair[order], documents[order]
        cuts, ends = C.runs(self.pair // width)
        self.best = self.documents == np.repeat(np.maximum.reduceat(self.documents, cuts), ends - cuts)


def weigh(links: DataFrame, counts: DataFrame, width: int, packs: int) -> DataFrame:
    """(pack, text, n_best, count_sum) of every text that has links; the counts stream ahead of the packs of their bucket."""
    copies = -(-packs // PACKS)
    names = [f.split()[0] for f in LINKS.split(", ")]
    asked = links.select("pack", *names, F.pmod(F.xxhash64("pack"), F.lit(copies)).alias("copy"), F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("documents"))
    told = counts.select(F.lit(None).cast("long").alias("pack"), "bucket", *[F.lit(None).cast("binary").alias(n) for n in names[1:]], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"), "pair", "documents")
    met = told.unionByName(asked).repartition("bucket", "copy").sortWithinPartitions("bucket", "copy", F.col("pack").asc_nulls_first())

    def run(batches):
        at, parts, known = None, [], None
        for batch in batches:
            place = np.stack([batch.column(n).to_numpy() for n in ("bucket", "copy")], axis=1)
            for i, j in zip(*C.runs(place[:, 0], place[:, 1]), strict=True):
                part = batch.slice(i, j - i)
                if tuple(place[i]) != at:
                    at, parts, known = tuple(place[i]), [], None
                asks = part.column("pack").is_valid().to_numpy(zero_copy_only=False)
                split = int(np.argmax(asks)) if asks.any() else len(asks)
                if split:
                    parts.append([part.column(n).slice(0, split).to_numpy() for n in ("pair", "documents")])
                for row in part.slice(split).select(["pack", *names]).to_pylist():
                    known = known or Counts(*(np.concatenate(x) for x in zip(*parts, strict=True)), width)
                    pairs, text, where, times = _entries(row)
                    there = np.searchsorted(known.pair, pairs)
                    sums = np.zeros((2, int(text[-1]) + 1), np.int64)
                    np.add.at(sums[0], text, times * known.best[there][where])
                    np.add.at(sums[1], text, times * known.documents[there][where])
                    seen = np.unique(text)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), row["pack"], np.int64)), pa.array(seen.astype(np.int32)), pa.array(sums[0][seen]), pa.array(sums[1][seen])], ["pack", "text", "n_best", "count_sum"])

    found = met.mapInArrow(run, "pack long, text int, n_best long, count_sum long")
    return found.groupBy("pack", "text").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, *, byte_model: str = BYTE_MODEL, piece_model: str = MODEL, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """docs with MEASURES and groups_sha256: tokens of A and B, groups, links, those that are the most frequent of their
    A id, and the sum of the links' counts."""
    import sentencepiece

    docs = C.prepared(docs, *MEASURES, "groups_sha256")
    steps = C.Steps(docs.sparkSession)
    text = docs[text_col].cast("string")
    distinct = docs.select(text.alias("text")).where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("copies"))
    distinct = distinct.select("text", "copies", F.unhex(F.sha2("text", 256)).alias("key"))
    found = steps.store(align_texts(distinct, byte_model, piece_model, buckets))
    texts, links = found.where("bucket IS NULL").select("pack", "text", *[f.split()[0] for f in TEXTS.split(", ")]), found.where("bucket IS NOT NULL")
    packs = links.agg(F.count_distinct("pack")).first()[0]
    width = sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()
    sums = weigh(links, pair_counts(links), width, max(1, packs))
    measured = steps.store(texts.join(sums, ["pack", "text"], "left").select("key", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in MEASURES], "groups_sha256"))
    steps.done(measured)
    named = docs.select(*[docs[c].alias(f"c_{i}") for i, c in enumerate(docs.columns)], F.unhex(F.sha2(text, 256)).alias("_key"))
    joined = named.join(measured, named["_key"] == measured["key"], "left")
    return joined.select(*[joined[f"c_{i}"].alias(c) for i, c in enumerate(docs.columns)], *[F.coalesce(joined[n], F.lit(0).cast("long")).alias(n) for n in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs).select("doc_id", *MEASURES, "groups_sha256")
