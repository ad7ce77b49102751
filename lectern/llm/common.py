"""What the training-data operators share: flat byte views of Arrow text, vectorised words and rolling
hashes, packed postings for the shuffle, and the read-side plumbing around documents.

Postings are packed because a row per token window would cost more than thirty bytes in a shuffle; a row
here holds the postings of PACK_BYTES of a task's texts that fall into one bucket of the key space, so Spark
still partitions, shuffles and recovers the work, at eight or nine bytes a window.

Common to all operators: ids are integers (another type is refused when the job is planned); a column that an
operator adds replaces one of the same name in its input.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 19
"""Text that a task looks at in one go; a longer single text is a slice of its own."""

PACK_BYTES = 8 << 20
"""Text whose postings are packed together."""

BATCH_BYTES = 4 << 20
"""Bytes of an Arrow batch on its way to a Python worker."""

NULL_KEY = (1 << 63) - 1
"""Order key of a null doc_id: larger than any other."""

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def times(factor: np.uint64, n: int) -> np.uint64:
    """factor * n modulo 2**64."""
    return np.uint64(int(factor) * n & 0xFFFFFFFFFFFFFFFF)


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_powers: dict[str, np.ndarray] = {}


def _power_series(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling base, and of its inverse, modulo 2**64; a worker keeps those of a slice."""
    size = SLICE_BYTES + 1024
    if n > size:
        return _power_series(_BASE, n), _power_series(_BASE_INV, n)
    if not _powers:
        _powers.update(up=_power_series(_BASE, size), down=_power_series(_BASE_INV, size))
    return _powers["up"][:n], _powers["down"][:n]


class Roller:
    """Rabin-Karp hashes of any spans of one sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def windows(self, width: int) -> np.ndarray:
        """Hash of every span of that width."""
        n = max(0, len(self.sums) - width)
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


class Flat:
    """The texts of a slice as one byte array; nulls count as empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"")
        self.n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n + 1]
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]

    def words(self, is_space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each text the number of words before it (with a last total)."""
        inside = ~is_space[self.data]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < len(inside)]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        last = self.offsets[1:][self.offsets[1:] > 0] - 1
        after[last] = False
        return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """The hash of every word, a stretch of about SLICE_BYTES at a time."""
        table, out, at = BYTE_HASH_LOWER if lower else BYTE_HASH, np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            size = (ends[at:to] - starts[at:to]).astype(np.uint64)
            out[at:to] = mix(Roller(table[self.data[base : ends[to - 1]]]).spans(starts[at:to] - base, ends[at:to] - base) + size * _MULT)
            at = to
        return out


BYTE_HASH_LOWER = BYTE_HASH.copy()
BYTE_HASH_LOWER[0x41:0x5B] = BYTE_HASH[0x61:0x7B]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the column holds about so many bytes (of a list: elements) at most in each, one
    row at least."""
    for batch in batches:
        length = pa.compute.list_value_length if pa.types.is_list(batch.column(column).type) else pa.compute.binary_length
        sizes = length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def planes(values: np.ndarray, width: int | None = None) -> bytes:
    """Little-endian bytes, all lowest bytes first; small values then compress to little. width: bytes kept."""
    values = np.ascontiguousarray(values)
    size = values.dtype.itemsize
    return values.view(np.uint8).reshape(len(values), size)[:, : width or size].T.tobytes()


def unplanes(blob: bytes, dtype: type, width: int | None = None) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    got = np.frombuffer(blob, np.uint8).reshape(width or size, -1)
    full = np.zeros((got.shape[1], size), np.uint8)
    full[:, : got.shape[0]] = got.T
    return full.view(dtype).ravel()


def steps(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Differences within each run of so many values; the first of a run stays."""
    out = np.diff(values, prepend=values.dtype.type(0))
    firsts = np.cumsum(counts) - counts
    out[firsts] = values[firsts]
    return out


def unsteps(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total, firsts = np.cumsum(values, dtype=values.dtype), np.cumsum(counts) - counts
    return total - np.repeat(total[firsts] - values[firsts], counts)


POSTINGS = "bucket int, keys binary, ks binary, fs binary, counts binary, places binary, tags binary"
KEY_BYTES = 7


def pack(buckets: int, keys: np.ndarray, rows: np.ndarray, places: np.ndarray, ks: np.ndarray, fs: np.ndarray, tags: np.ndarray | None = None) -> pa.RecordBatch:
    """Postings (key, text row, place in the text) of some texts, as a row for each bucket of keys.

    The bucket comes from the key's top bits and the row keeps the low 56, so that a key has 56 bits and
    the logarithm of the number of buckets. rows must not decrease. tags: a second 64-bit value a posting.
    """
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable").astype(np.int32)
    bucket = bucket[order]
    cuts, ends = runs(bucket)
    out: dict[str, list] = {name.split()[0]: [] for name in POSTINGS.split(", ")}
    for a, b in zip(cuts, ends, strict=True):
        at = order[a:b]
        row, counts = np.unique(rows[at], return_counts=True)
        out["bucket"].append(int(bucket[a]))
        out["keys"].append(planes(keys[at], KEY_BYTES))
        out["ks"].append(planes(np.diff(ks[row], prepend=0)))
        out["fs"].append(planes(fs[row]))
        out["counts"].append(planes(counts.astype(np.uint32)))
        out["places"].append(planes(steps(places[at].astype(np.uint32), counts)))
        out["tags"].append(None if tags is None else planes(tags[at]))
    kinds = [pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def pack_slices(batches: Iterator[pa.RecordBatch], buckets: int, look) -> Iterator[pa.RecordBatch]:
    """pack() for a task's texts (k, f, text), about PACK_BYTES of them at a time.

    look(flat) gives a slice's postings as (keys, rows, places, tags or None), or None if it has none.
    """
    held: list[list[np.ndarray]] = [[], [], [], []]
    ks, fs, rows, size = [], [], 0, 0

    def joined(parts: list[np.ndarray]) -> np.ndarray | None:
        whole = np.concatenate(parts) if parts else None
        parts.clear()
        return whole

    def packed():
        nonlocal rows, size
        keys, row, place, tags = map(joined, held)
        yield pack(buckets, keys, row, place, joined(ks), joined(fs), tags)
        rows = size = 0

    for batch in slices(batches):
        flat = Flat(batch.column("text"))
        got = look(flat)
        if got is None or not len(got[0]):
            continue
        for x, values in zip(held, got, strict=True):
            if values is not None:
                x.append(values)
        held[1][-1] = held[1][-1].astype(np.int32) + np.int32(rows)
        held[2][-1] = held[2][-1].astype(np.uint32)
        ks.append(batch.column("k").to_numpy())
        fs.append(batch.column("f").to_numpy())
        rows, size = rows + flat.n, size + len(flat.data)
        if size >= PACK_BYTES:
            yield from packed()
    if ks:
        yield from packed()


def unpack(frame) -> dict[str, np.ndarray]:
    """The postings of a pandas frame of packed rows: key (low 56 bits), place, tag if there is one, and text, the
    place of the posting's text in ks and fs."""
    counts = [unplanes(x, np.uint32).astype(np.int64) for x in frame["counts"]]
    total = sum(int(c.sum()) for c in counts)
    out = {"key": np.empty(total, np.uint64), "place": np.empty(total, np.uint32)}
    if frame["tags"].iat[0] is not None:
        out["tag"] = np.empty(total, np.uint64)
    at = 0
    for row, count in zip(frame.itertuples(index=False), counts, strict=True):
        to = at + int(count.sum())
        out["key"][at:to] = unplanes(row.keys, np.uint64, KEY_BYTES)
        out["place"][at:to] = unsteps(unplanes(row.places, np.uint32), count)
        if "tag" in out:
            out["tag"][at:to] = unplanes(row.tags, np.uint64)
        at = to
    out["ks"] = np.concatenate([np.cumsum(unplanes(x, np.int64)) for x in frame["ks"]])
    out["fs"] = np.concatenate([unplanes(x, np.int64) for x in frame["fs"]])
    counts = np.concatenate(counts)
    out["text"] = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches over which none of the columns changes."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    cuts = np.flatnonzero(new)
    return cuts, np.append(cuts, len(new))[1:]


MARKS = "g int, ks binary, fs binary, counts binary, places binary, tags binary"
PLACES = "k long, f long, marks binary"
TAGGED_PLACES = "k long, f long, marks binary, tags binary"


def pack_marks(groups: int, k: np.ndarray, f: np.ndarray, place: np.ndarray, tags: np.ndarray | None = None) -> list[tuple]:
    """Marked places (unsigned) as a row for each group of documents, so that what a reducer makes does not
    grow with the documents it has seen; schema MARKS."""
    g = (mix(k.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((place, f, k, g))
    g, k, f, place = g[order], k[order], f[order], place[order]
    tags = None if tags is None else tags[order]
    rows = []
    for a, b in zip(*runs(g), strict=True):
        firsts, ends = runs(k[a:b], f[a:b])
        counts = ends - firsts
        rows.append((int(g[a]), planes(np.diff(k[a:b][firsts], prepend=0)), planes(f[a:b][firsts]), planes(counts.astype(np.uint32)), planes(steps(place[a:b], counts)), None if tags is None else planes(tags[a:b])))
    return rows


def merge_marks(packed: DataFrame, dtype: type) -> DataFrame:
    """One row for each document that has marks: its sorted places, and their tags if there are any."""
    tagged = "tags" in packed.columns

    def run(frame):
        import pandas as pd

        got: list[list[np.ndarray]] = [[], [], [], []]
        for row in frame.itertuples(index=False):
            counts = unplanes(row.counts, np.uint32).astype(np.int64)
            got[0].append(np.repeat(np.cumsum(unplanes(row.ks, np.int64)), counts))
            got[1].append(np.repeat(unplanes(row.fs, np.int64), counts))
            got[2].append(unsteps(unplanes(row.places, dtype), counts))
            if tagged:
                got[3].append(unplanes(row.tags, np.uint64))
        k, f, place, *tags = (np.concatenate(x) for x in got if x)
        order = np.lexsort((place, f, k))
        k, f, place = k[order], f[order], place[order]
        cuts, ends = runs(k, f)
        out = {"k": k[cuts], "f": f[cuts], "marks": [planes(np.diff(place[a:b], prepend=dtype(0))) for a, b in zip(cuts, ends, strict=True)]}
        if tagged:
            out["tags"] = [planes(tags[0][order][a:b]) for a, b in zip(cuts, ends, strict=True)]
        return pd.DataFrame(out)

    return packed.groupBy("g").applyInPandas(run, TAGGED_PLACES if tagged else PLACES)


def keyed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, f and text: the id (null: NULL_KEY) and a 64-bit fingerprint of the text, which together name a row and its
    exact repetitions; of n different texts under one id two share a name with a probability of n**2 / 2**65."""
    k, f, text = _key_columns(docs, id_col, text_col)
    return docs.select(k.alias("k"), f.alias("f"), text.alias("text"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, which sizes buckets; one narrow scan."""
    return int(docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0)


def bucket_count(units: float, each: int) -> int:
    """Buckets so that each gets about so many postings."""
    return max(1, int(units // each) + 1)


def zipped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with k and f, and the text as zstd in `_text`: what a join by (k, f) moves."""
    keep = docs.columns if keep is None else keep
    named = docs.select(*[docs[c].alias(f"c_{i}") for i, c in enumerate(keep) if c != text_col], *[c.alias(n) for c, n in zip(_key_columns(docs, id_col, text_col), ("_k", "_f", "_text"), strict=True)])
    schema = T.StructType([*named.schema.fields[:-1], T.StructField("_text", T.BinaryType())])

    def squeeze(batches):
        import zstandard

        pack_one = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "_text"):
            texts = [None if x is None else pack_one(x) for x in batch.column("_text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], schema=pa.schema([*list(batch.schema)[:-1], pa.field("_text", pa.binary())]))

    return named.mapInArrow(squeeze, schema)


def whole_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """docs, if its ids are integers."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} is {kind.simpleString()}; ids must be integers")
    return docs


def _key_columns(docs: DataFrame, id_col: str, text_col: str):
    whole_ids(docs, id_col)
    return F.coalesce(docs[id_col].cast("long"), F.lit(NULL_KEY)), F.xxhash64(docs[text_col]), docs[text_col].cast("string")


def rewrite(docs: DataFrame, marks: DataFrame, change, extra: str, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, as_bytes: bool = False, how: str = "left") -> DataFrame:
    """Joins marks, one row for each (k, f), back to the documents and rewrites the texts.

    change(texts: list[bytes | None], marks: list[bytes | None]) gives the new texts and a list for
    each column of `extra`. Column order is that of docs (or `keep`), then the extra columns.
    as_bytes: the new text is a binary column. how="inner" keeps marked rows alone.
    """
    keep = docs.columns if keep is None else keep
    left = zipped(docs, id_col=id_col, text_col=text_col, keep=keep)
    right = marks.select("k", "f", F.col("marks").alias("_marks"))
    both = left.join(right, (left["_k"] == right["k"]) & (left["_f"] == right["f"]), how).drop("k", "f", "_k", "_f")
    rest = [c for c in keep if c != text_col]
    added = T._parse_datatype_string(extra) if extra else T.StructType([])
    fields = [*both.schema.fields[: len(rest)], T.StructField("_new", T.BinaryType() if as_bytes else T.StringType()), *added.fields]
    width = len(rest)

    def unzip(batches):
        import zstandard

        open_one = zstandard.ZstdDecompressor().decompress
        out_schema = None
        for batch in batches:
            for part in slices([batch], "_text", SLICE_BYTES // 4):
                texts = [None if x is None else open_one(x) for x in part.column(width).to_pylist()]
                new, *more = change(texts, part.column(width + 1).to_pylist())
                kinds = [pa.binary() if as_bytes else pa.string(), *[_ARROW[f.dataType.simpleString()] for f in added.fields]]
                names = [*part.schema.names[:width], "_new", *[f.name for f in added.fields]]
                arrays = [*part.columns[:width], pa.array(new if as_bytes else [None if x is None else x.decode("utf-8", "replace") for x in new], kinds[0]), *[pa.array(v, t) for v, t in zip(more, kinds[1:], strict=True)]]
                out_schema = out_schema or pa.schema([*list(part.schema)[:width], *[pa.field(n, t) for n, t in zip(names[width:], kinds, strict=True)]])
                yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    done = both.mapInArrow(unzip, T.StructType(fields))
    columns = [done["_new"].alias(c) if c == text_col else done[f"c_{i}"].alias(c) for i, c in enumerate(keep)]
    return done.select(*columns, *[done[f.name] for f in added.fields])


_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}


def places(marks: bytes | None, dtype: type) -> np.ndarray:
    """The places of one document from the blob that merge_marks() made, sorted, each once."""
    if not marks:
        return np.zeros(0, np.int64)
    return np.unique(np.cumsum(unplanes(marks, dtype), dtype=dtype)).astype(np.int64)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units lie in some span of that width that begins at one of the sorted starts."""
    ends = np.zeros(n + 1, np.int64)
    np.add.at(ends, starts, 1)
    np.add.at(ends, np.minimum(starts + width, n), -1)
    return np.cumsum(ends[:n]) > 0


def cut(text: bytes, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the words that are gone; a word's stretch reaches to the next word."""
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=1, append=1))
    at = np.append(starts, len(text))
    kept = [text[at[a] : at[b]] for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return (text[: at[0]] if not gone[0] else b"") + b"".join(kept)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; one of our own only on a single machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lectern-")


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(True)


class Steps:
    """Tables written once in the shared folder and read back, for loops, since a checkpoint carries its plan's
    constraints along, which grow with every step that renames. done() removes all but the ones to keep."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
        self.tables: list[DataFrame] = []

    def store(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.tables)}"
        df.write.parquet(path)
        self.tables.append(self.spark.read.schema(df.schema).parquet(path))
        return self.tables[-1]

    def done(self, *keep: DataFrame) -> None:
        for i, table in enumerate(self.tables):
            if not any(table is k for k in keep):
                remove(self.spark, f"{self.folder}/{i}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs do not have."""
    while name in docs.columns:
        name += "_"
    return name


def prepared(docs: DataFrame, *added: str) -> DataFrame:
    """docs without the columns that an operator is about to add.

    From now on the session's Arrow batches stay under BATCH_BYTES, unless it has a bound of its own, and its
    Python workers give the memory of large freed arrays back to the machine at once.
    """
    spark = docs.sparkSession
    for name, size in (("MALLOC_MMAP_THRESHOLD_", 3 << 20), ("MALLOC_TRIM_THRESHOLD_", 16 << 20)):
        spark.sparkContext.environment.setdefault(name, str(size))
    spark.sparkContext.environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return docs.drop(*[c for c in docs.columns if c in added])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
