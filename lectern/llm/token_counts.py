"""Token counts: a separator scan over flat unindexed token files, stitched across blocks by a prefix scan.

A token file is a sequence of 16-bit ids in which an end-of-document id follows every document, and nothing
else: no index, no lengths. Files are kept as blocks of `BLOCK` tokens, cut wherever that number falls. The
scan looks at each block alone, vectorised: where its separators are. A prefix scan, windows over one summary
row of four numbers a block, gives every block the place of its file's last separator before it and the number
of documents ended; joined to the lengths inside the blocks it gives all lengths, those of documents over many
blocks included. The token files of token_counts() stay in the shared folder, for the caller to remove.

Defined results: null and empty texts are documents of no tokens; a document without a last separator counts
with what is there; repeated rows are documents of their own; a file of no blocks has no documents.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import common as C

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BLOCK = 1 << 18
END = 50256
# Fixed value: the vocabulary's word pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_bpe(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def flat_files(docs: DataFrame, ranks: dict[bytes, int], *, block: int = BLOCK, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as token files, one for each partition: blocks (file, block, tokens), and in rows with a
    null block the ids of the file's documents in order (file, first, ids), which the scan never reads."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = ["file", "block", "tokens", "first", "ids"]

    def rows(values: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], t) for i, t in enumerate(kinds)], names)

    def run(batches):
        encode = byte_bpe(shared.value).encode_to_numpy
        file, number, done, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        last = np.array([end], np.uint16)
        for batch in batches:
            for text in batch.column("text"):
                got = encode(text.as_py() or "", disallowed_special=()).astype(np.uint16)
                held += [got, last]
                size += len(got) + 1
                if size >= block:
                    flat = np.concatenate(held)
                    cut = size // block * block
                    yield rows([(file, number + i, flat[a : a + block].tobytes(), None, None) for i, a in enumerate(range(0, cut, block))])
                    number, held, size = number + cut // block, [flat[cut:]], size - cut
            yield rows([(file, None, None, done, batch.column("doc_id").to_pylist())])
            done += batch.num_rows
        if size:
            yield rows([(file, number, np.concatenate(held).tobytes(), None, None)])

    docs = C.whole_ids(C.prepared(docs), id_col)
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, "file int, block int, tokens binary, first long, ids array<long>")


def _opened(uri: str):
    """A file of any size to read ranges of, by the path that Spark lists."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest if colon else uri).lstrip("/"))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def read_token_files(spark, path: str, *, block: int = BLOCK) -> DataFrame:
    """Blocks (file, block, tokens) of raw little-endian 16-bit token files of any size under a path. Spark lists the
    files without their content and shuffles ranges of them; tasks read those by offset. An odd last byte is no token."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.floor(F.col("length") / 2).alias("n"))
    ranges = files.where("n > 0").select("file", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))).alias("block"))

    def run(batches):
        held, source = None, None
        for batch in batches:
            for file, n, number in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if file != held:
                    held, source = file, _opened(file)
                tokens = source.read_at(2 * min(block, n - number * block), 2 * block * number)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int32()), pa.array([tokens], pa.binary())], ["file", "block", "tokens"])

    return ranges.repartition("file", F.floor(F.col("block") / 64)).mapInArrow(run, "file string, block int, tokens binary")


def scan(blocks: DataFrame, *, end: int = END) -> DataFrame:
    """(file, document, n_tokens) of every document in the token files; documents are numbered in file order."""
    file_type = blocks.schema["file"].dataType.simpleString()

    def look(batches):
        for batch in batches:
            size, count, first, last = [], [], [], []
            for blob in batch.column("tokens"):
                tokens = np.frombuffer(blob.as_buffer(), np.uint16)
                at = np.flatnonzero(tokens == end)
                size.append(len(tokens))
                count.append(len(at))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *(pa.array(x, pa.int64()) for x in (size, count, first, last))], ["file", "block", "size", "count", "first", "last"])

    def within(batches):
        for batch in batches:
            inner = [np.diff(np.flatnonzero(np.frombuffer(blob.as_buffer(), np.uint16) == end)) - 1 for blob in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(inner, pa.list_(pa.int64()))], ["file", "block", "inner"])

    tokens = blocks.select("file", "block", "tokens")
    seen = tokens.mapInArrow(look, f"file {file_type}, block int, size long, count long, first long, last long")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy("file").orderBy("block")
    placed = seen.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.withColumns({"number": F.coalesce(F.sum("count").over(before), F.lit(0)), "opened": F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(-1)), "is_last": F.lead("block").over(ahead).isNull()})
    lead = F.when(F.col("count") > 0, F.array(F.col("start") + F.col("first") - F.col("opened") - 1)).otherwise(F.array().cast("array<long>"))
    rest = F.col("start") + F.col("size") - 1 - F.greatest("opened", F.coalesce(F.col("start") + F.col("last"), F.lit(-1)))
    tail = F.when(F.col("is_last") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<long>"))
    edges = placed.select("file", "block", "number", lead.alias("lead"), tail.alias("tail"))
    both = edges.join(tokens.mapInArrow(within, f"file {file_type}, block int, inner array<long>"), ["file", "block"])
    lengths = both.select("file", "number", F.posexplode(F.concat("lead", "inner", "tail")).alias("i", "n_tokens"))
    return lengths.select("file", (F.col("number") + F.col("i")).alias("document"), "n_tokens")


def token_counts(docs: DataFrame, *, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", block: int = BLOCK, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row: its tokens are written to flat files once, and the files are scanned."""
    import uuid

    spark = docs.sparkSession
    folder = f"{C.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    flat_files(docs, load_ranks(vocabulary), block=block, end=end, id_col=id_col, text_col=text_col).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.parquet(folder)
    lengths = scan(stored.where("block IS NOT NULL").select("file", "block", "tokens"), end=end)
    names = stored.where("block IS NULL").select("file", "first", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("document"), "doc_id")
    return names.join(lengths, ["file", "document"]).select("doc_id", "n_tokens")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(C.table(spark, sf_dir, "documents"))
