"""LM scoring: a log-frequency Bloom filter holds quantised n-gram counts; smoothed probabilities come from
repeated membership probes.

A filter over all n-grams grows with the corpus, so it has no proven bound under which it could be broadcast
whole. It is cut into shards by the n-gram's hash, each of bounded size, and a shard lives where Spark's
shuffle puts its n-grams:

1. documents go into groups of about `group_bytes` of text; a group's distinct words and word pairs, with
   their training counts, go to the shards of their hashes as packed rows;
2. a shard sums the counts. Words get their exact count back. Pairs go into the shard's filter: a pair of
   count c is entered once for each level up to 1 + floor(log2 c), and every pair asked for is probed level
   by level until one is missing; the last level found goes back. Errors are one-sided: a false positive
   raises a level;
3. each group scores its documents: P(w | h) = (2**(level - 1) + m * P(w)) / (c(h) + m), where the word
   model P(w) = (c(w) + 1) / (N + V + 1) and c(h) are exact. A level's lowest count stands for it, so that
   no history's probabilities exceed one but for false positives;
4. m is the one of `priors` under which the training documents, each scored by the counts that the others
   leave, are likeliest in sum; all of them are scored in one pass, and equals give the smallest. A held-out
   row has no part in it.

Groups and shards have bounded sizes at any corpus size; a pair that a third of all documents share is one
entry a group.

Defined results: null and empty texts are the end token alone; a null id counts as training; repeated rows
count as often as they occur; without training rows N = V = 0 and m is the smallest prior; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common as C

GROUP_BYTES = 6 << 20
PER_SHARD = 1_000_000
PAIR_BYTES = 5
BITS, PROBES = 10, 7
PRIORS = (1.0, 10.0, 100.0, 1000.0, 10000.0)
_PAIR = np.uint64(0xA0761D6478BD642F)
END = C.mix(np.array([0xE7037ED1A0B428DB], np.uint64))[0]


def tokens(texts: list[bytes]):
    """(token hashes with an end token a text, hashes of the tokens before, text row)."""
    flat = C.Flat(C.pa.array(texts, C.pa.binary()))
    starts, ends, before = flat.words()
    n = np.diff(before) + 1
    row = np.repeat(np.arange(flat.n), n)
    token = np.full(len(row), END, np.uint64)
    is_word = np.ones(len(row), bool)
    is_word[np.cumsum(n) - 1] = False
    token[is_word] = flat.word_hashes(starts, ends, lower=True)
    previous = np.empty_like(token)
    previous[:1], previous[1:] = END, token[:-1]
    return token, previous, row


def pair_hash(previous: np.ndarray, token: np.ndarray) -> np.ndarray:
    return C.mix(previous * _PAIR + token)


class LogBloom:
    """A Bloom filter of (key, level) entries for quantised counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int = BITS, probes: int = PROBES):
        levels = np.frexp(counts.astype(float))[1]
        self.most, self.probes = int(levels.max(initial=0)), probes
        self.size = max(64, int(levels.sum()) * bits)
        self.bits = np.zeros(self.size // 8 + 1, np.uint8)
        filled = np.zeros(self.size // 8 * 8 + 8, bool)
        for level in range(1, self.most + 1):
            for place in self._places(keys[levels >= level], level):
                filled[place] = True
        self.bits = np.packbits(filled, bitorder="little")

    def _places(self, keys: np.ndarray, level: int):
        one = C.mix(keys + C.times(_PAIR, level))
        two = C.mix(one) | np.uint64(1)
        for i in range(self.probes):
            yield (((one + np.uint64(i) * two) >> np.uint64(32)) * np.uint64(self.size) >> np.uint64(32)).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level each key is found at, from 1 without a gap; 0 if none."""
        found = np.zeros(len(keys), np.uint8)
        live = np.arange(len(keys))
        for level in range(1, self.most + 1):
            here = np.ones(len(live), bool)
            for place in self._places(keys[live], level):
                here &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            live = live[here]
            found[live] = level
        return found


GROUPED = "g"
REQUESTS = "bucket int, g int, kind int, keys binary, counts binary"
REPLIES = "g int, bucket int, kind int, vals binary, n_types long, n_tokens long"
_KEY_WIDTH = (C.KEY_BYTES, PAIR_BYTES)


def grouped_documents(docs: DataFrame, groups: int, training, id_col: str, text_col: str) -> DataFrame:
    marked = docs.select(docs[id_col].alias("doc_id"), F.coalesce(training, F.lit(True)).alias("train"), docs[text_col].alias("text"))
    zipped = C.zipped(marked, keep=["doc_id", "train"])
    return zipped.select(F.pmod(F.hash("_k", "_f"), F.lit(groups)).alias("g"), F.col("c_0").alias("doc_id"), F.col("c_1").alias("train"), "_text")


def open_texts(frame) -> list[bytes]:
    import zstandard

    open_one = zstandard.ZstdDecompressor().decompress
    return [open_one(x) if x is not None else b"" for x in frame["_text"]]


def requests(documents: DataFrame, shards: int) -> DataFrame:
    def run(frame):
        import pandas as pd

        token, previous, row = tokens(open_texts(frame))
        weight = frame["train"].to_numpy().astype(float)[row]
        out = []
        for kind, value in enumerate((token, pair_hash(previous, token))):
            keys, inverse = np.unique(value, return_inverse=True)
            counts = np.bincount(inverse, weight, len(keys)).astype(np.uint32)
            bucket = C.bucket_of(keys, shards)
            for a, b in zip(*C.runs(bucket), strict=True):
                out.append((int(bucket[a]), int(frame["g"].iat[0]), kind, C.planes(keys[a:b], _KEY_WIDTH[kind]), C.planes(counts[a:b])))
        return pd.DataFrame(out, columns=["bucket", "g", "kind", "keys", "counts"])

    return documents.groupBy("g").applyInPandas(run, REQUESTS)


def answers(asked: DataFrame, bits: int, probes: int) -> DataFrame:
    def run(frame):
        import pandas as pd

        out = []
        for kind, rows in frame.groupby("kind"):
            own = [C.unplanes(x, np.uint64, _KEY_WIDTH[kind]) for x in rows["keys"]]
            keys, inverse = np.unique(np.concatenate(own), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([C.unplanes(x, np.uint32) for x in rows["counts"]]), len(keys)).astype(np.int64)
            known = counts > 0
            value = counts if kind == 0 else LogBloom(keys[known], counts[known], bits, probes).levels(keys)
            cuts = np.cumsum([len(x) for x in own])[:-1]
            for i, (g, part) in enumerate(zip(rows["g"], np.split(value[inverse], cuts), strict=True)):
                first = kind == 0 and i == 0
                out.append((g, rows["bucket"].iat[0], kind, C.planes(part), int(known.sum()) if first else 0, int(counts.sum()) if first else 0))
        return pd.DataFrame(out, columns=["g", "bucket", "kind", "vals", "n_types", "n_tokens"])

    return asked.groupBy("bucket").applyInPandas(run, REPLIES)


def own_count(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often each value occurs in its own text."""
    order = np.lexsort((value, row))
    firsts, ends = C.runs(row[order], value[order])
    out = np.empty(len(row), np.int64)
    out[order] = np.repeat(ends - firsts, ends - firsts)
    return out


def score_lm(docs: DataFrame, training, *, group_bytes: int = GROUP_BYTES, per_shard: int = PER_SHARD, bits: int = BITS, probes: int = PROBES, priors: tuple[float, ...] = PRIORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row.

    training: a boolean column of docs; counts come from its true rows. priors: values of m to choose from.
    """
    docs, priors = C.prepared(docs), sorted(priors)
    total = C.text_bytes(docs, text_col)
    groups, shards = C.bucket_count(total, group_bytes), C.bucket_count(total / 7, per_shard)
    documents = grouped_documents(docs, groups, training, id_col, text_col)
    replies = C.settle(answers(requests(documents, shards), bits, probes))
    sums = replies.agg(F.sum("n_types"), F.sum("n_tokens")).first()
    n_types, n_tokens = int(sums[0] or 0), int(sums[1] or 0)
    fields = documents.schema["doc_id"].dataType.simpleString()
    each = range(len(priors))
    scores, lefts = [f"score_{i}" for i in each], [f"left_{i}" for i in each]
    out = f"doc_id {fields}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, " + ", ".join(f"{c} double" for c in scores + lefts)

    def run(frame, got):
        import pandas as pd

        if not len(frame):
            return pd.DataFrame({c.split()[0]: [] for c in out.split(", ")})
        token, previous, row = tokens(open_texts(frame))
        got = got.sort_values(["kind", "bucket"])
        told = [np.concatenate([C.unplanes(x, dtype) for x in got["vals"][got["kind"] == kind]]) for kind, dtype in enumerate((np.int64, np.uint8))]
        words, at = np.unique(token, return_inverse=True)
        both = pair_hash(previous, token)
        count, level = told[0][at], told[1][np.unique(both, return_inverse=True)[1]]
        place = np.minimum(np.searchsorted(words, previous), len(words) - 1)
        history = told[0][place]
        pair = np.where(level > 0, 2.0 ** (level.astype(float) - 1), 0.0)
        n, size = len(frame), np.bincount(row, minlength=len(frame))
        train = frame["train"].to_numpy().astype(bool)

        def by_prior(row, unigram, pair, history):
            for prior in priors:
                yield np.bincount(row, np.log10((pair + prior * unigram) / (np.maximum(history, pair) + prior)), n)

        unigram = (count + 1.0) / (n_tokens + n_types + 1.0)
        done = {"doc_id": frame["doc_id"], "train": train, "n_tokens": size, "n_known": np.bincount(row, count > 0, n).astype(np.int64), "train_tokens": n_tokens, "base_score": np.bincount(row, np.log10(unigram), n)}
        done |= zip(scores, by_prior(row, unigram, pair, history), strict=True)
        seen = np.flatnonzero(train[row])
        row, token, previous, both = row[seen], token[seen], previous[seen], both[seen]
        unigram = (count[seen] - own_count(row, token) + 1.0) / (n_tokens - size[row] + n_types + 1.0)
        pair, history = np.maximum(pair[seen] - own_count(row, both), 0), history[seen] - own_count(row, previous)
        done |= zip(lefts, by_prior(row, unigram, pair, history), strict=True)
        return pd.DataFrame(done)

    scored = C.settle(documents.groupBy("g").cogroup(replies.groupBy("g")).applyInPandas(run, out))
    left = scored.where("train").agg(*[F.sum(c) for c in lefts]).first()
    best = max(each, key=lambda i: (left[i] or 0.0, -i))
    return scored.select("doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", F.col(scores[best]).alias("score"))


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    scored = score_lm(docs, ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
