"""op11 against plain loops over both libraries' tokens, and its defined results."""

import hashlib
import random
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import alignment


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def brute(rows):
    byte_level = Tokenizer.from_file(alignment.BYTE_MODEL)
    byte_level.encode_special_tokens = True
    pieces, letters = sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL), alignment.byte_letters()
    found, counts = [], Counter()
    for text in rows:
        raw = (" " + (text or "")).encode()
        got = byte_level.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(got.ids, got.tokens, strict=True)]
        b = []
        for i in pieces.encode(text or ""):
            p = pieces.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
        if not text or any(b"".join(t for _, t in x) != raw for x in (a, b)):
            found.append(None)
            continue
        a, b = spans(a), spans(b)
        links = [(i, j) for s, e, i in a for t, u, j in b if s < u and t < e]
        groups, start = [], 0
        for end in sorted({x[1] for x in a} & {x[1] for x in b}):
            inside = [",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in (a, b)]
            groups.append("|".join(inside))
            start = end
        counts.update(set(links))
        found.append((len(a), len(b), groups, links))
    most = Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(0,) * 6 + ("",) if x is None else (x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == most[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in found]


def texts():
    draw = random.Random(11)
    words = ["The", "straße", "naïve", "日本語", "été", "<|endoftext|>", "</s>", "x_1", "don't", "1234", "🙂🙃", "​", "\n\n", "  ", "a\tb", "ﬁ"]
    out = [" ".join(draw.choices(words, k=draw.randrange(1, 25))) for _ in range(40)]
    return [*out, *out[:7], out[0], None, "", " ", "   ", "a▁b", "▁", "\r\n", "\u0000", "é", "x" * 300]


def test_against_loops(spark):
    rows = texts()
    got = alignment.align(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), buckets=5).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in (*alignment.MEASURES, "groups_sha256")) for r in got] == brute(rows)


def test_portions_of_long_texts():
    """Ids and measures of a text in portions are those of the whole text."""
    with open(alignment.BYTE_MODEL, "rb") as a, open(alignment.MODEL, "rb") as b:
        both = alignment.Tokenizers.of(a.read(), b.read())
    draw = random.Random(3)
    text = " ".join("".join(draw.choices("abcdefgh é1.", k=draw.randrange(1, 9))) for _ in range(80_000))
    assert len(alignment.portions(" " + text)) > 2
    (a,), (b,) = both.encode([text])
    byte_level = Tokenizer.from_file(alignment.BYTE_MODEL)
    assert a.tolist() == byte_level.encode(" " + text, add_special_tokens=False).ids and b.tolist() == both.pieces.encode(text)
    no_edge = "ab" * 200_000
    assert alignment.portions(no_edge) == [no_edge]


def test_tables(spark):
    """Clashing and further columns, null ids, hot rows, an empty table."""
    rows = [(None, "one two"), (None, "one two"), (3, None), *[(i, "one two three") for i in range(4, 3000)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("key", "pack", "bucket", "copies", "n_a", "c_0", "_key", "more")])
    got = alignment.align(docs)
    assert got.columns == ["doc_id", "text", "key", "pack", "bucket", "copies", "c_0", "_key", "more", *alignment.MEASURES, "groups_sha256"]
    found = got.collect()
    assert len(found) == len(rows) and {r.more for r in found} == {"own"} and len({(r.text, r.n_links, r.count_sum) for r in found}) == 3
    assert {r.count_sum for r in found if r.text == "one two three"} == {2 * 2998 + 2996}
    assert alignment.align(docs.limit(0)).count() == 0
