"""Blocks, runs and sentences against hand-written results, and sentence rules against a second implementation."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import spoken as S
from lectern.operators import blocks as B


def said(text):
    return [text[a:b] for a, b in S.sentence_ranges(text)]


@pytest.mark.parametrize(
    "text, sentences",
    [
        ("Bring fruit, e.g. apples, to the meeting.", ["Bring fruit, e.g. apples, to the meeting."]),
        ("He paused... then spoke. It was over.", ["He paused... then spoke.", "It was over."]),
        ('"Stop," she said. He stopped.', ['"Stop," she said.', "He stopped."]),
        ("He paid 3. 4 apples were left.", ["He paid 3. 4 apples were left."]),
        ("Wait… What happened.", ["Wait… What happened."]),
        ("  Spaced out.   And again.  ", ["Spaced out.", "And again."]),
        ("A heading with no full stop", ["A heading with no full stop"]),
        ("See no. 5. Then go.", ["See no. 5.", "Then go."]),
        ("U.S.A. won! Really?! Yes.", ["U.S.A. won!", "Really?!", "Yes."]),
        ("一。二！", ["一。", "二！"]),
        ("", []),
    ],
)
def test_sentences(text, sentences):
    assert said(text) == sentences


def by_rules(text):
    """The default rules one position at a time, without the regular expression."""
    kinds = text.translate(S._CLASSES)
    out = []
    for i in range(1, len(kinds)):
        if kinds[i - 1] == "R" and kinds[i] == "P":
            continue
        if kinds[i - 1] in "PR":
            out.append(i)
            continue
        if kinds[i] == "X":
            continue
        before = [k for k in range(i) if kinds[k] != "X" or kinds[k - 1 : k] in ("P", "R", "")]
        j = len(before) - 1
        while j >= 0 and kinds[before[j]] == "S":
            j -= 1
        while j >= 0 and kinds[before[j]] == "C":
            j -= 1
        term = kinds[before[j]] if j >= 0 else ""
        if term not in ("A", "T") or not term:
            continue
        direct, c = j == len(before) - 1, kinds[i]
        spaced = not direct and kinds[before[-1]] == "S"
        if term == "A" and direct and c == "N":
            continue
        if term == "A" and direct and c == "U" and j > 0 and kinds[before[j - 1]] in "UL":
            continue
        ahead = i
        while ahead < len(kinds) and kinds[ahead] not in "OULPRAT":
            ahead += 1
        if term == "A" and ahead < len(kinds) and kinds[ahead] == "L":
            continue
        if c in "KAT" or c in "SPR" or (c == "C" and not spaced):
            continue
        out.append(i)
    return [*out, len(text)] if text else []


def test_sentence_rules_agree():
    draw = random.Random(3)
    for _ in range(4000):
        text = "".join(draw.choices("aB3.!?,: \n\r\")é中̈…", weights=[4, 3, 2, 6, 2, 2, 2, 1, 6, 1, 1, 1, 1, 1, 1, 1, 1], k=draw.randint(0, 14)))
        assert S.breaks(text) == by_rules(text), repr(text)


def test_code_spans_stay_whole():
    blocks = B.parse("Use `a. B c` now. Done.")
    assert [s[-1] for s in B.sentences(blocks)] == ["Use a. B c now.", "Done."]


@pytest.mark.parametrize(
    "text, runs",
    [
        ("a **b** *c* _d_ `e_f`", [("a ", 0, 0, 0), ("b", 1, 0, 0), (" ", 0, 0, 0), ("c", 0, 1, 0), (" ", 0, 0, 0), ("d", 0, 1, 0), (" ", 0, 0, 0), ("e_f", 0, 0, 1)]),
        ("2 * 3 * 4", [("2 * 3 * 4", 0, 0, 0)]),
        ("`**x**`", [("**x**", 0, 0, 1)]),
        ("[see **it**](http://a.b) ![p](q.png)end", [("see ", 0, 0, 0), ("it", 1, 0, 0), (" end", 0, 0, 0)]),
        ("**a *b* c**", [("a ", 1, 0, 0), ("b", 1, 1, 0), (" c", 1, 0, 0)]),
        ("x<br/>y snake_case_word", [("x y snake_case_word", 0, 0, 0)]),
        ("", []),
    ],
)
def test_inline_runs(text, runs):
    assert S.inline_runs(text) == [(t, bool(b), bool(i), bool(c)) for t, b, i, c in runs]


@pytest.mark.parametrize("code, spoken", [("max_tokens", "max tokens"), ("parseHTTPResponse", "parse HTTP Response"), ("src/db.ts", "src/db.ts")])
def test_identifiers_agree(spark, code, spoken):
    from lectern.functions import text as X

    assert S.spoken_identifier(code) == spoken == spark.range(1).select(X.spoken_identifier(F.lit(code))).first()[0]


def kinds(text):
    return [(b["kind"], b["level"] or b["ordered"] or b["language"] or b["icon"], b["code_text"] if b["kind"] == "code" else S.display(b["runs"] or []), [S.display(c["runs"]) for c in children]) for b, children in B.parse(text)]


@pytest.mark.parametrize(
    "text, blocks",
    [
        ("# T\n\n## 1. Summary\n\n#### Deep", [("heading", 1, "T", []), ("heading", 2, "1. Summary", []), ("heading", 3, "Deep", [])]),
        ("**Status**: Draft", [("meta", None, "Status: Draft", [])]),
        ("```tsx\nconst x = 1\n  y()\n```", [("code", "tsx", "const x = 1\n  y()", [])]),
        ("- a\n- b\n\n3. c\nd", [("list-item", None, "a", []), ("list-item", None, "b", []), ("list-item", 3, "c d", [])]),
        ("<aside>\n⚠️\n\n**Work**\n\nBody `x`.\n\n</aside>\n\nAfter.", [("callout", "⚠️", "", ["Work", "Body x."]), ("paragraph", None, "After.", [])]),
        ("*Figure 1 — The drawer.*", [("caption", None, "Figure 1 — The drawer.", [])]),
        ("* * *\n!x.png\n> # x", [("paragraph", None, "# x", [])]),
        ("```\nlost", []),
        ("<aside>\na\n<aside>\nb", [("callout", None, "", ["b"])]),
        ("| a | b |\n|--|--|\n| `maxTok` | **y** |\n|--|--|\n| only |\ntext", [("paragraph", None, "a: max Tok. b: y.", []), ("paragraph", None, "a: only.", []), ("paragraph", None, "text", [])]),
        ("| a | b |\nno table", [("paragraph", None, "| a | b | no table", [])]),
        ("", []),
    ],
)
def test_markdown_blocks(text, blocks):
    assert kinds(text) == blocks


def test_rows_of_blocks_and_sentences(spark):
    docs = spark.createDataFrame([(1, "# 13.16. Peek\n\nOne. Two.\n<aside>\n💡\n\nMind.\n</aside>\n- a\n- b\n\nx\n2. c"), (2, None), (3, "")], "doc_id long, text string")
    rows = B.segment_documents(docs).orderBy("sentence_id").collect()
    assert [(r.sentence_id, r.block_no, r.child_no, r.text) for r in rows] == [(0, 0, None, "13.16 Peek"), (1, 1, None, "One."), (2, 1, None, "Two."), (3, 2, 0, "Mind."), (4, 3, None, "a"), (5, 4, None, "b"), (6, 5, None, "x"), (7, 6, None, "c")]
    blocks = B.markdown_blocks(docs)
    assert [(r.ordered, r.start, r["items"]) for r in B.group_lists(blocks).orderBy("list_no").collect()] == [(False, None, ["a", "b"]), (True, 2, ["c"])]
    assert [(r.icon, r.children) for r in B.callouts(blocks).collect()] == [("💡", ["Mind."])]
    paragraphs = B.segment_paragraphs(docs, F.array(F.lit("Real text."), F.lit("  "), F.lit("More text.")))
    assert [r.block_no for r in paragraphs.where("doc_id = 1").orderBy("sentence_id").collect()] == [0, 2]


def test_normalize_runs_agree(spark):
    draw = random.Random(2)
    cases = [[("".join(draw.choices(["a", " ", "​", "b ", "  "], k=draw.randint(0, 4))), draw.random() < 0.5, False, False) for _ in range(draw.randint(0, 5))] for _ in range(60)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"id int, runs array<{B.RUN}>")
    for r in rows.select("id", B.normalize_runs(F.col("runs")).alias("n")).collect():
        assert [tuple(x) for x in r.n] == S.normalize_runs(cases[r.id])


@pytest.mark.parametrize("space", [" ", " " * 45, "\n" * 300, " ﻿" * 50])
def test_abbreviations_before_any_white_space(space):
    for word, cut in (("Dr.", False), ("approx.", False), ("xapprox.", True), ("Drum.", True), ("12.", True)):
        text = f"See {word}{space}Smith left."
        assert len(S.sentence_ranges(text)) == 1 + cut, word


def test_code_spans_hold_sentences():
    text = "Run a. B now. Then c. D. End."
    assert [text[a:b] for a, b in S.sentence_ranges(text, [(4, 8), (19, 23)])] == ["Run a. B now.", "Then c. D.", "End."]
