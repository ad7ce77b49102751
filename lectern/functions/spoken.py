"""Text rules inside Arrow tasks: sentence boundaries, inline Markdown as runs, and what a voice says for them.

The Column versions of single rules are in functions.text; these take whole paragraphs, where order and nesting
decide. A run is (text, bold, italic, code); offsets count code points of a block's display text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

from lectern.functions.text import ABBREVIATIONS

Run = tuple[str, bool, bool, bool]

WS = r"\s﻿"
WORDS = re.compile(r"[^\W_]")
_ZERO_WIDTH = re.compile("[​-‍⁠﻿]")
_SPACES = re.compile(f"[{WS}]+")
_ENDS = f" \t\n\r\v\f\u0085  {''.join(map(chr, range(0x2000, 0x200B)))}    　﻿"

# ---------------------------------------------------------------- sentence boundaries (UAX #29)

# Terminators and continuing marks of the default sentence rules.
_ATERM = ".․﹒．"
_STERM = "!?։؝؞؟۔܀܁܂߹࠷࠹࠽࠾।॥၊။።፧፨᙮᜵᜶។៕᠃᠉᥄᥅‼‽⁇⁈⁉⸮⸼。꓿﹖﹗！？｡"
_CONTINUE = ",-:;;՝،؍߸᠂᠈–—、︐︑︓︔︱︲﹐﹑﹔﹕﹘﹣，－：；､"


class _Classes(dict):
    """A translation table from characters to one letter for their sentence-break class."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if c in "\n\u0085  ":
            found = "P"
        elif c == "\r":
            found = "R"
        elif c in _ATERM:
            found = "A"
        elif c in _STERM:
            found = "T"
        elif c in _CONTINUE:
            found = "K"
        elif kind in ("Mn", "Me", "Mc", "Cf"):
            found = "X"
        elif c.isspace() and code not in range(0x1C, 0x20):
            found = "S"
        elif kind in ("Ps", "Pe", "Pi", "Pf") or c in "\"'":
            found = "C"
        elif c.islower():
            found = "L"
        elif c.isupper() or kind == "Lt":
            found = "U"
        elif kind == "Nd":
            found = "N"
        elif c.isalpha() or kind == "Nl":
            found = "O"
        else:
            found = "Z"
        self[code] = found
        return found


_CLASSES = _Classes()
_STOP = re.compile(r"(?P<term>[AT])X*+(?P<rest>(?:CX*+)*+(?:SX*+)*+)(?P<para>RP|P|R)?+|RP|P|R")
_LOWER_AHEAD = re.compile("[^OULPRAT]*+L")


def breaks(text: str) -> list[int]:
    """Ends of the sentences of a text by the default rules, its own end included."""
    kinds, out = text.translate(_CLASSES), []
    for m in _STOP.finditer(kinds):
        end = m.end()
        if end == len(kinds):
            break
        if m["term"] and not m["para"]:
            then, is_aterm = kinds[end], m["term"] == "A"
            if then in "KAT" or (is_aterm and _LOWER_AHEAD.match(kinds, end)):
                continue
            if is_aterm and not m["rest"]:
                before = kinds[: m.start()].rstrip("X")[-1:] if kinds[m.start() - 1 : m.start()] == "X" else kinds[m.start() - 1 : m.start()]
                if then == "N" or (then == "U" and before in ("U", "L")):
                    continue
        out.append(end)
    return [*out, len(text)] if text else out


_TRAILING = re.compile(r"([^\W\d_]+)\.\Z")
_LONGEST = max(map(len, ABBREVIATIONS))


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    left = len(part) - len(part.lstrip(_ENDS))
    return start + left, max(start + left, start + len(part.rstrip(_ENDS)))


def _after_abbreviation(text: str, start: int, end: int) -> bool:
    """Whether the text from start to end ends in an abbreviation, its period and white space."""
    while end > start and (text[end - 1].isspace() or text[end - 1] == "\ufeff"):
        end -= 1
    last = _TRAILING.search(text, max(start, end - _LONGEST - 2), end)
    return last is not None and last[1].lower() in ABBREVIATIONS


def sentence_ranges(text: str, code: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """(start, end) of the sentences, trimmed: a cut after an abbreviation or inside a code span is none. The spans of
    code are in order and apart."""
    out, start = [], 0
    begins = [a for a, _ in code]
    for end in breaks(text):
        if end < len(text):
            before = bisect_left(begins, end) - 1
            if (before >= 0 and end < code[before][1]) or _after_abbreviation(text, start, end):
                continue
        a, b = trimmed(text, start, end)
        if b > a:
            out.append((a, b))
        start = end
    return out


# ---------------------------------------------------------------- runs


def even(text: str) -> str:
    """Runs of spaces to one, ends trimmed."""
    return " ".join(text.split()) if "\ufeff" not in text else _SPACES.sub(" ", text).strip(_ENDS)


# The inline grammar, in the order that breaks ties.
_INLINE = {
    "code": re.compile(r"`([^`\n]+)`"),
    "image": re.compile(r"!\[[^\]]*\]\([^)]*\)"),
    "link": re.compile(r"\[([^\]]*)\]\([^)]*\)"),
    "bold": re.compile(rf"\*\*(?=[^{WS}])([\s\S]*?[^{WS}])\*\*"),
    "star": re.compile(rf"(?<![A-Za-z0-9_*])\*(?=[^{WS}])([^*\n]*?[^{WS}])\*(?![A-Za-z0-9_*])"),
    "under": re.compile(rf"(?<![A-Za-z0-9_])_(?=[^{WS}])([^_\n]*?[^{WS}])_(?![A-Za-z0-9_])"),
}
_TAG = re.compile(rf"</?[A-Za-z][A-Za-z0-9-]*([{WS}][^<>]*)?/?>")
_INLINE_MARKS = re.compile(r"[`*_\[]")


def _styled(text: str, bold: bool, italic: bool):
    """Runs of a text: the earliest construct wins, the table's order breaks ties, and styles nest."""
    at, ahead = 0, {}
    while at < len(text):
        for name, pattern in _INLINE.items():
            if name not in ahead or (ahead[name] is not None and ahead[name].start() < at):
                ahead[name] = pattern.search(text, at)
        found = min((m.start(), i, name) for i, (name, m) in enumerate(ahead.items()) if m) if any(ahead.values()) else None
        if found is None:
            break
        start, _, name = found
        if start > at:
            yield text[at:start], bold, italic, False
        m = ahead[name]
        if name == "code":
            yield m[1], bold, italic, True
        elif name != "image":
            yield from _styled(m[1], bold or name == "bold", italic or name in ("star", "under"))
        at = m.end()
    if at < len(text):
        yield text[at:], bold, italic, False


def normalize_runs(runs) -> list[Run]:
    """Zero-width characters out, spaces collapsed also between runs, equal styles merged, ends trimmed."""
    out: list[list] = []
    for text, *style in runs:
        text = _SPACES.sub(" ", _ZERO_WIDTH.sub("", text))
        if out and out[-1][0].endswith(" ") and text.startswith(" "):
            text = text[1:]
        if text and out and out[-1][1:] == style:
            out[-1][0] += text
        elif text:
            out.append([text, *style])
    if out:
        out[0][0] = out[0][0].lstrip(_ENDS)
        out[-1][0] = out[-1][0].rstrip(_ENDS)
    return [tuple(r) for r in out if r[0]]


def inline_runs(text: str) -> list[Run]:
    text = _TAG.sub(" ", text)
    return normalize_runs(_styled(text, False, False) if _INLINE_MARKS.search(text) else [(text, False, False, False)])


def display(runs: list[Run]) -> str:
    return "".join(r[0] for r in runs)


def code_spans(runs: list[Run]) -> list[tuple[int, int]]:
    at, out = 0, []
    for text, _, _, code in runs:
        if code:
            out.append((at, at + len(text)))
        at += len(text)
    return out


# A lone identifier, and an address with the punctuation that stays outside it.
_IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)*")
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9_])https?://[^{WS}<>()]+[^{WS}<>().,;:!?]", re.I)


def spoken_identifier(code: str) -> str:
    if not _IDENTIFIER.fullmatch(code):
        return code
    words = re.sub("([a-z0-9])([A-Z])", r"\1 \2", re.sub("[_-]+", " ", code))
    return re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", words)


def spoken_urls(text: str) -> str:
    if "://" not in text:
        return text
    return _ADDRESS.sub(lambda m: re.sub(r"\Awww\.", "", m[0].partition("://")[2].split("/")[0], flags=re.I), text)


def spoken_slice(runs: list[Run], start: int, end: int) -> str:
    """What is said for a range of the display text: code is read as an identifier, addresses as their host."""
    at, said = 0, []
    for text, _, _, code in runs:
        part = text[max(0, start - at) : max(0, end - at)]
        at += len(text)
        if code and part:
            body = part.strip(_ENDS)
            left = len(part) - len(part.lstrip(_ENDS))
            part = part[:left] + spoken_identifier(body) + part[left + len(body) :]
        said.append(part)
    return spoken_urls(even("".join(said)))
