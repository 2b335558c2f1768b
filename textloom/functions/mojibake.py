"""UTF-8 that was read in another encoding, set right stretch by stretch.

A stretch is a run of characters whose bytes in a wrong encoding are whole UTF-8 characters. Each of them, for each encoding, is judged with the
rest of its word: it is replaced if the word then looks more like writing (fewer symbols, no capitals after small letters, one
script). Text in good order thus stays as it is even next to damaged words, and a text may hold damage of several kinds.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

#: The encodings that UTF-8 is read in by mistake, the likeliest first.
ENCODINGS = ("cp1252", "mac_roman", "cp1251", "cp437")
#: What a character of a general category costs in a word, outside of ASCII; letters cost nothing, some marks as much as symbols.
COSTS = {"S": 2.0, "M": 1.5, "N": 1.5, "C": 2.0, "P": 0.3, "Z": 0.8}
MARKS = dict.fromkeys("\u2020\u2021\u2030\u2022\u201a", 1.0) | dict.fromkeys("\u00a3\u00a5\u20ac", 0.5)
#: A capital after a small letter, a change of script, and by how much a word has to look better.
RISE, SCRIPTS, LEAST = 1.0, 1.5, 0.45
#: Punctuation and symbols between two letters, but for apostrophes, dashes and middle dots.
INSIDE, FINE = 1.0, "\u2018\u2019\u00b7\u2010\u2011\u2013\u2014"


@dataclass(frozen=True)
class Wrong:
    """One encoding: its characters' bytes and what runs of UTF-8 look like in it."""

    byte_of: dict[str, int]
    runs: re.Pattern
    first: str
    more: str


def _wrong(encoding: str) -> Wrong:
    chars = [bytes([i]).decode(encoding, "ignore") or chr(i) for i in range(256)]  # bytes without a character are read as themselves
    some = lambda a, b: "".join(map(re.escape, chars[a:b]))
    more = some(0x80, 0xC0)
    runs = rf"(?:[{some(0xC2, 0xE0)}][{more}]|[{some(0xE0, 0xF0)}][{more}]{{2}}|[{some(0xF0, 0xF5)}][{more}]{{3}})+"
    return Wrong({c: i for i, c in enumerate(chars)}, re.compile(runs), "".join(chars[0xC2:0xF5]), "".join(chars[0x80:0xC0]))


WRONG = [_wrong(e) for e in ENCODINGS]


def suspicious() -> str:
    """A regular expression, the same in Java, that all damaged texts match: a character that may begin a run and one that may go on, in any of the encodings."""
    code = lambda s: "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(s)))
    return "|".join(f"[{code(w.first)}][{code(w.more)}]" for w in WRONG)


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


def cost(word: str) -> float:
    """How little a word looks like writing."""
    total, before = 0.0, ""
    for x, c, y in zip(word, word[1:], word[2:], strict=False):
        total += INSIDE * (x.isalpha() and y.isalpha() and not c.isascii() and c not in FINE and unicodedata.category(c)[0] in "PS")
    for c in word:
        kind = unicodedata.category(c)
        if not c.isascii():
            total += MARKS.get(c, COSTS.get(kind[0], 0.0))
        if kind[0] == "L":
            if before:
                total += RISE * (before.islower() and kind == "Lu") + SCRIPTS * (_script(before) != _script(c))
            before = c
        elif kind[0] != "M":
            before = ""
    return total


def repaired(text: str) -> str:
    """The text with its damaged stretches set right, also those that were damaged up to three times if each step back looks better."""
    for _ in range(3):
        found = []
        for rank, wrong in enumerate(WRONG):
            for m in wrong.runs.finditer(text):
                try:
                    right = bytes(wrong.byte_of[c] for c in m[0]).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                a, b = m.span()
                while a > 0 and m.start() - a < 40 and text[a - 1].isalpha():
                    a -= 1
                while b < len(text) and b - m.end() < 40 and text[b].isalpha():
                    b += 1
                gain = cost(text[a:b]) - cost(text[a : m.start()] + right + text[m.end() : b])
                if gain > LEAST:
                    found.append((-gain, rank, m.start(), m.end(), right))
        if not found:
            return text
        parts, taken = [], []
        for _, _, a, b, right in sorted(found):  # the best first; others that overlap with it are left
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, right))
        at = 0
        for a, b, right in sorted(taken):
            parts += [text[at:a], right]
            at = b
        text = "".join([*parts, text[at:]])
    return text
