"""Text cleaning as column expressions, in a fixed order; switched-off steps never enter the plan."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import mojibake

#: Character classes that mean in Java what `\w`, `\d`, `\s` and line ends mean for Unicode strings.
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
SPACES = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACES}]"
#: SPACE for patterns that look at every character: one look in a table and one comparison for most of them.
_WIDE = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
_ODD_SPACE = rf"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0{_WIDE}]"
_ANY_SPACE = rf"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0{_WIDE}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"
#: The removal patterns.
URL = r"https?://[a-zA-Z0-9$-_@.&+!*\\(),]+"
EMAIL = rf"[\p{{L}}\p{{N}}_.-]+@[\p{{L}}\p{{N}}_.-]+\.{WORD}+"
PHONE = r"\+?\d{1,4}?[-.\s]?\(?\d{1,3}?\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}".replace(r"\d", DIGIT).replace(r"\s", SPACES)
SPECIAL = rf"[^\p{{L}}\p{{N}}_{SPACES}.,!?-]"


#: Characters outside of the ranges that NFC leaves as they are.
NOT_PLAIN = r"[^\x00-\x{02FF}\x{0400}-\x{0482}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{3040}-\x{3098}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"


@dataclass(frozen=True)
class CleanOptions:
    """Which steps run. remove_redundant_spaces and standardize_quotes are accepted and change nothing."""

    fix_unicode: bool = True
    remove_headers_footers: bool = True
    remove_redundant_spaces: bool = True
    normalize_whitespace: bool = True
    fix_line_breaks: bool = True
    remove_urls: bool = False
    remove_emails: bool = False
    remove_phone_numbers: bool = False
    remove_numbers: bool = False
    remove_special_characters: bool = False
    remove_multiple_spaces: bool = True
    standardize_quotes: bool = True
    fix_broken_unicode: bool = True
    remove_empty_lines: bool = True


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return let(text, lambda t: F.when(ends(t).rlike(_ANY_SPACE), F.regexp_replace(t, rf"\A{SPACE}+|{SPACE}+\z", "")).otherwise(t))


def normal_unicode(text: str) -> str:
    """Stretches of UTF-8 that were read in another encoding, set right; then composed characters (NFC)."""
    return unicodedata.normalize("NFC", mojibake.repaired(text))


@F.arrow_udf(StringType())
def _normal_unicode(texts: pa.Array) -> pa.Array:
    return pa.array([None if (t := x.as_py()) is None else normal_unicode(t) for x in texts], pa.string())


def repair_unicode(text: Column) -> Column:
    """Wrongly decoded text, composed characters, line ends, curly quotes, ligatures and control characters; text in good order stays as it is.

    Only texts with characters that the first two steps could change are sent to Python."""
    beyond = F.regexp_replace(text, r"[\x00-\x7f]+", " ")  # what is asked for needs no ASCII, so the patterns see a small part of most texts
    odd = let(beyond, lambda b: b.rlike(mojibake.suspicious()) | b.rlike(NOT_PLAIN))
    text = F.coalesce(_normal_unicode(F.when(odd, text)), text)
    return let(text, lambda t: let(F.regexp_replace(t, r"[\x00-\x7f]+", ""), lambda b: _in_order(t, b)))


def _in_order(text: Column, beyond: Column) -> Column:
    """The other steps of repair_unicode; each runs only on texts that have its characters, most of which `beyond`, the text without ASCII, tells."""

    def step(out: Column, has: Column, change) -> Column:
        return let(out, lambda t: F.when(has, change(t)).otherwise(t))

    def ligatures(t: Column) -> Column:
        for one, many in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
            t = F.replace(t, F.lit(one), F.lit(many))
        return t

    out = step(text, text.contains("\r") | beyond.rlike(r"[\x85\x{2028}\x{2029}]"), lambda t: F.regexp_replace(t, r"\r\n?|[\x85\x{2028}\x{2029}]", "\n"))
    out = step(out, beyond.rlike("[‘’‚‛“”„‟]"), lambda t: F.translate(t, "‘’‚‛“”„‟", "''''\"\"\"\""))
    out = step(out, beyond.rlike("[ﬀ-ﬆ]"), ligatures)
    return step(out, text.rlike(r"[\x00-\x08\x0b\x0e-\x1f\x7f]") | beyond.contains("\ufeff"), lambda t: F.regexp_replace(t, r"[\x00-\x08\x0b\x0e-\x1f\x7f\x{FEFF}]", ""))


def _at(lines: Column, i: Column) -> Column:
    return F.get(lines, i)


def _first_equal(lines: Column, places: list[tuple[Column, Column]]) -> Column:
    found = F.lit(None).cast("string")
    for a, b in reversed(places):
        found = F.when(_at(lines, a) == _at(lines, b), _at(lines, a)).otherwise(found)
    return found


def repeated_line_abort(text: Column) -> Column:
    """True where texts of 3 or 4 lines have no repeated line half their length apart: cleaning then stops."""

    def test(lines: Column) -> Column:
        n = F.size(lines)
        h = F.floor(n / 2).cast("int")
        same = F.coalesce(_at(lines, F.lit(0)) == _at(lines, h), F.lit(False)) | F.coalesce(_at(lines, F.lit(1)) == _at(lines, h + 1), F.lit(False))
        return n.isin(3, 4) & ~same

    return let(F.split(text, "\n", -1), test)


def remove_headers_footers(text: Column) -> Column:
    """Drops lines equal to a repeated first or last line, page numbers and lines of digits; texts under 3 lines stay."""
    number = rf"\A{SPACE}*(Page {DIGIT}+( of {DIGIT}+)?|{DIGIT}+){SPACE}*\z"

    def kept(lines: Column) -> Column:
        n = F.size(lines)
        h = F.floor(n / 2).cast("int")
        header = _first_equal(lines, [(F.lit(i), h + i) for i in range(3)])
        footer = _first_equal(lines, [(n - 1 - i, F.when(n - 1 - i - h >= 0, n - 1 - i - h)) for i in range(3)])
        drop = F.struct(F.when(n >= 3, header).alias("header"), F.when(n >= 3, footer).alias("footer"), (n < 3).alias("few"))
        return let(drop, lambda d: F.filter(lines, lambda x: d["few"] | (~x.eqNullSafe(d["header"]) & ~x.eqNullSafe(d["footer"]) & ~x.rlike(number))))

    return F.array_join(let(F.split(text, "\n", -1), kept), "\n")


def fix_line_breaks(text: Column) -> Column:
    text = F.regexp_replace(text, rf"([.!?]){SPACE}*\n(?=[A-Z])", "$1\n\n")
    text = let(text, lambda t: F.when(t.contains("-\n"), F.regexp_replace(t, rf"({WORD})-\n({WORD})", "$1$2")).otherwise(t))
    return F.regexp_replace(text, r"\n(?<=[^.!?]\n)(?=[a-z])", " ")  # a pattern that begins with its line feed is tried at few places


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"(?:\x20(?={_ANY_SPACE})|{_ODD_SPACE}){_ANY_SPACE}*", " ")  # single spaces stay as they are


def normalise_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), rf"\n{SPACE}*\n{SPACE}*\n+", "\n\n")


def remove_empty_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, LINE_END, -1), lambda x: x.rlike(rf"[^{SPACES}]")), "\n")


def clean_text(text: Column, options: CleanOptions = CleanOptions()) -> Column:
    """All selected steps; null and empty texts stay. Where header search aborts, the text is returned as it was then, not stripped."""
    o = options

    def run(start: Column) -> Column:
        out = remove_headers_footers(start) if o.remove_headers_footers else start
        for on, pattern in ((o.remove_urls, URL), (o.remove_emails, EMAIL), (o.remove_phone_numbers, PHONE), (o.remove_numbers, f"{DIGIT}+"), (o.remove_special_characters, SPECIAL)):
            out = F.regexp_replace(out, pattern, "") if on else out
        for on, step in ((o.fix_line_breaks, fix_line_breaks), (o.remove_multiple_spaces, collapse_spaces), (o.normalize_whitespace, normalise_whitespace), (o.remove_empty_lines, remove_empty_lines)):
            out = step(out) if on else out
        out = strip(out)
        return F.when(repeated_line_abort(start), start).otherwise(out) if o.remove_headers_footers else out

    start = repair_unicode(text) if o.fix_unicode or o.fix_broken_unicode else text
    return let(start, run)  # an empty text comes out empty


def line_count(text: Column) -> Column:
    other = r"[\x0b\f\r\x1c\x1d\x1e\x85[\x{2028}\x{2029}]]"
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    ends = F.when(text.rlike(other), F.regexp_count(text, F.lit(LINE_END))).otherwise(feeds)
    last = F.substring(text, -1, 1).rlike(rf"\n|{other}").cast("int")
    return F.when(F.length(text) == 0, 0).otherwise(ends + 1 - last).cast("long")


def clean_stats(original: Column, cleaned: Column) -> dict[str, Column]:
    """The six figures; the percentage of an empty original is null.

    It is rounded as a binary number, as SQL's round does: Spark's with two places takes the shortest decimal form, which at ties may go the other way."""
    a, b = F.length(original).cast("long"), F.length(cleaned).cast("long")
    return {"original_length": a, "cleaned_length": b, "reduction_percentage": F.when(a > 0, F.round((1 - b / a) * 100 * 100) / 100), "removed_characters": a - b, "original_lines": line_count(original), "cleaned_lines": line_count(cleaned)}
