"""Chunking by length, sentence or structure: an Arrow pass over batches of texts, then one row per chunk.

By length, all texts of a batch advance together: their paragraph breaks and periods are found once, as sorted arrays over the
whole batch, and each round looks up the next end of every text that is not yet through. Sentences are packed by looking up
where their summed lengths pass the size. Offsets count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from textloom.functions.sentences import SentenceModel
from textloom.tables import given_back

#: How far around a chunk's end breaks are searched, and what a heading and the end of a sentence are.
PARAGRAPH_REACH, PERIOD_REACH = 50, 30
HEADING = re.compile(r"^#{1,6}\s+.+$", re.M)
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
#: Bytes of text that are taken at once; a longer text stands alone.
BATCH_BYTES = 1 << 19


def _leftmost(breaks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each window low <= place < high the first of the sorted breaks inside, or -1."""
    if not len(breaks):
        return np.full(len(low), -1)
    found = breaks[np.minimum(np.searchsorted(breaks, low), len(breaks) - 1)]
    return np.where((found >= low) & (found < high), found, -1)


def length_spans(texts: list[str], size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all chunks, sorted by text and start, white ones included; end is -1 where a chunk would not advance."""
    lengths = np.array([len(t) for t in texts], np.int64)
    # size + PARAGRAPH_REACH places behind each text keep the windows of one off the next
    base = np.cumsum(lengths + size + PARAGRAPH_REACH) - lengths - size - PARAGRAPH_REACH
    paragraphs, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t, b in zip(texts, base.tolist(), strict=True):
        points = np.frombuffer(t.encode("utf-32-le"), "<u4")
        feeds = points == 10
        paragraphs.append(np.flatnonzero(feeds[1:] & feeds[:-1]) + b)
        periods.append(np.flatnonzero(points == 46) + b)
    paragraphs, periods = np.concatenate(paragraphs), np.concatenate(periods)
    open_, start, rounds = np.flatnonzero(lengths > 0), np.zeros(int((lengths > 0).sum()), np.int64), []
    while len(open_):
        end = start + size
        at = base[open_] + end
        paragraph = _leftmost(paragraphs, at - PARAGRAPH_REACH, at + PARAGRAPH_REACH - 1)  # both line feeds inside
        period = _leftmost(periods, at - PERIOD_REACH, at + PERIOD_REACH)
        moved = np.where(paragraph >= 0, paragraph, np.where(period >= 0, period + 1, at)) - base[open_]
        end = np.where(end < lengths[open_], moved, end)
        rounds.append((open_, start, end))
        stuck = end - overlap <= start
        rounds.append((open_[stuck], start[stuck], np.full(int(stuck.sum()), -1)))
        on = ~stuck & (end - overlap < lengths[open_])
        open_, start = open_[on], (end - overlap)[on]
    row, start, end = (np.concatenate(x) if rounds else np.zeros(0, np.int64) for x in (zip(*rounds, strict=True) if rounds else ((), (), ())))
    order = np.argsort(row, kind="stable")
    return row[order], start[order], end[order]


def _by_length(texts: list[str], size: int, overlap: int, model: SentenceModel | None, exact: bool):
    for row, start, end in zip(*(x.tolist() for x in length_spans(texts, size, overlap)), strict=True):
        if end < 0:
            yield row, None, f"no progress at {start}: a break right behind it and an overlap of {overlap}"
        elif piece := texts[row][start:end].strip():
            yield row, (piece, start, end, None), None


def sentence_spans(text: str, model: SentenceModel | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence without white space around it."""
    ends = model.ends_in(text) if model else (m.span() for m in SENTENCE_END.finditer(text))
    out, begin = [], 0
    for a, b in (*ends, (len(text), len(text))):
        part = text[begin:a]
        if s := part.strip():
            start = begin + len(part) - len(part.lstrip())
            out.append((start, start + len(s)))
        begin = b
    return out


def packs(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(from, to) of the sentences of each chunk: as many as have at most `size` characters; the last two of a chunk, or the last of two or one, begin the next, which then takes another whatever its length."""
    before, n, out = [0, *accumulate(lengths)], len(lengths), []
    first, least = 0, 1
    while n:
        to = min(n, max(least, bisect_right(before, before[first] + size) - 1))
        out.append((first, to))
        if to == n:
            break
        first, least = (to - 2 if to - first > 2 else to - 1), to + 1
    return out


def _by_sentence(texts: list[str], size: int, overlap: int, model: SentenceModel | None, exact: bool):
    for row, text in enumerate(texts):
        spans, found = sentence_spans(text, model), {}
        parts = [text[a:b] for a, b in spans]

        def at(i: int, spans=spans, parts=parts, text=text, found=found) -> int:
            """A sentence's place, or where its text stands first."""
            return spans[i][0] if exact else found[parts[i]] if parts[i] in found else found.setdefault(parts[i], text.find(parts[i]))

        for a, b in packs([len(p) for p in parts], size):
            yield row, (" ".join(parts[a:b]), at(a), at(b - 1) + len(parts[b - 1]), None), None


def _by_structure(texts: list[str], size: int, overlap: int, model: SentenceModel | None, exact: bool):
    for row, text in enumerate(texts):
        if text.startswith("#"):
            heads = [(0, 0), *(m.span() for m in HEADING.finditer(text))]
            for (a, b), until in zip(heads, [*(x for x, _ in heads[1:]), len(text)], strict=True):
                if text[b:until].strip():
                    whole = f"{text[a:b]}\n{text[b:until]}".strip()
                    if exact:
                        first = a if a < b else len(text[:until]) - len(text[:until].lstrip())
                        level = re.match("#*", text[a:b])[0]
                        yield row, (whole, first, len(text[:until].rstrip()), len(level)), None
                    else:
                        at = text.find(whole)  # -1 for most, as a line feed has come between
                        yield row, (whole, at, at + len(whole), 0), None
        else:
            parts = text.split("\n\n")
            for x, behind in zip(parts, accumulate(len(x) + 2 for x in parts), strict=True) if exact else []:
                if piece := x.strip():
                    first = behind - 2 - len(x) + len(x) - len(x.lstrip())
                    yield row, (piece, first, first + len(piece), 0), None
            kept = [x for x in parts if x.strip()] if not exact else []
            for x, behind in zip(kept, accumulate(len(x) + 2 for x in kept), strict=True):
                yield row, (x.strip(), behind - len(x) - 2, behind - 2, 0), None


#: How each strategy is called in its chunks, and what yields (text's number, (chunk, start, end, level), error) for a list of texts.
STRATEGIES = {"Length-based": ("length_based", _by_length), "Semantic": ("semantic", _by_sentence), "Structure-based": ("structure_based", _by_structure)}
_MADE = [("chunk_ix", pa.int32()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strategy", pa.string()), ("level", pa.int32()), ("error", pa.string())]
MADE_NAMES = [n for n, _ in _MADE]


def _parts(texts: pa.Array):
    """Consecutive (from, to) of at most BATCH_BYTES of text, or one text."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BATCH_BYTES, "right")))
        yield a, b
        a = b


def chunked(texts: list[str | None], strategy: str, size: int, overlap: int, model: SentenceModel | None = None, exact: bool = False) -> tuple[list[int], list[tuple]]:
    """(number of the text, values of _MADE) of all chunks; numbered within each text. A text with an error has one row with nulls and the error instead."""
    name, spans = STRATEGIES[strategy]
    rows, made = [], []
    for row, span, error in spans([t or "" for t in texts], size, overlap, model, exact):
        if error:
            while rows and rows[-1] == row:
                rows.pop()
                made.pop()
            made.append((None, None, None, None, None, None, error))
        else:
            made.append((made[-1][0] + 1 if rows and rows[-1] == row else 0, *span[:3], name, span[3], None))
        rows.append(row)
    return rows, made


def chunk_batches(batches, strategy: str, size: int, overlap: int, model: SentenceModel | None = None, exact: bool = False):
    """Arrow batches whose first column is the text, to batches of chunks: the other columns, then those of _MADE."""
    for batch in batches:
        for a, b in _parts(batch.column(0)):
            part = batch.slice(a, b - a)
            rows, made = chunked(part.column(0).to_pylist(), strategy, size, overlap, model, exact)
            if made:
                columns = [pa.array(x, kind) for x, (_, kind) in zip(zip(*made, strict=True), _MADE, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in part.columns[1:]), *columns], names=[*batch.schema.names[1:], *(n for n, _ in _MADE)])


def chunk_schema(fields: list[StructField]) -> StructType:
    kinds = {pa.int32(): IntegerType(), pa.int64(): LongType(), pa.string(): StringType()}
    return StructType([*fields, *(StructField(n, kinds[k]) for n, k in _MADE)])


def checked(strategy: str, size: int, overlap: int) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    if strategy == "Length-based" and (size < PARAGRAPH_REACH or size - PARAGRAPH_REACH - overlap < 0):
        raise ValueError("size must be at least 50 and exceed the overlap by at least 50")


def chunk(df: DataFrame, strategy: str = "Length-based", size: int = 500, overlap: int = 10, text: str = "text", overlap_mode: str = "raw", errors: bool = False, model: SentenceModel | None = None, exact: bool = False) -> DataFrame:
    """One row per chunk: the other columns of df, chunk_ix, chunk text, start, end, strategy, level. overlap_mode 'percent' takes overlap as a share of size.

    Offsets of sentences are where their text stands first, those of paragraphs leave out blank ones, and sections under headings mostly have none and level 0. With `exact` all are
    true places in the text, and level is the number of a heading's signs.
    Sentences end after `.`, `!` or `?` and white space, or where a model from sentences.learn() says so.
    A text that cannot be chunked gives one row with nulls; with `errors` a column `error` says why. Null and empty texts give no
    rows. By length, sizes under 50 or steps that could not advance anywhere are refused. Columns of df with the names of new ones are left out.
    """
    overlap = int(size * overlap / 100) if overlap_mode == "percent" else overlap
    checked(strategy, size, overlap)
    others = [c for c in df.columns if c != text and c not in MADE_NAMES]
    kept = df.select(F.col(text).alias("__text"), *others)
    out = kept.mapInArrow(lambda it: given_back(chunk_batches(it, strategy, size, overlap, model, exact)), chunk_schema(kept.schema.fields[1:]))
    return out if errors else out.drop("error")
