"""Ends of sentences, learned without labels: which words are abbreviations and which ones begin sentences.

A word is an abbreviation if it stands before a period far more often than chance has it, the more so the shorter it is and the more periods
are in it, and the less often it goes without one (a log-likelihood ratio with these factors, after Kiss and Strunk). A word
begins sentences if it stands after the other periods far more often than elsewhere. Words are counted where texts are read, so
patterns see each different word once; what is learned is a small model, which is sent to where texts are split.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.tables import materialise

#: Fixed values of the method: scores from which on a word is an abbreviation or begins sentences, and how sure a period follows an abbreviation.
ABBREVIATION, STARTER, SURE = 0.3, 30.0, 0.99
#: At most so many abbreviations and sentence starters, the best first, make a model.
MODEL_WORDS = 50_000
END = re.compile(r"[.!?][)\]}\"'»“”’]*(\s+)")
_AFTER = re.compile(r"\S{1,64}").match
#: Punctuation left off before and behind a word.
OPENING, CLOSING = r"^[(\[{\"'«„“‚‘]+", r"[)\]}\"'»“”’,;:!?]+$"
_OPENING, _CLOSING = re.compile(OPENING), re.compile(CLOSING)
#: White space between words is ASCII's.
_WORD = re.compile(r"\S+", re.A)
#: Different words that a task counts before it passes them on.
DIFFERENT = 200_000
_NUMBER = re.compile(r"[0-9][0-9.,]*")


@dataclass(frozen=True)
class SentenceModel:
    abbreviations: frozenset[str] = field(default_factory=frozenset)
    starters: frozenset[str] = field(default_factory=frozenset)

    def ends(self, word: str, after: str) -> bool:
        """Whether a sentence ends between `word`, which ends with `.`, `!` or `?`, and the word after it."""
        core = _CLOSING.sub("", _OPENING.sub("", word))
        following = _OPENING.sub("", after)
        if not core.endswith(".") or not following:
            return True
        name = core[:-1]
        if name.endswith(".") or not name:  # an ellipsis
            return not following[:1].islower()
        if following[:1].islower():  # no sentence begins in lower case after a short form or a number
            return not (self.short(name) or _NUMBER.fullmatch(name))
        if len(name) == 1 and name.isupper():  # an initial
            return False
        return not self.short(name) or typed(following) in self.starters

    def short(self, name: str) -> bool:
        return typed(name) in self.abbreviations or len(name) == 1 and name.isalpha() or re.fullmatch(r"(?:\w\.)+\w", name) is not None

    def ends_in(self, text: str):
        """(end of a sentence, start of what follows) in a text."""
        begin = 0
        for m in END.finditer(text):
            word = text[max(begin, m.start() - 64) : m.start(1)].split()
            if word and self.ends(word[-1], (_AFTER(text, m.end()) or [""])[0]):
                yield m.start(1), m.end()
                begin = m.end()

    def split(self, text: str) -> list[str]:
        """The sentences of a text, without white space around them."""
        out, begin = [], 0
        for a, b in (*self.ends_in(text), (len(text), len(text))):
            out.append(text[begin:a].strip())
            begin = b
        return [s for s in out if s]


def typed(word: str) -> str:
    """The form under which a word is counted."""
    word = _CLOSING.sub("", _OPENING.sub("", word)).lower()
    return "#" if _NUMBER.fullmatch(word) else word.removesuffix(".")


def _type(word: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.regexp_replace(word, OPENING, ""), CLOSING, ""))
    kind = lambda b: F.when(b.rlike(r"^[0-9][0-9.,]*\.$"), "#.").when(b.rlike(r"^[0-9][0-9.,]*$"), "#").otherwise(b)
    return F.get(F.transform(F.array(bare), kind), F.lit(0))  # the patterns of `bare` are matched once


def _pairs(batches):
    """(word, word before it if that holds a period, n) of all texts, counted until so many are different."""
    seen: Counter = Counter()

    def told():
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.string()), pa.array([b for _, b in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "before", "n"])

    for batch in batches:
        for t in batch.column(0):
            found = _WORD.findall(t.as_py())
            seen.update(zip(found, [None, *(w if "." in w else None for w in found[:-1])], strict=True) if found else ())
            if len(seen) > DIFFERENT:
                yield told()
                seen.clear()
    yield told()


def words(docs: DataFrame, text: str) -> DataFrame:
    """(type, dot, before, n): how often each word of the texts is there as it is counted, whether a period ends it, and the word before it if it holds a period; words without letters or digits are left out."""
    pairs = docs.select(F.col(text).alias("text")).filter("text IS NOT NULL").mapInArrow(_pairs, "word string, before string, n long")
    each = pairs.groupBy("word", "before").agg(F.sum("n").alias("n"))
    form = each.select(_type(F.col("word")).alias("form"), "before", "n").filter(F.col("form").rlike(r"[\p{L}\p{N}#]"))
    return form.select(F.regexp_replace("form", r"\.$", "").alias("type"), F.col("form").endswith(".").alias("dot"), "before", "n")


def abbreviation_scores(counted: DataFrame) -> DataFrame:
    """(type, n_dot, n_plain, score) of all types that end with a period somewhere; counted: words()."""
    types = counted.groupBy("type").agg(F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("n_dot"), F.sum(F.when(F.col("dot"), 0).otherwise(F.col("n"))).alias("n_plain"))
    types = materialise(types, "types")
    total = types.agg(F.sum("n_dot").alias("all_dot"), F.sum(F.col("n_dot") + F.col("n_plain")).alias("all"))  # one row
    periods = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - periods
    share = F.col("all_dot") / F.col("all")
    ratio = -2 * (F.col("n_dot") * F.log(share / SURE) + F.col("n_plain") * F.log(F.greatest(1 - share, F.lit(1e-12)) / (1 - SURE)))
    score = ratio * F.exp(-letters) * (periods + 1) * F.pow(F.greatest(letters, F.lit(1)).cast("double"), -F.col("n_plain").cast("double"))
    return types.filter("n_dot > 0").crossJoin(F.broadcast(total)).select("type", "n_dot", "n_plain", score.alias("score"))


def starter_scores(counted: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """(type, n_after, n, score) of types that stand after a period which ends no abbreviation; abbreviations: (type), at most MODEL_WORDS."""
    before = F.regexp_replace(_type(F.col("before")), r"\.$", "")
    marked = counted.filter("type <> '#'").withColumn("b", F.when(F.col("before").rlike(r"\.[)\]}\"'»“”’]*$"), before))
    marked = marked.join(F.broadcast(abbreviations.select(F.col("type").alias("b"), F.lit(True).alias("short"))), "b", "left")
    after = F.col("b").isNotNull() & F.col("short").isNull() & (F.length("b") > 1)
    types = materialise(marked.groupBy("type").agg(F.sum(F.when(after, F.col("n")).otherwise(0)).alias("n_after"), F.sum("n").alias("n")), "starters")
    total = types.agg(F.sum("n_after").alias("breaks"), F.sum("n").alias("all"))  # one row
    chance = lambda k, n, p: k * F.log(F.greatest(p, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))
    n, k, breaks, rest = F.col("n"), F.col("n_after"), F.col("breaks"), F.col("all") - F.col("breaks")
    p, p1, p2 = n / F.col("all"), k / breaks, (n - k) / F.greatest(rest, F.lit(1))
    score = -2 * (chance(k, breaks, p) + chance(n - k, rest, p) - chance(k, breaks, p1) - chance(n - k, rest, p2))
    return types.filter("n_after > 0").crossJoin(F.broadcast(total)).filter(p1 > p).select("type", "n_after", "n", score.alias("score"))


def learn(docs: DataFrame, text: str = "text") -> SentenceModel:
    """A model from all texts of docs. Null texts count for nothing; without texts no word is an abbreviation."""
    counted = materialise(words(docs, text), "words")
    best = lambda df, least: df.filter(F.col("score") >= least).orderBy(F.desc("score"), "type").limit(MODEL_WORDS)
    short = materialise(best(abbreviation_scores(counted), ABBREVIATION).select("type"), "abbreviations")
    starters = best(starter_scores(counted, short), STARTER).select("type").collect()  # MODEL_WORDS rows at most, as are the abbreviations
    return SentenceModel(frozenset(r["type"] for r in short.collect()), frozenset(r["type"] for r in starters))
