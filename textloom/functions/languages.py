"""Languages by learned profiles of character triples, for corpora with some labelled texts.

Triples of all labelled texts are counted by language where they are read and summed in one shuffle; the most frequent ones of each language make a
model of bounded size, with which any text is scored. Without labels `sources.files.detect_language` votes by stop words instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Triples of a language in a model, how much an unseen one counts, by how much the best language has to lead (in log-likelihood a triple), and characters handled at once.
TRIPLES, UNSEEN, LEAD, CHARACTERS = 4000, 0.5, 0.05, 1 << 20
UNKNOWN = "unknown"


def triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(packed triples of characters of all texts, how many each text has): lower case, other characters than letters as one space, and a space at both ends."""
    words = [" " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " " for t in texts]
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = np.array([len(w) for w in words])
    packed = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    ends = np.cumsum(sizes)
    keep = np.ones(len(packed), bool)
    for back in (1, 2):  # triples across two texts
        at = ends[:-1] - back
        keep[at[(at >= 0) & (at < len(packed))]] = False
    return packed[keep], np.maximum(sizes - 2, 0)


def _counted(batches):
    """(lang, triple, n) of rows (lang, text), summed over some texts at a time."""
    for batch in batches:
        held: dict[str, list[str]] = {}
        size = 0
        for lang, text in [*zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), (None, None)]:
            if text is not None:
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size > CHARACTERS or text is None:
                for k, some in held.items():
                    found, n = np.unique(triples(some)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))], names=["lang", "triple", "n"])
                held, size = {}, 0


@dataclass
class Profiles:
    """langs, and the log-probabilities of the known triples (sorted) by language; the last row is for all others."""

    langs: list[str]
    known: np.ndarray
    logs: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, lead over the second best a triple) of each text; `unknown` without letters, without a model or with too small a lead."""
        out, lead = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs or not texts:
            return out, lead
        packed, sizes = triples(texts)
        at = np.searchsorted(self.known, packed)
        at = np.where((at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == packed), at, len(self.known))
        some = np.flatnonzero(sizes > 0)
        if not len(some):
            return out, lead
        sums = np.add.reduceat(self.logs[at], (np.cumsum(sizes) - sizes)[some]) / sizes[some, None]
        order = np.sort(sums, axis=1)
        lead[some] = order[:, -1] - order[:, -2] if len(self.langs) > 1 else 1.0
        for i, k in zip(some.tolist(), sums.argmax(1).tolist(), strict=True):
            out[i] = self.langs[k] if lead[i] >= LEAD else UNKNOWN
        return out, lead

    def detect(self, text: Column) -> Column:
        """The language of a text column; null texts are unknown."""

        @F.arrow_udf(StringType())
        def run(texts: pa.Array) -> pa.Array:
            out: list[str] = []
            for a in range(0, len(texts), 256):
                out += self.score([t or "" for t in texts.slice(a, 256).to_pylist()])[0]
            return pa.array(out, pa.string())

        return run(text)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of the languages that docs' rows are labelled with; rows without a text or label count for nothing. The model holds TRIPLES rows a language."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, triple long, n long").groupBy("lang", "triple").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "triple"))
    best = counts.withColumn("place", place).filter(F.col("place") <= TRIPLES).select("lang", "triple", "n").collect()
    langs = sorted({r["lang"] for r in best})
    known = np.array(sorted({r["triple"] for r in best}), np.int64)
    n = np.full((len(known) + 1, len(langs)), UNSEEN)
    for r in best:
        n[np.searchsorted(known, r["triple"]), langs.index(r["lang"])] += r["n"]
    return Profiles(langs, known, np.log(n / n.sum(0)) if langs else n)
