"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are byte n-grams (ORDERS) of the text in ASCII lower case, other ASCII non-letters as spaces, hashed into BUCKETS rows of
an embedding table. A text is the mean of its subwords' embeddings. Training sees about `per_language` rows of each
language, as subword counts made on the executors; a fifth of them calibrates a temperature and the rejection score.
For prediction embedding and softmax are folded into one table of BUCKETS x languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import give_back, joinable, materialise, slices, string_parts, table, tidy

ORDERS, BUCKETS, DIM, BATCH_BYTES = (2, 3), 1 << 15, 16, 1 << 18
PER_LANGUAGE, REJECT_RATE, UNKNOWN, BROADCAST_ROWS = 600, 0.002, "und", 100_000
_MAP = np.full(256, 32, np.uint32)
_MAP[128:] = np.arange(128, 256)
for _a in range(26):
    _MAP[[65 + _a, 97 + _a]] = 97 + _a
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each byte."""
    x, out = _MAP[data], []
    for n in ORDERS:
        h = np.full(max(0, len(x) - n + 1), n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ x[k : k + len(h)]
        out.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int64))
    return out


def _counts(batches):
    for batch in batches:
        data, offsets = string_parts(batch.column(1))
        ids, counts = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            c = np.bincount(np.concatenate(subwords(data[a:b])), minlength=BUCKETS) if b > a else np.zeros(BUCKETS, int)
            some = np.flatnonzero(c).astype(np.int32)
            ids.append(some.tobytes())
            counts.append(c[some].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "ids", "counts"])


class Model:
    """langs, table float64[BUCKETS, langs] (embedding times softmax weights, over the temperature), bias, reject."""

    def __init__(self, rows: list, epochs: int = 12, rate: float = 4.0, seed: int = 5):
        rows = sorted((r for r in rows if len(r[1])), key=lambda r: (r[0], list(r[1][:8]), len(r[1])))
        self.langs = sorted({r[0] for r in rows})
        rng, n = np.random.default_rng(seed), len(rows)
        self.table, self.bias, self.reject = np.zeros((BUCKETS, max(1, len(self.langs)))), np.zeros(max(1, len(self.langs))), 0.0
        if not n:
            return
        y = np.array([self.langs.index(r[0]) for r in rows])
        ids = [np.asarray(r[1]) for r in rows]
        share = lambda i: np.asarray(rows[i][2], float) / np.sum(rows[i][2])
        order = rng.permutation(n)
        held, train = order[: n // 5], order[n // 5 :]
        E, W, b = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(self.langs))), np.zeros(len(self.langs))
        for epoch in range(epochs):
            rng.shuffle(train)
            step = rate * (1 - epoch / epochs)
            for k in range(0, len(train), 16):
                part = train[k : k + 16]
                which, w = np.concatenate([ids[i] for i in part]), np.concatenate([share(i) for i in part])
                at = np.cumsum([0, *(len(ids[i]) for i in part)])
                x = np.add.reduceat(E[which] * w[:, None], at[:-1])
                p = self._softmax(x @ W + b)
                p[np.arange(len(part)), y[part]] -= 1
                p /= len(part)
                back = p @ W.T
                W -= step * x.T @ p
                b -= step * p.sum(0)
                np.add.at(E, which, -step * 16 * w[:, None] * np.repeat(back, np.diff(at), 0))
        table = E @ W
        held = held if len(held) else train
        z = np.array([table[ids[i]].T @ share(i) + b for i in held])
        loss = lambda t: -np.log(self._softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
        t = min(np.geomspace(0.05, 20, 60), key=loss)
        self.table, self.bias = table / t, b / t
        self.reject = float(min(0.5, np.quantile(self._softmax(z / t).max(1), REJECT_RATE)))

    @staticmethod
    def _softmax(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: pa.StringArray) -> tuple[list[str], np.ndarray]:
        data, offsets = string_parts(texts)
        z, total = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]
        for n, grams in zip(ORDERS, subwords(data), strict=True):
            start, stop = offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - n + 1)
            some = stop > start
            total += np.where(some, stop - start, 0)
            if some.any():
                bounds = np.stack([start[some], np.minimum(stop[some], len(grams))], 1).ravel()
                for c in range(z.shape[1]):
                    scores = np.append(self.table[:, c][grams], 0.0)
                    z[some, c] += np.add.reduceat(scores, bounds)[::2]
        p = self._softmax(z / np.maximum(total, 1)[:, None] + self.bias)
        best, score = p.argmax(1), p.max(1)
        known = np.diff(letters) > 0
        for i in np.flatnonzero(~known):
            known[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
        known &= bool(self.langs)
        return [self.langs[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from labelled(doc_id, text, lang): about per_language rows of every language (the bound of the sample), by hash of doc_id.

    Rows without a language or text are left out; rows that repeat a doc_id are drawn together. Without rows the model knows no language.
    """
    seen = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    shares = seen.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(per_language) / F.count(F.lit(1))).alias("__share"))
    shares = materialise(shares, "lang-shares")
    drawn = seen.select("doc_id", "lang", "text").join(joinable(shares, shares.count(), BROADCAST_ROWS), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("__share") * (1 << 30)).select("lang", "text")
    rows = drawn.mapInArrow(_counts, "lang string, ids binary, counts binary").collect()
    model = Model([(r["lang"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in rows])
    del rows
    give_back()
    return model


def _identified(batches, model: Model, keep: list[str], place: int):
    """The columns `keep` of the batches and what the model says about the texts in the column `place`, some BATCH_BYTES at a time."""
    for batch in batches:
        texts = batch.column(place)
        for a, b in slices(np.diff(string_parts(texts)[1]), BATCH_BYTES):
            lang, score = model.predict(texts.slice(a, b - a))
            out = [pa.array(lang, pa.string()), pa.array(score), pa.array([x == UNKNOWN or s < model.reject for x, s in zip(lang, score, strict=True)])]
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + out, names=[*keep, "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs and lang_pred, score, rejected. Texts are read whole; null texts and texts without a letter are `und` with score 0, and rejected.

    Every row is judged by its own text, rows that repeat too; a null doc_id or other nulls in `keep` stay; an empty table gives no rows. Names in `keep` that clash raise ValueError.
    """
    if clash := set(keep) & {"lang_pred", "score", "rejected"}:
        raise ValueError(f"clashing names: {sorted(clash)}")
    narrow = docs.select(*keep) if "text" in keep else docs.select(*keep, docs["text"].alias("__text"))  # a text is sent once
    place = keep.index("text") if "text" in keep else len(keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(keep)]] + ["lang_pred string, score double, rejected boolean"])

    return narrow.mapInArrow(lambda it: tidy(_identified(it, sent.value, keep, place)), schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out() & F.col("doc_id").isNotNull()))
    return identify(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
